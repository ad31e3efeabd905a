"""Tables: Parquet files, DataFrames, SQLite files."""
