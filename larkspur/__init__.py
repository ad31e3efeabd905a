"""A read-only SQL engine on Spark for a compact, SQLite-flavoured SELECT dialect."""
