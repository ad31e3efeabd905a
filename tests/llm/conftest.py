import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """Rows as a DataFrame with a column that clashes with the operators' own names."""

    def make(rows, schema, extra=("score", "rank", "key", "node", "label", "n", "host", "path", "__h", "__source", "mix_block", "predicted")):
        have = {c.split()[0] for c in schema.split(", ")}
        more = [c for c in extra if c not in have]
        return spark.createDataFrame([(*r, *["clash"] * len(more)) for r in rows], ", ".join([schema, *[f"{c} string" for c in more]]))

    return make
