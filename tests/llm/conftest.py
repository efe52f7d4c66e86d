import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and blank texts, ties, repeated rows, a long text and clashing extra columns."""
    rows = [
        (1, f"{LONG} {LONG}\n{LONG}", "en", "a", 5), (2, None, None, None, None), (3, "", "en", "a", 0), (4, " \n\t ", "en", "a", 3),
        (5, "One", "en", "a", 3), (5, "One", "en", "a", 3), (6, "Same text here\nSame text here\n#tag $5", "en", "b", 1),
        (7, "Same text here\nSame text here\n#tag $5", "fr", "b", 1), (None, f"x {LONG.upper()} y", "en", "a", 1), (None, None, "en", None, None),
        (8, "ÉCOLE é ß " + "très long mot " * 3000, "fr", "c", 1), (9, "a-b_c 12|34 %&<>", "de", "c", 2),
        (10, " nbsp em\x0bvt\x0cff\x1cfs", "es", "d", 2), (11, "!!! ... ???", "en", "d", 2),
    ]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, DOCS)
    extra = {c: F.lit(1) for c in ("key", "words", "size", "shard", "block", "n", "h", "value", "item", "cell")}
    return df.withColumns(extra)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
