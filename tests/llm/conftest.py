import pytest

#: Columns whose names the operators use themselves.
CLASHES = ["digest", "key", "fp", "row", "file", "found", "raw", "n", "ids", "shard", "component", "TEXT_"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

LONG = "the quick brown fox jumps over the lazy dog while seven wizards hex a pyjama party near the old stone bridge "


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and blank texts, repeated rows, ids used twice, a very long text."""
    rows = [(i, f"{LONG} number {i} of {i * 7} things {'abc' * (i % 5)}", "en", "s", 1) for i in range(40)]
    rows += [(100, "same text here", "en", "s", 1), (101, "same text here", None, "s", None), (99, "same text here", "fr", None, 1)]
    rows += [(200, None, "en", "s", 1), (201, "", "en", "s", 0), (202, None, None, None, None), (203, " \n\t", "en", "s", 3)]
    rows += [(300, "repeated row", "en", "s", 1)] * 3 + [(301, "one id", "en", "s", 1), (301, "two texts", "en", "s", 1)]
    rows += [(None, "no id", "en", "s", 1), (None, "same text here", "en", "s", 1), (None, "alone without id", "en", "s", 1), (None, "alone without id", "en", "s", 1)]
    rows += [(400, LONG * 9000, "en", "s", 1), (401, "x" * 300_000, "en", "s", 1), (402, " " * 50_000 + "é" * 5, "fr", "s", 1)]
    rows += [(403, "\u2028 naïve \U0001f600 \x00 ÀÉ İ ſ 漢字 it's WE'LL 12½ ___ \r\n\r\n  end", "xx", "s", 1)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    from pyspark.sql import functions as F

    return spark.createDataFrame(odd_rows, SCHEMA).withColumns({c: F.lit(c) for c in CLASHES}).repartition(5)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
