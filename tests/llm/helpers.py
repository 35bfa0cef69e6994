from __future__ import annotations

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 997}x{i % 89}" for i in range(60_000)) + "."
PROSE = "The quick brown fox jumps over the lazy dog near the river bank today. It was a bright cold day in April, and the clocks were striking thirteen. Nobody came."


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty and very long texts, repeated rows and ties."""
    return [
        (1, PROSE, "en", "a", len(PROSE)), (1, PROSE, "en", "a", len(PROSE)), (2, PROSE, "de", "b", len(PROSE)), (3, None, "en", "a", None), (4, "", "en", None, 0), (5, "   \n\t ", None, "b", 6),
        (None, PROSE + " More.", None, None, None), (6, LONG, "en", "a", len(LONG)), (7, "word", "fr", "c", 4), (8, "\U0001f600 \x1c ퟿ ß", "de", "c", 7), (9, "12345 67890 !!!", "es", "d", 15),
    ]


def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(spark):
    """Columns with the names that operators add."""
    return odd(spark).withColumns({c: F.lit("x") for c in ("score", "kept", "n_words", "shard", "slot", "items", "row", "rep", "component", "print", "part", "label", "lang_pred", "total", "spans")})
