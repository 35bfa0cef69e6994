"""Line-first quality rules, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import let

# Fixed values.
SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
SEPARATORS = "[|»›•·]"
DOUBLED_MARKS = "[#*$%&<>=_~^!?]{2,}"
SENTENCE_MARKS = "[.!?;:…。！？]"
BOILERPLATE = "|".join([
    "accept (all )?cookies", "all rights reserved", "click here", "cookie policy", "enable javascript", "forgot (your )?password",
    "log in to", "lorem ipsum", "privacy policy", "sign in to", "sign up for", "skip to (main )?content", "subscribe to our", "terms of (service|use)",
    "this site uses cookies", "we use cookies",
])
BOILERPLATE_WORDS = 30  #: longer lines are prose that mentions such a phrase
NAVIGATION_SEPARATORS, NAVIGATION_WORDS = 2, 4  #: separators at least; words (separators too) for each part at most
UNMARKED_WORDS = 8  #: a line of this length without any sentence mark is not prose
LOST_PERCENT = 50
WINDOW = 8
MIN_WORDS, REPEAT_PERCENT = 20, 30


def judged(line: Column) -> Column:
    """struct(line, worded, fails): the punctuation, navigation and boilerplate rules for one line, its words counted
    once; a line without words passes. The cheap tests stand first."""
    bare = F.btrim(line, F.lit(BLANKS))

    def rules(words: Column) -> Column:
        parts = F.regexp_count(line, F.lit(SEPARATORS))
        unmarked = (words >= UNMARKED_WORDS) & ~line.rlike(SENTENCE_MARKS)
        navigation = (parts >= NAVIGATION_SEPARATORS) & (words <= NAVIGATION_WORDS * (parts + 1))
        boilerplate = (words <= BOILERPLATE_WORDS) & F.lower(line).rlike(BOILERPLATE)
        noisy = (words > 0) & (2 * F.regexp_count(line, F.lit(DOUBLED_MARKS)) >= words)
        return F.struct(line.alias("line"), (words > 0).alias("worded"), (unmarked | navigation | boilerplate | noisy).alias("fails"))

    return let(F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, SPACE))), rules)


def _window_hashes(words: Column) -> Column:
    """A hash of every run of WINDOW words, a power of two: hashes of runs are joined in pairs, so that each step costs
    one call a word."""

    def twice(width: int):
        return lambda h: F.zip_with(h, F.slice(h, width + 1, F.size(h)), lambda a, b: F.xxhash64(a, b))

    hashes, width = F.transform(words, lambda w: F.xxhash64(w)), 1
    while width < WINDOW:
        hashes, width = let(hashes, twice(width)), 2 * width
    return F.slice(hashes, F.lit(1), F.size(words) - (WINDOW - 1))


def _repeated_words(words: Column) -> Column:
    """Words that lie in a WINDOW-word window found twice or more in the text. The windows' hashes are sorted with their
    places only if one occurs twice; the words covered follow from the gaps between the sorted places."""

    def places(s: Column) -> Column:
        twice = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: (F.get(s, k)["h"] == F.get(s, k - 1)["h"]) | (F.get(s, k)["h"] == F.get(s, k + 1)["h"]))
        return F.sort_array(F.transform(twice, lambda k: F.get(s, k)["i"]))

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda at, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - at, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)

    def count(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(let(ordered, places), covered))

    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(let(_window_hashes(words), count))


def quality_rules(docs: DataFrame) -> DataFrame:
    """Adds to docs(doc_id, text, ...): n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    n_lines_failed, lost_chars, clean_text, kept. Each row is judged alone, so copies, ties and repeated rows are alike.

    Lines that break a rule are dropped; a document is rejected when base_failed, or when the dropped lines hold more
    than LOST_PERCENT of its word characters. clean_text holds the lines left, equal to text if none failed. A null or
    wordless text has zero counts and fails the base rule; its clean_text is the text. A very long text is judged whole
    inside its row. An empty table gives an empty result. Extra columns stay as they are; columns of the names above are
    replaced.
    """
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("given"))
    text = F.coalesce(F.col("given.text"), F.lit(""))
    row = row.withColumn("_words", F.filter(F.split(text, SPACE), lambda w: w != "")).withColumn("_lines", F.transform(F.split(text, "\n"), judged))
    row = row.withColumn("_failed", F.filter("_lines", lambda x: x["fails"])["line"]).withColumn("_worded", F.filter("_lines", lambda x: x["worded"])["line"])
    long = lambda c: c.cast("long")
    found = {
        "n_words": long(F.size("_words")),
        "word_chars": long(F.length(F.array_join("_words", ""))),
        "n_symbols": long(F.regexp_count(text, F.lit(SYMBOLS))),
        "n_dup_lines": long(F.size("_worded") - F.size(F.array_distinct("_worded"))),
        "n_repeat_words": long(_repeated_words(F.col("_words"))),
        "n_lines_failed": long(F.size("_failed")),
        "lost_chars": long(F.length(F.regexp_replace(F.array_join("_failed", ""), SPACE, ""))),
        "clean_text": F.when(F.size("_failed") == 0, F.col("given.text")).otherwise(F.array_join(F.filter("_lines", lambda x: ~x["fails"])["line"], "\n")),
    }
    # One generated row: a filter on what follows then uses these values instead of computing them again.
    others = [F.col(f"given.`{c}`").alias(c) for c in docs.columns if c not in (*found, "base_failed", "kept")]
    row = row.select(*others, F.inline(F.array(F.struct(*(c.alias(n) for n, c in found.items())))))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    row = row.withColumn("base_failed", failed)
    return row.withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= LOST_PERCENT * F.col("word_chars")))
