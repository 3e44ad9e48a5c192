"""Line-first quality rules, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneloom.llm.common import id_text, let, words_of

WORD = "[^\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"

# Separators of link lists, and phrases of page furniture.
SEPARATORS = "[|»›•·]"
PHRASES = (
    "all rights reserved|cookie policy|privacy policy|terms of use|terms of service|enable javascript|"
    "lorem ipsum|sign in|log in|subscribe now|click here|skip to content|licensed under|public license"
)


def line_counts(line: Column) -> Column:
    """What the rules read of a line: words, symbols, separators."""
    return F.struct(
        F.regexp_count(line, F.lit(WORD)).alias("words"),
        F.regexp_count(line, F.lit(SYMBOLS)).alias("symbols"),
        F.regexp_count(line, F.lit(SEPARATORS)).alias("bars"),
        (~line.rlike("[.!?:;,…。！？]")).alias("bare"),
        F.lower(line).rlike(PHRASES).alias("phrase"),
    )


def line_fails(c: Column, symbols_per_word: float, boilerplate_words: int, bare_words: int) -> Column:
    punctuation = (c["symbols"] > c["words"] * symbols_per_word) | (c["bare"] & (c["words"] >= bare_words))
    navigation = (c["bars"] >= 2) & (c["bars"] * 4 >= c["words"])
    boilerplate = c["phrase"] & (c["words"] <= boilerplate_words)
    return punctuation | navigation | boilerplate


def repeated_words(words: Column) -> Column:
    """Words inside a 3-word window that the text holds twice or more.

    Windows are hashed (64 bits). Most texts repeat none, which one distinct
    count shows; only the others sort their (window, place) pairs.
    """

    def covered(places: Column) -> Column:
        steps = F.zip_with(places, F.slice(places, 2, F.size(places)), lambda a, b: F.least(F.lit(3), F.coalesce(b, a + 3) - a))
        return F.aggregate(steps, F.lit(0), lambda acc, x: acc + x)

    def repeated(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            again = F.filter(
                s,
                lambda x, j: (F.get(s, j + 1)["h"] == x["h"]) | ((j > 0) & (F.get(s, F.greatest(j - 1, F.lit(0)))["h"] == x["h"])),
            )
            return F.sort_array(F.transform(again, lambda x: x["i"]))

        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(let(pairs, places), covered)).otherwise(F.lit(0))

    def windows(w: Column) -> Column:
        n = F.size(w) - 2
        zipped = F.arrays_zip(F.slice(w, 1, n).alias("a"), F.slice(w, 2, n).alias("b"), F.slice(w, 3, n).alias("c"))
        return F.transform(zipped, lambda z: F.xxhash64(z["a"], z["b"], z["c"]))

    return let(words, lambda w: F.when(F.size(w) >= 3, let(windows(w), repeated)).otherwise(F.lit(0)))


def quality(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    symbols_per_word: float = 0.1,
    boilerplate_words: int = 30,
    bare_words: int = 3,
    max_loss: float = 0.3,
) -> DataFrame:
    """Cleans texts line by line, then rejects texts that lost too much.

    A line fails the punctuation rule if it has more symbols than
    ``symbols_per_word`` allows, or ``bare_words`` words and no punctuation;
    the navigation rule if separators divide it into short items; the
    boilerplate rule if it is short and holds a fixed phrase. ``cleaned`` is
    the text without failing lines. A document is rejected if the words of
    failing lines are more than ``max_loss`` of its words, or by the base
    rules: fewer than 50 words, or over half of them in repeated windows.

    One row comes out per row, with its id. Null and empty texts have no words
    and fail the base rules; blank lines neither fail nor count; repeated rows
    are judged alike; an empty table gives none; other columns are not read.
    All rules are row-wise: nothing is shuffled.
    """
    base = id_text(docs, id_col, text_col)
    lines = F.split("text", "\n", -1)
    tagged = F.transform(
        lines,
        lambda line: let(
            line_counts(line),
            lambda c: F.struct(line.alias("line"), c["words"].alias("words"), line_fails(c, symbols_per_word, boilerplate_words, bare_words).alias("fails")),
        ),
    )
    first = base.select("doc_id", "text", words_of(F.col("text")).alias("words"), tagged.alias("lines"))

    def tally(ls: Column) -> Column:
        worded = F.transform(F.filter(ls, lambda x: x["words"] > 0), lambda x: x["line"])
        lost = F.aggregate(ls, F.lit(0), lambda acc, x: acc + F.when(x["fails"], x["words"]).otherwise(0))
        return F.struct(
            let(worded, lambda w: F.size(w) - F.size(F.array_distinct(w))).alias("dup"),
            lost.alias("lost"),
            F.size(F.filter(ls, lambda x: x["fails"])).alias("failed"),
            F.array_join(F.transform(F.filter(ls, lambda x: ~x["fails"]), lambda x: x["line"]), "\n").alias("cleaned"),
        )

    counted = first.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
        let(F.col("lines"), tally).alias("t"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        F.col("t.dup").cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (F.col("t.lost") <= F.col("n_words") * max_loss)).alias("kept"),
        F.col("t.failed").cast("long").alias("n_failed_lines"),
        F.col("t.lost").cast("long").alias("n_lost_words"),
        F.col("t.cleaned").alias("cleaned"),
    )
