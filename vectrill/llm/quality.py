"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

No row leaves its partition and no user function runs: counts of words, characters, symbols, lines and repeated
windows are array expressions on the row's own text, and the verdict is a conjunction of comparisons made from
``RULES``. A rule can have an exception: the stop-word rule knows a few languages only, so sentence ends excuse a text
without its stop words; scripts that are written without blanks have no short words. Defined cases: a null or an empty text has no words,
fails the base and isn't kept; repeated rows get equal verdicts; an empty table has no rows; other columns aren't read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GAP = r"[\x20\x09-\x0D]+"
STOP = (
    "the of and to in a is that it for on was with as be by this are at from or an not have which "
    "de la le les et des en un une du que qui dans est pour pas sur par au plus se ce avec ne "
    "der die und das von mit zu den ist im nicht auf ein eine dem sich des es er als auch für "
    "el los las y por con una su para del al lo no como más pero sus o"
).split()


#: Ends of sentences, and letters of scripts without blanks (Thai, Lao, Khmer, kana, Han, Hangul).
ENDS = "[.!?\u2026\u3002\uff01\uff1f\u061f\u0964]"
UNSPACED = "[\u0e00-\u0eff\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]"


@dataclass(frozen=True)
class Rule:
    """The ratio ``top / bottom`` must lie in [least, most]; a row whose bottom is 0 passes, and so does one of which the
    ratio of the two measures in ``unless`` is at least the number there."""

    name: str
    top: str
    bottom: str
    least: float | None = None
    most: float | None = None
    unless: tuple[str, str, float] | None = None


#: Lenient on purpose: prose in any of the languages passes, tables of symbols and word salad don't.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 1.5, 20.0, ("n_unspaced", "word_chars", 0.3)),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 0.25),
    Rule("stop_word_share", "n_stop", "n_words", 0.01, None, ("n_ends", "n_words", 0.02)),
    Rule("duplicate_line_share", "n_dup_lines", "n_lines", None, 0.5),
    Rule("words_per_line", "n_words", "n_lines", 1.5, None),
)


def bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, as a lambda's variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column, width: int = 8) -> Column:
    """Words inside windows of ``width`` words that occur twice or more in the array, the first occurrence included.

    Only rows with an equal pair of windows pay for a sort; hashes of 64 bits stand for windows of one row.
    """

    def covered(hashes: Column) -> Column:
        order = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            twin = lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])
            return F.array_sort(F.transform(F.filter(s, lambda x, i: F.coalesce(twin(x, i), F.lit(False))), lambda x: x["i"]))

        def union(p: Column) -> Column:
            gap = F.transform(p, lambda x, i: F.least(F.lit(width), F.coalesce(F.get(p, i + 1) - x, F.lit(width))))
            return F.aggregate(gap, F.lit(0).cast("long"), lambda a, g: a + g)

        return bind(bind(order, starts), union)

    def repeats(hashes: Column) -> Column:
        plain = F.size(F.array_distinct(hashes)) == F.size(hashes)
        return F.when(plain, F.lit(0).cast("long")).otherwise(covered(hashes))

    n = F.size(words) - (width - 1)
    coded = F.transform(words, lambda w: F.xxhash64(w))
    window = lambda c: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*[F.get(c, i + k) for k in range(width)]))
    return F.when(n < 2, F.lit(0).cast("long")).otherwise(bind(bind(coded, window), repeats))


def measures(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select("doc_id", text.alias("text")).select("doc_id", "text", F.filter(F.split("text", GAP), lambda w: w != "").alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    distinct = bind(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d")))
    return split.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        distinct.alias("lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(*dict.fromkeys(STOP)))).cast("long").alias("n_stop"),
        F.regexp_count("text", F.lit(ENDS)).cast("long").alias("n_ends"),
        F.regexp_count("text", F.lit(UNSPACED)).cast("long").alias("n_unspaced"),
    ).select(
        "doc_id", "n_words", "word_chars", "n_symbols", (F.col("lines")["n"] - F.col("lines")["d"]).cast("long").alias("n_dup_lines"),
        "n_repeat_words", F.col("lines")["n"].cast("long").alias("n_lines"), "n_stop", "n_ends", "n_unspaced",
    )


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """One boolean expression from the threshold table."""
    ratio = lambda top, bottom: F.col(top) / F.nullif(F.col(bottom), F.lit(0))
    out = F.lit(True)
    for r in rules:
        within = F.lit(True)
        if r.least is not None:
            within = within & (ratio(r.top, r.bottom) >= r.least)
        if r.most is not None:
            within = within & (ratio(r.top, r.bottom) <= r.most)
        passes = F.coalesce(within, F.lit(True))
        if r.unless:
            passes = passes | F.coalesce(ratio(*r.unless[:2]) >= r.unless[2], F.lit(False))
        out = out & passes
    return out


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, min_words: int = 20, max_repeat_percent: int = 30) -> DataFrame:
    """Measures of each text of ``docs`` (doc_id, text), ``base_failed`` and ``kept``."""
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return measures(docs).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))
