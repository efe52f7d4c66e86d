"""Benchmark decontamination as a prefix-filtered set join on built-in functions.

A window is ``width`` consecutive words of an item (all words of a shorter item). A document that contains the
window contains its rarest word, so of the words ordered by rarity the prefix that must be joined is that one word:
documents are joined on it alone. Each such word of an item is a key, with the words around it in the item, ``width - 1``
on either side at most. Where a document has the word, its own neighbours are compared with those: words agree up to some
distance to the left and to the right, which the ends of both texts bound, and if that makes a window, the whole
stretch is hit. So overlapping windows of an item are verified at once, and a place costs one row a key.
Rarity is counted over all documents, for the benchmark's words only.

The benchmark's windows are counted first; its keys are broadcast while there are at most ``BROADCAST_WINDOWS`` windows.
Beyond, places of words join the keys by shuffle, without the texts, where Spark splits the partitions of hot words
(adaptive skew join); what they find then meets the texts by row, each distinct row once.

Defined cases: null and empty texts have no words and no hits; null item ids are left out of ``n_items``; repeated
rows get equal results; other columns aren't read; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import lower_ascii, row_key

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A word of a text in which A-Z are still there.
ANY_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BROADCAST_WINDOWS = 200_000


def split_words(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), GAP), lambda w: w != "")


def before(words: Column, at: Column, most: Column) -> Column:
    """The words left of a place, the nearest first."""
    n = F.least(at, most)
    return F.reverse(F.slice(words, at - n + 1, n))


def after(words: Column, at: Column, most: Column) -> Column:
    return F.slice(words, at + 2, most)


def agreeing(a: Column, b: Column) -> Column:
    """How many words two arrays have in common from the start."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))  # the longer one's rest meets null
    first = F.array_position(same, F.lit(False))
    return F.when(first > 0, first - 1).otherwise(F.size(same).cast("long"))


def keys(items: DataFrame, words: DataFrame, hint) -> tuple[DataFrame, DataFrame]:
    """The keys (id, word, left, right, length of a window) and their items (id, item_id).

    items: (item_id, w, length), words: (words) of the documents.
    """
    each = items.select("item_id", "w", "length", F.posexplode("w").alias("at", "word"))
    vocabulary = each.select("word").distinct()
    counts = words.select(F.explode("words").alias("word")).join(hint(vocabulary), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    # a window without one of its words in any document can't occur; of the others, the rarest word is the prefix
    rated = each.join(hint(counts), "word", "left")
    whole = rated.groupBy("item_id", "w", "length").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("n", F.lit(0)).alias("n"), "word"))).alias("r"))
    starts = F.sequence(F.lit(0), F.size("w") - F.col("length"))
    rarest = lambda s: F.array_min(F.transform(F.slice("r", s + 1, F.col("length")), lambda x: F.struct(x["n"].alias("n"), x["word"].alias("word"), x["at"].alias("at"))))
    prefix = whole.select("item_id", "w", "length", F.explode(F.array_distinct(F.transform(starts, rarest))).alias("p")).where("p.n > 0")
    most = F.col("length") - 1
    made = prefix.select("item_id", "length", F.col("p.word").alias("word"), before(F.col("w"), F.col("p.at"), most).alias("left"), after(F.col("w"), F.col("p.at"), most).alias("right"))
    made = made.withColumn("id", F.struct(F.xxhash64("word", F.size("left"), "left", "right"), F.xxhash64("right", F.size("left"), "left", "word")))
    return made.select("id", "word", "left", "right", "length").dropDuplicates(["id"]), made.select("id", "item_id").distinct()


def matches(docs: DataFrame, benchmark: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """row, start, length and id of the stretches of ``docs`` (row, words) that have a window, and (id, item_id)."""
    items = benchmark.select("item_id", split_words(F.col("text")).alias("w")).where(F.size("w") > 0).distinct()
    items = items.withColumn("length", F.least(F.lit(width), F.size("w")))
    few = (items.agg(F.sum(F.size("w"))).first()[0] or 0) <= BROADCAST_WINDOWS
    hint = F.broadcast if few else (lambda df: df)
    table, owners = keys(items, docs, hint)
    places = docs.where(F.size("words") > 0).select("row", *(["words"] if few else []), F.posexplode("words").alias("pos", "word"))
    met = places.join(hint(table), "word")
    if not few:
        met = met.alias("m").join(docs.dropDuplicates(["row"]).alias("d"), F.col("m.row") == F.col("d.row")).select("m.*", "d.words")
    most = F.col("length") - 1
    # the neighbours alone go on: rows that kept the whole text's words would be as long as it, one for each place
    beside = met.select("row", "id", "pos", "length", "left", "right", before(F.col("words"), F.col("pos"), most).alias("own_left"), after(F.col("words"), F.col("pos"), most).alias("own_right"))
    left, right = agreeing(F.col("own_left"), F.col("left")), agreeing(F.col("own_right"), F.col("right"))
    stretch = F.array(F.struct((F.col("pos") - left).alias("start"), (left + right + 1).alias("length")))
    # exploded, not filtered: a filter would move into the join and make it hold all rows of a text with its words at once
    hits = beside.select("row", "id", F.explode(F.filter(stretch, lambda m: m["length"] >= F.col("length"))).alias("m"))
    return hits.select("row", "id", "m.start", "m.length"), owners


def covered(spans: Column) -> Column:
    """Length of the union of (start, length) ranges sorted by start."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))

    def add(a: Column, s: Column) -> Column:
        end = F.greatest(a["end"], s["start"] + s["length"])
        return F.struct((a["n"] + F.greatest(F.lit(0), end - F.greatest(a["end"], s["start"]))).alias("n"), end.alias("end"))

    return F.aggregate(F.array_sort(spans), zero, add)["n"]


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, rows: bool = False) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of ``docs`` (doc_id, text).

    With ``rows``, also ``row`` (see ``row_key``).
    """
    words = docs.select(row_key().alias("row"), split_words(F.col("text")).alias("words"))
    hits, owners = matches(words, benchmark, width)
    # a document's stretches and items, each of the size of its own result
    spans = hits.groupBy("row", "id").agg(F.collect_set(F.struct("start", "length")).alias("spans"))
    named = spans.join(owners, "id", "left").groupBy("row").agg(F.flatten(F.collect_set("spans")).alias("spans"), F.collect_set(F.col("item_id").cast("string")).alias("items"))
    found = named.select("row", covered(F.array_distinct("spans")).alias("n_hit"), F.array_sort("items").alias("items"))
    n_words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(ANY_WORD)).cast("long")
    joined = docs.select("doc_id", row_key().alias("row"), n_words.alias("n_words")).join(found, "row", "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), *(["row"] if rows else []),
    )
