"""Documents to packed training sequences, in five stages; each works on what the one before kept.

``STAGES`` are (name, function) pairs. A function takes (spark, docs, sf_dir) and returns a DataFrame: all but the last
the columns of ``documents``, the last the pieces of packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vectrill.llm import decontaminate, language, line_dedup, near_dedup, packing
from vectrill.llm._shared import Cut, once, without

#: Line dedup, near-dedup and packing are not SQL; the stages are tested one by one against brute force.
ORACLE_SQL = None


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without a language that scores half or more, go.

    Null and empty texts have no letter and go. Repeated rows go or stay together; ties between languages halve the
    score at least, which is still kept. The model learns from the documents at hand that name a language; if none does,
    all go. An empty table stays empty.
    """
    return language.keep_identified(docs, language.fit(docs, "piece_bpe_32k.model"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated and nearly repeated lines go, and with them documents of which no word is left.

    Of equal lines the one of the smallest doc_id, then line, stays; a null doc_id comes last. Rows repeated with id and
    text are one document here, so all of them keep their lines. Null and empty texts go. An empty table stays empty.
    """
    return line_dedup.dedup_lines(docs).where(r"text RLIKE '[^\\x20\\x09-\\x0D]'")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, Jaccard 0.8) the row of the smallest id stays.

    Rows that share an id are told apart by their texts. Of a row that is repeated with id and text, one stays. Null ids
    come last; null, empty and blank texts have no near-duplicates and stay. An empty table stays empty.
    """
    kept = without(docs, near_dedup.duplicates(docs, width=5, percent=80))
    return once(kept)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of ten words, or all words, of a benchmark item go.

    Rows are told apart by id and text; null ids and texts are compared like any other, null texts have no passage.
    Repeated rows go or stay together. An empty table, or an empty benchmark, changes nothing.
    """
    found = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), width=10, rows=True)
    return without(docs, found.where("contaminated").select("row"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 1024 tokens: null and empty texts are the end token alone, repeated rows are packed once
    each, an empty table has no pieces."""
    return packing.pack(docs, "byte_bpe_50k.json", width=1024, end_id=0)


STAGES = [("language ID", identify), ("line dedup", lines), ("near-dedup", near), ("decontamination", clean), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written as Parquet and read again, and removed once it has been."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        cut = Cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before:
            before.drop()
        docs, before = cut.df, cut
    return STAGES[-1][1](spark, docs, sf_dir)
