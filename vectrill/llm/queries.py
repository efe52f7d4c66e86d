"""The queries ``opN_<name>`` over whole tables, with production parameters, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate as _decontaminate
from . import language as _language
from . import line_dedup as _line_dedup
from . import lm_scoring as _lm_scoring
from . import near_dedup as _near_dedup
from . import packing as _packing
from . import quality as _quality
from . import sharding as _sharding
from . import token_count as _token_count
from . import toxicity as _toxicity
from ._shared import held_out


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return _lm_scoring.lm_score(docs.withColumn("held_out", held_out(F.col("doc_id"), 7)))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _quality.quality(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_stop", "n_ends", "n_unspaced")


def op3_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _token_count.count_tokens(_read(spark, sf_dir, "documents"), "piece_bpe_32k.model")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _line_dedup.dedup_lines(_read(spark, sf_dir, "documents"), counts=True)
    return out.select("doc_id", "n_lines", "n_repeated", "n_near", "n_kept", F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = _toxicity.fit(docs.where(~held_out(F.col("doc_id"), 4)), _read(spark, sf_dir, "labels"))
    return _toxicity.score(docs, model).select(
        "doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("segments").alias("n_segments")
    )


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near_dedup.near_duplicates(_read(spark, sf_dir, "documents"), width=2, percent=80)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sharding.assign_shards(_read(spark, sf_dir, "documents"), shards=40)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decontaminate.decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), width=10)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packing.pack(_read(spark, sf_dir, "documents"), "byte_bpe_50k.json", width=1024, end_id=0)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = _language.fit(docs.where(~held_out(F.col("doc_id"), 4)), "piece_bpe_32k.model")
    return _language.identify(docs, model).select("doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), "lang_pred", "score", "n_words")


QUERIES = {f.__name__: f for f in (op1_lm_scoring, op2_quality_rules, op3_token_count, op4_line_dedup, op5_toxicity, op6_minhash_near_dedup, op7_sharding, op8_decontamination, op9_packing, op10_language_id)}

_WORD = r"[^\x20\x09-\x0D]+"
_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _rules() -> str:
    """The threshold table as SQL."""
    out = []
    for r in _quality.RULES:
        bounds = [f"{r.top} / nullif({r.bottom}, 0) {sign} {x}" for sign, x in ((">=", r.least), ("<=", r.most)) if x is not None]
        text = f"coalesce({' AND '.join(bounds)}, true)"
        out.append(f"({text} OR coalesce({r.unless[0]} / nullif({r.unless[1]}, 0) >= {r.unless[2]}, false))" if r.unless else text)
    return " AND ".join(out)


#: Each works on rows, not ids, so that repeated ids are no matter.
SQL: dict[str, str] = {
    "op2_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '{_WORD}') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM d),
x AS (SELECT rid, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM w),
win AS (SELECT rid, i, x || {" || ".join(f"' ' || lead(x, {k}) OVER o" for k in range(1, 8))} AS x FROM x WINDOW o AS (PARTITION BY rid ORDER BY i)),
twin AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, x) AS n FROM win WHERE x IS NOT NULL),
cover AS (SELECT rid, least(8, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 8)) AS n FROM twin WHERE n > 1),
rep AS (SELECT rid, sum(n)::BIGINT AS n_repeat_words FROM cover GROUP BY rid),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
 (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines,
 len(list_filter(w, lambda x: lower(x) IN ({", ".join(f"'{x}'" for x in dict.fromkeys(_quality.STOP))})))::BIGINT AS n_stop,
 len(regexp_extract_all(t, '{_quality.ENDS}'))::BIGINT AS n_ends, len(regexp_extract_all(t, '{_quality.UNSPACED}'))::BIGINT AS n_unspaced FROM w LEFT JOIN rep USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND {_rules()} AS kept FROM b""",
    "op4_line_dedup": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
l AS (SELECT rid, doc_id, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS line FROM (SELECT rid, doc_id, string_split(text, chr(10)) AS x FROM d WHERE text IS NOT NULL)),
solid AS (SELECT *, row_number() OVER (ORDER BY doc_id, i) AS place FROM l WHERE regexp_matches(line, '{_WORD}')),
u AS (SELECT line, min(place) AS first, length(line)::INTEGER AS n FROM solid GROUP BY line),
half AS (SELECT DISTINCT line, first, n, h, side, CASE side WHEN 0 THEN left(line, h) ELSE right(line, h) END AS k
 FROM (SELECT *, unnest([(n - 1) // 2, (n - 2) // 2]) AS h FROM u WHERE n >= 20) CROSS JOIN (SELECT unnest([0, 1]) AS side)),
pair AS (SELECT DISTINCT a.line AS a, b.line AS b, a.n AS an, b.n AS bn FROM half a JOIN half b ON a.h = b.h AND a.side = b.side AND a.k = b.k AND b.first < a.first AND abs(a.n - b.n) <= 1),
near AS (SELECT DISTINCT a AS line FROM (SELECT CASE WHEN an <= bn THEN a ELSE b END AS s, CASE WHEN an <= bn THEN b ELSE a END AS t, a FROM pair)
 WHERE len(list_filter(range(0, length(s) + 1), lambda i: left(s, i) = left(t, i) AND (right(s, length(s) - i) = right(t, length(s) - i) AND length(t) > length(s)
  OR right(s, length(s) - i - 1) = right(t, length(s) - i - 1) AND length(t) = length(s) AND i < length(s)))) > 0),
j AS (SELECT s.rid, s.i, s.place > u.first AS rep, s.place = u.first AND near.line IS NOT NULL AS near FROM solid s JOIN u ON s.line = u.line LEFT JOIN near ON near.line = s.line),
c AS (SELECT rid, count(*) AS n_lines, count_if(rep)::BIGINT AS n_repeated, count_if(near)::BIGINT AS n_near FROM j GROUP BY rid),
t AS (SELECT l.rid, string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE NOT coalesce(j.rep OR j.near, false)) AS text FROM l LEFT JOIN j ON l.rid = j.rid AND l.i = j.i GROUP BY l.rid)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_repeated, 0)::BIGINT AS n_repeated, coalesce(n_near, 0)::BIGINT AS n_near, (coalesce(n_lines, 0) - coalesce(n_repeated, 0) - coalesce(n_near, 0))::BIGINT AS n_kept,
 CASE WHEN d.text IS NOT NULL THEN md5(coalesce(t.text, '')) END AS text_md5 FROM d LEFT JOIN c USING (rid) LEFT JOIN t USING (rid)""",
    "op6_minhash_near_dedup": rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_FOLD}, '{_WORD}') AS w FROM documents),
s AS (SELECT DISTINCT rid, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS x FROM d),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
b AS (SELECT p.rid AS a, q.rid AS b, count(*) AS k FROM s p JOIN s q ON p.x = q.x AND p.rid < q.rid GROUP BY ALL),
link AS (SELECT a, b FROM b JOIN n p ON p.rid = a JOIN n q ON q.rid = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
two AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT a, b FROM two UNION SELECT r.a, x.b FROM reach r JOIN two x ON r.b = x.a),
least AS (SELECT a AS rid, min(e.doc_id) AS m FROM reach JOIN d e ON e.rid = reach.b GROUP BY a),
o AS (SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(least(d.doc_id, m), d.doc_id) AS component_id FROM d LEFT JOIN n USING (rid) LEFT JOIN least USING (rid))
SELECT *, doc_id IS NOT DISTINCT FROM component_id AS kept FROM o""",
    "op8_decontamination": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS x FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS p FROM i WHERE len(w) > 0)),
place AS (SELECT rid, n, p, array_to_string(w[p:p + n - 1], ' ') AS x FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT rid, item_id, p, n FROM place JOIN win USING (n, x)),
word AS (SELECT rid, count(*) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(p, p + n)) FROM hit) GROUP BY rid),
item AS (SELECT rid, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS xs FROM (SELECT DISTINCT rid, item_id::VARCHAR AS x FROM hit WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(xs, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN word USING (rid) LEFT JOIN item USING (rid)""",
}
