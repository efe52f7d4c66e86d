"""The registered queries themselves: against DuckDB where there is SQL, else against what their contracts fix."""
import glob
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from vectrill.llm import queries

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.fixture(scope="module")
def source(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def rows(spark, name):
    return queries.QUERIES[name](spark, DATA).collect()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, duck, name):
    df, want = queries.QUERIES[name](spark, DATA), duck.sql(queries.SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    got, rows_ = ({tuple(map(str, r)) for r in x} for x in (df.select(*columns).collect(), want.select(*columns).fetchall()))
    assert got == rows_ and len(got) == 1000


def held(d, of):
    return zlib.crc32(str(d).encode()) % of == 2


def test_op1(spark, source):
    got = rows(spark, "op1_lm_scoring")
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    seqs = {d: [*words(r.text), None] for d, r in source.items()}
    counts = Counter(w for d, s in seqs.items() if not held(d, 7) for w in s)
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(source)
    for r in got:
        s = seqs[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id, 7), len(s), sum(counts[w] > 0 for w in s), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in s)) and r.score < 0
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)


def test_op5_and_op10(spark, source):
    for r in rows(spark, "op5_toxicity"):
        assert r.held_out == held(r.doc_id, 4) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    got = rows(spark, "op10_language_id")
    langs = {r.lang for r in source.values()}
    assert len(got) == len(source) and all(r.held_out == held(r.doc_id, 4) and 0 <= r.score <= 1 and r.lang_pred in langs | {"und"} for r in got)
    right = [source[r.doc_id].lang == r.lang_pred for r in got if r.held_out and r.lang_pred != "und"]
    assert sum(right) >= 0.97 * len(right)


def test_op3_op7_op9(spark, source):
    assert all(r.n_tokens <= len((source[r.doc_id].text or "").encode()) + 1 for r in rows(spark, "op3_token_count"))
    slots = defaultdict(list)
    for r in rows(spark, "op7_sharding"):
        text = (source[r.doc_id].text or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text) + 16, zlib.crc32(text), "bytes", None)
        slots[r.shard].append(r.slot)
    assert set(slots) <= set(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    pieces, used = defaultdict(list), Counter()
    for r in rows(spark, "op9_packing"):
        pieces[r.doc_id, r.doc_tokens].append((r.start, r.length))
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 1024 and {d for d, _ in pieces} == set(source)
    for (_, total), p in pieces.items():
        assert sum(n for _, n in p) == total and all(a + n == b for (a, n), (b, _) in zip(sorted(p), sorted(p)[1:], strict=False))


def test_prose_of_other_languages_is_kept(spark):
    from vectrill.llm import quality

    hungarian = "Egy szép napon a kis fiú elindult az erdőbe. Ott talált egy öreg kunyhót, amelyben senki sem lakott. Bement és leült. " * 1
    hungarian += "Aztán elaludt, mert nagyon fáradt volt. Reggel madarak énekére ébredt, és továbbment."
    japanese = "。\n".join("昔々あるところに おじいさんと おばあさんが 住んで いました " + x for x in ("山へ 行く", "川へ 行く", "家へ 帰る", "桃を 切る", "鬼を 退治", "宝を 得る"))
    table = "\n".join(f"{i} | {i * 7} | # | {i % 3}" for i in range(30))
    rows_ = [(1, hungarian), (2, japanese), (3, table), (4, "zxq vbn " * 20)]
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality.quality(spark.createDataFrame(rows_, "doc_id long, text string")).collect()}
    assert got[1] == (False, True) and got[2] == (False, True) and not got[3][1] and not got[4][1]
