"""Operators 2, 7 and 8 against brute force."""
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest

from vectrill.llm import decontaminate, quality, sharding

WORDS, ALNUM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows(df):
    return [r.asDict() for r in df.collect()]


def measured(text):
    text = text or ""
    w = WORDS.findall(text)
    wins = defaultdict(list)
    for i in range(len(w) - 7):
        wins[tuple(w[i : i + 8])].append(i)
    hit = {i + k for p in wins.values() if len(p) > 1 for i in p for k in range(8)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


@pytest.fixture(scope="module", params=["odd", "sf", "none"])
def docs(request, spark):
    return spark.read.parquet(request.getfixturevalue("sf") + "/documents.parquet") if request.param == "sf" else request.getfixturevalue(request.param)


def test_quality(docs):
    want = sorted((str(r.doc_id), *measured(r.text)) for r in docs.collect())
    got = rows(quality.quality(docs))
    assert sorted((str(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])


def test_rules_reject_symbols_and_keep_prose(spark):
    prose = " ".join(["the house of the river and a stone in that field is old"] + [f"w{i}" for i in range(30)])
    table = " | ".join(f"cell{i}" for i in range(60))
    got = {r["doc_id"]: r["kept"] for r in rows(quality.quality(spark.createDataFrame([(1, prose), (2, table)], "doc_id long, text string")))}
    assert got == {1: True, 2: False}


def test_sharding(docs):
    got = rows(sharding.assign_shards(docs))
    src = docs.collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((r.doc_id, 16 + len((r.text or "").encode()), zlib.crc32((r.text or "").encode())) for r in src)
    slots, at, load = defaultdict(list), defaultdict(set), Counter()
    for r in got:
        slots[r["shard"]].append(r["slot"])
        at[r["text_crc32"], r["size"]].add(r["shard"])
        load[r["shard"]] += r["size"]
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 40
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for k, s in at.items() if k != (0, 16))  # null and empty texts are two groups
    if len(got) > 100:
        groups = Counter()
        for r in src:
            groups[r.text] += 16 + len((r.text or "").encode())
        assert max(load.values()) <= max(max(groups.values()), sum(load.values()) / 40 * 1.34)  # the bound of the schedule


def test_lpt_takes_the_largest_first():
    assert sharding.lpt([(3, "a"), (3, "b"), (2, "c"), (2, "d"), (2, "e")], 2) == {"a": 0, "b": 1, "c": 0, "d": 1, "e": 0}


def contamination(docs, items, width):
    fold = lambda t: ALNUM.findall((t or "").translate(FOLD))
    wins = defaultdict(set)
    for i, t in items:
        w = fold(t)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            wins[tuple(w[k : k + width])].add(i)
    out = []
    for d, t in docs:
        w, hit, ids = fold(t), set(), set()
        for n in {len(k) for k in wins}:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in wins:
                    hit |= set(range(i, i + n))
                    ids |= wins[k]
        ids = sorted(str(i) for i in ids if i is not None)
        out.append((str(d), len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def test_decontaminate_odd(spark, odd, none):
    items = [(1, "Beta GAMMA delta epsilon zeta eta theta iota kappa lambda mu alpha"), (2, "one"), (3, None), (4, "--"), (5, "text here same"), (6, "one"), (70, "a b c 12 34"), (None, "nbsp"), (8, "très long mot très")]
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as key", "2 as words", "3 as window")
    got = decontaminate.decontaminate(odd, bench)
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == contamination([(r.doc_id, r.text) for r in odd.collect()], items, 10)
    assert decontaminate.decontaminate(none, bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.decontaminate(odd, bench.limit(0)).collect())


def test_decontaminate_shuffled(spark, sf, monkeypatch):
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    want = contamination([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()], 10)
    assert any(r[-1] for r in want)
    assert sorted((str(r[0]), *r[1:]) for r in decontaminate.decontaminate(docs, bench).collect()) == want
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 10)
    assert sorted((str(r[0]), *r[1:]) for r in decontaminate.decontaminate(docs, bench).collect()) == want
