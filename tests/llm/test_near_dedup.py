"""Operator 6 against all pairs."""
import random
import re

import pytest

from vectrill.llm import near_dedup
from vectrill.llm.components import components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def wanted(rows, width=2):
    sets = []
    for d, t in rows:
        w = WORDS.findall((t or "").translate(FOLD))
        k = min(width, len(w))
        sets.append((d, frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if k else frozenset()))
    up = list(range(len(sets)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                up[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(sets):
        r = find(i)
        low[r] = min((x for x in (low.get(r), d) if x is not None), default=None)
    return sorted(((str(d), len(s), str(c := low[find(i)] if s else d), d == c) for i, (d, s) in enumerate(sets)))


def got(df, width=2):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in near_dedup.near_duplicates(df, width).collect())


def test_odd(odd, none):
    assert got(odd) == wanted([(r.doc_id, r.text) for r in odd.collect()])
    assert got(none) == []


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert got(docs) == wanted([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("width", [2, 5])
def test_chains_near_the_threshold(spark, width):
    """Copies with edits, chains of them, and documents that share most of a passage but aren't near."""
    rng = random.Random(7)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 400}"
    rows, texts = [], [[word() for _ in range(n)] for n in (3, 6, 12, 30, 80, 200, 400) for _ in range(6)]
    passage = [word() for _ in range(60)]
    texts += [passage + [word() for _ in range(n)] for n in (5, 10, 20, 20, 20, 40, 100)]
    for t in texts:
        for _ in range(5):
            t = list(t)
            for _ in range(rng.randrange(0, 1 + len(t) // (10 * width))):
                t[rng.randrange(len(t))] = word()
            rows.append((len(rows), " ".join(t)))
    assert got(spark.createDataFrame(rows, "doc_id long, text string"), width) == wanted(rows, width)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 60), (60, 80), (7, 7), (300, 200)]
    label = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert label == {i: 1 for i in range(1, 41)} | {60: 60, 80: 60, 100: 60, 200: 200, 300: 200}


def test_clusters_whose_members_link_though_centres_do_not(spark):
    """Two families whose first members are apart, linked only by their outer members; with and without sampling."""
    rng = random.Random(11)
    for size in (100, 2500):
        base = [f"v{rng.randrange(10**6)}" for _ in range(size)]
        rows = []
        for i in range(12):  # a chain: each differs from the one before in 2 % of its words
            base = list(base)
            for _ in range(size // 50):
                base[rng.randrange(size)] = f"u{rng.randrange(10**6)}"
            rows += [(len(rows), " ".join(base))]
            for _ in range(3):
                t = list(base)
                t[rng.randrange(size)] = f"x{rng.randrange(10**6)}"
                rows.append((len(rows), " ".join(t)))
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "doc_id long, text string")
        sketch = None if size == 100 else near_dedup.SKETCH
        assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in near_dedup.near_duplicates(df, sketch=sketch).collect()) == wanted(rows)


def test_duplicates_by_row(spark, odd):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(5, text), (5, text + " more"), (5, "other words"), (None, text), (6, ""), (7, None), (8, "other words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    gone = near_dedup.duplicates(df)
    from vectrill.llm._shared import without

    left = [(r.doc_id, r.text) for r in without(df, gone).collect()]
    assert len(left) == 4 and {(6, ""), (7, None), (5, "other words")} < set(left) and [d for d, t in left if t and t.startswith("w0")] == [5]
    assert without(odd, near_dedup.duplicates(odd)).columns == odd.columns


def test_hot_keys_are_dealt_and_nothing_else_changes(spark, monkeypatch):
    from pyspark.sql import functions as F

    from vectrill.llm import _shared

    rows = spark.range(3000).select(F.when(F.col("id") < 2000, 7).otherwise(F.col("id") % 50).alias("k"), "id", F.array("id").alias("more"))
    table = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).where("k != 3")
    want = sorted(map(tuple, rows.join(table.drop("n"), "k").select("k", "id", "first").collect()))
    for least in (10_000, 100):
        monkeypatch.setattr(_shared, "LEAST", least)
        counted = _shared.Counted(table, "test")
        got = _shared.meet(rows, counted, "k")
        assert got.columns == ["k", "id", "more", "first"] and sorted(map(tuple, got.select("k", "id", "first").collect())) == want
        assert _shared.meet(rows, counted, "k", "left_semi").count() == len(want)


def test_members_of_a_large_cluster_are_not_compared_with_all_around_it(spark, monkeypatch):
    """Near copies of one text, and around them texts with a few more edits that link with none or few of them."""
    rng = random.Random(3)
    base = [f"v{rng.randrange(10**6)}" for _ in range(100)]
    rows = []
    for i in range(400):
        t = list(base)
        for _ in range(rng.randrange(0, 5) if i < 300 else rng.randrange(5, 10)):
            t[rng.randrange(len(t))] = f"u{rng.randrange(10**6)}" if rng.random() < 0.7 else f"c{rng.randrange(60)}"
        rows.append((i, " ".join(t)))
    rng.shuffle(rows)
    pairs, compared = [], near_dedup._Corpus.compared

    def counted(self, df):
        pairs.append(df.select("a", "b").distinct().count())
        return compared(self, df)

    monkeypatch.setattr(near_dedup._Corpus, "compared", counted)
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == wanted(rows)
    assert sum(pairs) < 10 * len(rows), pairs
