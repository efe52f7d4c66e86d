"""Operator 5: segments against brute force, and held-out labels."""
import math
import random
import re
import time

import numpy as np
from pyspark.sql import functions as F

from vectrill.llm import toxicity
from vectrill.llm._shared import held_out


def segments(s, lo=0, hi=None):
    """Maximal scoring segments by their definition: the best one (shortest of equals), then left and right of it."""
    hi = len(s) if hi is None else hi
    best = max(((sum(s[i:j]), i - j, -i, i, j) for i in range(lo, hi) for j in range(i + 1, hi + 1)), default=(0,))
    if best[0] <= 0:
        return []
    *_, i, j = best
    return [*segments(s, lo, i), (i, j, best[0]), *segments(s, j, hi)]


def test_maximal_segments():
    rng = random.Random(2)
    for _ in range(300):
        s = [rng.choice([-3.0, -1.0, -0.5, 0.25, 2.0, 1.0625, 4.0]) + k / 1024 for k in range(rng.randrange(0, 14))]
        got, want = toxicity.maximal_segments(np.array(s)), segments(s)
        assert [x[:2] for x in got] == [x[:2] for x in want] and np.allclose([x[2] for x in got], [x[2] for x in want])


def test_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs.where(~held_out(F.col("doc_id"), 4)), labels)
    rows = toxicity.score(docs, model).where(held_out(F.col("doc_id"), 4)).join(labels, "doc_id").select("score", "toxic").collect()
    hit = sum(r.toxic == 1 and r.score >= 0.3 for r in rows)
    said, true = sum(r.score >= 0.3 for r in rows), sum(r.toxic == 1 for r in rows)
    print("toxicity held out: precision", hit / said, "recall", hit / true, "of", true)
    assert hit / said >= 0.8 and hit / true >= 0.8


def test_odd(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (5, 0), (6, 0), (7, None), (None, 1), (9, 1)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels)
    got = toxicity.score(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(none, model).count() == 0
    for teach in (labels.limit(0), labels.where("toxic = 1"), labels.where("toxic = 0")):
        assert {round(r.score, 6) for r in toxicity.score(odd, toxicity.fit(odd, teach)).collect()} == {1.0 if teach.where("toxic = 1").count() else 0.0}
    assert toxicity.score(odd, toxicity.fit(none, labels)).count() == len(got)


def test_falling_segments_take_linear_time():
    """Rare hits in a long clean text: each segment's left sum is below those of all before it."""
    def seconds(hits):
        s = np.tile([1.0, -0.5, -0.5, -0.5], hits)
        began = time.process_time()
        assert len(toxicity.maximal_segments(s)) == hits
        return time.process_time() - began

    assert seconds(16_000) < 1 and seconds(64_000) < 20 * max(seconds(8_000), 0.01)


def test_scores_and_spans_by_hand(spark):
    """Token by token from the lexicon, segments by their definition, spans as bytes of the text."""
    rng = random.Random(4)
    bad, good = ["vile", "rotten", "scumble"], [f"w{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice(good) for _ in range(rng.randrange(20, 60))]
        if i % 4 == 0:
            at = rng.randrange(len(words))
            words[at:at] = [rng.choice(bad) + rng.choice(["", "ly"]) for _ in range(6)]
        rows.append((i, rng.choice([" ", ", ", "é "]).join(words)))
        labels.append((i, int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    table = dict(zip(model.keys.tolist(), model.odds.tolist(), strict=True))
    key = lambda word: int(toxicity.features(word)[0][0])
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert sum((got[i].score >= 0.3) == (i % 4 == 0) for i in range(400)) >= 390
    for i, text in rows[:60]:
        data, scores, places = text.encode(), [], []
        for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", data):
            odds = [table.get(int(h)) for h in toxicity.features(m[0])[0]]
            plus = [o for o in odds if o is not None and o > 0]
            word = table.get(key(m[0]))
            scores.append(max(plus) if plus else word if word is not None else -toxicity.DRIFT)
            places.append(m.span())
        n, want = len(scores), []
        for s, e, x in segments(scores):
            p = 1 - math.exp(-model.k * n * math.exp(-model.rate * x))
            if p <= toxicity.ALPHA:
                want.append((places[s][0], places[e - 1][1], x))
        assert [(s.start, s.end) for s in got[i].segments] == [w[:2] for w in want] and np.allclose([s.score for s in got[i].segments], [w[2] for w in want])
        evidence = math.log1p(sum(max(0, model.rate * x - math.log(model.k * n)) for *_, x in want))
        assert abs(got[i].score - 1 / (1 + math.exp(-model.weights[0] - model.weights[1] * evidence))) < 1e-9
