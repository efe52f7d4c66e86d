"""Operator 1 against counters."""
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from vectrill.llm import lm_scoring

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
END, START = object(), object()


class Model:
    """The automaton, state by state. rows: (doc_id, text, held_out)."""

    def __init__(self, rows):
        self.c = [Counter(), Counter(), Counter()]
        for s, (_, _, held) in zip(map(tokens, rows), rows, strict=True):
            if not held:
                self.c[0].update(s)
                self.c[1].update(zip([START, *s], s, strict=False))
                self.c[2].update(zip([START, *s], s, s[1:], strict=False))
        uni, bi, tri = self.c
        self.n, self.v = sum(uni.values()), len(uni)
        n1, n2 = (sum(x == k for x in uni.values()) for k in (1, 2))
        self.d = min(max(n1 / (n1 + 2 * n2), 0.05), 0.95) if n1 + n2 else 0.5
        self.k2, self.k3 = self.strength(uni, bi), self.strength(bi, tri)

    @staticmethod
    def strength(contexts, seen):
        n1, lo, hi = sum(x == 1 for x in seen.values()), -3.0, 6.0
        bins = defaultdict(list)
        for c in contexts.values():
            bins[c if c < lm_scoring.EXACT else lm_scoring.EXACT + c.bit_length()].append(c)
        means = [(len(b), sum(b) / len(b)) for b in bins.values()]
        for _ in range(60):
            mid = (lo + hi) / 2
            k = 10**mid
            if sum(n * c * k / (c + k) for n, c in means) < n1:
                lo = mid
            else:
                hi = mid
        return 10**hi

    def context(self, state):
        return self.c[0][END] if state == (START,) else self.c[len(state) - 1][state if len(state) > 1 else state[0]]

    def arc(self, state, w):
        """Probability of the arc, or None."""
        uni, bi, tri = self.c
        if not state:
            return (uni[w] - self.d) / self.n if uni[w] else self.d * self.v / self.n if self.n else 1.0
        k, seen = (self.k2, bi[state[0], w]) if len(state) == 1 else (self.k3, tri[(*state, w)])
        return (seen + k * self.p(state[1:], w)) / (self.context(state) + k) if seen else None

    def p(self, state, w):
        weight = 1.0
        while (arc := self.arc(state, w)) is None:
            k = self.k2 if len(state) == 1 else self.k3
            weight *= k / (self.context(state) + k)
            state = state[1:]
        return weight * arc

    def score(self, s):
        total, state = 0.0, (START,)
        for w in s:
            total += math.log10(self.p(state, w))
            state = (state[-1], w) if state else (w,)
        return total


def tokens(row):
    return [*WORDS.findall((row[1] or "").translate(FOLD)), END]


def wanted(rows):
    m = Model(rows)
    out = []
    for s, (d, _, held) in zip(map(tokens, rows), rows, strict=True):
        base = sum(math.log10((m.c[0][w] + 1) / (m.n + m.v + 1)) for w in s)
        out.append((str(d), held, len(s), sum(m.c[0][w] > 0 for w in s), m.n, base, m.score(s)))
    return sorted(out)


def check(df, rows, **kw):
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in lm_scoring.lm_score(df, **kw).collect())
    want = wanted(rows)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5:] == pytest.approx(w[5:], rel=1e-6, abs=1e-6)


def test_documents_and_small_blocks(spark, sf):
    rows = [(r.doc_id, r.text, zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")
    check(df, rows, block_bytes=100_000, share_keys=20_000)


def test_odd(odd, none):
    from pyspark.sql import functions as F

    held = F.coalesce(F.col("doc_id") % 3 == 0, F.lit(False))
    check(odd.withColumn("held_out", held), [(r.doc_id, r.text, r.h) for r in odd.withColumn("h", held).collect()])
    check(odd.withColumn("held_out", F.lit(True)), [(r.doc_id, r.text, True) for r in odd.collect()])
    assert lm_scoring.lm_score(none.withColumn("held_out", held)).count() == 0


def test_probabilities_sum_to_one():
    m = Model([(i, t, False) for i, t in enumerate(["a b a c", "b a", "", "a a a b"])])
    for state in ((), (START,), ("a",), ("b",), ("unseen",), (START, "a"), ("a", "b"), ("a", "unseen")):
        assert math.fsum(m.p(state, w) for w in [*m.c[0], "other"]) == pytest.approx(1)


def test_binned_counts_of_counts_change_little():
    rng = np.random.default_rng(1)
    counts = rng.zipf(1.3, 100_000)
    counts = counts[counts < 1e7]
    exact, coarse = lm_scoring.Stats(), lm_scoring.Stats()
    for s, b in ((exact, counts), (coarse, lm_scoring.bins(counts))):
        for x, n, t in zip(*(np.unique(b)[None], np.unique(b, return_counts=True)[1][None], np.bincount(np.unique(b, return_inverse=True)[1], counts)[None]), strict=True):
            s.number |= {(1, int(i)): int(j) for i, j in zip(x, n, strict=True)}
            s.total |= {(1, int(i)): int(j) for i, j in zip(x, t, strict=True)}
        s.number[2, 1] = 30_000
    assert coarse.strength(2) == pytest.approx(exact.strength(2), rel=0.01)


def test_packing_of_keys():
    rng = np.random.default_rng(2)
    for n in (0, 1, 1000):
        keys = np.unique(rng.integers(1 << 40, 1 << 41, n).astype(np.uint64))
        assert (lm_scoring.unpacked_keys(lm_scoring.packed_keys(keys, 1 << 40), 1 << 40) == keys).all()
