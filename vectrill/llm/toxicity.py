"""Toxic passages as maximum-scoring segments of token log-odds.

Learning. Features of a token are its word and its first 3 to 8 bytes, in lower case (A-Z). Labelled training
documents, at most about ``sample`` of them by a hash of the id, give for each feature the numbers of distinct contexts
(the tokens before and after) in toxic and in clean documents. Contexts, not occurrences, are counted because copies
of one document would make all its words look toxic. Log-odds under a Dirichlet prior, and the signed root of the
likelihood ratio as their significance, make the lexicon: features that are toxic beyond chance (at least ``Z`` and
``LEAST_ODDS``), and words that are clean beyond chance. A token scores the largest log-odds of its toxic features, else the
negative ones of its clean word, else ``-DRIFT``. Bounds of the sample are parameters of ``fit``: ``sample`` documents, the
``candidates`` features of largest significance whose contexts are looked at, and the ``lexicon`` best of these.

Scoring. One linear scan finds every maximal scoring segment. Under Karlin and Altschul, the best segment of n
background tokens with score S has the extreme-value tail ``1 - exp(-K n exp(-L S))``, where L solves ``E[exp(L s)] = 1`` over
the tokens of clean documents and K is fitted to the number of their segments; a segment is significant if that is at
most ``ALPHA``. The summed normalised scores of a text's significant segments become a probability by logistic regression.
L, K and the regression see only scores from the lexicon of the other half of the sample, so that no document is judged by
what it has taught; the final lexicon is that of both halves.

Defined cases: null and empty texts have no segment and get the probability of such texts; repeated rows get equal
scores; a document with several labels is toxic if one says so; rows without a label don't teach; with no
toxic or no clean document to learn from, all scores are the share of toxic ones, and 0 without labels; an empty
table has no rows; other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import arrow_schema, batch, few_rows, mapped
from ._shared import Cut
from ._words import MARKS, chunks, mix, prefix, span, words

SAMPLE, CANDIDATES, LEXICON, PREFIXES = 40_000, 50_000, 20_000, range(3, 9)
Z, LEAST_ODDS, PRIOR, DRIFT, ALPHA = 4.5, 3.0, 0.5, 0.15, 0.05
HIT = "doc_id long, n long, score double, segments array<struct<start: long, end: long, score: double, p_value: double>>"


def features(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, token number) of every feature of every token, first the words themselves, and the tokens' starts and ends."""
    data = data.lower()
    raw = np.frombuffer(data, np.uint8)
    h, start, end = words(data, False, MARKS)
    hs, ts = [mix(h ^ np.uint64(0xA5A5))], [np.arange(len(h))]
    for at in range(0, len(h), 1 << 16):  # tokens lie close together: prefix sums of a bounded stretch
        s, e = start[at : at + (1 << 16)], end[at : at + (1 << 16)]
        lo = int(s[0])
        sums = prefix(raw[lo : int(min(e[-1], s[-1] + PREFIXES[-1]))])
        for k in PREFIXES:
            t = np.flatnonzero(e - s >= k)
            hs.append(mix(span(sums, s[t] - lo, s[t] - lo + k) ^ np.uint64(k)))
            ts.append(t + at)
    return np.concatenate(hs), np.concatenate(ts), start, end


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments [start, end) in one pass over the positive scores (Ruzzo and Tompa).

    Each segment keeps the place of the last one before it with a smaller sum on its left; the search for a partner
    follows these places, and so the pass is linear.
    """
    total = np.concatenate([[0.0], np.cumsum(scores)])
    out: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum after, place
    for i in np.flatnonzero(scores > 0).tolist():
        start, before, after, j = i, total[i], total[i + 1], len(out) - 1
        while True:
            while j >= 0 and out[j][2] >= before:
                j = out[j][4]
            if j < 0 or out[j][3] >= after:
                out.append((start, i + 1, before, after, j))
                break
            start, before, place = out[j][0], out[j][2], out[j][4]
            del out[j:]
            j = place
    return [(s, e, float(b - a)) for s, e, a, b, _ in out]


@dataclass
class Model:
    keys: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    odds: np.ndarray = field(default_factory=lambda: np.empty(0))
    rate: float = 1.0  # L
    k: float = 0.1  # K
    weights: tuple[float, float] = (-30.0, 0.0)

    def token_scores(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores, starts and ends of the tokens."""
        h, t, start, end = features(data)
        best, clean = np.full(len(start), -np.inf), np.full(len(start), -DRIFT)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            hit = np.flatnonzero(self.keys[at] == h)
            odds = self.odds[at[hit]]
            np.maximum.at(best, t[hit][odds > 0], odds[odds > 0])
            clean[t[hit][odds < 0]] = odds[odds < 0]  # clean features are words
        return np.where(best > 0, best, clean), start, end

    def p_value(self, score: float, n: int) -> float:
        return -math.expm1(-self.k * max(n, 1) * math.exp(-self.rate * score))

    def significant(self, scores: np.ndarray) -> list[tuple[int, int, float, float]]:
        n = len(scores)
        return [(s, e, x, p) for s, e, x in maximal_segments(scores) if (p := self.p_value(x, n)) <= ALPHA]

    def evidence(self, segments: list[float], n: int) -> float:
        """Of the scores of significant segments."""
        return math.log1p(sum(max(0.0, self.rate * x - math.log(self.k * max(n, 1))) for x in segments))

    def probability(self, evidence: float) -> float:
        z = self.weights[0] + self.weights[1] * evidence
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _background_rate(scores: np.ndarray, counts: np.ndarray) -> float:
    """L > 0 with E[exp(L s)] = 1 over background tokens; one unseen toxic token is added, so that the tail is never empty."""
    s = np.append(scores, max(5.0, scores.max(initial=0.0)))
    p = np.append(counts, 1) / (counts.sum() + 1)
    f = lambda x: float((p * np.exp(x * s)).sum()) - 1
    lo, hi = 1e-6, 1.0
    while f(hi) < 0 and hi < 64:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return hi


def _background_k(segments: np.ndarray, tokens: int, rate: float) -> float:
    """K such that K n exp(-L S) segments of n background tokens reach S, the median of their scores."""
    if not len(segments):
        return 0.1
    s = float(np.median(segments))
    return float(np.clip((segments >= s).sum() / max(tokens, 1) * math.exp(min(rate * s, 50.0)), 1e-3, 1.0))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by Newton steps, with a weak penalty so that separable classes stay finite."""
    a = np.stack([np.ones_like(x), x], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hess = (a * (p * (1 - p))[:, None]).T @ a + np.eye(2) * 0.1
        w += np.clip(np.linalg.solve(hess, a.T @ (y - p) - 0.1 * w), -5, 5)
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, candidates: int = CANDIDATES, lexicon: int = LEXICON) -> Model:
    """Learn from ``docs`` (doc_id, text) that have a label (doc_id, toxic). The bounds are described above."""
    few_rows(docs.sparkSession)
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    keep = known.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) * n < sample * 1_000_000) if n > sample else known
    # keep has about ``sample`` rows at most, so it can be broadcast; what it meets is written once and read three times
    half = F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(2)).cast("int").alias("half")
    taught = Cut(docs.select("doc_id", "text").join(F.broadcast(keep), "doc_id").select("text", (F.col("toxic") == 1).cast("int").alias("toxic"), half), "taught").df
    kinds = [f"{k}{f}" for f in (0, 1) for k in ("clean", "toxic")]  # of both halves
    counted = "feature long, " + ", ".join(f"{k} long" for k in kinds)
    seen = arrow_schema(counted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents by feature; feature 0 has all tokens."""
        for b in batches:
            got: dict[int, list[np.ndarray]] = {}
            tokens = [0] * 4
            for text, toxic, f in zip(*(c.to_pylist() for c in b.columns), strict=True):
                h, _, start, _ = features((text or "").encode())
                got.setdefault(2 * f + toxic, []).append(np.unique(h))
                tokens[2 * f + toxic] += len(start)
            for kind, found in got.items():
                h, c = np.unique(np.concatenate([np.zeros(1, np.uint64), *found]), return_counts=True)
                c[h == 0] = tokens[kind]
                yield batch([h.view(np.int64), *(c * (kind == i) for i in range(4))], seen)

    def summed(df: DataFrame) -> DataFrame:
        return df.groupBy("feature").agg(*[F.sum(k).alias(k) for k in kinds])

    counts = summed(mapped(taught, count, counted))
    sizes = counts.where("feature = 0").first()
    sizes = [sizes[k] for k in kinds] if sizes else [0] * 4
    if not sizes[0] + sizes[2] or not sizes[1] + sizes[3]:
        shown = taught.agg(F.avg(F.col("toxic").cast("double")).alias("p")).first()["p"] or 0.0
        return Model(weights=(30.0 if shown == 1 else -30.0, 0.0))

    def judged(folds: tuple[int, ...]):
        """Log-odds and signed significance of a feature in these halves."""
        m, k = (sum((F.col(f"{x}{f}") for f in folds), F.lit(0)) for x in ("clean", "toxic"))
        n0, n1 = (max(sum(sizes[2 * f + y] for f in folds), 1) for y in (0, 1))
        share = n1 / (n0 + n1)
        part = lambda x, p: F.when(x > 0, x * F.log(x / ((k + m) * p))).otherwise(0.0)
        z = F.sqrt(2 * F.greatest(part(k, share) + part(m, 1 - share), F.lit(0.0))) * F.signum(k - (k + m) * share)
        return F.log((k + PRIOR) / n1) - F.log((m + PRIOR) / n0), z

    _, z = judged((0, 1))
    likely = counts.where("feature != 0").select("feature", z.alias("z")).where("abs(z) >= 3")
    wanted = np.sort(np.array([r["feature"] for r in likely.orderBy(F.desc(F.abs("z")), "feature").limit(candidates).collect()], np.int64).view(np.uint64))
    placed = "feature long, context long, kind int, word boolean"
    placed_shape = arrow_schema(placed)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, toxic, f in zip(*(c.to_pylist() for c in b.columns), strict=True):
                h, t, start, _ = features((text or "").encode())
                word = h[: len(start)]  # the first features are the words themselves
                if not len(wanted) or not len(word):
                    continue
                hit = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)] == h)
                around = np.concatenate([[np.uint64(1)], word, [np.uint64(2)]])
                near = mix(around[t[hit]] ^ mix(around[t[hit] + 2]))
                both = np.unique(np.stack([h[hit], near, (hit < len(word)).astype(np.uint64)]), axis=1)
                yield batch([both[0].view(np.int64), both[1].view(np.int64), np.full(both.shape[1], 2 * f + toxic), both[2].astype(bool)], placed_shape)

    apart = mapped(taught, contexts, placed).distinct()
    kept = apart.groupBy("feature", "word").agg(*[F.sum((F.col("kind") == i).cast("long")).alias(k) for i, k in enumerate(kinds)])
    rated = kept.select("feature", "word", *[x.alias(f"{n}{i}") for i, folds in enumerate(((0,), (1,), (0, 1))) for n, x in zip("oz", judged(folds), strict=True)])
    good = lambda i: ((F.col(f"z{i}") >= Z) & (F.col(f"o{i}") >= LEAST_ODDS)) | (F.col("word") & (F.col(f"z{i}") <= -Z) & (F.col(f"o{i}") < 0))
    most = F.greatest(*[F.abs(f"z{i}") for i in range(3)])
    best = rated.where(good(0) | good(1) | good(2)).orderBy(F.desc(most), "feature").limit(lexicon).select("feature", *[F.when(good(i), F.col(f"o{i}")).alias(f"o{i}") for i in range(3)]).collect()

    def made(i: int) -> Model:
        own = sorted((np.int64(r["feature"]).view(np.uint64), r[f"o{i}"]) for r in best if r[f"o{i}"] is not None)
        return Model(np.array([k for k, _ in own], np.uint64), np.array([o for _, o in own]))

    first, second, model = made(0), made(1), made(2)
    told = "toxic int, n long, scores array<double>, counts array<long>, segments array<double>"
    told_shape = arrow_schema(told)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, toxic, f in zip(*(c.to_pylist() for c in b.columns), strict=True):
                s, *_ = (first if f else second).token_scores((text or "").encode())
                values, n = np.unique(s, return_counts=True)
                out.append((toxic, len(s), values.tolist(), n.tolist(), [x for *_, x in maximal_segments(s)]))
            yield batch(list(zip(*out, strict=True)) if out else [[]] * 5, told_shape)

    rows = mapped(taught, judge, told).collect()
    clean = [r for r in rows if not r["toxic"]]
    tokens = sum(r["n"] for r in clean)
    flat = lambda name: np.array([x for r in clean for x in r[name]], float)
    model.rate = _background_rate(flat("scores"), flat("counts"))
    model.k = _background_k(flat("segments"), tokens, model.rate)
    x = np.array([model.evidence([s for s in r["segments"] if model.p_value(s, r["n"]) <= ALPHA], r["n"]) for r in rows])
    model.weights = _logistic(x, np.array([float(r["toxic"]) for r in rows]))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n (tokens), score and the significant segments (byte ranges) of each row of ``docs`` (doc_id, text)."""
    few_rows(docs.sparkSession)
    shape = arrow_schema(HIT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ns, scores, found = [], [], []
            for _, run_ in chunks(b.column(1).to_pylist(), 1 << 19):
                joined = b"\n".join(run_)
                s, start, end = model.token_scores(joined)
                offsets = np.concatenate([[0], np.cumsum([len(x) + 1 for x in run_])])
                cut = np.searchsorted(start, offsets)
                for i in range(len(run_)):
                    own, at, ends = s[cut[i] : cut[i + 1]], start[cut[i] : cut[i + 1]] - offsets[i], end[cut[i] : cut[i + 1]] - offsets[i]
                    seg = model.significant(own)
                    ns.append(len(own))
                    scores.append(model.probability(model.evidence([x for _, _, x, _ in seg], len(own))))
                    found.append([{"start": int(at[x]), "end": int(ends[y - 1]), "score": v, "p_value": p} for x, y, v, p in seg])
            yield batch([b.column(0), ns, scores, found], shape)

    return mapped(docs.select(F.col("doc_id").cast("long"), "text"), run, HIT)
