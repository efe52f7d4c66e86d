"""Trigram language model as a weighted backoff automaton, learned and applied without ever being in one place.

Model. Words by absolute discount: ``P(w) = (c(w) - d) / N`` for training words, ``P(unknown) = d V / N``. Pairs and triples
by Dirichlet smoothing: ``P(w | u) = (c(u w) + k2 P(w)) / (c(u) + k2)`` and
``P(w | u v) = (c(u v w) + k3 P(w | v)) / (c(u v) + k3)``. The strengths k are those at which the mass left for unseen
n-grams is that of the n-grams seen once (Good and Turing): ``sum over contexts of c k / (c + k) = n1``.

The states of the automaton are the contexts: the seen pairs, the seen words and the root. An arc for each seen n-gram
carries its log probability. The failure arc of a pair's state, of weight ``k3 / (c + k3)``, leads to the state of its last
word, and that of a word's state, of weight ``k2 / (c + k2)``, to the root, whose arcs are the words. A text is traversed once
from left to right: without an arc for the next word the state fails, adding up weights, until there is one, and the arc leads
to the state of the longest seen context. ``Automaton.step`` is that; ``traverse`` makes the same moves for all tokens of a
block at once. Probabilities in each state sum to one over the V words and the unknown one.

Plan. Documents are dealt into blocks of about ``block_bytes`` by a hash of the row and of its partition, so that rows
repeated many times are dealt too. A block asks for the counts of its distinct words, pairs and triples and adds those it
has seen in training rows. Requests travel as sorted, packed hashes, one parcel for each share of the hashes in which the block has
any: never more parcels than n-grams. A share sums the counts of its n-grams from all blocks and answers each request in
its order; their number follows the n-grams, apart from that of blocks. Sizes and counts of counts, a few hundred
numbers, are summed over all shares and broadcast. The block then builds the part of the automaton that its own texts can reach, and
traverses them. So a task holds one block or one share, and what travels is proportional to the input.

N-grams are hashes of ``WIDTH`` bits more than the number of the corpus's words has: of two n-grams in about 2^WIDTH, one
shares its hash with another, and then their counts add up.

Defined cases: null and empty texts are the end token alone; repeated rows are counted and scored each; a null doc_id
scores like any other; without training rows all tokens are unknown, with probability 1; an empty table has no rows; other columns
aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import arrow_schema, few_rows, release, table
from ._shared import partitions, text_bytes
from ._words import chunks, doc_words, mix, planes, unplanes

BLOCK, SHARE, WIDTH, EXACT = 8 << 20, 3 << 20, 17, 256
START, END = np.uint64(0x517CC1B727220A95), np.uint64(0x2545F4914F6CDD1D)
ORDERS = (1, 2, 3)
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def sequences(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, each text closed by the end token, and the numbers of their texts."""
    words, docs = [], []
    for first, run in chunks(texts):
        h, bounds = doc_words(run)
        n = np.diff(bounds) + 1
        ends = np.cumsum(n) - 1
        seq = np.full(len(h) + len(run), END)
        inner = np.ones(len(seq), bool)
        inner[ends] = False
        seq[inner] = h
        words.append(seq)
        docs.append(np.repeat(np.arange(first, first + len(run)), n))
    return np.concatenate(words), np.concatenate(docs)


def grams(seq: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words, pairs and triples that end at each token, and whether a text begins there.

    The first word's pair is with the start; it has no triple.
    """
    first = np.diff(doc, prepend=-1) > 0
    prev = np.where(first, START, np.concatenate([seq[:1], seq[:-1]]))
    two = mix(mix(prev ^ np.uint64(0xA0761D6478BD642F)) ^ seq)
    context = np.concatenate([two[:1], two[:-1]])
    return mix(seq), two, mix(mix(context ^ np.uint64(0xE7037ED1A0B428DB)) ^ seq), first


def packed(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(planes(a.astype(np.uint64)))


def unpacked(b: bytes) -> np.ndarray:
    return unplanes(zstandard.ZstdDecompressor().decompress(b))


def packed_keys(keys: np.ndarray, base: int) -> bytes:
    """Sorted keys as steps from the one before."""
    return packed(np.diff(keys, prepend=np.uint64(base)))


def unpacked_keys(b: bytes, base: int) -> np.ndarray:
    return np.cumsum(unpacked(b), dtype=np.uint64) + np.uint64(base)


@dataclass(frozen=True)
class Grid:
    """Hashes of ``bits`` bits, cut into shares of equal width."""

    bits: int
    shares: int

    @property
    def step(self) -> int:
        return -(-(1 << self.bits) // self.shares)

    def key(self, h: np.ndarray) -> np.ndarray:
        return h >> np.uint64(64 - self.bits)


class Block:
    """The distinct n-grams of a block's texts, with the training rows' counts, and which of them each token ends."""

    def __init__(self, texts: list, train: np.ndarray, grid: Grid) -> None:
        self.grid, self.texts = grid, len(texts)
        seq, self.doc = sequences(texts)
        weight = train[self.doc].astype(np.float64)
        *hashes, self.first = grams(seq, self.doc)
        self.inner = np.flatnonzero(~self.first)
        self.keys, self.at, self.counts = [], [], []
        for order in ORDERS:
            h, w = (hashes[order - 1], weight) if order < 3 else (hashes[2][self.inner], weight[self.inner])
            keys, at = np.unique(grid.key(h), return_inverse=True)
            self.keys.append(keys)
            self.at.append(at)
            self.counts.append(np.bincount(at, w, len(keys)).astype(np.int64))

    def parcels(self) -> Iterator[tuple]:
        """(share, keys and counts of each order) for each share that has any."""
        step = np.uint64(self.grid.step)
        share = [(k // step).astype(np.int64) for k in self.keys]
        for s in np.unique(np.concatenate(share)).tolist():
            row: list = [s]
            for k, c, own in zip(self.keys, self.counts, share, strict=True):
                a, b = np.searchsorted(own, s), np.searchsorted(own, s, "right")
                row += [packed_keys(k[a:b], s * self.grid.step), packed(c[a:b])]
            yield tuple(row)


@dataclass
class Stats:
    """Sums over all n-grams of training rows: by order, numbers and totals of n-grams by their count."""

    number: dict = field(default_factory=dict)  # (order, bin) -> distinct n-grams
    total: dict = field(default_factory=dict)  # (order, bin) -> occurrences
    ends: int = 0

    def _sum(self, what: dict, order: int) -> int:
        return sum(v for (o, _), v in what.items() if o == order)

    @property
    def tokens(self) -> int:
        return self._sum(self.total, 1)

    @property
    def types(self) -> int:
        return self._sum(self.number, 1)

    @property
    def discount(self) -> float:
        n1, n2 = self.number.get((1, 1), 0), self.number.get((1, 2), 0)
        return float(np.clip(n1 / (n1 + 2 * n2), 0.05, 0.95)) if n1 + n2 else 0.5

    def strength(self, order: int) -> float:
        """k of the order: the left side of its equation rises with k, so by halving on a logarithmic scale."""
        bins = [(self.number[o, b], self.total[o, b] / self.number[o, b]) for o, b in self.number if o == order - 1]
        n1, lo, hi = self.number.get((order, 1), 0), -3.0, 6.0
        for _ in range(60):
            k = 10 ** ((lo + hi) / 2)
            lo, hi = (np.log10(k), hi) if sum(n * c * k / (c + k) for n, c in bins) < n1 else (lo, np.log10(k))
        return float(10**hi)


def bins(counts: np.ndarray) -> np.ndarray:
    """Counts below ``EXACT`` one by one, others by powers of two."""
    return np.where(counts < EXACT, counts, EXACT + np.log2(np.maximum(counts, 1)).astype(np.int64))


class Automaton:
    """The states and arcs that a block's texts can reach, with log10 weights."""

    def __init__(self, block: Block, counts: list[np.ndarray], stats: Stats) -> None:
        self.block, self.counts = block, counts
        one, two, three = counts
        n, d = max(stats.tokens, 1), stats.discount
        k2, k3 = stats.strength(2), stats.strength(3)
        unknown = d * stats.types / n if stats.tokens else 1.0
        root = np.where(one > 0, (one - d) / n, unknown)
        at1, at2, at3 = block.at
        # a pair's context is the word before, or the start; a triple's is the pair before
        place = np.empty(len(two), np.int64)
        place[at2] = np.arange(len(at2))
        context = np.where(block.first[place], stats.ends, one[at1[place - 1]])
        p2 = (two + k2 * root[at1[place]]) / (context + k2)
        last = np.empty(len(three), np.int64)
        last[at3] = block.inner
        under = two[at2[last - 1]]
        p3 = (three + k3 * p2[at2[last]]) / (under + k3)
        log = lambda x: np.log10(np.maximum(x, 1e-300))
        self.arcs = [log(root), log(p2), log(p3)]
        self.fail_start = float(np.log10(k2 / (stats.ends + k2)))
        self.fail = [np.log10(k2 / (one + k2)), np.log10(k3 / (two + k3))]

    def traverse(self) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of each token in its state, and the word's count. A state of an unseen context has a failure
        arc of weight 1, as if it weren't there."""
        b = self.block
        (one, two, three), (at1, at2, at3) = self.counts, b.at
        before = np.where(b.first, self.fail_start, self.fail[0][np.concatenate([at1[:1], at1[:-1]])])
        logs = np.where(two[at2] > 0, self.arcs[1][at2], before + self.arcs[0][at1])
        i = b.inner
        logs[i] = np.where(three[at3] > 0, self.arcs[2][at3], self.fail[1][at2[i - 1]] + logs[i])
        return logs, one[at1]


def lm_score(docs: DataFrame, held_out: str = "held_out", block_bytes: int = BLOCK, share_keys: int = SHARE) -> DataFrame:
    """Score each row of ``docs`` (doc_id, text, and the boolean column ``held_out``) by a model of the others.

    doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigrams) and score, both log10.
    A block holds about ``block_bytes`` of text, a share is asked for about ``share_keys`` n-grams.
    """
    spark = docs.sparkSession
    few_rows(spark)
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(F.col(held_out), F.lit(False)).alias("held_out"))
    size = text_bytes(rows)
    blocks = max(1, -(-size // block_bytes))
    words = max(size // 6, 1)
    grid = Grid(min(60, max(44, words.bit_length() + WIDTH)), max(partitions(spark), -(-2 * words // share_keys)))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(blocks)))
    ask = "block long, share long, k1 binary, n1 binary, k2 binary, n2 binary, k3 binary, n3 binary"
    ask_shape = arrow_schema(ask)

    def block_of(got) -> Block:
        return Block(got["text"].to_pylist(), ~np.array(got["held_out"].to_pylist(), bool), grid)

    def asks(key, got):
        release()
        own = [(key[0].as_py(), *r) for r in block_of(got).parcels()]
        return table(list(zip(*own, strict=True)), ask_shape)

    asked = dealt.groupBy("block").applyInArrow(asks, ask)

    def summed(got, order: int) -> tuple[np.ndarray, np.ndarray, list[int], np.ndarray]:
        """Distinct keys, where each request's are among them, the requests' ends, and counts over all requests."""
        base = got["share"][0].as_py() * grid.step
        keys = [unpacked_keys(x, base) for x in got[f"k{order}"].to_pylist()]
        u, at = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(at, np.concatenate([unpacked(x) for x in got[f"n{order}"].to_pylist()]), len(u)).astype(np.int64)
        return u, at, np.cumsum([len(k) for k in keys]).tolist(), n

    reply = "block long, share long, c1 binary, c2 binary, c3 binary, stats array<long>"
    reply_shape = arrow_schema(reply)

    def answer(key, got):
        release()
        own = []
        for order in ORDERS:
            _, at, ends, n = summed(got, order)
            own.append([packed(n[at[a:b]]) for a, b in zip([0, *ends], ends, strict=False)])
        return table([got["block"].to_pylist(), got["share"].to_pylist(), *own, [None] * got.num_rows], reply_shape)

    counted = "ord int, bin long, number long, total long"
    counted_shape = arrow_schema(counted)
    end_key = int(grid.key(mix(np.array([END])))[0])

    def count(key, got):
        release()
        out: list[tuple] = []
        for order in ORDERS:
            u, _, _, n = summed(got, order)
            b, at = np.unique(bins(n), return_inverse=True)
            out += [(order, x, y, z) for x, y, z in zip(b.tolist(), np.bincount(at).tolist(), np.bincount(at, n).astype(np.int64).tolist(), strict=True) if z]
            if order == 1:
                out.append((0, 0, 0, int(n[u == end_key].sum())))
        return table(list(zip(*out, strict=True)), counted_shape)

    sums = asked.groupBy("share").applyInArrow(count, counted).groupBy("ord", "bin").agg(F.sum("number").alias("number"), F.sum("total").alias("total"))
    # a few hundred rows, whatever the corpus, in one
    facts = sums.agg(F.flatten(F.collect_list(F.array(F.col("ord").cast("long"), "bin", "number", "total"))).alias("stats")).withColumn("all", F.lit(0).cast("long"))
    none = F.lit(None).cast("binary")
    told = spark.range(blocks).withColumn("all", F.col("id") % 1).join(F.broadcast(facts), "all").select(F.col("id").alias("block"), F.lit(None).cast("long").alias("share"), none.alias("c1"), none.alias("c2"), none.alias("c3"), "stats")
    shape = arrow_schema(SCORED)

    def scores(key, texts, answers):
        release()
        if not texts.num_rows:
            return table([[]] * 7, shape)
        block = block_of(texts)
        got = sorted((r for r in answers.to_pylist() if r["stats"] is None), key=lambda r: r["share"])
        counts = [np.concatenate([unpacked(r[f"c{order}"]) for r in got]).astype(np.int64) for order in ORDERS]
        stats = Stats()
        for r in answers.to_pylist():
            for o, b, number, total in np.array(r["stats"] or [], np.int64).reshape(-1, 4).tolist():
                if o:
                    stats.number[o, b], stats.total[o, b] = number, total
                else:
                    stats.ends = total
        logs, known = Automaton(block, counts, stats).traverse()
        add = lambda x: np.bincount(block.doc, x, block.texts)
        n, hits = add(np.ones(len(logs))).astype(np.int64), add(known > 0).astype(np.int64)
        base = add(np.log10(known + 1) - np.log10(stats.tokens + stats.types + 1))
        return table([texts["doc_id"].to_pylist(), texts["held_out"].to_pylist(), n, hits, np.full(len(n), stats.tokens), base, add(logs)], shape)

    answers = asked.groupBy("share").applyInArrow(answer, reply).unionByName(told)
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(scores, SCORED)
