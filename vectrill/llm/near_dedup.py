"""Near-duplicates by bottom-k sketches from one hash function.

Sketch. A document's set is its distinct shingles, hashed; the sketch keeps the ``SKETCH`` smallest hashes (40 bits of
each). Documents with equal sets form a class, and only classes are compared, so copies never multiply pairs.

Candidates. Each class enters the inverted lists of its rarest retained values. Two linked sets share at least ``t``
retained values: exactly known where both sketches are whole sets, else the ``Z`` sigma lower limit of a sample (a chance of
2e-4 to lose a link that lies just at the threshold, and next to none above it). Of the values ordered by rarity, the first ``size - t + 1`` of
each then share one. Where two classes meet in a list, ``t`` is that of their two sizes, mostly a larger one, and the
value's place in both orders must lie in the then shorter heads. Rarity is a count over all documents in 2^24 buckets:
a fixed total order of fixed size, whatever the corpus. With ``sketch=None`` sketches are whole sets: no link can be lost.

Pairs. A group of thousands of near copies, or of texts around one passage that stay below the threshold, must not be
compared pair by pair. First the classes of a list are compared with one only,
that with the fewest values of its own.
Those linked to it are members of its cluster, each with a known difference. Then lists that hold several components
give pairs of clusters, of which only the centres are compared. ``|a & b| <= |A & B| + |a - A| + |b - B|`` rules out the
members of most; only members that it can't rule out are compared themselves. So no link between different texts is
lost, and centres that are linked need no member pairs at all.

Verification. The estimate from the sketch of the pair's union comes first, and where it doesn't rule the pair out, the
exact sizes of intersection and union of the full sets.

Defined cases: null, empty and blank texts have no shingles, link with nothing and stay; fewer words than a shingle's
are one shingle; repeated rows are copies of one class, and all rows with the smallest id of a component are ``kept``;
a null doc_id is larger than any other; an empty table has no rows. Shingles are 64-bit hashes, and so are classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._arrow import arrow_schema, batch, few_rows, mapped, release, table
from ._shared import Counted, Cut, Mask, forget, meet, row_key
from ._words import chunks, doc_words, mix, planes, unplanes
from .components import components

SKETCH, Z = 512, 3.5
BUCKETS, BLOCKS, FAN = 24, 64, 64
#: Classes of a task that it remembers to have sent.
SEEN = 100_000
SET = "a long, b long, doc_id long, cls long, n long, sketch binary"


def shingles(texts: list, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashed shingles of each text."""
    for _, run in chunks(texts):
        h, bounds = doc_words(run)
        for i in range(len(run)):
            w = h[bounds[i] : bounds[i + 1]]
            k = min(width, len(w))
            if not k:
                yield np.empty(0, np.uint64)
                continue
            s = np.full(len(w) - k + 1, np.uint64(k))
            for j in range(k):
                s = mix(s ^ w[j : len(w) - k + 1 + j])
            yield np.unique(s)


def class_of(s: np.ndarray) -> int:
    """A hash of the set itself: sums don't depend on order."""
    both = np.array([s.sum(dtype=np.uint64), mix(s ^ np.uint64(0x9E37)).sum(dtype=np.uint64), len(s)], np.uint64)
    return int(np.bitwise_xor.reduce(mix(both + np.arange(1, 4, dtype=np.uint64))).view(np.int64))


def coded(s: np.ndarray) -> bytes:
    """The high 40 bits of sorted hashes."""
    return planes(s >> np.uint64(24), 5)


def decoded(b: bytes) -> np.ndarray:
    return unplanes(b, 5) << np.uint64(24)


def full(s: np.ndarray) -> bytes:
    return planes(s)


def sampled(k: int, share: float) -> int:
    """Least number, of k retained values that are shared with this probability each, to be expected at Z sigma."""
    return int(np.floor(k * share - Z * np.sqrt(k * share * (1 - share))))


def needed(n: int, k: int, percent: int) -> int:
    """Retained values that two linked sets share at least, by the size of one, whatever the other's."""
    whole = -(-n * percent // 100)
    return whole if n * 100 <= k * percent else max(1, min(whole, sampled(k, percent / 100)))


def _head(own: Column, n: Column, m: Column, k: int, percent: int) -> Column:
    """Places that count in the order of a class of size ``own``, where classes of sizes n and m meet."""
    large = F.greatest(n, m)
    share = (n + m) * percent / ((100 + percent) * large)
    part = F.floor(k * share - Z * F.sqrt(k * share * F.greatest(F.lit(0.0), 1 - share)))
    return F.least(own, F.lit(k)) - F.when(large <= k, F.ceil((n + m) * percent / (100 + percent))).otherwise(F.greatest(part, F.lit(1))) + 1


def enough(n: Column, m: Column, percent: int) -> Column:
    """The size of intersection from which sets of these sizes are linked."""
    return F.ceil((n + m) * percent / (100 + percent))


def within(place: Column, n: Column, m: Column, other: Column, k: int, percent: int) -> Column:
    """Whether a value at this place or later of a set of size n at most may be the first that it shares with a linked one of
    size m at least, and of size ``other`` at most. Sketches that aren't whole sets don't rule it out."""
    return (F.greatest(n, other) > k) | (place <= n - enough(n, m, percent) + 1)


def overlap(a: np.ndarray, b: np.ndarray, n: int, m: int, k: int) -> tuple[int, int]:
    """(size of intersection or -1, what it is at most) from two sketches: exact if they are whole sets."""
    both = np.intersect1d(a, b, True)
    if max(n, m) <= k:
        return len(both), len(both)
    union = np.union1d(a, b)[:k]
    s, k = int(np.searchsorted(both, union[-1], "right")), len(union)
    most = (s + Z * Z / 2 + Z * np.sqrt(s * (k - s) / k + Z * Z / 4)) / (k + Z * Z)  # of the Jaccard index
    return -1, int(most / (1 + most) * (n + m)) + 1


class _Corpus:
    """The sketches of all documents, and what is derived from them on the way."""

    def __init__(self, docs: DataFrame, width: int, percent: int, sketch: int | None) -> None:
        self.docs = docs.select(row_key().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text").select("row.a", "row.b", "doc_id", "text")
        self.width, self.percent, self.k = width, percent, sketch or 1 << 40
        shape, k = arrow_schema(SET), self.k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = list(shingles(b.column(3).to_pylist(), width))
                yield batch([*b.columns[:3], [class_of(s) for s in found], [len(s) for s in found], [coded(s[:k]) for s in found]], shape)

        self.sets = Cut(mapped(self.docs, run, SET), "sketches").df
        self.filled = self.sets.where("n > 0")

    def rarity(self) -> np.ndarray:
        """A step on a logarithmic scale for each bucket of values: how many documents retain one of them.

        Each task sends its counts in blocks, which are added in a tree of ``FAN`` branches.
        """
        shape, size = "block int, part long, places binary, counts binary", 1 << BUCKETS
        made, wide = arrow_schema(shape), size // BLOCKS

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size, np.uint32)
            for b in batches:
                if b.num_rows:
                    v = np.concatenate([decoded(x) for x in b.column(0).to_pylist()])
                    u, n = np.unique((mix(v) >> np.uint64(64 - BUCKETS)).astype(np.int64), return_counts=True)
                    total[u] += n.astype(np.uint32)
            use, part = np.flatnonzero(total), TaskContext.get().partitionId()
            for i in np.unique(use // wide).tolist():
                own = use[np.searchsorted(use, i * wide) : np.searchsorted(use, (i + 1) * wide)]
                yield batch([[i], [part], [planes(np.diff(own - i * wide, prepend=0), 3)], [planes(total[own], 5)]], made)
            release()

        def summed(got) -> np.ndarray:
            out = np.zeros(wide, np.uint64)
            for at, n in zip(got["places"].to_pylist(), got["counts"].to_pylist(), strict=True):
                out[np.cumsum(unplanes(at, 3)).astype(np.int64)] += unplanes(n, 5)
            return out

        def add(key, got):
            total = summed(got)
            use = np.flatnonzero(total)
            return table([[key[0].as_py()], [key[1].as_py()], [planes(np.diff(use, prepend=0), 3)], [planes(total[use], 5)]], made)

        def step(key, got):
            return table([[key[0].as_py()], [0], [None], [(2 * np.log2(1 + summed(got).astype(float))).astype(np.uint8).tobytes()]], made)

        rows = mapped(self.filled.select("sketch"), count, shape)
        for _ in range(2):
            rows = rows.groupBy("block", F.expr(f"part div {FAN}").alias("up")).applyInArrow(add, shape)
        out = np.zeros((BLOCKS, size // BLOCKS), np.uint8)
        for r in rows.groupBy("block").applyInArrow(step, shape).toLocalIterator():
            out[r["block"]] = np.frombuffer(r["counts"], np.uint8)
        return out.reshape(-1)

    def lists(self) -> DataFrame:
        """value, cls, n, place of the classes in the lists that hold several, and head (rare, cls, n, place), the first.

        A class with few values of its own in its head (``rare``) comes first: most copies of a text are as near to it as
        they can be, while an arbitrary one among them is apart from many.
        """
        common, k, percent = self.rarity(), self.k, self.percent

        def heads(b: pa.RecordBatch, seen: set):
            for cls, n, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if cls in seen:
                    continue
                if len(seen) < SEEN:
                    seen.add(cls)
                v = decoded(s)
                level = common[(mix(v) >> np.uint64(64 - BUCKETS)).astype(np.int64)]
                order = np.lexsort((v, level))[: len(v) - needed(n, k, percent) + 1]
                order, place = order[level[order] > 2], np.arange(1, len(order) + 1)[level[order] > 2]  # a count of one has no partner
                yield cls, n, v[order], place

        value_shape = arrow_schema("value long")

        def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            for b in batches:
                found = [v for _, _, v, _ in heads(b, seen)]
                yield batch([np.concatenate(found).view(np.int64) if found else []], value_shape)

        kept = self.filled.select("cls", "n", "sketch")
        shared = Cut(mapped(kept, values, "value long").groupBy("value").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("value"), "values")
        likely = Mask(shared.df, "value")
        shared.drop()
        listed = "value long, cls long, n long, place int, rare int"
        list_shape = arrow_schema(listed)

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            for b in batches:
                vs, cs, ns, ps, rs = [], [], [], [], []
                for cls, n, v, place in heads(b, seen):
                    use = likely.has(v)
                    vs.append(v[use])
                    ps.append(place[use])
                    cs.append(np.full(len(vs[-1]), cls))
                    ns.append(np.full(len(vs[-1]), n))
                    rs.append(np.full(len(vs[-1]), min(n, k) - needed(n, k, percent) + 1 - len(vs[-1])))
                yield batch([np.concatenate(vs).view(np.int64), *map(np.concatenate, (cs, ns, ps, rs))] if vs else [[]] * 5, list_shape)

        once = Cut(mapped(kept, rows, listed).distinct(), "lists")
        head = F.min(F.struct("rare", "cls", "n", "place")).alias("head")
        heads_ = Counted(once.df.groupBy("value").agg(head, F.count(F.lit(1)).alias("n")).where("n > 1"), "heads")
        out = Cut(meet(once.df.drop("rare"), heads_, "value"), "lists")
        once.drop()
        heads_.drop()
        forget(out.spark)
        return out.df

    def near(self, n: Column, m: Column) -> Column:
        """Sizes alone can rule a pair out."""
        return F.least(n, m) * 100 >= self.percent * F.greatest(n, m)

    def meets(self, n: Column, p: Column, m: Column, q: Column) -> Column:
        """Whether a value at places p and q lies in the heads that linked classes of sizes n and m must share."""
        return self.near(n, m) & (p <= _head(n, n, m, self.k, self.percent)) & (q <= _head(m, n, m, self.k, self.percent))

    def compared(self, pairs: DataFrame) -> DataFrame:
        """a, b, n, m, most, linked for pairs (a, b) of classes: their sizes, what their intersection is at most, and
        whether they are similar."""
        k, percent = self.k, self.percent
        found = Cut(pairs.select("a", "b").distinct(), "pairs", rows=F.count(F.lit(1)))
        if not found.found["rows"]:
            return found.spark.createDataFrame([], "a long, b long, n long, m long, most long, linked boolean")
        some = "cls long, row long, size long, sketch binary"
        wanted = Mask(found.df.select(F.col("a").alias("cls")).union(found.df.select("b")), "cls")

        def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            for b in batches:
                use = []
                for i in np.flatnonzero(wanted.has(b.column(0).to_numpy().view(np.uint64))).tolist():
                    if (c := b.column(0)[i].as_py()) not in seen:
                        use.append(i)
                        if len(seen) < SEEN:
                            seen.add(c)
                yield b.take(pa.array(use, pa.int64()))

        rows = self.filled.select("cls", F.col("a").alias("row"), F.col("n").alias("size"), "sketch").mapInArrow(chosen, some)
        sketches = Cut(_one_each(rows, found.df, "row", "size", "sketch"), "chosen")
        tested = "a long, b long, n long, m long, inter long, most long"
        shape = arrow_schema(tested)

        def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in batches:
                out = [(x["size"], y["size"], *overlap(decoded(x["items"]), decoded(y["items"]), x["size"], y["size"], k)) for x, y in zip(t.column(2).to_pylist(), t.column(3).to_pylist(), strict=True)]
                yield batch([t.column(0), t.column(1), *(zip(*out, strict=True) if out else [[]] * 4)], shape)

        rated = Cut(mapped(self._beside(found.df, sketches.df.withColumnRenamed("sketch", "items")), estimate, tested), "rated")
        found.drop()
        unsure = (F.col("inter") < 0) & (F.col("most") >= enough(F.col("n"), F.col("m"), percent))
        left = Cut(rated.df.where(unsure).select("a", "b"), "unsure", rows=F.count(F.lit(1)))
        decided = rated.df.where(~unsure)
        sets = self._sets(left.df, sketches.df) if left.found["rows"] else None
        if sets:
            decided = decided.unionByName(mapped(self._beside(left.df, sets.df), estimate_exact, tested))
        linked = (F.col("inter") >= 0) & (F.col("inter") >= enough(F.col("n"), F.col("m"), percent))
        out = Cut(decided.select("a", "b", "n", "m", "most", linked.alias("linked")), "compared")
        for x in (sketches, rated, left, sets):
            if x:
                x.drop()
        forget(found.spark)
        return out.df

    def _sets(self, pairs: DataFrame, sketches: DataFrame) -> Cut:
        """cls, size, items of the classes of ``pairs``: their full sets, made again from the texts of one row each, with
        a few others that a mask lets pass."""
        rows = Cut(_one_each(sketches, pairs, "row"), "rows")
        wanted, width = Mask(rows.df, "row"), self.width
        rows.drop()
        some = "cls long, size long, items binary"
        shape = arrow_schema(some)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = b.column(1).filter(pa.array(wanted.has(b.column(0).to_numpy().view(np.uint64)))).to_pylist()
                out = [(class_of(s), len(s), full(s)) for s in shingles(texts, width) if len(s)]
                yield batch(list(zip(*out, strict=True)) if out else [[]] * 3, shape)

        return Cut(_one_each(mapped(self.docs.select("a", "text"), scan, some), pairs, "size", "items"), "sets")

    def _beside(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """a, b, x and y for pairs (a, b): size and items of both, though one class may be in most pairs."""
        plain = pairs
        for own, name in (("a", "x"), ("b", "y")):
            counts = Counted(plain.groupBy(own).agg(F.count(F.lit(1)).alias("n")), "counts")
            pairs = meet(pairs, counts.of(sets.select(F.col("cls").alias(own), F.struct("size", "items").alias(name)), own), own)
        return pairs.select("a", "b", "x", "y")


def estimate_exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shape = arrow_schema("a long, b long, n long, m long, inter long, most long")
    for t in batches:
        xs, ys = t.column(2).to_pylist(), t.column(3).to_pylist()
        inter = [len(np.intersect1d(unplanes(x["items"]), unplanes(y["items"]), True)) for x, y in zip(xs, ys, strict=True)]
        yield batch([t.column(0), t.column(1), [x["size"] for x in xs], [y["size"] for y in ys], inter, inter], shape)


def _one_each(rows: DataFrame, pairs: DataFrame, *columns: str) -> DataFrame:
    """One row for each class (cls) that is in pairs (a, b)."""
    ids = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
    return rows.join(ids, "cls", "left_semi").groupBy("cls").agg(*[F.first(c).alias(c) for c in columns])


def _labelled(df: DataFrame, label: DataFrame, column: str, name: str) -> DataFrame:
    """df with the component of the class in ``column``: itself if it has no link."""
    return df.join(label.withColumnsRenamed({"node": column, "label": name}), column, "left").withColumn(name, F.coalesce(name, column))


def labels(corpus: _Corpus) -> DataFrame:
    """(node, label) of the components of all links, for the classes that have any."""
    percent, c = corpus.percent, F.col
    lists = corpus.lists()
    stars = lists.where("cls != head.cls").where(corpus.meets(c("n"), c("place"), c("head.n"), c("head.place")))
    linked = Cut(corpus.compared(stars.select(c("cls").alias("a"), c("head.cls").alias("b"))).where("linked"), "stars").df
    label = components(linked)

    # A cluster is a class that has linked with none before it (by ``rare``, then cls), and those that have linked with it.
    outer = linked.select(c("a").alias("b")).distinct().withColumn("outer", F.lit(True))
    closest = F.max_by(F.struct(c("b").alias("centre"), (c("n") - c("most")).alias("own")), F.struct("most", -c("b"))).alias("best")
    member = linked.join(outer, "b", "left").where("outer IS NULL").groupBy(c("a").alias("cls")).agg(closest).select("cls", "best.*")
    placed = lists.select("value", "cls", "n", "place").join(member, "cls", "left")
    placed = _labelled(placed.withColumns({"centre": F.coalesce("centre", "cls"), "own": F.coalesce("own", F.lit(0))}), label, "cls", "label")
    placed = Cut(placed, "placed")
    several = placed.df.groupBy("value").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo != hi").select("value", "n")
    mixed = Cut(meet(placed.df, Counted(several, "mixed"), "value", "left_semi"), "mixed").df
    placed.drop()

    # Clusters that meet in a list, by the extremes of their members there.
    kinds = {"n1": F.min("n"), "n2": F.max("n"), "place": F.min("place"), "label": F.min("label")}
    there = Cut(mixed.groupBy("value", "centre").agg(*[f.alias(k) for k, f in kinds.items()]), "there").df
    x, y = there.alias("x"), there.alias("y")
    single = (c("x.n1") == c("x.n2")) & (c("y.n1") == c("y.n2"))
    sizes = (c("x.n2") * 100 >= percent * c("y.n1")) & (c("y.n2") * 100 >= percent * c("x.n1"))
    k, least = corpus.k, F.greatest("x.n1", "y.n1")
    shared = F.ceil(least * percent / 100)
    if k < 1 << 40:
        shared = F.when(F.greatest("x.n2", "y.n2") > k, F.least(shared, F.lit(max(1, sampled(k, percent / 100))))).otherwise(shared)
    loose = lambda s: c(f"{s}.place") <= F.least(c(f"{s}.n2"), F.lit(k)) - shared + 1
    first = lambda s, o: within(c(f"{s}.place"), c(f"{s}.n2"), c(f"{o}.n1"), c(f"{o}.n2"), k, percent)
    can = F.when(single, corpus.meets(c("x.n1"), c("x.place"), c("y.n1"), c("y.place"))).otherwise(sizes & loose("x") & loose("y") & first("x", "y") & first("y", "x"))
    met = x.join(y, (c("x.value") == c("y.value")) & (c("x.centre") < c("y.centre")) & (c("x.label") != c("y.label")) & can)
    centres = corpus.compared(met.select(c("x.centre").alias("a"), c("y.centre").alias("b")))
    new = Cut(centres.where("linked").select("a", "b"), "links", rows=F.count(F.lit(1)))
    joined = linked.select("a", "b").union(new.df)

    # Members that the bound can't rule out, of clusters that are still apart.
    again = components(joined) if new.found["rows"] else label
    # Wherever two of them meet, it is at their first places here or later, so these rule out pairs as places in a list do.
    members = Cut(mixed.groupBy("cls", "n", "centre", "own").agg(F.min("place").alias("place")), "members").df
    extreme = members.groupBy("centre").agg(F.max("own").alias("own"), F.min("n").alias("n1"), F.max(c("cls") != c("centre")).alias("wide"))
    side = lambda s: extreme.select(c("centre").alias(s), c("own").alias(f"own_{s}"), c("n1").alias(f"n_{s}"), c("wide").alias(f"wide_{s}"))
    apart = _labelled(_labelled(centres.where("NOT linked").select("a", "b", "most"), again, "a", "label_a"), again, "b", "label_b").where("label_a != label_b")
    apart = apart.join(side("a"), "a").join(side("b"), "b").where("wide_a OR wide_b").where(c("most") + c("own_a") + c("own_b") >= enough(c("n_a"), c("n_b"), percent))
    apart_ = Cut(apart.select("a", "b", "most", "own_a", "own_b", "n_a", "n_b"), "apart").df

    # Only members that meet the other cluster in a list themselves, at a place that a link allows.
    kinds = lambda s: [c(f"{s}.{x}").alias(f"{s}_{x}") for x in ("n1", "n2", "place")]
    places = Cut(met.select("x.value", c("x.centre").alias("a"), c("y.centre").alias("b"), *kinds("x"), *kinds("y")).join(apart_.select("a", "b"), ["a", "b"], "left_semi"), "places").df

    def near_it(s: str, other: str, o: str) -> DataFrame:
        there_ = mixed.select("value", c("centre").alias(s), "cls", c("n").alias("size"), c("place").alias("at"))
        here = within(c("at"), c("size"), c(f"{o}_n1"), c(f"{o}_n2"), k, percent) & within(c(f"{o}_place"), c(f"{o}_n2"), c("size"), c("size"), k, percent)
        seen = places.join(there_, ["value", s]).where(here).select("a", "b", "cls").distinct()
        found = apart_.join(seen, ["a", "b"]).join(members.select("cls", F.struct("cls", "n", "own", "place").alias("m")), "cls")
        return found.where(c("most") + c("m.own") + c(f"own_{other}") >= enough(c("m.n"), c(f"n_{other}"), percent))

    left, right = near_it("a", "b", "y").select("a", "b", "most", c("m").alias("x")), near_it("b", "a", "x").select("a", "b", c("m").alias("y"))
    bound = c("most") + c("x.own") + c("y.own") >= enough(c("x.n"), c("y.n"), percent)
    rest = left.join(right, ["a", "b"]).where(bound & corpus.meets(c("x.n"), c("x.place"), c("y.n"), c("y.place")) & ((c("x.cls") != c("a")) | (c("y.cls") != c("b"))))
    more = Cut(corpus.compared(rest.select(c("x.cls").alias("a"), c("y.cls").alias("b"))).where("linked").select("a", "b"), "links", rows=F.count(F.lit(1)))
    return components(joined.union(more.df)) if more.found["rows"] else again


def near_duplicates(docs: DataFrame, width: int = 2, percent: int = 80, sketch: int | None = SKETCH, rows: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable) and kept for each row of ``docs`` (doc_id, text).

    Documents are linked if their sets of shingles of ``width`` words have 100 * intersection >= ``percent`` * union.
    ``sketch`` is the number of retained values; None retains all. With ``rows``, also ``row`` (see ``row_key``) and
    ``component``, which tells components apart that have the same smallest id.
    """
    few_rows(docs.sparkSession)
    corpus = _Corpus(docs, width, percent, sketch)
    classes = corpus.filled.groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
    named = Cut(_labelled(classes, labels(corpus), "cls", "component"), "named").df
    smallest = Counted(named.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("n")), "smallest")
    ids = Counted(meet(named.withColumnRenamed("n", "copies"), smallest, "component").select("component", "component_id", "cls", F.col("copies").alias("n")), "classes")
    full = meet(corpus.filled.select("a", "b", "doc_id", "cls", F.col("n").alias("n_shingles")), ids, "cls")
    empty = corpus.sets.where("n = 0").select("a", "b", "doc_id", "cls", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id"))
    out = full.unionByName(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    extra = [F.struct("a", "b").alias("row"), "component"] if rows else []
    return out.select("doc_id", "n_shingles", "component_id", "kept", *extra)


def duplicates(docs: DataFrame, width: int = 5, percent: int = 80, sketch: int | None = SKETCH) -> DataFrame:
    """row (see ``row_key``) of each row of ``docs`` that goes if one document of each group stays: that of the smallest id,
    and of rows that have it the one with the smallest key. Texts without words stay."""
    found = Cut(near_duplicates(docs, width, percent, sketch, rows=True).where("component IS NOT NULL").select("component", "doc_id", "row"), "found").df
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    stays = Counted(found.groupBy("component").agg(first, F.count(F.lit(1)).alias("n")).where("n > 1"), "stays")
    return meet(found, stays, "component").where("first.row != row").select("row")
