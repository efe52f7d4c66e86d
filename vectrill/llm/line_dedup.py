"""Line deduplication by deletion neighbourhoods.

Lines are split at ``\\n``; a line without a word is never touched. A line is dropped if an equal line, or for lines of
at least ``shortest`` characters one within ``edits`` (0 or 1) edits, comes earlier in the corpus (by doc_id, then line),
whether or not that one is itself dropped.

Equal lines meet by hash. For near lines, each distinct line emits its variants within the bound as hashed keys:
itself, and itself without its i-th character. Two lines are one substitution apart if and only if they share a variant
with the same i, and one insertion apart if and only if a variant of one is the other. So the earliest line of each key
is enough: no pairs are formed, and a group that shares a variant costs its size. The edit distance of every line to be
dropped is then verified on the texts.

Two necessary conditions keep variants few without losing a line. Lines within distance 1 share their first or their
last half; of lines that pass, they also share all but a hole of an eighth of the line, and the edit lies in that hole.
So a line emits only variants without a character of a hole in whose keys it met another line. Each condition is a
group-by of keys and a semi-join, both in proportion to the lines. One scan of the texts makes the lines' hashes, a
second fetches the few lines whose half met another's, ahead of whose exact join a mask of fixed size drops most others.
At worst, when the mask is full, that fetch moves every line's text once.

Defined cases: null and empty texts stay as they are; rows repeated with id and text get equal results, as one
document; a null doc_id comes last; blank lines stay; an empty table stays empty; other columns pass through whatever
their names. A line that a third of all rows hold is a hot key: its rows meet a broadcast table where they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import arrow_schema, batch, few_rows, mapped
from ._shared import Counted, Cut, Mask, meet
from ._words import U64, down, mix, prefix_of, span

SHORTEST, EDITS, HOLES = 20, 1, 8
#: Lines of a task whose text it remembers to have sent.
SEEN = 100_000
_GRID = [1]
while _GRID[-1] < 1 << 40:
    _GRID.append(int(_GRID[-1] * 1.25) + 1)
_GRID = np.array([0, *_GRID])


class Lines:
    """The lines with a word of some texts, as ranges of code points with prefix sums to hash any part of them."""

    def __init__(self, texts: list) -> None:
        joined = "\n".join(t or "" for t in texts)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = mix(points.astype(np.uint64) + U64(0x9E3779B97F4A7C15))
        self.sums = prefix_of(codes)
        breaks = np.flatnonzero(points == 10)
        start, end = np.concatenate([[0], breaks + 1]), np.append(breaks, len(points))
        text_start = np.cumsum([0] + [len(t or "") + 1 for t in texts])[:-1]
        doc = np.searchsorted(text_start, start, "right") - 1
        solid = np.concatenate([[0], np.cumsum((points != 32) & ((points < 9) | (points > 13)))])
        keep = np.flatnonzero(solid[end] > solid[start])
        number = np.arange(len(start)) - np.searchsorted(start, text_start)[doc]
        self.joined, self.start, self.end, self.doc, self.number = joined, start[keep], end[keep], doc[keep], number[keep]
        self.size = self.end - self.start
        self.hash = mix(span(self.sums, self.start, self.end) ^ self.size.astype(np.uint64))

    def part(self, at: np.ndarray, end: np.ndarray, tag) -> np.ndarray:
        return mix(span(self.sums, at, end) ^ mix(np.atleast_1d(tag).astype(np.uint64)))

    def halves(self, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of each line's first and last half, in the one or two lengths of a grid that neighbours share: all keys,
        and how many of them each line has."""
        out, lengths = [], []
        for less in (1, 2):
            h = _GRID[np.searchsorted(_GRID, np.maximum(self.size[use] - less, 0) // 2, "right") - 1]
            out += [self.part(self.start[use], self.start[use] + h, 2 * h), self.part(self.end[use] - h, self.end[use], 2 * h + 1)]
            lengths.append(h)
        twice = lengths[0] != lengths[1]
        mine = np.stack([np.ones_like(twice), np.ones_like(twice), twice, twice], 1)
        return np.stack(out, 1)[mine], mine.sum(1)

    def holes(self, use: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(layout, width of the head before its hole, size of the tail behind it, key of both) of each layout: the holes
        of the line's length and those of one less."""
        for less in (0, 1):
            size = np.maximum(self.size[use] - less, 0)
            width = np.maximum(-(-size // HOLES), 1)
            for q in range(HOLES):
                head, tail = np.minimum(q * width, size), np.maximum(size - (q + 1) * width, 0)
                a, b = self.part(self.start[use], self.start[use] + head, size * HOLES + q), self.part(self.end[use] - tail, self.end[use], 1)
                yield less * HOLES + q, head, tail, mix(a ^ (b * U64(3)))

    def variants(self, i: int, places: np.ndarray) -> np.ndarray:
        """Keys of line i without the character at each of the places (from 0)."""
        s, e = int(self.start[i]), int(self.end[i])
        at = s + places
        rest = (self.sums[e] - self.sums[at + 1]) * down(s + 1)
        return mix(((self.sums[at] - self.sums[s]) * down(s) + rest) ^ U64(e - s - 1))


def _runs(b: pa.RecordBatch, size: int = 1 << 18) -> Iterator[tuple[list, list]]:
    """Some (key columns, texts) at a time, by characters."""
    texts = b.column(b.num_columns - 1).to_pylist()
    first, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t or "")
        if n >= size or i == len(texts) - 1:
            yield b.slice(first, i + 1 - first), texts[first : i + 1]
            first, n = i + 1, 0


def _met(keys: DataFrame) -> DataFrame:
    """Rows of ``keys`` (key, h, ...) whose key another h has too, for a table that is read again at low cost."""
    some = keys.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi"), F.count(F.lit(1)).alias("n"))
    return meet(keys, Counted(some.where("lo != hi").select("key", "n"), "shared"), "key", "left_semi")


PLACE = ("ord", "key", "line")


def near_lines(docs: DataFrame, lines: DataFrame, shortest: int) -> DataFrame:
    """h of each line that is within one edit of an earlier one. docs: (ord, key, text), lines: (h, halves)."""
    half = "key long, h long"
    half_shape = arrow_schema(half)
    halves = lines.select(F.explode("halves").alias("key"), "h")
    some = halves.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi"), F.count(F.lit(1)).alias("n"))
    shared = Counted(some.where("lo != hi").select("key", "n"), "halves")
    likely = Mask(shared.df, "key")

    def masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(1).flatten().to_numpy()
            use = np.flatnonzero(likely.has(keys.view(np.uint64)))
            owner = np.repeat(np.arange(b.num_rows), b.column(1).value_lengths().to_numpy())[use]
            yield batch([keys[use], b.column(0).to_numpy()[owner]], half_shape)

    few = Cut(lines.select("h", "halves").mapInArrow(masked, half).distinct(), "halves")
    wanted = Cut(meet(few.df, shared, "key", "left_semi").select("h").distinct(), "wanted")
    shared.drop()
    few.drop()
    fetch = Mask(wanted.df, "h")
    text = "ord long, key long, line int, h long, body string"
    text_shape = arrow_schema(text)

    def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, tuple] = {}
        for b in batches:
            for own, texts in _runs(b):
                x = Lines(texts)
                use = np.flatnonzero((x.size >= shortest) & fetch.has(x.hash))
                order, keys, rows = own.column(0).to_pylist(), own.column(1).to_pylist(), []
                for i, h in zip(use.tolist(), x.hash[use].view(np.int64).tolist(), strict=True):
                    place = (order[x.doc[i]], keys[x.doc[i]], int(x.number[i]))
                    if h in seen and seen[h] <= place:  # an earlier one has been sent
                        continue
                    if len(seen) < SEEN:
                        seen[h] = place
                    rows.append((*place, h, x.joined[x.start[i] : x.end[i]]))
                yield batch(list(zip(*rows, strict=True)) if rows else [[]] * 5, text_shape)

    once = mapped(docs, fetched, text).join(wanted.df, "h", "left_semi").groupBy("h").agg(F.min(F.struct(*PLACE)).alias("first"), F.first("body").alias("body"))
    bodies = Cut(once, "bodies")
    hole = "key long, h long, layout int"
    hole_shape = arrow_schema(hole)

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for own, texts in _runs(b):
                x, h = Lines(texts), own.column(0).to_numpy()
                for layout, _, _, key in x.holes(np.arange(len(x.size))):
                    yield batch([key.view(np.int64), h[x.doc], np.full(len(key), layout)], hole_shape)

    keys = Cut(mapped(bodies.df.select("h", "body"), around, hole), "holes")
    met = _met(keys.df).groupBy("h").agg(F.collect_set("layout").alias("layouts"))  # 16 at most
    close = Cut(bodies.df.join(met, "h"), "close")
    keys.drop()
    bodies.drop()
    # sides: 0 a variant under a key with its place, 1 a variant and 2 the line itself under keys without place
    variant = "key long, side int, h long, ord long, doc long, line int"
    variant_shape = arrow_schema(variant)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for own, texts in _runs(b):
                x, layouts = Lines(texts), own.column(4).to_pylist()
                spans: list[list] = [[] for _ in texts]
                for layout, head, tail, _ in x.holes(np.arange(len(x.size))):
                    for i, (lo, hi) in enumerate(zip(head.tolist(), (x.size - tail).tolist(), strict=True)):
                        if layout in layouts[i]:
                            spans[i].append(np.arange(lo, hi))
                ks, sides, counts = [], [], []
                for i, parts in enumerate(spans):
                    places = np.unique(np.concatenate(parts))
                    k = x.variants(i, places)
                    ks += [mix(k ^ mix(places.astype(np.uint64) + U64(0x5851F42D4C957F2D))), k, x.hash[i : i + 1]]
                    sides.append(np.repeat([0, 1, 2], [len(k), len(k), 1]))
                    counts.append(2 * len(k) + 1)
                line = pa.array(np.repeat(np.arange(len(texts)), counts))
                own_columns = [own.column(c).take(line) for c in range(4)]
                yield batch([np.concatenate(ks).view(np.int64), np.concatenate(sides).astype(np.int32), *own_columns], variant_shape)

    rows = Cut(mapped(close.df.select("h", "first.ord", F.col("first.key").alias("doc"), "first.line", "layouts", "body"), emit, variant), "variants")
    candidate = F.struct(F.struct("ord", "doc", "line").alias("first"), "h")
    # Lines that share a variant at its place differ in one character there: so few rows have a key that no key is hot.
    best = [F.min(F.when(F.col("side") == side, candidate)).alias(f"m{side}") for side in (0, 1, 2)]
    least = rows.df.groupBy("key").agg(*best, F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo != hi").drop("lo", "hi")
    other = F.when(F.col("side") == 0, F.col("m0")).when(F.col("side") == 1, F.col("m2")).otherwise(F.col("m1"))
    met = rows.df.join(least, "key").select("h", F.struct("ord", "doc", "line").alias("first"), other.alias("m")).where("m.first < first")
    pairs = met.groupBy("h").agg(F.min("m").alias("m")).select("h", F.col("m.h").alias("g"))
    texts = close.df.select("h", "body")
    both = pairs.join(texts, "h").join(texts.select(F.col("h").alias("g"), F.col("body").alias("other")), "g")
    near = Cut(both.where(F.levenshtein("body", "other", EDITS) >= 0).select("h"), "near")
    rows.drop()
    close.drop()
    return near.df


def dropped_lines(docs: DataFrame, shortest: int = SHORTEST, edits: int = EDITS) -> DataFrame:
    """(key, drops): 0-based numbers of the lines to drop of each row (key, ord, text) of ``docs`` that has any.

    ``drops`` is sorted and holds (line, near): near is false for repeats, true for lines near an earlier one.
    """
    if edits not in (0, 1):
        raise ValueError("edits must be 0 or 1")
    few_rows(docs.sparkSession)
    docs = docs.select("ord", "key", "text")
    made = "ord long, key long, line int, h long, halves array<long>"
    made_shape = arrow_schema(made)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for own, texts in _runs(b):
                x = Lines(texts)
                near = np.flatnonzero(x.size >= (shortest if edits else 1 << 62))
                keys, n = x.halves(near)
                offsets = np.zeros(len(x.size) + 1, np.int32)
                offsets[near + 1] = n
                halves = pa.ListArray.from_arrays(np.cumsum(offsets, dtype=np.int32), keys.view(np.int64))
                ords, own_keys = own.column(0).take(pa.array(x.doc)), own.column(1).take(pa.array(x.doc))
                yield pa.RecordBatch.from_arrays([ords, own_keys, pa.array(x.number.astype(np.int32)), pa.array(x.hash.view(np.int64)), halves], schema=made_shape)

    lines = Cut(mapped(docs, scan, made), "lines")
    place = F.struct(*PLACE)
    seen = lines.df.groupBy("h").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    if edits:
        near = near_lines(docs, lines.df.select("h", "halves"), shortest).withColumn("near", F.lit(True))
        seen = seen.join(near, "h", "full")
    # a line that occurs once has no first place but its own
    marks = Counted(seen.select("h", "first", F.coalesce("n", F.lit(1)).alias("n"), F.coalesce("near", F.lit(False)).alias("near") if edits else F.lit(False).alias("near")), "marks")
    out = (
        meet(lines.df.select(*PLACE, "h"), marks, "h")
        .where((F.col("first") != place) | F.col("near"))
        .select("key", F.struct("line", (F.col("near") & (F.coalesce("first", place) == place)).alias("near")).alias("d"))
    )
    return out.groupBy("key").agg(F.array_sort(F.collect_set("d")).alias("drops"))


def dedup_lines(docs: DataFrame, counts: bool = False, shortest: int = SHORTEST, edits: int = EDITS) -> DataFrame:
    """``docs`` (doc_id, text and any others) with texts cut to the lines that stay.

    A line is near another only if both have ``shortest`` characters; with ``edits`` 0 only equal lines count.
    With ``counts``, instead: doc_id, n_lines (with a word), n_repeated, n_near, n_kept and the new text.
    """
    last = F.lit((1 << 63) - 1)
    keyed = docs.select(F.struct("*").alias("row"), F.xxhash64("doc_id", "text").alias("key"), F.coalesce(F.col("doc_id").cast("long"), last).alias("ord"), F.col("text").alias("text"))
    drops = dropped_lines(keyed.select("ord", "key", "text"), shortest, edits)
    joined = keyed.select("row", "key", "text").join(drops.hint("shuffle_hash"), "key", "left")
    at = F.transform("drops", lambda d: d["line"])
    lines = F.split("text", "\n", -1)
    # What lies between dropped lines, by slices: linear in the lines, however many are dropped.
    def cut(x):
        n, d = x["n"], x["d"]
        begin = lambda j: F.coalesce(F.get(d, j - 1) + 1, F.lit(0))
        end = lambda j: F.coalesce(F.get(d, j), F.size(n))
        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(d)), lambda j: F.slice(n, begin(j) + 1, end(j) - begin(j)))), "\n")

    bound = F.element_at(F.transform(F.array(F.struct(lines.alias("n"), at.alias("d"))), cut), 1)
    text = F.when(F.col("drops").isNull(), F.col("text")).otherwise(bound)
    if not counts:
        return joined.select(F.col("row").withField("text", text).alias("row")).select("row.*")
    solid = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    gone = F.coalesce(F.size("drops"), F.lit(0))
    near = F.size(F.filter(F.coalesce("drops", F.expr("CAST(array() AS array<struct<line: int, near: boolean>>)")), lambda d: d["near"]))
    return joined.select(
        F.col("row.doc_id").alias("doc_id"), solid.cast("long").alias("n_lines"), (gone - near).cast("long").alias("n_repeated"),
        near.cast("long").alias("n_near"), (solid - gone).cast("long").alias("n_kept"), text.alias("text"),
    )
