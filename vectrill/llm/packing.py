"""Bounded-space online packing of token sequences into windows of fixed length.

Each partition keeps ``OPEN`` windows open. What is left of a document after its whole windows goes to the open window
with the least room that still holds it (best fit). If none holds it, the fullest is topped up with the head of the
piece, since documents may be cut freely, and emitted; the rest of the piece is placed again. What a partition leaves
open, at most ``OPEN`` windows, is merged by the same rule in groups of ``FAN`` partitions, level by level, until one
group is left; it closes all but one window without padding. A task thus holds at most ``FAN * OPEN`` windows.

Pieces of the first level are written to the shared folder before the merge reads them, so the sequence numbers, made
of a partition's number and a counter, can't change under a retry.

Defined cases: null and empty texts are the end id alone; repeated rows and ids are packed once for each row; an empty
table has no pieces; a null doc_id is kept; other columns aren't read.
"""

from __future__ import annotations

import bisect
import json
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import arrow_schema, batch, few_rows, located, mapped
from ._shared import Cut

OPEN, FAN = 32, 256
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, source long"
_SCHEMA = arrow_schema(PIECE)
_encoders: dict[str, object] = {}


def encoder(path: str):
    """The byte-level BPE of a ``tokenizers`` file, merged by ranks: equal ids, several times as fast.

    As in ``tokenizers``, the text of a special token in a document is that token.
    """
    if path not in _encoders:
        import tiktoken

        with open(located(path), encoding="utf-8") as f:
            spec = json.load(f)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        _encoders[path] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    return _encoders[path]


class Windows:
    """The open windows of one task. ``add`` and ``close`` give finished pieces; ids are bytes, four for each id."""

    def __init__(self, width: int, first_id: int, space: int = OPEN) -> None:
        self.width, self.next, self.space = width, first_id, space
        self.open: list[tuple[int, int]] = []  # (room, sequence), sorted
        self.held: dict[int, list[tuple]] = {}

    def _new(self) -> int:
        self.next += 1
        return self.next - 1

    def _put(self, at: int, piece: tuple, n: int) -> list[tuple]:
        """Into the open window at this place of the list; the window's pieces if that fills it."""
        room, seq = self.open.pop(at)
        self.held[seq].append((*piece, self.width - room))
        if room > n:
            bisect.insort(self.open, (room - n, seq))
            return []
        return [(*p, seq) for p in self.held.pop(seq)]

    def add(self, doc, start: int, ids: bytes, total: int) -> list[tuple]:
        """Pieces are (doc_id, start, ids, doc_tokens, offset, sequence)."""
        out, at, end = [], 0, len(ids) // 4
        while end - at >= self.width:
            out.append((doc, start + at, ids[4 * at : 4 * (at + self.width)], total, 0, self._new()))
            at += self.width
        while n := end - at:
            fit = bisect.bisect_left(self.open, (n, -1))
            if fit == len(self.open):
                if len(self.open) < self.space:
                    seq = self._new()
                    self.held[seq] = []
                    bisect.insort(self.open, (self.width, seq))
                    continue
                fit, n = 0, self.open[0][0]
            out += self._put(fit, (doc, start + at, ids[4 * at : 4 * (at + n)], total), n)
            at += n
        return out

    def left(self) -> list[tuple]:
        return [(*p, seq) for _, seq in self.open for p in self.held[seq]]


def _rows(pieces: list[tuple], source: int | None) -> pa.RecordBatch:
    """Finished pieces, or those of windows still open if ``source`` is given: these keep their ids."""
    doc, start, ids, total, offset, seq = zip(*pieces, strict=True) if pieces else ((),) * 6
    keep = ids if source is not None else [None] * len(ids)
    return batch([doc, start, [len(i) // 4 for i in ids], [zlib.crc32(i) for i in ids], total, seq, offset, keep, [source] * len(ids)], _SCHEMA)


def pack(docs: DataFrame, tokenizer: str, width: int = 1024, end_id: int = 0) -> DataFrame:
    """One row for each piece of each row of ``docs`` (doc_id, text).

    doc_id, start (the document's ids before the piece), length, ids_crc32 (little-endian unsigned 32-bit ids),
    doc_tokens (with the end id), sequence_id and offset in the sequence.
    """
    few_rows(docs.sparkSession)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, enc = TaskContext.get().partitionId(), encoder(tokenizer)
        special = set(enc.special_tokens_set)
        windows = Windows(width, part << 32)
        for b in batches:
            done = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = array("I", enc.encode(text or "", allowed_special=special))
                ids.append(end_id)
                done += windows.add(doc, 0, ids.tobytes(), len(ids))
            yield _rows(done, None)
        yield _rows(windows.left(), part)

    level, found = 0, Cut(mapped(docs.select(F.col("doc_id").cast("long"), "text"), first, PIECE), "pack")
    result, rest = found.df.where("source IS NULL"), found.df.where("source IS NOT NULL")
    while True:
        groups = (rest.agg(F.max("source").alias("m")).first()["m"] or 0) // FAN + 1
        level += 1
        found = Cut(_merged(rest, width, level, groups == 1), "pack")
        result = result.unionByName(found.df.where("source IS NULL"))
        if groups == 1:
            return result.drop("ids", "source")
        rest = found.df.where("source IS NOT NULL")


def _merged(rest: DataFrame, width: int, level: int, last: bool) -> DataFrame:
    def merge(key, got):  # bare: Spark reads annotations
        group = key[0].as_py()
        windows = Windows(width, level << 52 | group << 32, space=1 if last else OPEN)
        done = []
        # fullest windows first, each window's pieces in their order
        rows = sorted(got.to_pylist(), key=lambda r: (r["source"], r["sequence_id"], r["offset"]))
        for r in rows:
            done += windows.add(r["doc_id"], r["start"], r["ids"], r["doc_tokens"])
        if last:
            return pa.Table.from_batches([_rows(done + windows.left(), None)])
        return pa.Table.from_batches([_rows(done, None), _rows(windows.left(), group)])

    return rest.groupBy(F.expr(f"source div {FAN}").alias("g")).applyInArrow(merge, PIECE)
