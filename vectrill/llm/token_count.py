"""How many pieces a unigram tokenizer makes of each text, without making them.

The vocabulary is that of a public SentencePiece file. Its ranks give the unigram scores, ``-log(rank + 1)`` in
steps of 1/64, so sums are exact integers. An Aho-Corasick automaton lists the vocabulary's matches; dynamic
programming keeps, for each end, the best score and that path's number of pieces. Ties go as in the tokenizer: starts
come in order and only a strictly better score replaces, so the longest last piece wins. A character without a piece
scores ten below the worst and counts as its bytes (byte fallback). Blanks become ``▁`` and one is put in front, as the
file's normaliser does. No piece holds ``▁`` after another character, so texts are cut there and counts of the parts
are looked up or computed once.

Defined cases: null and empty texts have 0 pieces; repeated rows get equal counts; other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import arrow_schema, batch, few_rows, located, mapped

SPACE, STEPS, UNKNOWN, CACHE = "▁", 64, 10, 300_000
COUNTED = "doc_id long, n_chars long, n_tokens long"
_SCHEMA = arrow_schema(COUNTED)
_counters: dict[str, Counter] = {}


def vocabulary(path: str) -> dict[str, int]:
    """Piece to score in units of 1/STEPS, for the file's ordinary pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=located(path))
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return {sp.id_to_piece(i): -round(STEPS * math.log(rank + 1)) for rank, i in enumerate(ids)}


class Counter(dict):
    """Counts of the parts of texts; a bounded number of them is kept."""

    def __init__(self, vocab: dict[str, int]) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocab.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p in vocab if len(p) == 1}
        self.unknown = min(vocab.values()) - UNKNOWN * STEPS
        if any(SPACE in p.lstrip(SPACE) for p in vocab):
            raise ValueError("a piece goes across a blank: texts can't be cut there")

    def viterbi(self, s: str) -> int:
        n = len(s)
        best: list[int | None] = [0] + [None] * n
        count = [0] * (n + 1)
        matches = iter(self.automaton.iter(s))
        at, hit = next(matches, (n, None))
        for end in range(n):
            top, c = None, 0
            while at == end:  # the longest comes first
                size, score = hit
                if (x := best[end + 1 - size] + score) is not None and (top is None or x > top):
                    top, c = x, count[end + 1 - size] + 1
                at, hit = next(matches, (n, None))
            if s[end] not in self.single and (top is None or best[end] + self.unknown > top):
                top, c = best[end] + self.unknown, count[end] + len(s[end].encode("utf-8", "surrogatepass"))
            best[end + 1], count[end + 1] = top, c
        return count[n]

    def __missing__(self, part: str) -> int:
        n = self.viterbi(SPACE + part)
        if len(self) < CACHE and len(part) < 64:
            self[part] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        parts = text.replace(SPACE, " ").split(" ")
        if "" in parts:  # runs of blanks belong to what follows
            joined, run = [], 0
            for p in parts[:-1]:
                if p:
                    joined.append(SPACE * run + p)
                    run = 0
                else:
                    run += 1
            parts = [*joined, SPACE * run + parts[-1]]
        return sum(map(self.__getitem__, parts))


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(vocabulary(path))
    return _counters[path]


def count_tokens(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_chars (code points) and n_tokens for each row of ``docs`` (doc_id, text)."""
    few_rows(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(model)
        for b in batches:
            texts = b.column(1).to_pylist()
            yield batch([b.column(0), [len(t or "") for t in texts], [c.count(t) for t in texts]], _SCHEMA)

    return mapped(docs.select(F.col("doc_id").cast("long"), "text"), run, COUNTED)
