"""Language identification by unigrams marginalised over segmentations.

For each language, the pieces of a fixed public vocabulary have probabilities; the probability of a word is the sum
over all its segmentations into pieces, computed by the forward algorithm, and that of a text the product over its
words. Piece probabilities are learned by expectation-maximisation on the word counts of a bounded sample of labelled
documents. Its bounds are parameters of ``fit``: about ``sample`` documents of each language by a hash of the id, of these the
``words`` most frequent words of each language, those of at most ``longest`` bytes, and the ``languages`` most frequent
languages. Scoring knows no bound. A single byte is a piece of probability ``FLOOR`` in every language, so no text is
impossible.

Words begin with a letter and go on with letters and combining marks, in lower case and with the file's word-start mark;
learning and scoring cut them by the same function. Forward sums run over many distinct words at once, one piece length
after the other; long words get a scaled recursion of their own. The score is the posterior with the weight of four
words, so that long texts don't all score 1.

Defined cases: null texts and texts without a letter are ``und`` with score 0; ties go to the first language in
sorted order; repeated rows get equal results; null languages don't teach; with nothing to learn from, all is ``und``;
an empty table has no rows; other columns aren't read.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._arrow import arrow_schema, batch, few_rows, located, mapped, release
from ._words import U64, prefix, span

SAMPLE, WORDS, LONGEST, LANGUAGES = 2000, 25_000, 64, 1000
ROUNDS, FLOOR, LONG, MARK = 3, 1e-9, 32, "▁"
PREDICTED = "doc_id long, lang_pred string, score double, n_words long"
_BITS, _SPREAD = 18, U64(0xD6E8FEB86659FD93)
#: A worker goes through its texts in runs of about so many characters, and keeps tables of about so many bytes.
RUN, TABLE = 1 << 17, 1 << 22


def _class(kinds: str) -> str:
    """A character class of all code points whose general category begins with one of the letters."""
    runs = itertools.groupby((c for c in range(0x110000) if unicodedata.category(chr(c))[0] in kinds), lambda c, n=itertools.count(): c - next(n))
    ends = ((r[0], r[-1]) for r in (list(g) for _, g in runs))
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ends) + "]"


LETTERS = re.compile(_class("L") + _class("LM") + "*")


def split(text: str | None) -> list[str]:
    """The words of a text."""
    return LETTERS.findall((text or "").lower())


def vocabulary(path: str) -> list[bytes]:
    """The ordinary pieces of a SentencePiece file, as UTF-8 in lower case."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=located(path))
    skip = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)
    return sorted({sp.id_to_piece(i).lower().encode() for i in range(sp.get_piece_size()) if not skip(i)})


class Pieces:
    """Piece numbers by the hash of their bytes, in a table of direct addresses with rare overflow by search."""

    def __init__(self, pieces: list[bytes]) -> None:
        self.size = len(pieces)
        self.lengths = sorted({len(p) for p in pieces})
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        end = np.cumsum([len(p) for p in pieces])
        start = end - np.array([len(p) for p in pieces])
        keys = span(prefix(raw), start, end) * _SPREAD
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], order
        bucket = (self.keys >> np.uint64(64 - _BITS)).astype(np.int64)
        self.first = np.searchsorted(bucket, np.arange(1 << _BITS)).astype(np.int32)
        self.full = np.bincount(bucket, minlength=1 << _BITS) > 0
        self.deep = int(np.bincount(bucket).max())

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the hashes that belong to pieces, and the pieces' numbers."""
        h = h * _SPREAD
        bucket = (h >> U64(64 - _BITS)).astype(np.int64)
        some = np.flatnonzero(self.full[bucket])
        h, at = h[some], self.first[bucket[some]]
        out = np.full(len(h), -1, np.int64)
        for k in range(self.deep):
            i = np.minimum(at + k, self.size - 1)
            hit = self.keys[i] == h
            out[hit] = self.ids[i[hit]]
        hit = out >= 0
        return some[hit], out[hit]


def matches(words: list[bytes], pieces: Pieces):
    """For words sorted by length: yields (end, piece length, word numbers, piece numbers) by rising end."""
    size = np.array([len(w) for w in words])
    raw = np.frombuffer(b"".join(words), np.uint8)
    start = np.cumsum(size) - size
    sums = prefix(raw)
    for end in range(1, int(size[-1]) + 1 if len(size) else 0):
        first = int(np.searchsorted(size, end))
        at = start[first:] + end
        for k in pieces.lengths:
            if k > end:
                break
            hit, ids = pieces.find(span(sums, at - k, at))
            if len(hit):
                yield end, k, hit + first, ids


def forward(words: list[bytes], pieces: Pieces, prob: np.ndarray) -> np.ndarray:
    """log probability of each word (rows) in each language, summed over all segmentations. prob: pieces x languages."""
    out = np.empty((len(words), prob.shape[1]))
    short = sorted((i for i, w in enumerate(words) if len(w) <= LONG), key=lambda i: len(words[i]))
    if short:
        own = [words[i] for i in short]
        size = np.array([len(w) for w in own])
        alpha = np.zeros((int(size[-1]) + 1, len(own), prob.shape[1]))
        alpha[0] = 1
        last = 0
        for end, k, w, ids in matches(own, pieces):
            for e in range(last + 1, end + 1):
                alpha[e] += alpha[e - 1] * FLOOR
            last = max(last, end)
            alpha[end, w] += alpha[end - k, w] * prob[ids]
        for e in range(last + 1, len(alpha)):
            alpha[e] += alpha[e - 1] * FLOOR
        out[short] = np.log(alpha[size, np.arange(len(own))])
    for i, w in enumerate(words):
        if len(w) > LONG:
            out[i] = forward_scaled(w, pieces, prob)
    return out


def forward_scaled(word: bytes, pieces: Pieces, prob: np.ndarray) -> np.ndarray:
    """The same for one word of any length, rescaled at each byte; memory stays that of the longest piece."""
    longest = pieces.lengths[-1]
    raw, logs = np.frombuffer(word, np.uint8), np.zeros(prob.shape[1])
    recent = [np.ones(prob.shape[1])]
    for lo in range(0, len(raw), 1 << 16):
        base = max(0, lo - longest)
        sums = prefix(raw[base : lo + (1 << 16)])
        for end in range(lo + 1, min(len(raw), lo + (1 << 16)) + 1):
            ks = [k for k in pieces.lengths if k <= end]
            e = np.full(len(ks), end - base)
            hit, ids = pieces.find(span(sums, e - np.array(ks, np.int64), e))
            a = recent[-1] * FLOOR
            for i, p in zip(hit.tolist(), ids.tolist(), strict=True):
                if ks[i] <= len(recent):
                    a = a + recent[-ks[i]] * prob[p]
            recent = [*recent[-longest:], a]
            logs += (step := np.log(a))
            scale = np.exp(-step)
            recent = [r * scale for r in recent]
    return logs


def learn(counts: list[tuple[str, str, int]], pieces: Pieces, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages and piece probabilities (pieces x languages) from (language, word, count) by EM, language by language."""
    langs = sorted({lang for lang, _, _ in counts})
    prob = np.full((pieces.size, len(langs)), 1.0 / pieces.size)
    by_lang: dict[str, dict[bytes, int]] = {lang: Counter() for lang in langs}
    for lang, word, n in counts:
        by_lang[lang][(MARK + word).encode("utf-8", "replace")] += n
    for i, lang in enumerate(langs):
        words = sorted(by_lang[lang], key=len)
        found = list(matches(words, pieces))
        for _ in range(rounds):
            prob[:, i] = _step(words, np.array([by_lang[lang][w] for w in words], float), found, prob[:, i])
    return langs, prob


def _step(words: list[bytes], weight: np.ndarray, found: list, prob: np.ndarray) -> np.ndarray:
    """One round: each piece's expected number of uses over all segmentations, smoothed."""
    size, rows = np.array([len(w) for w in words]), np.arange(len(words))
    alpha = np.zeros((int(size[-1]) + 1, len(words)))
    beta = np.zeros_like(alpha)
    alpha[0], beta[size, rows] = 1, 1
    at = 0
    for end in range(1, len(alpha)):
        alpha[end] += alpha[end - 1] * FLOOR
        while at < len(found) and found[at][0] == end:
            _, k, w, ids = found[at]
            alpha[end, w] += alpha[end - k, w] * prob[ids]
            at += 1
    scale = weight / np.maximum(alpha[size, rows], 1e-300)
    expected = np.zeros_like(prob)
    at = len(found)
    for end in range(len(alpha) - 1, 0, -1):
        while at and found[at - 1][0] == end:
            at -= 1
            _, k, w, ids = found[at]
            beta[end - k, w] += beta[end, w] * prob[ids]
            expected += np.bincount(ids, alpha[end - k, w] * prob[ids] * beta[end, w] * scale[w], len(prob))
        beta[end - 1] += beta[end] * FLOOR
    return (expected + 0.01) / (expected.sum() + 0.01 * len(prob))


def runs(texts: list[str | None]) -> Iterator[list[list[str]]]:
    """The words of each text, in runs of texts."""
    run, size = [], 0
    for t in texts:
        run.append(split(t))
        size += len(t or "")
        if size >= RUN:
            yield run
            run, size = [], 0
    if run:
        yield run


class Model:
    """Pieces and their probabilities by language. Words' log probabilities are kept, a bounded number of them."""

    KEEP = 100_000

    def __init__(self, pieces: Pieces, langs: list[str], prob: np.ndarray) -> None:
        self.pieces, self.langs, self.prob = pieces, langs, prob

    def open(self) -> None:
        wide = 8 * max(1, len(self.langs))
        self.keep, self.part = min(self.KEEP, TABLE // wide), max(1, TABLE // (wide * (LONG + 1)))
        self.row, self.table = {}, np.empty((self.keep, len(self.langs)))

    def close(self) -> None:
        self.row, self.table = {}, None
        release()

    def _learn(self, words: set[str]) -> None:
        """See that the words are in the table."""
        new = list(words.difference(self.row))
        if len(self.row) + len(new) > self.keep:
            self.row, new = {}, list(words)
            if len(new) > len(self.table) or len(self.table) > self.keep:
                self.table = np.empty((max(self.keep, len(new)), len(self.langs)))
        for at in range(0, len(new), self.part):
            part, first = new[at : at + self.part], len(self.row)
            self.row.update(zip(part, range(first, first + len(part)), strict=True))
            self.table[first : first + len(part)] = forward([(MARK + w).encode("utf-8", "replace") for w in part], self.pieces, self.prob)

    def texts(self, texts: list[str | None]) -> list[tuple[str, float, int]]:
        return [x for run in runs(texts) for x in self._run(run)]

    def _run(self, words_of: list[list[str]]) -> list[tuple[str, float, int]]:
        self._learn(set().union(*words_of))
        out = []
        for words in words_of:
            n = len(words)
            if not self.langs or not n:
                out.append(("und", 0.0, n))
                continue
            logs = self.table[list(map(self.row.__getitem__, words))].sum(0)
            best = int(np.argmax(logs))
            # the posterior at the weight of four words: long texts don't all saturate
            out.append((self.langs[best], float(1 / np.exp((logs - logs[best]) * min(1.0, 4 / n)).sum()), n))
        return out


def fit(docs: DataFrame, model_path: str, sample: int = SAMPLE, words: int = WORDS, longest: int = LONGEST, languages: int = LANGUAGES) -> Model:
    """Learn from ``docs`` (doc_id, text, lang). The bounds of the sample are described above."""
    few_rows(docs.sparkSession)
    taught = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")
    sizes = taught.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages)
    share = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) * F.col("count") < sample * 1_000_000
    chosen = taught.join(F.broadcast(sizes), "lang").where(share)  # languages rows at most
    counted = "lang string, word string, n long"
    shape = arrow_schema(counted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for langs, texts in ((b.column(0)[at : at + 64], b.column(1)[at : at + 64]) for at in range(0, b.num_rows, 64)):
                n = Counter((lang, w) for lang, text in zip(langs.to_pylist(), texts.to_pylist(), strict=True) for w in split(text) if len(w.encode("utf-8", "replace")) <= longest)
                yield batch([*(zip(*n, strict=True) if n else ([], [])), list(n.values())], shape)
        release()

    totals = mapped(chosen.select("lang", "text"), count, counted).groupBy("lang", "word").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    rows = totals.withColumn("r", F.row_number().over(order)).where(F.col("r") <= words).toArrow()
    pieces = Pieces(vocabulary(model_path))
    return Model(pieces, *learn(list(zip(*(rows[c].to_pylist() for c in ("lang", "word", "n")), strict=True)), pieces))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and n_words for each row of ``docs`` (doc_id, text)."""
    few_rows(docs.sparkSession)
    shape = arrow_schema(PREDICTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model.open()
        for b in batches:
            yield batch([b.column(0), *zip(*model.texts(b.column(1).to_pylist()), strict=True)], shape) if b.num_rows else batch([[], [], [], []], shape)
        model.close()

    return mapped(docs.select(F.col("doc_id").cast("long"), "text"), run, PREDICTED)


def keep_identified(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """Rows of ``docs`` (text and any others) with a language whose score is at least ``least``."""
    few_rows(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model.open()
        for b in batches:
            found = model.texts(b.column(at).to_pylist()) if b.num_rows else []
            yield b.filter(pa.array([lang != "und" and score >= least for lang, score, _ in found], pa.bool_()))
        model.close()

    return mapped(docs, run, docs.schema)
