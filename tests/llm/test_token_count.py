"""Operator 3 against the tokenizer library's own unigram encoder over the same vocabulary and scores."""
import math
import random
import struct

import public_tokenizers
import pytest
import sentencepiece

from vectrill.llm import token_count

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def varint(b, at):
    n = shift = 0
    while True:
        n |= (b[at] & 127) << shift
        at, shift = at + 1, shift + 7
        if b[at - 1] < 128:
            return n, at


def coded(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def fields(b):
    """(number, wire type, value, raw) of each field of a protocol buffer."""
    at = 0
    while at < len(b):
        first = at
        key, at = varint(b, at)
        kind = key & 7
        if kind == 0:
            value, at = varint(b, at)
        elif kind == 2:
            n, at = varint(b, at)
            value, at = b[at : at + n], at + n
        else:
            n = 4 if kind == 5 else 8
            value, at = b[at : at + n], at + n
        yield key >> 3, kind, value, b[first:at]


@pytest.fixture(scope="module")
def unigram():
    """The file as a unigram model, whose scores are those of ``token_count``."""
    out, rank = b"", 0
    with open(MODEL, "rb") as f:
        data = f.read()
    for number, _, value, raw in fields(data):
        if number == 1:
            piece = {n: v for n, _, v, _ in fields(value)}
            normal = piece.get(3, 1) == 1
            score = -round(token_count.STEPS * math.log(rank + 1)) / token_count.STEPS if normal else 0.0
            rank += normal
            body = b"\x0a" + coded(len(piece[1])) + piece[1] + b"\x15" + struct.pack("<f", score) + b"\x18" + coded(piece.get(3, 1))
            out += b"\x0a" + coded(len(body)) + body
        elif number == 2:
            body = b"".join(b"\x18\x01" if n == 3 else r for n, _, _, r in fields(value))
            out += b"\x12" + coded(len(body)) + body
        else:
            out += raw
    return sentencepiece.SentencePieceProcessor(model_proto=out)


def test_random_texts(unigram):
    rng, c = random.Random(1), token_count.Counter(token_count.vocabulary(MODEL))
    alphabet = ["the ", "ing", "a", "e", " ", "  ", "\n", "é", "ß", "日", "🙂", "1", ".", "ation", "▁", "\t", "x"]
    for _ in range(2000):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 40)))
        assert c.count(t) == len(unigram.encode(t)), repr(t)


def test_documents(spark, sf, unigram):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = sorted((r.doc_id, len(r.text), len(unigram.encode(r.text))) for r in docs.collect() if r.text is not None and len(r.text) < 30_000)
    got = {tuple(r) for r in token_count.count_tokens(docs, MODEL).collect()}
    assert set(want) <= got and len(got) == docs.count()


def test_odd(odd, none):
    c = token_count.Counter(token_count.vocabulary(MODEL))
    got = sorted((str(r.doc_id), r.n_chars, r.n_tokens) for r in token_count.count_tokens(odd, MODEL).collect())
    assert got == sorted((str(r.doc_id), len(r.text or ""), c.count(r.text)) for r in odd.collect())
    assert token_count.count_tokens(none, MODEL).count() == 0


def test_very_long_texts(spark, unigram):
    """Whole: one run of the dynamic programme over all characters, and the tokenizer on parts that blanks keep apart."""
    c, rng = token_count.Counter(token_count.vocabulary(MODEL)), random.Random(3)
    words = ["the", "station", "ing", "é", "日本", "x" * 40, "", "a.b,c", "🙂"]
    parts = [" ".join(rng.choice(words) for _ in range(400)) + " end" for _ in range(40)]
    text = " ".join(parts)
    assert len(text) > 60_000
    whole = c.viterbi(token_count.SPACE + text.replace(" ", token_count.SPACE))
    got = token_count.count_tokens(spark.createDataFrame([(1, text), (2, "y" * 50_000)], "doc_id long, text string"), MODEL).collect()
    assert [r.n_tokens for r in sorted(got)] == [whole, c.viterbi(token_count.SPACE + "y" * 50_000)]
    assert c.count(parts[0]) == len(unigram.encode(parts[0]))
