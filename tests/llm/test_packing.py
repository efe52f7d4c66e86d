"""Operator 9: an exact round trip."""
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from vectrill.llm import packing

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("name,fan", [("odd", 256), ("sf", 256), ("sf", 2), ("none", 256)])
def test_round_trip(request, spark, name, fan, monkeypatch):
    monkeypatch.setattr(packing, "FAN", fan)
    docs = spark.read.parquet(request.getfixturevalue("sf") + "/documents.parquet").repartition(7) if name == "sf" else request.getfixturevalue(name)
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    ids = {}
    for (_, t), e in zip(rows, Tokenizer.from_file(FILE).encode_batch([t for _, t in rows], add_special_tokens=False), strict=True):
        ids[t] = np.array([*e.ids, 0], np.uint32)
    got = packing.pack(docs, FILE).collect()
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id, r.doc_tokens].append((r.start, r.length, r.ids_crc32))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at and length > 0
            at += length
        assert at <= 1024
    want = Counter()
    for d, t in rows:
        want[d, len(ids[t])] += 1
    assert {k: sum(n for _, n, _ in v) for k, v in pieces.items()} == {k: k[1] * n for k, n in want.items()}
    by_id = {(d, len(ids[t])): ids[t] for d, t in rows}
    for k, v in pieces.items():
        if want[k] == 1:
            at = 0
            for start, n, crc in sorted(v):
                assert start == at and crc == zlib.crc32(by_id[k][at : at + n].astype("<u4").tobytes())
                at += n
    if rows:
        assert len(sequences) <= -(-sum(len(ids[t]) for _, t in rows) // 1024) + 1
