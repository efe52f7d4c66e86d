"""Operator 4 against brute force."""
import random
import re

import numpy as np
import pytest

from vectrill.llm import line_dedup

SOLID = re.compile(r"[^\x20\x09-\x0D]")


def close(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i:] == b[i + 1 :] or a[i + 1 :] == b[i + 1 :] and len(a) == len(b)


def wanted(rows):
    """rows (doc_id, text): new texts, by brute force over all earlier lines."""
    unique = sorted({r for r in rows}, key=lambda r: (r[0] is None, r[0] or 0))
    seen, out = {}, {}
    for d, t in unique:
        if t is None:
            out[d, t] = None
            continue
        kept = []
        for x in t.split("\n"):
            if SOLID.search(x):
                first = x in seen
                near = len(x) >= line_dedup.SHORTEST and any(len(y) >= line_dedup.SHORTEST and close(x, y) for y in seen)
                # an equal line drops for its first occurrence's reason too
                if first or near:
                    seen.setdefault(x, 1)
                    continue
                seen[x] = 1
            kept.append(x)
        out[d, t] = "\n".join(kept)
    return sorted((str(d), str(out[d, t])) for d, t in rows)


def got(df):
    return sorted((str(r.doc_id), str(r.text)) for r in line_dedup.dedup_lines(df).collect())


def test_close():
    assert close("abc", "abd") and close("abc", "abcd") and close("abc", "bc") and close("", "a") and not close("abc", "bca") and not close("ab", "abcd")


def test_odd(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert got(odd) == wanted(rows)
    assert line_dedup.dedup_lines(odd).columns == odd.columns
    assert got(none) == []


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert got(docs) == wanted([(r.doc_id, r.text) for r in docs.collect()])


def test_edits(spark):
    rng = random.Random(3)
    rows = []
    for i in range(60):
        base = "".join(rng.choice("abcé ß🙂") for _ in range(rng.choice([5, 19, 20, 21, 22, 40, 41, 90, 300])))
        lines = []
        for _ in range(8):
            x = list(base)
            for _ in range(rng.choice([0, 1, 1, 2])):
                k = rng.randrange(len(x))
                x[k : k + rng.randrange(2)] = rng.choice(["", "z", "a"])
            lines.append("".join(x))
        rows.append((i, "\n".join(lines)))
    rows += [(100 + i, f"a numbered line with the number {i % 10}\n\n  \nend") for i in range(30)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == wanted(rows)
    counts = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), counts=True).collect()
    assert all(r.n_lines == r.n_repeated + r.n_near + r.n_kept for r in counts) and any(r.n_near for r in counts)


def test_halves_and_holes_are_necessary():
    """Any two lines within distance 1 share a half, and a hole that holds an edit from one to the other."""
    rng = random.Random(5)
    for n in (1, 2, 3, 7, 8, 9, 19, 20, 21, 22, 23, 25, 27, 28, 33, 39, 64, 65, 100, 257):
        base = [rng.choice("abc") for _ in range(n)]
        for k in range(n):
            for new in ("", "z", base[k] + "z"):
                pair = ["".join(base), "".join(base[:k] + [new] + base[k + 1 :])]
                lines = line_dedup.Lines(pair)
                if len(lines.size) < 2:
                    continue
                keys, count = lines.halves(np.array([0, 1]))
                assert set(keys[: count[0]].tolist()) & set(keys[count[0] :].tolist())
                made = [{}, {}]
                for _, head, tail, key in lines.holes(np.array([0, 1])):
                    for i in (0, 1):
                        places = np.arange(head[i], lines.size[i] - tail[i])
                        made[i][int(key[i])] = (places, lines.variants(i, places).tolist())
                met = set(made[0]) & set(made[1])
                one, other = ([x[m] for m in met] for x in made)
                if len(pair[0]) == len(pair[1]):
                    same = [set(zip(a[0].tolist(), a[1], strict=True)) & set(zip(b[0].tolist(), b[1], strict=True)) for a in one for b in other]
                    assert any(same)
                else:
                    long = other if len(pair[1]) > len(pair[0]) else one
                    whole = int(lines.hash[0 if long is other else 1])
                    assert any(whole in x[1] for x in long)


def test_parameters(spark):
    rows = [(1, "abcd\nxy\nabcd"), (2, "abce\nxyz\nabcd"), (3, "12\n13")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df) == [("1", "abcd\nxy"), ("2", "abce\nxyz"), ("3", "12\n13")]
    new = lambda **kw: {r.doc_id: r.text for r in line_dedup.dedup_lines(df, **kw).collect()}
    assert new(shortest=1) == {1: "abcd\nxy", 2: "", 3: "12"}
    assert new(shortest=1, edits=0) == {1: "abcd\nxy", 2: "abce\nxyz", 3: "12\n13"}
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(df, edits=2)
