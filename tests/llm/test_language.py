"""Operator 10: the forward sum against all segmentations, and held-out accuracy."""
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from vectrill.llm import language
from vectrill.llm._shared import held_out

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def total(word, prob):
    """Summed over all segmentations, one by one."""
    if not word:
        return np.ones(2)
    out = language.FLOOR * total(word[1:], prob)
    for k in range(1, len(word) + 1):
        if word[:k] in prob:
            out = out + prob[word[:k]] * total(word[k:], prob)
    return out


def test_forward_sums_all_segmentations():
    names = sorted([b"a", b"b", b"ab", b"ba", b"aba", b"bb", "é".encode()])
    table = np.random.default_rng(1).random((len(names), 2))
    pieces, prob = language.Pieces(names), dict(zip(names, table, strict=True))
    words = [b"a", b"abba", b"xababb", "éabé".encode(), b"zz", b"abababab"]
    want = np.log([total(w, prob) for w in words])
    assert np.allclose(language.forward(words, pieces, table), want)
    assert np.allclose([language.forward_scaled(w, pieces, table) for w in words], want)
    long = b"ab" * 40_000
    assert np.isfinite(language.forward_scaled(long, pieces, table)).all()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs.where(~held_out(F.col("doc_id"), 4)), MODEL)
    rows = language.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(held_out(F.col("doc_id"), 4)).where("lang_pred != 'und' AND lang IS NOT NULL").collect()
    right = sum(r.lang == r.lang_pred for r in rows) / len(rows)
    kept = language.keep_identified(docs, model).count() / docs.count()
    print("language held out:", right, "of", len(rows), "kept", kept)
    assert right >= 0.97 and kept >= 0.98


def test_odd(odd, none):
    model = language.fit(odd, MODEL)
    got = {(r.doc_id, r.lang_pred) for r in language.identify(odd, model).collect()}
    assert {(2, "und"), (3, "und"), (4, "und"), (11, "und"), (None, "und")} <= got and (8, "fr") in got
    assert language.identify(none, model).count() == 0
    assert {r.lang_pred for r in language.identify(odd, language.fit(none, MODEL)).collect()} == {"und"}
    assert language.keep_identified(odd, model).columns == odd.columns


def test_letters(spark):
    texts = ["½ ² Ⅷ ③ 12 _", "´ ̈", "x", "École", "Écoles ́a", "हिन्दी भाषा", "日本", "a̱b"]
    assert [language.split(t) for t in texts] == [[], [], ["x"], ["e\u0301cole"] if len("École") == 6 else ["école"], ["e\u0301coles", "a"] if len("École") == 6 else ["écoles", "a"], ["हिन्दी", "भाषा"], ["日本"], ["a̱b"]]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language.identify(df, language.fit(df, MODEL)).collect()}
    assert [got[i] for i in range(8)] == ["und"] * 2 + ["en"] * 6


def test_every_language_keeps_its_words():
    """EM against expected uses over all segmentations, and language by language."""
    names = sorted([b"a", b"b", b"ab", "▁".encode(), "▁a".encode(), b"ba"])
    pieces = language.Pieces(names)
    counts = [("x", "abab", 3), ("x", "ba", 1), ("y", "aab", 2), ("x", "cab", 1)]

    def segmentations(w):
        if not w:
            yield []
        for n in [p for p in names if w.startswith(p)]:
            for rest in segmentations(w[len(n) :]):
                yield [n, *rest]
        if w:
            for rest in segmentations(w[1:]):
                yield [None, *rest]

    for lang in "xy":
        prob = dict.fromkeys(names, 1 / len(names))
        for _ in range(language.ROUNDS):
            uses = dict.fromkeys(names, 0.0)
            for lg, word, n in counts:
                if lg == lang:
                    found = [(s, np.prod([prob.get(p, language.FLOOR) for p in s])) for s in segmentations((language.MARK + word).encode())]
                    all_ = sum(p for _, p in found)
                    for s, p in found:
                        for piece in s:
                            if piece:
                                uses[piece] += n * p / all_
            total_ = sum(uses.values())
            prob = {p: (u + 0.01) / (total_ + 0.01 * len(names)) for p, u in uses.items()}
        langs, got = language.learn(counts, pieces)
        assert np.allclose(got[:, langs.index(lang)], [prob[p] for p in names])


def test_memory_is_bounded_by_run_and_table(spark):
    """Many languages and new words in each text: neither a batch's forward sums nor the words kept may add up."""
    import tracemalloc

    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 12))
    rows = [(i, f"{word()} {word()}", f"l{i % 40}") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model, texts = language.fit(df, MODEL), [" ".join(word() for _ in range(100)) for _ in range(250)]
    model.open()
    tracemalloc.start()
    got = model.texts(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6, peak
    assert got == [x for t in texts for x in model.texts([t])]
