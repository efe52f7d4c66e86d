"""The stages against the brute force of their operators, and what each must keep and drop."""
import corpus_pipeline as P
from test_line_dedup import wanted as lines_wanted
from test_native import contamination
from test_near_dedup import wanted as near_wanted


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = P.identify(spark, docs, sf).cache()
    assert kept.columns == docs.columns and kept.count() >= 0.98 * docs.count()
    cut = P.lines(spark, kept, sf).cache()
    assert cut.columns == docs.columns
    assert sorted((str(d), t) for d, t in pairs(cut)) == [(d, t) for d, t in lines_wanted(pairs(kept)) if t.split()]
    apart = P.near(spark, cut, sf).cache()
    assert apart.columns == docs.columns
    assert sorted(str(d) for d, _ in pairs(apart)) == sorted(d for d, _, _, k in near_wanted(pairs(cut), 5) if k)
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    good = P.clean(spark, apart, sf).cache()
    assert good.columns == docs.columns
    dirty = {d for d, *_, bad in contamination(pairs(apart), [(r.item_id, r.text) for r in bench.collect()], 10) if bad}
    assert sorted(str(d) for d, _ in pairs(good)) == sorted(str(d) for d, _ in pairs(apart) if str(d) not in dirty)
    packed = P.pack(spark, good, sf)
    ids = {r.doc_id for r in packed.select("doc_id").distinct().collect()}
    assert ids == {d for d, _ in pairs(good)}
    assert sorted(map(tuple, P.run(spark, sf).select("doc_id", "doc_tokens").distinct().collect())) == sorted(map(tuple, packed.select("doc_id", "doc_tokens").distinct().collect()))


def test_stages_on_odd_rows(spark, sf, odd, none):
    for docs in (odd.select("doc_id", "text", "lang", "source", "n_chars"), none.select("doc_id", "text", "lang", "source", "n_chars")):
        for _, stage in P.STAGES:
            docs = stage(spark, docs, sf).cache()
            docs.count()


def test_rows_that_share_an_id(spark, sf):
    """Rows are told apart by their texts: nothing kept is lost, nothing contaminated or repeated stays."""
    text = " ".join(f"word{i}" for i in range(40))
    item = spark.read.parquet(f"{sf}/benchmark.parquet").where("length(text) > 80").first().text
    rows = [(5, "something else that nobody has said before today", "en", "a", 1), (5, text, "en", "a", 1), (4, text, "en", "a", 1), (4, text, "en", "a", 1), (None, item, "en", "a", 1), (None, "another text without an id that is quite short", "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = P.clean(spark, P.near(spark, docs, sf).cache(), sf)
    assert sorted((str(d), t) for d, t in pairs(left)) == sorted((str(d), t) for d, t in {(r[0], r[1]) for r in (rows[0], rows[2], rows[5])})
