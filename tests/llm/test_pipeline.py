"""Each stage of the pipeline against a plain version, on what the stage before it kept."""

import duckdb
from pyspark.sql import functions as F

import corpus_pipeline
from docledger.llm import langid, mixing
from tests.llm import plain

SMALL = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{n}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{n}")
        kept[name] = docs.collect()
        rows = before.collect()
        if n < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert all(r.n_chars == len(r.text) for r in kept[name] if n >= 2)
        check = [language, near_copies, repeats, benchmarks, mix][n]
        check(spark, before, rows, kept[name], f"{tmp_path}/{n - 1}")
    again = corpus_pipeline.run(spark, SMALL).collect()
    assert sorted(map(str, again)) == sorted(map(str, kept["mix"]))


def language(spark, before, rows, kept, _):
    said = {r.doc_id for r in langid.languages(before).collect() if r.lang_pred != "und" and r.score >= corpus_pipeline.LEAST_SCORE}
    assert {r.doc_id for r in kept} == said and len(said) >= 0.97 * len(rows)


def near_copies(spark, before, rows, kept, _):
    groups = plain.components([(r.doc_id, r.text) for r in rows], 5, 80)
    assert sorted(r.doc_id for r in kept) == sorted({c for _, _, c in groups}) and len(kept) < len(rows)


def repeats(spark, before, rows, kept, _):
    want = {d: (n, gone) for d, n, gone, *_ in plain.repeats([(r.doc_id, r.text) for r in rows])}
    text = {r.doc_id: r.text for r in kept}
    for doc, (size, gone) in want.items():
        left = len(text.get(doc, "").encode())
        assert size - gone <= left <= size - gone + 6 * 20 or doc not in text and size - gone < 60
    assert any(gone for _, gone in want.values())


def benchmarks(spark, before, rows, kept, _):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    short = [(r.doc_id, r.text) for r in rows if len(r.text) <= 800]
    leaked = {doc for doc, _ in plain.leaks(items, short)}
    left = {r.doc_id for r in kept}
    assert {doc for doc, _ in short} - left == leaked
    assert not any(item in r.text for r in kept for _, item in items)


def mix(spark, before, rows, kept, path):
    want = duckdb.sql(mixing.SQL.format(docs=f"'{path}/*.parquet'")).fetchall()
    assert sorted((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in kept) == sorted(x for x in want if x[4] > 0)


STRANGE = ("id", "doc", "first", "row", "component_id", "score", "lang_pred", "size", "taken", "leaked", "start", "kept", "key", "n")


def awkward(spark):
    """Some documents of the small table, and what no document should be."""
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").limit(80).collect()
    one, two, three = [r.text for r in rows if r.lang == "en" and 400 < len(r.text) < 3000][:3]
    long = " ".join(f"{w}{n % 977}" for n, w in enumerate((one + " " + two).split() * 150))
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").orderBy("item_id").first().text
    more = [
        (None, "The old mill by the river was sold to a young family in the spring of that year.", "en", "web", 1), (9001, None, "en", "web", None), (9002, "", "en", "web", 0), (9003, " \n\t ", None, None, None),
        (9004, "12 34 !!", "en", "web", 8), (9005, one[::-1].title(), None, None, None), (9006, three + " Once more.", "en", "web", 5), (9006, three + " Once more.", "en", "web", 5), (9007, three + " Once more.", "en", "shop", 5), (9008, long, "en", "web", len(long)),
        (9009, item, "en", "web", len(item)), (None, item, None, None, None),
    ]
    docs = spark.createDataFrame([tuple(r) for r in rows], spark.read.parquet(f"{SMALL}/documents.parquet").schema).unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long"))
    return docs, item, long


def ids(frame):
    return sorted((r.doc_id for r in frame.select("doc_id").collect() if r.doc_id is None or r.doc_id > 9000), key=str)


def test_awkward_rows(spark):
    """Nulls in every column, blank and very long texts, repeated rows and clashing columns, in each stage by itself."""
    docs, item, long = awkward(spark)
    docs = docs.select("*", *(F.lit(name).alias(name) for name in STRANGE)).cache()
    stages = dict(corpus_pipeline.STAGES)
    assert ids(stages["language"](spark, docs, SMALL)) == [9005, 9006, 9006, 9007, 9008, 9009, None, None]
    assert ids(stages["near copies"](spark, docs, SMALL)) == [9001, 9002, 9003, 9004, 9005, 9008, 9009, None]  # 9006 and 9007 are near copies of a document of the table
    cut = {(r.doc_id, r.text) for r in stages["repeats"](spark, docs, SMALL).select("doc_id", "text").collect()}
    assert {(9001, ""), (9002, ""), (9003, " \n\t "), (9004, "12 34 !!")} <= cut
    assert 9006 in {d for d, _ in cut} and 9007 not in {d for d, _ in cut}
    clean = stages["benchmarks"](spark, docs, SMALL)
    assert ids(clean) == [9001, 9002, 9003, 9004, 9005, 9006, 9006, 9007, 9008]  # the null id of a leak takes its other row along
    mixed = stages["mix"](spark, docs, SMALL).collect()
    assert not {9001, 9002, 9003} & {r.doc_id for r in mixed} and all(0 < r.taken <= 2 * r.size for r in mixed)
    docs.unpersist()


def test_empty_tables(spark):
    empty = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        got = stage(spark, empty, SMALL)
        assert got.count() == 0 and (n == 4 or got.columns == empty.columns)
