"""Each stage of the pipeline on what its predecessor kept, against brute force."""

import corpus_pipeline
from pathspring.llm import quality
from pathspring.llm._store import written
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(written(stage(spark, kept[-1] if kept else docs, SF), "stage"))
        assert kept[-1].columns == columns
    good, single, once, clean = kept

    judged = quality.classify(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert {d for d, _ in pairs(good)} == {r["doc_id"] for r in judged.filter("accepted").collect()}

    want = brute.near(pairs(good), 80, 100)
    assert {d for d, _ in pairs(single)} == {d for d, (_, c) in want.items() if c == d}

    want = brute.substring(pairs(single))
    for r in once.collect():
        assert brute.sha(" ".join(brute.spaced(r["text"]))) == want[r["doc_id"]][2]
        assert r["n_chars"] == len(r["text"])
    same = {d for d, (_, n, _) in want.items() if n == 0}
    before = dict(pairs(single))
    assert all(t == before[d] for d, t in pairs(once) if d in same)

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = brute.decontaminated(pairs(once), items)
    assert {d for d, _ in pairs(clean)} == {d for d, x in want.items() if not x[4]}

    mixed = corpus_pipeline.STAGES[-1][1](spark, clean, SF).collect()
    assert {r["doc_id"] for r in mixed} == {d for d, _ in pairs(clean)}
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in mixed)
    assert sorted(mixed) == sorted(corpus_pipeline.run(spark, SF).collect())


def test_stages_on_odd_rows(spark):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "a", 0), (2, "word", None, None, 4)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = docs
    for _, stage in corpus_pipeline.STAGES:
        kept = written(stage(spark, kept, SF), "odd")
    assert kept.count() == 3


def test_stages_on_repeated_rows_and_other_columns(spark):
    text = " ".join(f"word{i}" for i in range(60))
    made = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (2, text, "en", "b", 1), (3, " ".join(f"other{i}" for i in range(40)), "en", "b", 1), (3, "short", "en", None, 5), (None, text, "en", "a", 1)]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", "'x' as key", "'x' as row", "'x' as bucket", "'x' as kept", "'x' as perplexity", "'x' as size", "'x' as w", "'x' as c0")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = written(stage(spark, kept, SF), "stage")
        assert kept.columns == docs.columns and kept.filter("key <> 'x' or c0 <> 'x'").count() == 0
    assert sorted(pairs(kept), key=str) == sorted([(1, text), (1, text), *pairs(docs.filter("doc_id = 3")), (None, text)], key=str)
    assert corpus_pipeline.STAGES[-1][1](spark, kept, SF).count() == 5


def test_stages_on_empty_tables(spark):
    kept = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        kept = written(stage(spark, kept, SF), "empty")
        assert kept.count() == 0


def test_leaks_without_an_id_are_removed(spark):
    passage = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    docs = spark.createDataFrame([(None, passage, "en", "a", 1), (None, "clean words", "en", "a", 1), (1, passage, "en", "a", 1), (2, "clean", "en", "a", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.benchmark_leaks(spark, docs, SF)
    assert kept.columns == docs.columns and sorted(pairs(kept), key=str) == [(2, "clean"), (None, "clean words")]
