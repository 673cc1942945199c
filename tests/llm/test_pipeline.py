import corpus_pipeline as c
from tests.llm import test_decontaminate, test_linedup, test_neardup, test_packing, test_quality


def brute(docs, items):
    """Kept (doc_id, text) after each stage, from rows (doc_id, text, source)."""
    verdict = test_quality.brute(docs, 10, 0.005)
    docs = [d for d, v in zip(docs, verdict) if v[4]]
    yield [d[:2] for d in docs]
    docs = [(i, t) for i, t, _, _ in test_linedup.brute(docs, 0.02, 5)]
    yield docs
    heads = {i for i, head in test_neardup.brute(docs) if i == head}
    docs = [d for d in docs if d[0] in heads]
    yield docs
    bad = {i for i, _ in test_decontaminate.brute(docs, items)}
    docs = [d for d in docs if d[0] not in bad]
    yield docs


def test_stages_against_brute_force(spark, data):
    given = spark.read.parquet(f"{data}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    wanted = brute([(r.doc_id, r.text, r.source) for r in given.collect()], items)
    docs = given
    for (name, stage), want in zip(c.STAGES, wanted):
        docs = c.stored(stage(spark, docs, data), "stage")
        assert docs.columns == given.columns
        got = sorted((r.doc_id, r.text) for r in docs.collect())
        assert got == sorted(want), name
        assert 100 < len(got) <= given.count()
    rows = c.run(spark, data).collect()
    test_packing.check_rows(rows, want)


def test_first_stage_removes_lines(spark, data):
    """A line in 1% of the documents of a host is above the limits of the first stage alone."""
    words = lambda i: " ".join(f"w{i}x{k}" for k in range(20))
    rows = [(i, words(i) + ("\nthe same line" if i % 100 == 0 else ""), "en", "s", None) for i in range(1200)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{data}/documents.parquet").schema)
    out = c.quality_rules(spark, docs, data).collect()
    assert len(out) == 1200 and [r.doc_id for r in out if "same line" in r.text] == [0]


def test_edges(spark, data):
    schema = spark.read.parquet(f"{data}/documents.parquet").schema
    words = " ".join(f"word{i}" for i in range(40))
    rows = [(1, words, "en", None, 1), (1, words, "en", None, 1), (None, words + " end", None, "s", None), (2, None, None, None, None), (3, "", "", "", 0)]
    for given, left in ((rows, 1), ([], 0)):
        docs = spark.createDataFrame(given, schema)
        for _, stage in c.STAGES[:-1]:
            docs = c.stored(stage(spark, docs, data), "stage")
            assert docs.columns == schema.names
        assert docs.count() == left
        assert {r.doc_id for r in c.packing(spark, docs, data).collect()} == {1 for _ in range(left)}
