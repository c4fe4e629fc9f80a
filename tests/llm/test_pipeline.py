"""The pipeline, stage by stage, against plain versions on the small tables."""

import corpus_pipeline

from tabloom.llm import decontaminate, near, quality
from tabloom.session import work_path
from tests.llm.test_dedup import brute


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, texts = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        path = work_path(spark, name)
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        kept.append({r.doc_id: r for r in docs.collect()} if name != "packing" else docs)
        assert name == "packing" or docs.columns == columns
    good, apart, cut, clean, packed = kept
    judged = {i: quality.judge(t) for i, t in texts.items()}
    assert {i: r.text for i, r in good.items()} == {i: j[1] for i, j in judged.items() if j[0][6]}
    assert set(apart) == {i for i, v in brute({i: r.text for i, r in good.items()}).items() if v[2]}
    words = {i: near.text_words(r.text) for i, r in cut.items()}
    seen = {}
    for i, w in words.items():
        for k in range(len(w) - 49):
            assert seen.setdefault(tuple(w[k:k + 50]), i) == i
    assert set(cut) <= set(apart) and all(r.n_chars == len(r.text) for r in cut.values())
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    own = decontaminate.automaton(items)
    assert set(clean) == {i for i, r in cut.items() if not decontaminate.scan(r.text, own)[1]}
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(clean)
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").count() == 0
    ran = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, ran.collect())) == sorted(map(tuple, packed.select(ran.columns).collect()))


def test_stages_of_nothing(spark, sf):
    """An empty table, and one of which the first stage keeps nothing, pass through all stages."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for start in (docs.limit(0), docs.limit(3).withColumn("text", docs.doc_id.cast("string"))):
        now = start
        for name, stage in corpus_pipeline.STAGES:
            path = work_path(spark, name)
            stage(spark, now, sf).write.parquet(path)
            now = spark.read.parquet(path)
            assert now.count() == 0
            assert name == "packing" or now.columns == docs.columns


def test_repeated_ids(spark, sf):
    """Rows with one id and different texts are documents that stay or go together."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) > 600").limit(30)
    twice = docs.unionByName(docs.withColumn("doc_id", docs.doc_id * 0 + 7))
    now = twice
    for name, stage in corpus_pipeline.STAGES:
        path = work_path(spark, name)
        stage(spark, now, sf).write.parquet(path)
        now = spark.read.parquet(path)
    pieces = now.groupBy("doc_id", "piece", "start").count().count()
    assert now.count() >= pieces > 0
