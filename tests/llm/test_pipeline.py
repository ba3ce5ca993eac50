import corpus_pipeline
from pyspark.sql import functions as F

from strataline.llm import decontaminate, lines, simhash


def test_stages_decide_what_they_say(spark, docs, corpus, tmp_path):
    labels = spark.createDataFrame([(r[0], 1) for r in corpus[::2]] + [(1, 0)], "doc_id bigint, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(9, corpus[7][1])], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path)).persist()
        before, after = {r.doc_id: r for r in now.collect()}, {r.doc_id: r for r in out.collect()}
        assert set(after) <= set(before) and (k == 4 or out.columns == now.columns)
        if k == 1:
            want = {r.doc_id: r.text for r in lines.dedup_lines(now).collect()}
            assert {i: r.text for i, r in after.items()} == want
            assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in after.values())
        elif k == 2:
            ids = {r.doc_id: r.component_id for r in simhash.near_duplicates(now).collect()}
            assert set(after) == set(ids.values())
        elif k == 3:
            bench = spark.read.parquet(f"{tmp_path}/benchmark.parquet")
            hit = {r.doc_id for r in decontaminate.contamination(now, bench).where("contaminated").collect()}
            assert hit and set(after) == set(before) - hit
        now = out
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in got.collect()} == {r.doc_id for r in now.collect()}
    assert got.where(F.col("mix_probability") > 1).count() == 0


def test_empty_table(spark, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1)], "doc_id bigint, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "a b c")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
