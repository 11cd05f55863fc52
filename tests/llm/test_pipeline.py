import corpus_pipeline
from tallyroll.llm import mixing, ngram_join, quality


def test_stages_follow_each_other(spark, documents):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "ngram_jaccard_join", "secret_scans", "mix_sources", "sentencepiece_codec"]
    folder = "/root/testdata/sf0.001"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    docs, seen = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        seen[name] = out.collect()
        if name != names[-1]:
            assert out.columns == documents.columns
            docs = spark.createDataFrame(seen[name], documents.schema)
    judged = quality.quality_rules(documents, labels).filter("kept")
    assert sorted(r["doc_id"] for r in judged.collect()) == sorted(r["doc_id"] for r in seen["quality_rules"])
    groups = ngram_join.similar_groups(spark.createDataFrame(seen["quality_rules"], documents.schema), ngram_join.Rule(5, 80))
    assert sorted(r["component_id"] for r in groups.select("component_id").distinct().collect()) == sorted(r["doc_id"] for r in seen["ngram_jaccard_join"])
    assert len(seen["secret_scans"]) == len(seen["ngram_jaccard_join"])
    taken = mixing.taken(spark.createDataFrame(seen["secret_scans"], documents.schema)).collect()
    assert sorted(r["doc_id"] for r in seen["mix_sources"]) == sorted(r["doc_id"] for r in taken for _ in range(r["copies"]))
    assert len(seen["sentencepiece_codec"]) == len(seen["mix_sources"])
    assert corpus_pipeline.run(spark, folder).count() == len(seen["mix_sources"])


def write_folder(folder, docs, labels):
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_odd_empty_and_clashing_tables(spark, odd, empty, clashing, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows, empty tables and columns of the operators' own names."""
    labels = spark.createDataFrame([(6, 1, 0), (7, 0, 0), (None, 1, 0), (4, None, None), (6, 1, 0)], "doc_id long, quality int, toxic int")
    none = labels.limit(0)
    for name, docs, marks in (("odd", odd, labels), ("clashing", clashing, labels), ("empty", empty, none), ("bare", odd, none)):
        folder = write_folder(tmp_path / name, docs, marks)
        stage_docs = docs
        for stage, fn in corpus_pipeline.STAGES[:-1]:
            stage_docs = fn(spark, stage_docs, folder)
            assert stage_docs.columns == docs.columns, (name, stage)
        rows = corpus_pipeline.run(spark, folder).collect()
        assert (len(rows) > 0) == (name != "empty"), name
        # What the last stage encodes are texts that the stage before it kept, masked and mixed.
        assert {r["doc_id"] for r in rows} <= {r["doc_id"] for r in docs.select("doc_id").collect()}
