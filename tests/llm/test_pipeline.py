import corpus_pipeline


def test_stages_keep_clean_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}
    columns = docs.columns
    before = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids <= before
        if name == "quality":
            assert len(good & ids) > 0.9 * len(good)
        if name != "mixing":
            assert docs.columns == columns
        before = ids
    assert {"size", "source_size", "target", "taken", "text"} <= set(docs.columns)
