import corpus_pipeline
from tests.llm.helpers import documents, edge_rows


def test_stages_keep_columns_and_clean_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    out = corpus_pipeline.run(spark, sf)
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "exact_dedup", "simhash_near_dedup", "decontamination", "byte_bpe"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == columns
    kept = {r.doc_id for r in out.select("doc_id").collect()}
    assert 600 < len(kept) < 950
    assert out.where("decoded_sha256 is null").count() == 0


def test_stages_take_edges(spark):
    docs = documents(spark, edge_rows(), clashes=True)
    empty = documents(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "/root/testdata/sf0.001").count() > 0
        assert stage(spark, empty, "/root/testdata/sf0.001").count() == 0
