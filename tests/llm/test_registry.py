import duckdb
import pytest

from keystrata.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", registry.SQL)
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = registry.QUERIES[name](spark, SF)
    want = db.sql(registry.SQL[name])
    at = [want.columns.index(c) for c in found.columns]
    assert sorted(map(tuple, found.collect()), key=str) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == [*corpus_pipeline.COLUMNS, "copy"]
    ids = {r["doc_id"] for r in out.select("doc_id").collect()}
    assert ids and ids <= {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert out.groupBy("doc_id").count().selectExpr("max(count)").first()[0] <= 3
