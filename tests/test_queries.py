"""Every registered query of the library against its SQL."""

import pytest
from oracle import compare
from quillwork import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_against_sql(spark, small, name):
    df = queries.QUERIES[name](spark, small)
    if name in queries.SQL:
        assert compare(df, queries.SQL[name], small) == ""
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(queries.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_probing_all_lists_is_exact_and_some_recall_well(spark, small):
    from pyspark.sql import functions as F
    from quillwork.operators import dense

    rows = queries.table(spark, small, "embeddings")
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    exact = {(r.qid, r.doc_id) for r in dense.search(rows, asked, doc_id="vec_id").collect()}
    index, centroids = dense.coarse_index(rows, 22, doc_id="vec_id", sample_rows=400)
    found = {(r.qid, r.doc_id) for r in dense.probe(index, centroids, asked, probes=22).collect()}
    assert found == exact
    some = {(r.qid, r.doc_id) for r in dense.probe(index, centroids, asked).collect()}
    assert len(some & exact) >= 0.9 * len(exact)


def test_query_vectors_in_blocks(spark, small, monkeypatch):
    from quillwork.operators import dense

    rows = queries.table(spark, small, "embeddings")
    asked = rows.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "qid")
    whole = sorted(map(tuple, dense.search(rows, asked, doc_id="vec_id").select("qid", "doc_id", "rank").collect()))
    monkeypatch.setattr(dense, "QUERY_BYTES", 1500)
    assert sorted(map(tuple, dense.search(rows, asked, doc_id="vec_id").select("qid", "doc_id", "rank").collect())) == whole


def test_few_lists_of_clustered_vectors_recall_well(spark, small):
    import numpy as np
    from pyspark.sql import functions as F
    from quillwork.operators import dense

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 64))
    held = spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding").collect()
    rows = spark.createDataFrame([(r.vec_id, (np.array(r.embedding) / np.linalg.norm(r.embedding) * 4 + centres[r.vec_id % 40]).tolist()) for r in held], "vec_id long, embedding array<double>")
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    exact = {(r.qid, r.doc_id) for r in dense.search(rows, asked, 10, doc_id="vec_id").collect()}
    index, centroids = dense.coarse_index(rows, 40, doc_id="vec_id")
    some = {(r.qid, r.doc_id) for r in dense.probe(index, centroids, asked, 10, probes=4).collect()}
    assert len(some & exact) >= 0.9 * len(exact)
    assert index.count() == rows.count()
