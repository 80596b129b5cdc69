"""The k-means tree against brute force."""

import math

import numpy as np
import pytest
from quillwork.llm import queries, vector_tree
from quillwork.llm.storage import Scratch


def exact(rows, asked, k):
    """Scores summed component by component, like the operator's."""
    ids = np.array([r[0] for r in rows])
    x = np.stack([np.asarray(r[1], np.float64) for r in rows])
    out = {}
    for q, v in asked:
        s = np.zeros(len(ids))
        for c in range(x.shape[1]):
            s += np.float64(v[c]) * x[:, c]
        best = [(int(i), float(t)) for i, t in sorted(zip(ids, s, strict=True), key=lambda p: (-p[1], p[0])) if i != q]
        out[q] = best[:k]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_query_recall(spark, small):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    want = exact(rows, [r for r in rows if r[0] % 20 == 0], 20)
    got = found(queries.op13_vector_tree(spark, small))
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    scores = {q: dict(exact(rows, [(q, dict(rows)[q])], len(rows))[q]) for q in list(want)[:5]}
    assert all(s == scores[q][i] for q in scores for i, s in got[q])
    assert np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want]) >= 0.9


def test_many_leaves_reach_the_recall_and_visit_few_on_clustered_vectors(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(50, 16))
    x = (centres[rng.integers(0, 50, 4000)] + 0.15 * rng.normal(size=(4000, 16))).astype(np.float32).astype(np.float64)
    rows = [(k, x[k].tolist()) for k in range(4000)]
    df = spark.createDataFrame(rows, "id long, vector array<double>").cache()
    with Scratch(spark) as scratch:
        index = vector_tree.build(scratch, df, k=10, leaf_rows=50, calibration=100)
        assert index.tree.leaves >= 60 and index.sizes.sum() == 4000
        assert index.recall >= 0.95 and index.least <= index.tree.leaves // 4
        asked = df.where("id % 40 = 0")
        got = {}
        for r in index.search(scratch, asked, 10).collect():
            got.setdefault(r.query, set()).add((r.id, r.score))
    want = exact(rows, rows[::40], 10)
    assert np.mean([len(got[q] & set(want[q])) / 10 for q in want]) >= 0.9


def test_a_third_of_equal_vectors_goes_by_id(spark):
    rng = np.random.default_rng(5)
    rows = [(k, [1.0, 2.0, 3.0] if k % 3 == 0 else rng.normal(size=3).tolist()) for k in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(vector_tree.search(df, df.where("vec_id % 100 = 0"), 20, recall=1.0))
    want = exact(rows, rows[::100], 20)
    hot = [q for q in want if q % 3 == 0]
    assert hot and all(got[q] == want[q] for q in hot)
    assert np.mean([len(set(got[q]) & set(want[q])) / 20 for q in want]) >= 0.9


def test_queries_in_blocks(spark, small, monkeypatch):
    rows = spark.read.parquet(f"{small}/embeddings.parquet")
    whole = found(vector_tree.search(rows, rows.where("vec_id % 25 = 0"), leaf_rows=32))
    monkeypatch.setattr(vector_tree, "QUERY_BYTES", 2000)
    assert found(vector_tree.search(rows, rows.where("vec_id % 25 = 0"), leaf_rows=32)) == whole


def test_any_rows(spark):
    nan = math.nan
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [0.5, 1.0], 1), (3, None, 1), (4, [0.0, 0.0], 1), (5, [nan, 1.0], 1), (6, [math.inf, 1.0], 1), (7, [None, 1.0], 1), (None, [1.0, 1.0], 1), (8, [], 1), (9, [2.0], None), (10, [0.5, 1.0], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, ID int")
    assert found(vector_tree.search(df, top_k=2)) == {1: [(9, 2.0), (2, 0.5)], 2: [(10, 1.25), (9, 1.0)], 9: [(1, 2.0), (2, 1.0)], 10: [(2, 1.25), (9, 1.0)]}
    assert found(vector_tree.search(df, df.where("vec_id = 2"), top_k=50)) == {2: [(10, 1.25), (9, 1.0), (1, 0.5)]}
    assert vector_tree.search(df.limit(0)).count() == 0 and vector_tree.search(df, df.limit(0)).count() == 0
    one = df.where("vec_id = 9")
    assert vector_tree.search(one).count() == 0
    longer = spark.createDataFrame([(77, [1.0, 1.0, 5.0])], "vec_id long, embedding array<double>")
    assert found(vector_tree.search(df, longer, 1)) == {77: [(9, 2.0)]}
    with pytest.raises(ValueError):
        vector_tree.search(df, top_k=0)
