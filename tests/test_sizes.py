"""What larger tables need: work that is bounded and distributed, with the rows of the SQL."""

import random

import numpy as np
import pytest
from quillwork import queries
from quillwork.operators import best, bm25, concepts, dense


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def brute(rows, asked, top_k):
    out = {}
    for qid, q in asked:
        near = [(-round(float(np.dot(v, q) / np.linalg.norm(v) / np.linalg.norm(q)), 9), i) for i, v in rows if v is not None and len(v) == len(q) and np.any(v)]
        out[qid] = [i for _, i in sorted(near)[:top_k]]
    return out


def ranked(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.qid, r.rank)):
        out.setdefault(r.qid, []).append(r.doc_id)
    return out


@pytest.mark.parametrize("cells,most", [(1 << 20, 500_000), (640, 70)])
def test_exact_search_takes_products_of_matrices(spark, monkeypatch, cells, most):
    monkeypatch.setattr(best, "CELLS", cells)
    monkeypatch.setattr(dense, "BEST_ROWS", most)
    rng = np.random.default_rng(5)
    held = [(f"d{k:04}", rng.normal(size=8).tolist()) for k in range(600)]
    held += [(f"a{k:04}", [3.7 * x for x in held[k][1]]) for k in range(300)]
    held += [("z0", None), ("z1", [0.0] * 8), ("z2", [1.0, 2.0])]
    asked = [(k, rng.normal(size=8).tolist()) for k in range(20)] + [(20 + k, held[k][1]) for k in range(10)] + [(30, [1.0, 2.0])]
    rows = spark.createDataFrame(held, "doc_id string, embedding array<double>").repartition(3)
    found = dense.search(rows, spark.createDataFrame(asked, "qid int, embedding array<double>"), 7)
    assert "NestedLoopJoin" not in plan(found) and "Cartesian" not in plan(found)
    assert ranked(found) == brute(held, asked, 7)


def test_probing_compares_what_is_in_the_lists(spark):
    rng = np.random.default_rng(6)
    held = [(k, rng.normal(size=8).tolist()) for k in range(900)]
    asked = [(k, rng.normal(size=8).tolist()) for k in range(12)]
    index, centroids = dense.coarse_index(spark.createDataFrame(held, "doc_id long, embedding array<double>"), 16)
    own = {r.doc_id: r["list"] for r in index.select("doc_id", "list").collect()}
    middle = {r["list"]: np.array(r.centroid) for r in centroids.collect()}
    for probes in (2, 12):
        found = dense.probe(index, centroids, spark.createDataFrame(asked, "qid long, embedding array<double>"), 5, probes)
        assert "Join" not in plan(found).split("MapInArrow")[-1]
        for qid, q in asked:
            near = sorted(middle, key=lambda k: (-round(float(np.dot(middle[k], q) / np.linalg.norm(middle[k]) / np.linalg.norm(q)), 9), k))[:probes]
            want = brute([(i, v) for i, v in held if own[i] in near], [(qid, q)], 5)
            assert ranked(found.where(f"qid = {qid}")) == want


def test_scores_equal_to_nine_digits_go_by_document(spark):
    scored = spark.createDataFrame([(1, 5, 0.9999999999999998), (1, 7, 1.0), (1, 3, 0.5)], "qid int, doc_id int, score double")
    assert ranked(bm25.rank(scored, 2)) == {1: [5, 7]}


def long_corpus(spark, n=500):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(80)]
    rows = [(k, " ".join(rng.choices(words, [1 / (j + 1) for j in range(80)], k=rng.randint(0, 40)))) for k in range(n)]
    rows += [(1000 + k, " ".join(rng.sample(rows[7][1].split(), len(rows[7][1].split())))) for k in range(30)]  # equal scores, sums in any order
    asked = [(q, " ".join(rng.choices(words, k=25))) for q in range(12)] + [(12, rows[7][1]), (13, "the"), (14, None)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(asked, "qid long, query string")


def test_many_queries_shuffle_no_row_for_each_document(spark, tmp_path, monkeypatch):
    docs, asked = long_corpus(spark)
    want = bm25.search(bm25.build(docs), asked, 9)
    want = sorted((r.qid, r.rank, r.doc_id, round(r.score, 9)) for r in want.collect())
    stored = bm25.store(docs, f"{tmp_path}/i", block_docs=16, parts=4)
    for rows, cells, bytes_ in ((20_000, 1 << 20, 8 << 20), (50, 100, 4000)):
        monkeypatch.setattr(bm25, "ROWS", rows)
        monkeypatch.setattr(bm25, "CELLS", cells)
        monkeypatch.setattr(bm25, "QUERY_BYTES", bytes_)
        found = bm25.search(stored, asked, 9)
        assert "Generate" not in plan(found) and "MapInArrow" in plan(found)
        assert sorted((r.qid, r.rank, r.doc_id, round(r.score, 9)) for r in found.collect()) == want


def test_an_index_is_stored_without_a_shuffle_of_postings(spark, tmp_path, monkeypatch):
    from quillwork.sources import tables

    seen, put = {}, tables.Draft.put
    monkeypatch.setattr(tables.Draft, "put", lambda self, name, df, *a, **b: (seen.setdefault(name, df._jdf.queryExecution().executedPlan().toString()), put(self, name, df, *a, **b))[1])
    docs, _ = long_corpus(spark, 100)
    bm25.store(docs.coalesce(1), f"{tmp_path}/i")
    assert seen["blocks"].split("RoundRobinPartitioning")[0].count("Exchange") <= 1 and "collect_list" not in seen["blocks"]


def test_traversal_looks_up_a_set_of_concepts_once(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    rows = [(p, n, f"name {n}", "other") for p in range(200) for n in rng.sample(range(12), 3)]
    graph = concepts.store(spark.createDataFrame(rows, "paper_id long, concept_id long, name string, concept_type string"), f"{tmp_path}/g")
    said = [(q, f"about name {q % 5} and name {q % 3}") for q in range(90)] + [(90, "nothing")]
    asked = spark.createDataFrame(said, "qid long, text string")
    whole = concepts.traverse(graph.links, graph.edges, asked)
    got = {}
    for r in whole.collect():
        got.setdefault(r.qid, []).append((r["rank"], r.paper_id, r.total, r.direct))
    for q in range(90):  # as its first query alone
        assert sorted(got[q]) == sorted(got[min(k for k in range(90) if {k % 5, k % 3} == {q % 5, q % 3})]) and len(got[q]) == 10
    alone = concepts.traverse(graph.links, graph.edges, asked.where("qid = 44"))
    assert sorted((r["rank"], r.paper_id, r.total, r.direct) for r in alone.collect()) == sorted(got[44]) and 90 not in got
    monkeypatch.setattr(concepts, "LOOKED_BYTES", 200)
    blocks = concepts.traverse(graph.links, graph.edges, asked)
    assert sorted(map(tuple, blocks.collect())) == sorted(map(tuple, whole.collect()))


def test_answers_keep_line_ends_as_sql_does(spark, tmp_path):
    from oracle import compare

    rng = np.random.default_rng(9)
    base = rng.normal(size=4)
    vectors = [(k, (base + 0.1 * rng.normal(size=4)).astype(float).tolist()) for k in range(61)]
    texts = [f" \nfirst {k}\n\n[note {k}] and more" if k % 2 else f"\tone, {'x' * 12}\n\n and more" for k in range(61)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert compare(queries.ask_batch(spark, str(tmp_path)), queries.SQL["ask_batch"], str(tmp_path)) == ""
