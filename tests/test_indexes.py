"""Pruned sparse search, codes of vectors, the automaton of concept names, and what retrieval makes of them."""

import random

import pytest
from pyspark.sql import functions as F
from quillwork import queries
from quillwork.operators import bm25, concepts, dense, segments
from quillwork.plans import indexing, retrieval

WORDS = [f"w{k}" for k in range(60)]


def corpus(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows = [(k, " ".join(rng.choices(WORDS, [1 / (j + 1) for j in range(60)], k=rng.randint(0, 30)))) for k in range(n)]
    rows += [(1000 + k, "w1 w2 w59") for k in range(5)]  # equal scores go by document
    return spark.createDataFrame(rows, "doc_id long, text string")


def top(df):
    return sorted((r.qid, r.rank, r.doc_id, round(r.score, 9)) for r in df.collect())


@pytest.mark.parametrize(("block_docs", "parts"), [(8, 4), (128, 64), (1000, 1)])
def test_pruned_search_finds_what_a_scan_finds(spark, tmp_path, block_docs, parts):
    docs = corpus(spark)
    asked = spark.createDataFrame([(1, "w59 w58"), (2, "w0 w0 w1"), (3, "the of"), (4, "w57 w3 w2 w1 w0"), (5, None), (6, "unknown"), (7, "w59")], "qid long, query string")
    stored = bm25.store(docs, f"{tmp_path}/i", block_docs=block_docs, parts=parts)
    plain = bm25.build(docs)
    for k in (1, 20):
        want = top(bm25.search(plain, asked, k))
        assert want and top(bm25.search(stored, asked, k)) == want
    assert sorted(map(tuple, stored.postings.select("doc_id", "term", "tf", "length").collect())) == sorted(map(tuple, plain.postings.select("doc_id", "term", "tf", "length").collect()))
    seen = {r.qid: (r.blocks, r.scored) for r in bm25.pruning(stored, asked, 1).collect()}
    assert all(scored <= blocks for blocks, scored in seen.values())
    if block_docs == 8:
        assert seen[1][1] < seen[1][0] / 2  # rare words stand in few blocks that can matter


def test_a_search_reads_the_folders_of_its_terms(spark, tmp_path, capsys):
    stored = bm25.store(corpus(spark), f"{tmp_path}/i", parts=32)
    asked = spark.createDataFrame([(1, "w59 w58")], "qid long, query string")
    bm25.search(stored, asked).explain()
    filters = [x for x in capsys.readouterr().out.split("\n") if "PartitionFilters" in x]
    assert filters and all("part#" in x and " IN (" in x for x in filters)


def test_an_empty_index(spark, tmp_path):
    asked = spark.createDataFrame([(1, "w1")], "qid long, query string")
    for docs in (corpus(spark).limit(0), corpus(spark).withColumn("text", F.lit("the"))):
        assert bm25.search(bm25.store(docs, f"{tmp_path}/{docs.count()}"), asked).count() == 0


def test_codes_recall_well_with_few_vectors(spark):
    rows = queries.table(spark, "/root/testdata/sf0.1", "embeddings")
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    exact = {(r.qid, r.doc_id) for r in dense.search(rows, asked, doc_id="vec_id").collect()}
    index, centroids = dense.coarse_index(rows, 20, doc_id="vec_id")
    codes = dense.quantise(index, centroids)
    assert codes.rows.count() == rows.count()
    few = {(r.qid, r.doc_id) for r in dense.search_codes(codes, asked, short=10).collect()}  # 200 of 2,000 vectors
    assert len(few & exact) >= 0.9 * len(exact)


def test_codes_in_blocks_and_of_any_vectors(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(f"d{k}", [rng.gauss(k % 7, 0.3) for _ in range(5)]) for k in range(300)] + [("none", None), ("zero", [0.0] * 5)]
    df = spark.createDataFrame(rows, "doc_id string, embedding array<double>")
    asked = df.where("doc_id like '%1'").select(F.col("doc_id").alias("qid"), "embedding").unionAll(df.where("doc_id in ('none', 'zero')").select("doc_id", "embedding"))
    index, centroids = dense.coarse_index(df, 7)
    codes = dense.quantise(index, centroids, parts=3)
    want = top(dense.search(df, asked, 5))
    assert top(dense.search_codes(codes, asked, 5, short=100)) == want
    monkeypatch.setattr(dense, "QUERY_BYTES", 20_000)
    assert top(dense.search_codes(codes, asked, 5, short=100)) == want
    assert len({(a, c) for a, _, c, _ in top(dense.search_codes(codes, asked, 5, probes=3))} & {(a, c) for a, _, c, _ in want}) >= 0.9 * len(want)
    assert dense.search_codes(codes, asked.limit(0)).count() == 0 and dense.quantise(index.limit(0), centroids) is None


def test_names_in_texts(spark):
    rng = random.Random(3)
    names = ["a", "ab", "a b", "b a b", "AB-c", "c d e", "e", "x y", "", "e  f!"] + [f"n{k} m{k % 5}" for k in range(40)]
    links = spark.createDataFrame([(n.lower(), n, f"p{k}") for k, n in enumerate(names)], "key string, name string, paper_id string")
    texts = [(k, " ".join(rng.choices(["a", "b", "ab", "c", "d", "e", "f", "n3", "m3", "n7", "m2", "xy"], k=rng.randint(0, 12)))) for k in range(60)] + [(60, None), (1, "A-b c.D?e"), (61, "")]
    asked = spark.createDataFrame(texts, "qid int, text string")
    form = lambda t: " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in t.lower()).split())
    want = {(q, n.lower()) for q, t in texts for n in names if len(form(n)) >= 2 and f" {form(n)} " in f" {form(t or '')} "}
    assert len(want) > 30
    for size in (1 << 20, 300):
        assert {tuple(r) for r in concepts.mentioned(links, asked, size).collect()} == want
    assert concepts.mentioned(links.limit(0), asked).count() == 0 and concepts.mentioned(links, asked.limit(0)).count() == 0


def test_the_leading_variant_is_named(spark):
    docs = spark.createDataFrame([("1", "T", "x"), ("2", "U", "y")], "doc_id string, title string, text string")
    vectors = spark.createDataFrame([("1", [1.0, 0.0]), ("2", [0.0, 1.0])], "doc_id string, embedding array<double>")
    texts = spark.createDataFrame([("q", "x")], "qid string, query string")
    asked = [("q", [1.0, 0.0], 1), ("q", [0.0, 1.0], 0)]
    for rows in (asked, asked[::-1]):
        many = spark.createDataFrame(rows, "qid string, embedding array<double>, variant int")
        sims = lambda v: {r.doc_id: r.sim for r in retrieval.hybrid(retrieval.Corpus(docs, vectors), texts, v).collect()}
        assert sims(many) == {"1": 0.0, "2": 1.0}
        assert sims(many.withColumn("variant", 1 - F.col("variant"))) == {"1": 1.0, "2": 0.0}
        assert sims(many.drop("variant")) == {"1": 0.0, "2": 1.0}


def test_eight_concepts_a_paper_over_all_pieces(spark):
    said = "".join(f" name{k} " + "x" * 700 for k in range(12))
    papers = spark.createDataFrame([("1", said)], "paper_id string, abstract string")
    answer = lambda rows: '{"papers": [' + ", ".join(f'{{"arxiv_id": "{i}", "concepts": [' + ", ".join(f'"name{k}"' for k in range(12) if f" name{k} " in t) + "]}" for i, t in rows) + "]}"
    (found,) = indexing.extract_concepts(papers, spark.createDataFrame([], "paper_id string"), answer).collect()
    assert [c.name for c in found.concepts] == [f"name{k}" for k in range(8)]


def test_increments_score_like_an_index_built_afresh(spark, tmp_path):
    rng = random.Random(7)
    text = lambda n: " ".join(rng.choices(WORDS, [1 / (j + 1) for j in range(60)], k=n))
    index = segments.Segments(spark, f"{tmp_path}/s", parts=4, block_docs=8, bucket_rows=30)
    assert index.read() is None and not index.merge()
    asked = spark.createDataFrame([(1, "w59 w58"), (2, "w0 w0 w1"), (3, "w57 w3 w2 w1 w0"), (4, "unknown")], "qid long, query string")
    held: dict = {}
    frame = lambda d: spark.createDataFrame(sorted(d.items()), "doc_id long, text string")
    steps = [({k: text(20) for k in range(90)}, []), ({k: text(9) for k in (3, 4, 200)}, [5, 6, 777]), ({201: None, 7: "", 3: text(12)}, []), ({5: "w59 w58 w59"}, [200])]
    for n, (new, removed) in enumerate(steps):
        index.add(frame(new), spark.createDataFrame([(k,) for k in removed], "doc_id long") if removed else None)
        held = {k: v for k, v in held.items() if k not in removed} | new
        if n == 2:
            assert index.merge(2) and len(index.store.latest()["docs"]["notes"]["segments"]) == 2
        plain, now = bm25.build(frame(held)), index.read()
        assert sorted((r.term, r.df, round(r.idf, 9)) for r in now.terms.collect()) == sorted((r.term, r.df, round(r.idf, 9)) for r in plain.terms.collect())
        assert now.corpus.first()[:2] == pytest.approx(plain.corpus.first()[:2])
        assert top(bm25.search(now, asked, 7)) == top(bm25.search(plain, asked, 7))
        assert now.postings.count() == plain.postings.count()
    before = index.store.numbers()
    with pytest.raises(ValueError, match="repeated"):
        index.add(frame({1: "x"}).unionAll(frame({1: "y"})))
    assert index.store.numbers() == before
