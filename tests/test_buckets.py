"""Versions of tables: buckets of a key, drafts, writers that meet."""

import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F
from quillwork.operators import bm25, cubes, stats, upsert
from quillwork.plans import ingest
from quillwork.schemas import RAW_PAPERS
from quillwork.sources import tables

KEYS = ["k"]


def bytes_of(root):
    return {f: os.path.getsize(f) for f in glob.glob(f"{root}/**/*.parquet", recursive=True)}


def rows(spark, n, version, step=1):
    return spark.range(0, n, step).select(F.col("id").alias("k"), F.lit(version).alias("v"), F.concat(F.lit(f"value {version} "), F.sha2(F.col("id").cast("string"), 256)).alias("x"))


def upserted(old, batch):
    return upsert.upsert(old, batch, KEYS, "v")


def test_a_merge_writes_what_its_keys_touch(spark, tmp_path):
    root, store = f"{tmp_path}/t", tables.Versions(spark, f"{tmp_path}/t")
    with store.begin() as draft:
        draft.create("t", "k long, v int, x string", KEYS, bucket_rows=100)
        draft.merge("t", rows(spark, 20_000, 1), upserted)
        assert draft.counts("t") == {"insert": 20_000}
        draft.publish()
    held = store.latest()["t"]["buckets"]
    assert 200 <= len(held) <= 512 and max(n for _, n in held.values()) <= 150 and sum(n for _, n in held.values()) == 20_000
    before = bytes_of(root)
    batch = rows(spark, 20_000, 2, 5000).unionAll(rows(spark, 3, 1)).unionAll(spark.createDataFrame([(-1, 1, "new"), (None, 1, "null")], "k long, v int, x string"))
    with store.begin() as draft:
        draft.merge("t", batch, upserted)
        assert {a: n for a, n in draft.counts("t").items() if a != "unchanged"} == {"insert": 2, "update": 4}
        draft.publish()
    new = {f: n for f, n in bytes_of(root).items() if f not in before}
    assert len(new) <= 9 and sum(new.values()) < sum(before.values()) / 20
    whole = upserted(rows(spark, 20_000, 1), batch).drop("action")
    assert sorted(map(str, store.read()["t"].collect())) == sorted(map(str, whole.collect()))
    store.clean(1)
    assert len(bytes_of(root)) == sum(n > 0 for _, n in store.latest()["t"]["buckets"].values())
    assert store.read()["t"].count() == 20_002


def test_buckets_divide_as_they_grow_and_may_get_empty(spark, tmp_path):
    store = tables.Versions(spark, f"{tmp_path}/t")
    for n in (0, 10, 400, 401, 2000):
        with store.begin() as draft:
            if not n:
                draft.create("t", "k long, v int, x string", KEYS, bucket_rows=50)
            draft.merge("t", rows(spark, n, n), upserted)
            draft.publish(keep=1)
        assert store.read()["t"].count() == n
        assert all(m <= 100 for _, m in store.latest()["t"]["buckets"].values())
    # a key that many rows of a batch share divides nothing
    before = len(store.latest()["t"]["buckets"])
    with store.begin() as draft:
        draft.merge("t", spark.range(5000).select(F.lit(7).cast("long").alias("k"), F.col("id").cast("int").alias("v"), F.lit("hot").alias("x")), upserted)
        draft.merge("t", rows(spark, 2000, 1, 2), lambda old, batch: old.join(batch.select("k"), "k", "left_anti").select(*old.columns))
        draft.publish(keep=1)
    assert len(store.latest()["t"]["buckets"]) <= 2 * before
    assert {r.k for r in store.read()["t"].collect()} == set(range(1, 2000, 2))
    with store.begin() as draft:
        draft.merge("t", rows(spark, 2000, 1), lambda old, batch: old.limit(0))
        draft.publish(keep=1)
    assert store.read()["t"].count() == 0


def test_of_two_writers_one_fails(spark, tmp_path):
    store = tables.Versions(spark, f"{tmp_path}/t")
    first, second = store.begin(), tables.Versions(spark, f"{tmp_path}/t").begin()
    with first:
        first.put("a", spark.range(1))
        first.publish()
    with pytest.raises(RuntimeError, match="another writer"), second:
        second.put("a", spark.range(2))
        second.publish()
    assert store.numbers() == [1] and store.read()["a"].count() == 1 and len(glob.glob(f"{tmp_path}/t/a/*")) == 1


def test_half_a_manifest_does_not_count(spark, tmp_path):
    root = f"{tmp_path}/i"
    docs = spark.createDataFrame([(1, "graph nets"), (2, "other words")], "doc_id long, text string")
    bm25.store(docs, root)
    want = bm25.Index.read(spark, root).postings.count()
    for torn in ("", '{"postings": "pos', "[]"):
        with open(f"{root}/v={max(tables.Versions(spark, root).numbers()) + 1}", "w") as f:
            f.write(torn)
        assert bm25.Index.read(spark, root).postings.count() == want
    assert tables.Versions(spark, root).write(more=spark.range(1)) == 5
    with open(f"{tmp_path}/v=1", "w") as f:
        f.write("{")
    assert bm25.Index.read(spark, str(tmp_path)) is None


def test_a_draft_that_fails_its_checks_is_gone(spark, tmp_path):
    store = tables.Versions(spark, f"{tmp_path}/t")
    with pytest.raises(ValueError, match=r"negative: \(-1,\)"), store.begin() as draft:
        made = draft.put("a", spark.range(-1, 3))
        draft.check(fine=made.where("id > 5"), negative=made.where("id < 0"))
        draft.publish()
    assert store.read() is None and not glob.glob(f"{tmp_path}/t/a/*")


def papers(spark, ids, day, names=("Ada B", "C D")):
    rows = [(i, f"T {i}", "text", f"{day}T00:00:00Z", f"{day}T00:00:00Z", list(names), "cs.AI", ["cs.AI", "cs.LG"], None, None) for i in ids]
    return spark.createDataFrame(rows, RAW_PAPERS)


def test_batches_into_buckets_equal_whole_tables(spark, tmp_path):
    stamp = F.lit(dt.datetime(2026, 2, 1))
    store = tables.Versions(spark, f"{tmp_path}/b")
    ingest.create(store, bucket_rows=20)
    held = {k: v for k, v in store.read().items() if k in ingest.KEYED}
    batches = [papers(spark, [f"p{k}" for k in range(60)], "2026-01-01"), papers(spark, ["p3", "p70", "p3"], "2026-01-02", ("ada b", "New One")), papers(spark, ["p4", "p80"], "2025-01-01")]
    seen = []
    for batch in batches:
        with store.begin() as draft:
            seen.append(ingest.merge(draft, batch, stamp))
            draft.publish(keep=1)
        new = ingest.ingest(held, batch, stamp)
        held = {k: (v.drop("action") if k == "papers" else v).checkpoint() for k, v in new.items()}
    tables_ = store.read()
    got = {k: sorted(map(str, v.collect())) for k, v in tables_.items() if k in ingest.KEYED}
    same = lambda a, b: list(map(tuple, a.collect())) == list(map(tuple, b.collect())) and a.count()
    star = [tables_[k] for k in ("papers", "paper_categories", "paper_authors", "categories", "authors")]
    papers_, codes, links, categories, authors = star
    for span in ({}, {"first": "2026-01-02"}, {"last": "2025-12-31"}):
        assert same(cubes.top_categories(tables_, categories, **span), stats.top_categories(papers_, categories, codes, **span))
        assert same(cubes.category_total(tables_, categories, **span), stats.category_total(papers_, categories, codes, **span))
        assert same(cubes.top_authors(tables_, authors, **span), stats.top_authors(papers_, authors, links, **span))
        assert same(cubes.velocity(tables_, "month", **span), stats.velocity(papers_, "month", **span))
        assert same(cubes.categories_over_time(tables_, "week", **span), stats.categories_over_time(papers_, codes, "week", **span))
    assert same(cubes.cooccurrence(tables_), stats.cooccurrence(codes))
    assert got == {k: sorted(map(str, v.collect())) for k, v in held.items()}
    assert seen[0] == {"insert": 60} and seen[1].get("insert") == 1 and seen[1].get("update") == 1 and "update" not in seen[2]
    assert store.latest()["authors"]["notes"] == {"top": 3}
    assert len(store.latest()["papers"]["buckets"]) >= 4


def test_a_run_in_buckets_goes_on_and_reset_removes_indexes(spark, tmp_path):
    stamp = F.lit(dt.datetime(2026, 2, 1))
    calls = []

    def fetch(category, first, last, offset, size):
        calls.append(offset)
        if offset == 2 and calls.count(2) == 1:
            raise OSError("down")
        return papers(spark, [f"{category}{k}" for k in range(offset, min(5, offset + size))], "2026-01-01")

    store = tables.Versions(spark, f"{tmp_path}/s")
    ingest.create(store)
    go = lambda: ingest.run(store, 1, ["cs.AI"], "2026-01-01", "2026-01-07", fetch, max_papers=10, page=2, now=stamp).first()
    with pytest.raises(OSError):
        go()
    done = go()
    assert (done.papers_fetched, done.papers_inserted, done.status) == (5, 5, "completed") and calls == [0, 2, 2, 4]
    assert store.read()["papers"].count() == 5 and not glob.glob(f"{tmp_path}/s/landed/1/cs.AI/2026-01-01/*")
    bm25.store(store.read()["papers"].select("arxiv_id", "abstract"), f"{tmp_path}/index", "arxiv_id", "abstract")
    with store.begin() as draft:
        draft.merge("categories", spark.createDataFrame([("cs.AI", "Name")], "code string, display_name string"), lambda old, batch: upsert.seed(old, batch, "code", "display_name"))
        draft.publish()
    with pytest.raises(ValueError):
        ingest.reset_store(store, "no", "yes")
    ingest.reset_store(store, "yes", "yes", [tables.Versions(spark, f"{tmp_path}/index")])
    assert {k: v.count() for k, v in store.read().items() if "cube" not in k or v.count()} == {"categories": 1, "papers": 0, "authors": 0, "paper_authors": 0, "paper_categories": 0, "runs": 0}
    assert bm25.Index.read(spark, f"{tmp_path}/index") is None
