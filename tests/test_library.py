"""Functions and operators on small inputs."""

import datetime as dt
import html
import io
import json
import os
import re
import shutil
import subprocess
import sys
import unicodedata
import urllib.error

import pytest
from pyspark.sql import functions as F
from quillwork.functions import dates, text
from quillwork.operators import bm25, concepts, evaluation, fusion, sampling, stats, upsert
from quillwork.plans import indexing, ingest, retrieval
from quillwork.schemas import AUTHORS, CATEGORIES, PAPER_AUTHORS, PAPER_CATEGORIES, PAPERS, RAW_PAPERS, RUNS, cascade, check_dimension
from quillwork.sources import atom, tables
from quillwork.streaming import incremental

FEED = """<feed xmlns="http://www.w3.org/2005/Atom" xmlns:o="http://a9.com/-/spec/opensearch/1.1/" xmlns:x="http://arxiv.org/schemas/atom">
<o:totalResults>2</o:totalResults><o:startIndex>0</o:startIndex><o:itemsPerPage>many</o:itemsPerPage>
<entry><id>http://arxiv.org/abs/2601.01234v3</id><title>A long
 title</title><summary>
 We use \\textbf{bold} &amp;amp; $x^2$
</summary><published>2026-01-02T00:00:00Z</published><updated>2026-01-03T00:00:00Z</updated>
<author><name>
	Ada  B </name></author><author><name>Émile C</name></author><author><name> 
	  </name></author>
<x:primary_category term="cs.LG"/><category term="cs.CL"/><category term="cs.LG"/><x:doi>
 10.1/x	</x:doi><x:journal_ref>J 1</x:journal_ref></entry>
<entry><id>2601.99999</id><title>Short</title><author><name>ada b</name></author><category term="cs.AI"/></entry></feed>"""


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_cleaning(spark):
    assert value(spark, text.clean_abstract(F.lit("\\textbf{Deep}\u00a0nets &amp;  $x^2$\n \\(a\\) \\[b\\] \\alpha e\u0301 "))) == "Deep nets & [MATH] [MATH] [MATH] é"
    assert value(spark, text.clean_abstract(F.lit(None).cast("string"))) == ""
    assert len(value(spark, text.clean_abstract(F.lit("ab " * 2000)))) <= 2000
    assert len(value(spark, text.clean_text(F.lit("ab " * 2000)))) == 5999
    assert value(spark, text.normalize_author(F.lit("  Ada \t B "))) == "ada b"
    assert value(spark, text.casefold(F.lit("Straße"))) == "strasse"


def test_identifiers(spark):
    for raw, want in (("http://arxiv.org/abs/2601.01234v2", "2601.01234"), ("http://arxiv.org/abs/solv-int/9501001v1", "solv-int/9501001"), ("plain", "plain")):
        assert value(spark, text.strip_version(F.lit(raw))) == want
    assert value(spark, text.normalize_identifier(F.lit(" arXiv:2601.01234v2 "))) == "2601.01234"
    assert value(spark, text.citations(F.lit("see arXiv: 2601.01234 and ARXIV:2601.1111"))) == ["2601.01234", "2601.1111"]
    assert value(spark, text.split_list(F.lit(" a, ,b "))) == ["a", "b"]
    assert value(spark, text.ordered_categories(F.lit("b"), F.array(F.lit("a"), F.lit(" b "), F.lit("")))) == ["b", "a"]
    assert value(spark, text.primary_category(F.lit(""), F.array().cast("array<string>"))) == "cs.AI"


def test_tokens_and_mentions(spark):
    assert value(spark, text.bm25_tokens(F.lit("The Graph of GRAPHS, and 2 nets"))) == ["graph", "graphs", "2", "nets"]
    assert value(spark, text.exact_match_form(F.lit("Ça, va_bien!"))) == "ça va_bien"
    assert value(spark, text.mentions(F.lit("deep graph nets"), F.lit("graph nets")))
    assert not value(spark, text.mentions(F.lit("deep graph nets"), F.lit("rap")))


def test_dates(spark):
    day = F.lit(dt.datetime(2024, 12, 30))
    assert [value(spark, dates.period(day, g)) for g in ("year", "month", "week")] == ["2024", "2024-12", "2025-W01"]
    with pytest.raises(ValueError):
        dates.period(day, "day")
    span = spark.createDataFrame([("2026-01-01", "2026-01-20")], "date_from string, date_to string")
    assert [(str(r.win_start), str(r.win_end)) for r in dates.windows(span).collect()] == [("2026-01-01", "2026-01-07"), ("2026-01-08", "2026-01-14"), ("2026-01-15", "2026-01-20")]
    back = F.lit(dt.datetime(2000, 1, 1))
    assert value(spark, dates.parse(F.lit("2024-05-01T10:00:00Z"), back)) == dt.datetime(2024, 5, 1, 10)
    assert value(spark, dates.parse(F.lit("soon"), back)) == dt.datetime(2000, 1, 1)


def test_bands_and_fusion(spark):
    df = spark.createDataFrame([(0.61,), (0.45,), (0.3,), (0.1,), (None,)], "s double")
    assert [r.b for r in df.select(fusion.confidence(F.col("s")).alias("b")).collect()] == ["high", "medium", "low", "none", "none"]
    legs = spark.createDataFrame([("q", "dense", 0, "a", 1), ("q", "dense", 0, "b", 2), ("q", "sparse", 1, "b", 1), ("q", "sparse", 1, "c", 2)], "qid string, leg string, leg_order int, doc_id string, rank int")
    found = fusion.rrf(legs).orderBy("rank").collect()
    assert [(r.doc_id, r.source) for r in found] == [("b", "sparse"), ("a", "dense"), ("c", "sparse")]
    assert found[0].rrf == pytest.approx(1 / 62 + 1 / 61)


def test_even_sample_with_a_cap(spark):
    rows = spark.createDataFrame([(w, c, k) for w in (1, 2) for c in ("a", "b") for k in range(5)], "w int, c string, k int")
    got = lambda *x: [(r.w, r.c, r.k) for r in sampling.even_sample(rows, ["w", "c"], ["k"], *x).orderBy("w", "c", "k").collect()]
    assert got(2) == [(w, c, k) for w in (1, 2) for c in ("a", "b") for k in (0, 1)]
    assert got(2, 5) == got(2)[:5] and got(2, 0) == [] and sampling.quota(5, 2, 2) == 2
    with pytest.raises(ValueError):
        sampling.even_sample(rows, ["w"], ["k"], 0)


def test_small_columns(spark):
    assert value(spark, text.abstract_url(F.lit("2601.1"))) == "https://arxiv.org/abs/2601.1"
    assert value(spark, dates.elapsed_seconds(F.lit(dt.datetime(2026, 1, 1)), F.lit(dt.datetime(2026, 1, 1, 0, 1)))) == 60
    assert value(spark, text.concept_name(F.lit(" a \n b "))) == "a b" and value(spark, text.concept_name(F.lit("x" * 81))) is None
    assert value(spark, text.json_object(F.lit('so: {"a": 1}.'), "a int")).a == 1
    assert value(spark, text.strip(F.lit("\u2003\n x \t\u00a0"))) == "x"


def test_limits_are_checked():
    with pytest.raises(ValueError):
        stats._limit(0, 100)
    with pytest.raises(ValueError):
        retrieval.ask(" ", None, None)


def test_feed(spark, tmp_path):
    (tmp_path / "page.xml").write_text(FEED)
    pages = atom.read_files(spark, str(tmp_path))
    full, sparse = atom.parse(pages).collect()
    assert (full.arxiv_id, full.title, full.authors, full.primary_category, full.categories) == ("2601.01234", "A long  title", ["Ada  B", "Émile C"], "cs.LG", ["cs.LG", "cs.CL"])
    assert (full.doi, full.journal_ref, full.abstract) == ("10.1/x", "J 1", "We use \\textbf{bold} &amp; $x^2$")
    assert (sparse.arxiv_id, sparse.doi, sparse.published, sparse.abstract, sparse.categories) == ("2601.99999", None, None, "", ["cs.AI"])
    assert atom.feed_meta(pages).first() == (2, 0, 0)
    with pytest.raises(Exception):  # noqa: B017
        atom.parse(spark.createDataFrame([("<feed><entry>",)], "body string")).collect()


def test_fetching_tries_again():
    waits, answers = [], [urllib.error.HTTPError("u", 429, "", {"Retry-After": "500"}, None), urllib.error.URLError("down"), io.BytesIO(b"ok")]

    def opener(url):
        answer = answers.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return answer

    assert atom.fetch("u", 3.5, opener, waits.append) == b"ok"
    assert waits == [120.0, 7.0]
    assert "cat%3Acs.AI+AND+submittedDate%3A%5B202601010000+TO+202601072359%5D" in atom.page_url("http://x", "cs.AI", "2026-01-01", "2026-01-07")
    with pytest.raises(urllib.error.HTTPError):
        atom.fetch("u", 1, lambda url: (_ for _ in ()).throw(urllib.error.HTTPError("u", 404, "", {}, None)), waits.append)


def test_feed_source_reads_windows_page_by_page(monkeypatch):
    pages = {("cs.AI", 0): 2, ("cs.AI", 2): 1, ("cs.CL", 0): 0}
    waits = []
    monkeypatch.setattr(atom.time, "sleep", waits.append)
    monkeypatch.setattr(atom, "fetch", lambda url, gap: url.encode())
    monkeypatch.setattr(atom, "page_url", lambda base, category, first, last, start, size: "<entry>" * pages[category, start])
    reader = atom.FeedReader({"url": "u", "gap": "2", "pageSize": "2", "quota": "5", "categories": "cs.AI,cs.CL", "windows": "2026-01-01:2026-01-07"})
    (one,) = reader.partitions()
    assert [(c, first, start) for c, first, _, start, _ in reader.read(one)] == [("cs.AI", "2026-01-01", 0), ("cs.AI", "2026-01-01", 2), ("cs.CL", "2026-01-01", 0)]
    assert waits == [2.0, 2.0]
    with pytest.raises(ValueError):
        atom.FeedReader({"url": "u", "serial": "false", "categories": "a", "windows": "x:y"})


def test_upsert_versions_and_repeats(spark):
    schema = "k int, v int, a string, b string"
    old = spark.createDataFrame([(1, 5, "o", "x"), (2, 5, "o", "x"), (3, 5, "o", "x")], schema)
    new = spark.createDataFrame([(1, 6, "n", "y"), (1, 7, "m", "z"), (2, 5, "n", "y"), (4, 1, "n", "y")], schema)
    once = upsert.upsert(old, new, ["k"], "v", fixed=("b",))
    rows = {r.k: (r.v, r.a, r.b, r.action) for r in once.collect()}
    assert rows == {1: (7, "m", "x", "update"), 2: (5, "o", "x", "unchanged"), 3: (5, "o", "x", "unchanged"), 4: (1, "n", "y", "insert")}
    twice = upsert.upsert(once.drop("action"), new, ["k"], "v", fixed=("b",))
    assert {r.action for r in twice.collect()} == {"unchanged"}
    assert {r.k: r.a for r in twice.collect()} == {k: v[1] for k, v in rows.items()}


def test_upsert_with_null_versions_and_keys(spark):
    schema = "k int, v int, a string"
    old = spark.createDataFrame([(1, None, "keep"), (2, 5, "keep"), (3, None, "keep"), (None, 1, "keep")], schema)
    new = spark.createDataFrame([(2, None, "n"), (3, 4, "n"), (4, None, "n"), (None, 2, "n")], schema)
    rows = {r.k: (r.v, r.a, r.action) for r in upsert.upsert(old, new, ["k"], "v").collect()}
    assert rows == {1: (None, "keep", "unchanged"), 2: (5, "keep", "unchanged"), 3: (None, "keep", "unchanged"), 4: (None, "n", "insert"), None: (2, "n", "update")}


def test_seed_and_update(spark):
    cats = spark.createDataFrame([("cs.AI", None), ("zz", "kept")], "code string, display_name string")
    seeded = {r.code: r.display_name for r in upsert.seed(cats, tables.seed_categories(spark), "code", "display_name").collect()}
    assert seeded["cs.AI"] == "Artificial Intelligence" and seeded["zz"] == "kept" and len(seeded) == 49
    t = spark.createDataFrame([(1, "a", None), (2, "b", None)], "id int, x string, y string")
    out = {r.id: r.y for r in upsert.update_columns(t, spark.createDataFrame([(1, "new")], "id int, y string"), "id").collect()}
    assert out == {1: "new", 2: None}


def test_ingest_twice_changes_nothing(spark):
    raw = atom.parse(spark.createDataFrame([(FEED,)], "body string"))
    empty = {"papers": PAPERS, "authors": "id long, name string, name_normalized string", "paper_authors": PAPER_AUTHORS, "categories": "code string, display_name string", "paper_categories": PAPER_CATEGORIES}
    now = F.lit(dt.datetime(2026, 2, 1))
    state = {k: spark.createDataFrame([], v) for k, v in empty.items()}
    first = ingest.ingest(state, raw, now)
    rows = {k: sorted(map(str, v.drop("action").collect())) for k, v in first.items()}
    assert [len(rows[k]) for k in ("papers", "authors", "paper_authors", "categories", "paper_categories")] == [2, 2, 3, 3, 3]
    held = {k: spark.createDataFrame(v.drop("action").collect(), v.drop("action").schema) for k, v in first.items()}
    again = ingest.ingest(held, raw, now)
    assert {k: sorted(map(str, v.drop("action").collect())) for k, v in again.items()} == rows
    assert {r.action for r in again["papers"].collect()} == {"unchanged"}
    named = upsert.seed(held["categories"], tables.seed_categories(spark), "code", "display_name")
    left = ingest.reset(held | {"categories": named}, "t", "t")
    assert left["papers"].count() == 0 and left["categories"].count() == 48
    with pytest.raises(ValueError):
        ingest.reset(held, "wrong", "t")
    with pytest.raises(RuntimeError):
        ingest.reset(held, "t", "t", running=True)


def test_concept_responses(spark):
    raw = spark.createDataFrame([('Sure: {"papers":[{"arxiv_id":"1","concepts":[{"name":" Graph  nets ","type":"MODEL"},"graph nets","BERT",{"name":"","type":"task"},{"name":"Stra\u00dfe","type":"zzz"},"STRASSE"]},{"arxiv_id":"9","concepts":["x"]},{"arxiv_id":"2","concepts":[]}]} done', ["1", "2"]), ("no json", ["3"])], "raw string, ids array<string>")
    got = {r.paper_id: [(c.name, c.type) for c in r.concepts] for r in concepts.parse_response(raw).collect()}
    assert got == {"1": [("Graph nets", "model"), ("BERT", "other"), ("Stra\u00dfe", "other")], "2": []}


GRAPH = [("p1", 1, "Graph Nets", "model"), ("p1", 2, "BERT", "model"), ("p2", 1, "Graph Nets", "model"), ("p2", 3, "QA", "task"), ("p3", 2, "bert", "model"), ("p3", 4, "Stra\u00dfe", None), ("p1", 5, "STRASSE", None)]


def test_traversal(spark, tmp_path):
    rows = spark.createDataFrame(GRAPH, "paper_id string, concept_id long, name string, concept_type string")
    nodes = {r.key: (r.name, r.concept_type, r.n_papers) for r in concepts.nodes(rows).collect()}
    assert nodes == {"graph nets": ("Graph Nets", "model", 2), "bert": ("BERT", "model", 2), "qa": ("QA", "task", 1), "strasse": ("Stra\u00dfe", "other", 2)}
    assert {(r.src, r.dst): r.weight for r in concepts.edges(rows).collect()}["bert", "strasse"] == 2
    assert concepts.Graph.read(spark, f"{tmp_path}/graph") is None
    concepts.graph(rows).write(f"{tmp_path}/graph")
    graph = concepts.Graph.read(spark, f"{tmp_path}/graph")
    asked = spark.createDataFrame([("q", "about graph-nets"), ("q", "and bert"), ("r", "q a bertha graph"), ("s", "")], "qid string, text string")
    got = concepts.traverse(graph.links, graph.edges, asked).orderBy("rank").collect()
    assert [(r.qid, r.paper_id, r.total, r.direct) for r in got] == [("q", "p1", 3, 2), ("q", "p2", 2, 1), ("q", "p3", 2, 1)]


def test_versions(spark, tmp_path):
    store = tables.Versions(spark, f"{tmp_path}/t")
    assert store.read() is None and store.numbers() == []
    assert store.write(a=spark.range(3), b=lambda done: done["a"].where("id > 0")) == 1
    assert {k: v.count() for k, v in store.read().items()} == {"a": 3, "b": 2}
    with pytest.raises(ZeroDivisionError):
        store.write(a=spark.range(5), b=lambda done: 1 / 0)
    assert store.numbers() == [1] and store.read()["a"].count() == 3  # half a version is none
    old = store.read()["a"]
    assert [store.write(keep=2, a=spark.range(7)), old.count(), store.write(keep=2, a=spark.range(8))] == [2, 3, 3] and store.numbers() == [2, 3]
    assert {k: v.count() for k, v in store.read().items()} == {"a": 8, "b": 2} and not os.path.exists(old.inputFiles()[0].removeprefix("file://"))


def test_stored_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "graph nets and graphs"), (2, "nets"), (3, None), (4, "the")], "doc_id long, text string")
    assert bm25.Index.read(spark, f"{tmp_path}/i") is None
    stored, lazy = bm25.store(docs, f"{tmp_path}/i"), bm25.build(docs)
    for name in ("postings", "terms", "corpus"):
        assert sorted(map(str, getattr(stored, name).select(*getattr(lazy, name).columns).collect())) == sorted(map(str, getattr(lazy, name).collect()))
    assert stored.corpus.first() == (4, 1.0)
    with pytest.raises(ValueError):
        bm25.search(stored, docs, 0)


def test_evaluation(spark):
    rows = spark.createDataFrame([(1, "The cat sat arXiv:2601.00001", ["the cat", "cat sat the"], ["2601.00001", "2601.00002"]), (2, "", [""], None), (3, "x", [], [])], "qid long, predicted string, golds array<string>, gold_citations array<string>")
    got = {r.qid: r for r in evaluation.evaluate(rows).collect()}
    assert got[1].f1 == pytest.approx(2 * (3 / 6) * 1 / (3 / 6 + 1)) and got[1].citation_recall == 0.5
    assert got[2].f1 == 1.0 and got[2].em and got[2].citation_recall is None
    assert evaluation.summary(evaluation.evaluate(rows)).first().total == 3
    assert evaluation.summary(evaluation.evaluate(rows.limit(0))).first().avg_f1 == 0.0


def test_asking(spark):
    found = spark.createDataFrame([("d1", 0.7, 1, "T", "words"), ("d2", 0.1, 2, "U", "more")], "doc_id string, sim double, rank int, title string, text string")
    said = []
    answer = retrieval.ask("q", lambda q: found, lambda q, p: said.append(p) or " yes ", faithful=lambda a, p: 1 / 0)
    assert (answer.answer, [d["doc_id"] for d in answer.docs], answer.confidence, answer.iterations, answer.faithful) == ("yes", ["d1"], "high", 1, None)
    said.clear()
    asked = []
    none = retrieval.ask("q", lambda q: asked.append(q) or found.where("sim < 0.2"), lambda q, p: said.append(p), rewrite=lambda q, last: "other")
    assert none.answer == retrieval.NO_MATCH and not said and asked == ["q", "other"] and none.iterations == 2


def test_answers_cite(spark):
    kept = [{"doc_id": "2601.00001", "title": "T", "text": "x"}, {"doc_id": "d2", "title": "U", "text": "y"}]
    assert retrieval.generated({"answer": " yes ", "cited": ["arXiv:2601.00001v2", "d2", "d2", "2601.99999"]}, kept) == ("yes", ["2601.00001", "d2"])
    assert retrieval.generated("see [arXiv:2601.00001] and arXiv:2601.12345", kept)[1] == ["2601.00001"]
    assert retrieval.generated({"answer": None, "cited": None}, kept) == ("", [])
    assert retrieval.prompt(kept) == "[1] T\nx\n\n[2] U\ny" and "found nothing: b" in retrieval.rewrite_prompt("a", "b") and "[2] U" in retrieval.check_prompt("z", kept)


def test_retrieval_without_some_legs(spark):
    docs = spark.createDataFrame([("1", "graph nets", "own"), ("2", "graph", "own"), ("3", "other", "own")], "doc_id string, text string, source string")
    vectors_ = spark.createDataFrame([("1", [1.0, 0.0]), ("3", [0.8, 0.6])], "doc_id string, embedding array<double>")
    texts = spark.createDataFrame([("q", "graph nets")], "qid string, query string")
    near = spark.createDataFrame([("q", [1.0, 0.0])], "qid string, embedding array<double>")
    index = bm25.build(docs)
    found = lambda corpus, *x: [(r.doc_id, r.rank, r.source, r.doc_source, r.sim) for r in retrieval.search(corpus, texts, *x).orderBy("rank").collect()]
    assert found(retrieval.Corpus(docs, vectors_, index)) == [("1", 1, "sparse", "own", 0.0), ("2", 2, "sparse", "own", 0.0)]
    assert found(retrieval.Corpus(docs, vectors_), near) == [("1", 1, "dense", "own", 1.0), ("3", 2, "dense", "own", pytest.approx(0.8))]
    assert found(retrieval.Corpus(docs.where("doc_id <> '1'"), vectors_, index), near) == [("2", 1, "sparse", "own", 0.0), ("3", 2, "dense", "own", pytest.approx(0.8))]
    assert found(retrieval.Corpus(docs, vectors_)) == []
    with pytest.raises(ValueError):
        retrieval.search(retrieval.Corpus(docs, vectors_), texts, top_k=0)


def test_checkpoints(spark):
    c = spark.createDataFrame([((["cs.AI:2026-01-01"], ("cs.CL", "2026-01-08", 500)),)], "c struct<done:array<string>,current:struct<category:string,date_window:string,offset:int>>")
    offset = lambda cat, day: c.select(incremental.resume_offset(F.col("c"), F.lit(cat), F.lit(day)).alias("o")).first().o
    assert (offset("cs.CL", "2026-01-08"), offset("cs.AI", "2026-01-08")) == (500, 0)
    done = c.select(incremental.complete(F.col("c"), F.lit("cs.CL"), F.lit("2026-01-08")).alias("x")).first().x
    assert done.done == ["cs.AI:2026-01-01", "cs.CL:2026-01-08"] and done.current is None
    under = spark.range(1).select(F.lit(None).cast("struct<done:array<string>,current:struct<category:string,date_window:string,offset:int>>").alias("c")).select(incremental.progress(F.col("c"), F.lit("cs.CL"), F.lit("2026-01-08"), F.lit(40)).alias("x")).first().x
    assert under.done == [] and tuple(under.current) == ("cs.CL", "2026-01-08", 40)


def test_stream_equals_batch(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    weeks = incremental.tumbling(stream, "ts", "7 days", incremental.MONDAY, "1 day", "event_type")
    run = weeks.writeStream.format("memory").queryName("weeks").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    run.awaitTermination(120)
    want = sorted((str(r.window.start), r.event_type, r.n_rows) for r in incremental.tumbling(events, "ts", "7 days", incremental.MONDAY, None, "event_type").collect())
    assert sorted((str(r.window.start), r.event_type, r.n_rows) for r in spark.table("weeks").collect()) == want
    seen = []
    incremental.into_tables(stream, lambda df, n: seen.append(df.count()), f"{tmp_path}/d").awaitTermination(120)
    assert sum(seen) == events.count()


def test_constraints(spark):
    parent, child = spark.createDataFrame([(1,)], "id int"), spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "pid int, x string")
    assert [r.x for r in cascade(child, parent, "pid", "id").collect()] == ["a"]
    vectors = spark.createDataFrame([([1.0, 2.0],)], "v array<double>")
    check_dimension(vectors, "v", 2)
    with pytest.raises(ValueError):
        check_dimension(vectors, "v", 3)


def test_samples_and_missing_tables(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"id":"1","query":"q","answer":"a","arxiv_ids":["x"]}\n\n{"id":"2","question":"p","answers":["b","c"]}\n')
    got = tables.samples(spark, f"{tmp_path}/s.jsonl").orderBy("qid").collect()
    assert [(r.question, r.golds, r.gold_citations) for r in got] == [("q", ["a"], ["x"]), ("p", ["b", "c"], [])]
    assert tables.read_or_empty(spark, f"{tmp_path}/none", "a int").count() == 0
    tables.write_json(spark.createDataFrame([(1, ["x"])], "a int, b array<string>"), f"{tmp_path}/out")
    tables.write_json(spark.createDataFrame([(2, ["y", None])], "a int, b array<string>"), f"{tmp_path}/out")
    assert [tuple(r) for r in spark.read.schema("a int, b array<string>").json(f"{tmp_path}/out").collect()] == [(2, ["y", None])]


def embedder(dim):
    return lambda texts: [[float(len(t) % (k + 2)) for k in range(dim)] for t in texts]


def gazetteer(names):
    return lambda rows: json.dumps({"papers": [{"arxiv_id": i, "concepts": [{"name": n, "type": t} for n, t in names.items() if n.lower() in text.lower()]} for i, text in rows]})


def test_indexing(spark):
    papers = spark.createDataFrame([("1", "T", "graph nets", None, None, None, dt.datetime(2026, 1, 1)), ("2", "", "", None, None, None, dt.datetime(2026, 1, 1)), ("3", "U", "BERT", [1.0, 0.0, 0.0, 0.0], "hashing", dt.datetime(2026, 1, 2), dt.datetime(2026, 1, 1))], "arxiv_id string, title string, abstract_clean string, embedding array<float>, embedding_model string, embedding_updated_at timestamp, updated_at timestamp")
    made = indexing.embed_pending(papers, embedder(4), "hashing", 4)
    assert [r.arxiv_id for r in made.collect()] == ["1"]
    stored = indexing.store_vectors(papers, made, now=F.lit(dt.datetime(2026, 2, 1)))
    assert {r.arxiv_id: r.embedding is not None for r in stored.collect()} == {"1": True, "2": False, "3": True}
    assert indexing.embed_pending(stored, embedder(4), "hashing", 4).count() == 0
    with pytest.raises(Exception, match="must give"):
        indexing.embed_pending(papers, embedder(3), "hashing", 4).collect()
    rows = papers.select(F.col("arxiv_id").alias("paper_id"), F.col("abstract_clean").alias("abstract"))
    found = indexing.extract_concepts(rows, spark.createDataFrame([("9",)], "paper_id string"), gazetteer({"Graph Nets": "model", "nets": "bad"}))
    got = {r.paper_id: [(c.name, c.type) for c in r.concepts] for r in found.collect()}
    assert got == {"1": [("Graph Nets", "model"), ("nets", "other")], "3": []}
    known, links = indexing.store_concepts(spark.createDataFrame([(4, "NETS", "nets")], "id long, name string, key string"), spark.createDataFrame([("1", 4)], "paper_id string, concept_id long"), found)
    assert {(r.id, r.name) for r in known.collect()} == {(4, "NETS"), (5, "Graph Nets")} and links.count() == 2


def test_long_texts_in_pieces(spark):
    said = "x" * 1150 + " Graph Nets " + "y" * 3000 + " nets " + "z" * 1300 + " BERT"
    rows = spark.createDataFrame([("1", said), ("2", "BERT"), ("3", "")], "paper_id string, abstract string")
    none = spark.createDataFrame([], "paper_id string")
    get = lambda **o: {r.paper_id: [c.name for c in r.concepts] for r in indexing.extract_concepts(rows, none, gazetteer({"Graph Nets": "model", "nets": "task", "BERT": "model"}), **o).collect()}
    assert get() == {"1": ["Graph Nets", "nets", "BERT"], "2": ["BERT"]}
    assert get(limit=1200)["1"] == ["Graph Nets", "nets"]
    assert value(spark, indexing.pieces(F.lit("abcdefgh"), 4, 2)) == ["abcd", "cdef", "efgh"] and value(spark, indexing.pieces(F.lit("a"), 4, 2)) == ["a"]


def test_failing_embedders(spark):
    papers = spark.createDataFrame([(str(k), "t", "w" * (k + 1)) for k in range(12)], "arxiv_id string, title string, abstract_clean string").coalesce(1)

    def fails(texts):
        if any(len(t) in (6, 7) for t in texts):
            raise OSError("down")
        return [[1.0, 0.0] for _ in texts]

    made = {r.arxiv_id: (r.embedding is not None, r.embedding_model) for r in indexing.embed_pending(papers, fails, "m", 2, batch=2, wait=0.0).collect()}
    assert len(made) == 12 and {k for k, v in made.items() if v == (False, None)} and all(v in ((True, "m"), (False, None)) for v in made.values())

    def down(texts):
        raise OSError("down")

    with pytest.raises(Exception, match="3 batches in a row"):
        indexing.embed_pending(papers, down, "m", 2, batch=2, wait=0.0).collect()


def test_runs(spark):
    warnings = indexing.run_stages([("a", lambda: None), ("b", lambda: 1 / 0), ("c", lambda: None)])
    assert warnings == ["b: division by zero"]
    runs = spark.createDataFrame([(1, dt.datetime(2026, 1, 1), None, "running", None, (["x"], ("cs.AI", "2026-01-08", 5)))], "id long, started_at timestamp, completed_at timestamp, status string, error_message string, last_checkpoint struct<done:array<string>,current:struct<category:string,date_window:string,offset:int>>")
    done = indexing.finish(runs, 1, "completed", warnings, F.lit(dt.datetime(2026, 1, 1, 0, 1)))
    assert done.first().error_message == warnings[0]
    assert indexing.status(done, F.current_timestamp()).first() == (1, "completed", 60, "2026-01-08")


def feed(n, down_at=None):
    """A feed of n papers for each category and week; the page at ``down_at`` fails once."""
    calls = []

    def fetch(spark, category, first, last, offset, size):
        calls.append((category, first, offset, size))
        if down_at == (category, first, offset) and calls.count(calls[-1]) == 1:
            raise OSError("down")
        rows = [(f"{category}-{first}-{k}" if k % 3 else f"both-{first}-{k}", f"T{k}", "abstract", f"{first}T00:00:00Z", f"{first}T0{'cs.CL' == category:d}:00:00Z", [f"Author {k % 4}", "Someone"], category, [category, "cs.LG"], None, None) for k in range(offset, min(n, offset + size))]
        return spark.createDataFrame(rows, RAW_PAPERS)

    return fetch, calls


def test_a_run_goes_on_where_it_stopped(spark, tmp_path):
    empty = {"papers": PAPERS, "authors": AUTHORS, "paper_authors": PAPER_AUTHORS, "categories": CATEGORIES, "paper_categories": PAPER_CATEGORIES, "runs": RUNS}
    now = F.lit(dt.datetime(2026, 2, 1))

    def outcome(root, down_at=None):
        store = tables.Versions(spark, root)
        store.write(**{k: spark.createDataFrame([], v) for k, v in empty.items()})
        fetch, calls = feed(7, down_at)
        go = lambda run_id: ingest.run(store, run_id, ["cs.AI", "cs.CL"], "2026-01-01", "2026-01-07", lambda *a: fetch(spark, *a), max_papers=7, page=3, stages=[("x", lambda: 1 / 0)], now=now).first()
        if down_at:
            with pytest.raises(OSError):
                go(1)
            half = store.read()["runs"].first()
            assert half.status == "failed" and tuple(half.last_checkpoint.current) == down_at
        done = go(1)
        return done, {k: sorted(map(str, v.collect())) for k, v in store.read().items() if k != "runs"}, calls

    plain, held, calls = outcome(f"{tmp_path}/a")
    # 7 papers over two categories: 4 each, and no more than 7 in all; one paper is in both, and newer in the second
    assert [c[3] for c in calls] == [3, 1, 3] and (plain.papers_fetched, plain.papers_inserted, plain.papers_updated) == (7, 6, 1)
    assert (plain.status, plain.error_message, plain.last_checkpoint.done) == ("completed", "x: division by zero", ["cs.AI:2026-01-01", "cs.CL:2026-01-01"])
    assert len(held["papers"]) == 6
    again, same, more = outcome(f"{tmp_path}/b", ("cs.AI", "2026-01-01", 3))
    assert same == held and (again.papers_fetched, again.papers_inserted, again.papers_updated) == (7, 6, 1) and len(more) == len(calls) + 1
    store = tables.Versions(spark, f"{tmp_path}/a")
    store.write(runs=store.read()["runs"].withColumn("status", F.lit("running")))
    with pytest.raises(RuntimeError):
        ingest.run(store, 2, ["cs.AI"], "2026-01-01", "2026-01-07", None, max_papers=1)
    assert ingest.counted(store.read()["runs"], 1, papers_embedded=5).first().papers_embedded == 5


def test_a_stream_into_keyed_tables(spark, tmp_path):
    empty = {"papers": PAPERS, "authors": AUTHORS, "paper_authors": PAPER_AUTHORS, "categories": CATEGORIES, "paper_categories": PAPER_CATEGORIES}
    store = tables.Versions(spark, f"{tmp_path}/t")
    store.write(**{k: spark.createDataFrame([], v) for k, v in empty.items()})
    spark.createDataFrame([(FEED,)], "body string").write.parquet(f"{tmp_path}/in")
    now = F.lit(dt.datetime(2026, 2, 1))

    def apply(df, n):
        new = ingest.ingest(store.read(), atom.parse(df), now)
        store.write(keep=2, **(new | {"papers": new["papers"].drop("action")}))

    stream = lambda: spark.readStream.schema("body string").parquet(f"{tmp_path}/in")
    incremental.into_tables(stream(), apply, f"{tmp_path}/c").awaitTermination(120)
    rows = {k: sorted(map(str, v.collect())) for k, v in store.read().items()}
    assert len(rows["papers"]) == 2
    incremental.into_tables(stream(), apply, f"{tmp_path}/other").awaitTermination(120)  # the same files once more
    assert {k: sorted(map(str, v.collect())) for k, v in store.read().items()} == rows


def test_entities_of_whole_texts(spark, small):
    rows = spark.read.parquet(f"{small}/pages.parquet").select("page_id", "html")
    got = {r.page_id: r.cleaned for r in rows.select("page_id", text.clean_text(F.col("html")).alias("cleaned")).collect()}
    for r in rows.collect():
        said = html.unescape(r.html or "")
        for pattern, new in text.LATEX_RULES:
            said = re.sub(pattern, new.replace("$1", r"\1"), said)
        assert got[r.page_id] == re.sub(r"\s+", " ", unicodedata.normalize("NFC", said)).strip(), r.page_id


def test_the_rest_works_without_the_llm_folders(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for gone in (["corpus_pipeline.py"], []):
        copy = tmp_path / f"copy{len(gone)}"
        shutil.copytree(root, copy, ignore=shutil.ignore_patterns("llm", ".git", "__pycache__", "*.json", "spark-warehouse", *gone))
        said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), [q for q in e.queries() if q.startswith('op') or q == 'pipeline'])"], cwd=copy, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, timeout=100)
        assert said.stdout.split(" ", 1)[1].strip() == "[]", said.stderr[-500:]
