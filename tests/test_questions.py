"""Questions in bulk against one by one."""

import os

import pytest
from pyspark.sql import functions as F
from quillwork.operators import fusion
from quillwork.plans import questions, retrieval

FOUND = {"near": [("d1", 0.7, "one"), ("d2", 0.1, "two"), ("d3", 0.5, "three")], "far": [("d2", 0.1, "two")], "better": [("2601.00004", 0.46, "four arXiv:2601.00004")], "null": [("d5", None, "five")], "edge": [("d6", fusion.LOW, "six")]}
QUESTIONS = {"a": "near", "b": "far", "c": "null", "d": "nothing", "e": "edge", "f": " far", "g": "stays", "h": "empty"}
REWRITTEN = {"far": "better", "null": "null", "nothing": " near ", "stays": "far", "empty": "", " far": None}


def table(spark):
    rows = [(q, d, s, k, f"T{d}", t) for q, docs in FOUND.items() for k, (d, s, t) in enumerate(docs, 1)]
    return spark.createDataFrame(rows, "query string, doc_id string, sim double, rank int, title string, text string")


def answers():
    return lambda question, prompt: {"answer": f" {len(prompt)} ", "cited": ["d1", "arXiv:2601.00004v1"]} if "four" not in prompt else f"see {prompt[-16:]}"


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame(list(QUESTIONS.items()), "qid string, question string")


def test_many_are_answered_as_each_is(spark, asked):
    held, answer = table(spark), answers()
    search = lambda q: q.join(held, "query").drop("query")
    steps = [questions.retrieve(search), questions.rewrite(lambda pairs: [REWRITTEN[q] for q, _ in pairs], search), questions.gate(), questions.generate(lambda pairs: [answer(*p) for p in pairs], batch=2), questions.check(lambda pairs: ["T" in p for _, p in pairs])]
    got = {r.qid: r for r in questions.ask_batch(asked, steps).collect()}
    assert set(got) == set(QUESTIONS)
    for qid, text in QUESTIONS.items():
        one = retrieval.ask(text, lambda q: held.where(F.col("query") == q), lambda q, p: answer(q, p), rewrite=lambda q, last: REWRITTEN[q], faithful=lambda a, p: "T" in p)
        r = got[qid]
        assert (r.answer, r.confidence, r.iterations, r.faithful, r.cited, [d.doc_id for d in r.docs]) == (one.answer, one.confidence, one.iterations, one.faithful, one.cited, [d["doc_id"] for d in one.docs]), qid


def test_services_that_fail(spark, asked, tmp_path):
    held = table(spark)
    search = lambda q: q.join(held, "query").drop("query")

    def model(kind, calls=1):
        def say(pairs):
            where = f"{tmp_path}/{kind.__name__}-{abs(hash(pairs[0]))}"
            n = int(open(where).read()) if os.path.exists(where) else 0
            with open(where, "w") as f:
                f.write(str(n + 1))
            if n < calls:
                raise kind("no", 0.01)
            return ["fine"] * len(pairs)

        return say

    out = lambda step: {r.qid: (r.answer, r.failed, r.retry_after) for r in questions.ask_batch(asked.where("qid in ('a', 'd')"), [questions.retrieve(search), questions.gate(), step]).collect()}
    nothing = (retrieval.NO_MATCH, None, None)
    assert out(questions.generate(model(questions.RateLimited))) == {"a": ("fine", None, None), "d": nothing}
    assert out(questions.generate(model(questions.RateLimited, 9), attempts=2)) == {"a": (None, "rate_limited", 0.01), "d": nothing}
    assert out(questions.generate(model(questions.Unavailable, 9), attempts=1)) == {"a": (None, "unavailable", 0.01), "d": nothing}
    with pytest.raises(Exception, match="division"):
        out(questions.generate(lambda pairs: [1 / 0]))
    kept = questions.ask_batch(asked.where("qid = 'b'"), [questions.retrieve(search), questions.rewrite(model(questions.Unavailable, 9), search, attempts=1), questions.gate(), questions.generate(lambda p: ["x"])]).first()
    assert (kept.answer, kept.iterations, kept.failed) == (retrieval.NO_MATCH, 1, None)


def test_steps_can_be_replaced(spark, asked):
    held = table(spark)
    search = lambda q: q.join(held, "query").drop("query")
    backwards = lambda state: state.withColumn("docs", F.reverse("docs"))
    out = questions.ask_batch(asked.where("qid = 'a'"), [questions.retrieve(search), backwards, questions.gate(0.0, 2), questions.shorten(2), questions.generate(lambda pairs: [p for _, p in pairs])]).first()
    assert out.answer == "[1] Td3\nth\n\n[2] Td2\ntw" and out.confidence == "medium"
    rows = spark.createDataFrame([("x", " "), ("y", None), (None, "near"), ("z", "near"), ("z", "nearer")], "qid string, question string")
    got = {r.qid: (r.failed, r.answer) for r in questions.ask_batch(rows, [questions.retrieve(search), questions.gate(), questions.generate(lambda pairs: [q for q, _ in pairs])]).collect()}
    assert got == {"x": ("blank", None), "y": ("blank", None), "z": (None, "near")}
    assert questions.ask_batch(rows.limit(0), [questions.retrieve(search), questions.gate()]).count() == 0
