"""Sharding, chat formatting and the URL filter."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from oracle import compare
from quillwork.llm import chat, links, oracles, queries, sharding
from quillwork.llm.storage import Scratch


def test_shards(spark):
    rows = [(k % 700, f"t{k % 50}", "z") for k in range(2011)] + [(None, None, "z")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, Shard string")
    placed = sharding.shard(df, 13, seed=5, least_blocks=16).collect()
    assert Counter((r.doc_id, r.text) for r in placed) == Counter((d, t) for d, t, _ in rows)
    by = {}
    for r in placed:
        by.setdefault(r.shard, []).append(r.slot)
    sizes = [len(by[s]) for s in range(13)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(rows)
    assert all(sorted(slots) == list(range(len(slots))) for slots in by.values())
    same = Counter((r.doc_id, r.text, r.shard, r.slot) for r in sharding.shard(df.repartition(7), 13, seed=5, least_blocks=16).collect())
    assert same == Counter((r.doc_id, r.text, r.shard, r.slot) for r in placed)
    assert sharding.shard(df.limit(0), 13).count() == 0


def test_matrix_has_its_sums_and_means():
    blocks, shards = [50, 0, 30, 120], [70, 70, 60]
    total = np.zeros((4, 3))
    for seed in range(400):
        m = np.array(sharding.matrix(blocks, shards, seed))
        assert m.sum(axis=1).tolist() == blocks and m.sum(axis=0).tolist() == shards and (m >= 0).all()
        total += m
    want = np.outer(blocks, shards) / 200
    assert np.abs(total / 400 - want).max() < 0.6
    rng = np.random.default_rng(0)
    draws = np.array([sharding.hypergeometric(10**11, 39 * 10**11, 10**6, rng) for _ in range(300)])
    assert abs(draws.mean() - 25000) < 5 * draws.std() / 300**0.5 and 120 < draws.std() < 200


def test_parts_are_flattened_in_order(spark):
    parts = [("text", "see <@image:0> and </s>", None, None, None, None, None), ("image", None, "a.png", 56, 29, None, None), None, ("audio", None, "b.wav", None, None, 2.5, None), ("document", None, "c.pdf", None, None, None, 3), ("text", None, None, None, None, None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "a]b<", [])], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    one = chat.format_chats(chat.flatten(df)).first()
    assert [(a.turn, a.kind, a.ref, a.tokens) for a in one.attachments] == [(0, "image", "a.png", 4), (0, "audio", "b.wav", 63), (0, "document", "c.pdf", 3072)]
    assert one.attachment_tokens == 3139 and one.n_turns == 2
    assert chat.turns_of(one.formatted) == [("user", "see <@image:0> and </s><@image:0><@audio:1><@document:2>"), ("a]b<", "")]
    with pytest.raises(ValueError):
        chat.turns_of(one.formatted + "x")
    with pytest.raises(Exception, match="unknown kind"):
        chat.flatten(spark.createDataFrame([([("video", None, None, None, None, None, None)],)], f"parts array<{chat.PART}>")).collect()


def test_texts_are_read_back(spark):
    said = ["</s>[INST] ok [/INST]", "<.<.", None, "", "<s>[user]x</s>", "a\nb", "<|", "<" * 50, "x" * 20000]
    rows = [(c, t, ("user", "assistant", None)[t % 3], said[((c or 0) + t) % len(said)]) for c in (1, 2, None) for t in range(9)]
    rows.append(rows[0])
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r.conv_id: r for r in chat.read_back(chat.format_chats(chat.flatten(df.withColumn("parts", chat.text_part())))).collect()}
    for c in (1, 2, None):
        turns = sorted((t, role or "", text or "") for k, t, role, text in rows if k == c)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        whole = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        assert found[c].n_turns == len(turns)
        assert found[c].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert (found[c].loss_chars, found[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def page(url, *targets):
    return url, "<p>" + "".join(f'<a HREF="{t}">x</a>' for t in targets) + "</p>"


PAGES = [
    page("http://good.org/fr/1", "http://Friend.com/x", "//friend.com", "/own"),
    page("http://friend.com/1", "https://third.com/"),
    page("http://third.com/1"),
    page("http://bad.net/1", "http://good.org/fr/1"),
    page("http://shill.com/1", "http://bad.net/", "http://bad.net/2"),
    page("http://mixed.com/1", "http://bad.net/", "http://friend.com/", "http://third.com/", "http://good.org/"),
    page("HTTP://WWW.Example.NET/en/x?y#z"), page("ftp://a.example.com/de/"), page("no scheme"), (None, None), page("http://net"), page("http://good.org#/fr/"),
]


def test_url_filter(spark, tmp_path):
    df = spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(PAGES)] + [(0, *PAGES[0])], "page_id long, url string, html string")
    df.write.parquet(f"{tmp_path}/pages.parquet")
    found = links.judge(df.withColumn("HOST", df.page_id), queries.RULES)
    by = {r.page_id: r for r in found.collect()}
    assert (by[6].host, by[6].path, by[6].rule, by[6].verdict) == ("www.example.net", "/en/x", "example.net/en/", "allow")
    assert (by[7].rule, by[7].verdict) == ("example.com/de/", "block")
    assert [(by[k].host, by[k].path, by[k].rule, by[k].verdict) for k in (8, 9)] == [("", "", None, "allow")] * 2
    assert (by[10].host, by[10].path, by[10].rule) == ("net", "", None)
    assert by[11].path == "" and by[11].rule is None
    assert by[4].verdict == "block" and by[5].verdict == by[1].verdict == by[2].verdict == "allow"
    assert compare(queries.op8_links(spark, str(tmp_path)), oracles.url_filter(queries.RULES), str(tmp_path)) == ""
    assert links.judge(df.limit(0), queries.RULES).count() == 0


def farm_pages():
    farm = [page(f"http://farm{k}.com/1", "http://bad.net/") for k in range(100)]
    rest = [page("http://bad.net/1"), page("http://back.com/1", *(f"http://farm{k}.com/" for k in range(40))), page("http://wide.com/1", "http://bad.net/", "http://one.com/", "http://two.com/"), page("http://one.com/1")]
    broken = [("no scheme", '<a href="http://bad.net/">x</a>'), ("also none", "<p>")]
    return [(k, u, h) for k, (u, h) in enumerate(farm + rest + broken)]


def test_many_linkers_of_a_blocked_host(spark, tmp_path):
    df = spark.createDataFrame(farm_pages(), "page_id long, url string, html string")
    df.write.parquet(f"{tmp_path}/pages.parquet")
    found = {r.host: r.verdict for r in links.judge(df, queries.RULES).collect()}
    assert {h for h, v in found.items() if v == "block"} == {*(f"farm{k}.com" for k in range(100)), "bad.net", "back.com"}
    assert compare(queries.op8_links(spark, str(tmp_path)), oracles.url_filter(queries.RULES), str(tmp_path)) == ""


def test_trust_and_distrust_spread(spark):
    edges = spark.createDataFrame([("a", "b", 3), ("a", "c", 1), ("b", "c", 2), ("d", "a", 1), ("d", "c", 5), ("b", "d", 1)], "src string, dst string, links long")
    hosts = spark.createDataFrame([("a", links.UNIT, 0), ("c", 0, links.UNIT)], "host string, trust long, distrust long")
    names, w = "abcd", np.array([[0, 3, 1, 0], [0, 0, 2, 1], [0, 0, 0, 0], [1, 0, 5, 0]], float)
    t = np.array([1.0, 0, 0, 0])
    d = np.array([0, 0, 1.0, 0])
    out = w.sum(1)
    x, y = t.copy(), d.copy()
    for _ in range(400):
        x = 0.15 * t + 0.85 * (w.T @ np.where(out > 0, x / np.maximum(out, 1), 0) + np.where(out == 0, x, 0))
        y = np.maximum(d, 0.85 * (w @ y) / np.maximum(out, 1))
    for tolerance in (1e-2, 1e-6):
        with Scratch(spark) as scratch:
            got = {r.host: (r.t / links.UNIT, r.d / links.UNIT) for r in links.spread(scratch, hosts, edges, tolerance=tolerance).collect()}
        for k, n in enumerate(names):
            assert got[n] == (pytest.approx(x[k], abs=1.01 * tolerance), pytest.approx(y[k], abs=1.01 * tolerance))
