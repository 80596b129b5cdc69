"""The registered queries, against SQL where there is some, and the pipeline against a plain version."""

import re
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from oracle import compare
from quillwork.llm import packing, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, small, name):
    assert compare(queries.queries()[name](spark, small), queries.oracle_sql()[name], small) == ""


def test_shard_query(spark, small):
    rows = queries.op2_shard(spark, small).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in spark.read.parquet(f"{small}/documents.parquet").collect())
    sizes = Counter(r.shard for r in rows)
    assert set(sizes) == set(range(40)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}


def test_shard_query_deals_whole_texts(spark, small, monkeypatch):
    given = []
    deal = queries.sharding.shard
    monkeypatch.setattr(queries.sharding, "shard", lambda df, *a, **k: (given.append(df.columns), deal(df, *a, **k))[1])
    queries.op2_shard(spark, small)
    assert given == [["doc_id", "text"]]


def grams(t, n):
    w = WORD.findall(t)
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def alike(a, b):
    x, y = grams(a, 5), grams(b, 5)
    shared = sum((x & y).values())
    return shared >= 0.8 * (sum(x.values()) + sum(y.values()) - shared)


def test_pipeline(spark, small, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "MinHash near-dedup", "substring dedup", "benchmark decontamination", "byte-level BPE encoding and decoding"]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    steps = [{r.doc_id: r for r in docs.collect()}]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, small).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        steps.append({r.doc_id: r for r in docs.collect()})
    first, kept, single, cut, clean, coded = steps

    def bad(t):
        n, held, g = len(WORD.findall(t)), {5: set(), 10: set()}, {k: grams(t, k) for k in (5, 10, 51)}
        w = WORD.findall(t)
        for k in (5, 10):
            for i in range(n - k + 1):
                if g[k][tuple(w[i : i + k])] > 1:
                    held[k] |= set(range(i, i + k))
        return n < 10 or len(held[5]) > 0.2 * n or len(held[10]) > 0.2 * n or any(v > 1 for v in g[51].values())

    assert set(kept) == {d for d, r in first.items() if not bad(r.text)}
    parent = {d: d for d in kept}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(kept)
    bags = {d: grams(kept[d].text, 5) for d in ids}
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if bags[a].keys() & bags[b].keys() and alike(kept[a].text, kept[b].text):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert set(single) == {d for d in ids if find(d) == d}
    seen = {}
    for d in sorted(single):
        for g in grams(single[d].text, 50):
            seen.setdefault(g, d)
    for d, r in single.items():
        again = any(seen[g] < d for g in grams(r.text, 50))
        if not again and (d not in cut or cut[d].text != r.text):  # nearly equal passages go too
            gone = grams(r.text, 5) - grams(cut[d].text if d in cut else "", 5)
            known = [g for g in gone if any(g in bags[e] for e in single if e < d)]
            assert len(gone) >= 40 and len(known) >= 0.6 * len(gone)  # runs over the cuts go as well
        if d in cut:
            assert not any(seen.get(g, d) < d for g in grams(cut[d].text, 50)) and cut[d].n_chars == len(cut[d].text)
    items = [r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    assert all(not any(t in r.text for t in items) for r in clean.values())
    assert set(clean) <= set(cut) and set(coded) == set(clean)
    own = packing.tokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    for d, r in coded.items():
        assert np.frombuffer(r.ids, "<u4").tolist() == own.encode_ordinary(r.text) and r.n_tokens == len(r.ids) // 4
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, small).collect()) == sorted(coded)


ROWS = [(1, None, "en", "s", 1), (2, "", None, None, None), (None, "w " * 3, "en", "s", 6), (None, " ".join(f"n{k}" for k in range(30)), "en", "s", 90), (3, " ".join(f"v{k}" for k in range(60)), "de", "s", 300), (3, " ".join(f"v{k}" for k in range(60)), "de", "s", 300), (4, " ".join(f"v{k}" for k in range(60)), "de", "s", 300), (5, " ".join(f"u{k}" for k in range(20000)), None, "s", 1)]


def test_stages_take_any_rows(spark, small):
    docs = spark.createDataFrame([(*r, "x") for r in ROWS], "doc_id long, text string, lang string, source string, n_chars long, spans string")
    ids = lambda df: sorted((r.doc_id is None, r.doc_id or 0) for r in df.collect())
    none, some = (True, 0), lambda *x: [(False, k) for k in x]
    want = {
        "quality rules": [*some(3, 3, 4, 5), none],
        "MinHash near-dedup": [*some(1, 2, 3, 3, 5), none, none],
        "substring dedup": [*some(1, 2, 3, 3, 5), none, none],
        "benchmark decontamination": [*some(1, 2, 3, 3, 4, 5), none, none],
        "byte-level BPE encoding and decoding": [*some(1, 2, 3, 3, 4, 5), none, none],
    }
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small)
        assert out.columns[:5] == list(corpus_pipeline.DOCUMENT) and "spans" not in out.columns
        assert ids(out) == want[name], name
        assert stage(spark, docs.limit(0), small).count() == 0


def texts_of(spark, small):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}


def test_query_near_duplicates(spark, small):
    texts, rows = texts_of(spark, small), queries.op1_near_duplicates(spark, small).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts) and all(r.is_first == (r.doc_id == r.class_id) for r in rows)
    of = {r.doc_id: r.class_id for r in rows}
    bags = {d: grams(t, 5) for d, t in texts.items()}
    for a in texts:
        for b in texts:
            if a < b and bags[a].keys() & bags[b].keys():
                assert not alike(texts[a], texts[b]) or of[a] == of[b]


def test_query_prefix_counts(spark, small):
    import tokenizers

    own = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    own.no_truncation()
    own.no_padding()
    texts = texts_of(spark, small)
    for r in queries.op4_prefix_counts(spark, small).collect():
        t = texts[r.doc_id]
        n = len(own.encode(t, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 2048)
        assert r.chars_in_limit == len(t) if n <= 2048 else len(own.encode(t[: r.chars_in_limit], add_special_tokens=False).ids) <= 2048


def test_query_decontaminate(spark, small):
    from quillwork.llm import decontaminate

    fold = lambda t: re.findall(r"[^\s!-/:-@\[-`{-~]+", t.lower())
    items = {r.item_id: r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    texts, found = texts_of(spark, small), {r.doc_id: r for r in queries.op5_decontaminate(spark, small).collect()}
    assert set(found) == set(texts)
    for d, t in texts.items():
        w = " " + " ".join(fold(t)) + " "
        whole = [i for i, x in items.items() if len(fold(x)) >= 5 and " " + " ".join(fold(x)) + " " in w]
        assert found[d].contaminated == (found[d].n_items > 0) and found[d].n_items >= len(whole)
        assert not whole or (found[d].coverage == 1.0 and found[d].best_item == min(whole))
    assert decontaminate.decontaminate(spark.createDataFrame([], "doc_id long, text string"), spark.read.parquet(f"{small}/benchmark.parquet")).count() == 0


def test_query_substrings(spark, small):
    texts = texts_of(spark, small)
    seen = {}
    rows = {r.doc_id: r for r in queries.op6_substrings(spark, small).collect()}
    assert set(rows) == set(texts)
    for d in sorted(texts):
        w = WORD.findall(texts[d])
        runs = [tuple(w[i : i + 50]) for i in range(len(w) - 49)]
        held = {j for i, g in enumerate(runs) if seen.get(g, d) < d for j in range(i, i + 50)}
        got = {j for s in rows[d].spans for j in range(s.start, s.end)}
        assert held <= got and len(got) == rows[d].repeated_words and len(rows[d].spans) == rows[d].n_passages
        assert all(s.source < d for s in rows[d].spans) and rows[d].sources == sorted({s.source for s in rows[d].spans})
        for g in runs:
            seen.setdefault(g, d)


def test_query_pack(spark, small):
    own = packing.tokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    texts, parts = texts_of(spark, small), {}
    rows = queries.op9_pack(spark, small).collect()
    for r in rows:
        ids, place = np.frombuffer(r.ids, "<u4"), np.frombuffer(r.positions, np.uint16)
        assert len(ids) == len(place) == 2048 and r.cu_seqlens[-1] == r.n_tokens and r.n_segments == len(r.doc_ids)
        for d, at, a, b in zip(r.doc_ids, r.doc_starts, r.cu_seqlens[:-1], r.cu_seqlens[1:], strict=True):
            parts.setdefault(d, {})[at] = ids[a:b].tolist()
            assert (place[a:b] == np.arange(b - a)).all()
    for d, t in texts.items():
        assert [x for at in sorted(parts.get(d, {})) for x in parts[d][at]] == own.encode_ordinary(t)


def test_query_bpe(spark, small):
    import hashlib

    own = packing.tokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    texts = texts_of(spark, small)
    for r in queries.op10_bpe(spark, small).collect():
        ids = np.array(own.encode_ordinary(texts[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
