"""Periodic runs against brute force."""

import hashlib
import random
import re
import zlib

import pyarrow as pa
import pytest
from quillwork.llm import queries, runs


def brute(w, least=6, exponent=4):
    out, n = [], len(w)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j + q - i if j > i else 0
            if length >= max(least, exponent * q) and not any(w[i : i + length - d] == w[i + d : i + length] for d in range(1, q)):
                out.append((i, length, q))
            i = max(i + 1, j)
    return sorted(out, key=lambda x: (x[0], x[2]))


def dropped(w, found):
    gone = {k for s, length, q in found for k in range(s + q, s + length)}
    return [x for k, x in enumerate(w) if k not in gone]


def periodic(rng):
    w = rng.choices("abcdefghijklmnopqrstuvwxyz"[: rng.choice([1, 2, 3, 26])], k=rng.randint(0, 60))
    for _ in range(rng.randint(0, 3)):
        at, u = rng.randint(0, len(w)), rng.choices("abxy", k=rng.randint(1, 6)) * rng.randint(2, 7)
        w[at:at] = u[: rng.randint(0, len(u))]
    return w


@pytest.mark.parametrize(("least", "exponent"), [(6, 4), (4, 2), (9, 3), (5, 5)])
def test_runs_of_texts_in_a_row(least, exponent):
    rng = random.Random(least)
    for _ in range(300):
        texts = [periodic(rng) for _ in range(rng.randint(1, 4))]
        g = runs.grid(pa.array([" ".join(w) for w in texts]))
        found = runs.runs_in(g, g.data.tobytes(), least, exponent)
        assert [found.get(d, []) for d in range(len(texts))] == [brute(w, least, exponent) for w in texts]


def test_squares_of_any_exponent():
    rng = random.Random(2)
    for _ in range(200):
        w = rng.choices("ab", k=rng.randint(0, 40))
        assert sorted((s, e - s, q) for (s, q), e in runs.squares([ord(c) for c in w]).items()) == sorted(brute(w, 2, 2))


def test_one_word_and_a_long_period_take_seconds():
    for w in ([7] * 200_000, [k % 40_000 for k in range(200_000)]):
        (found,) = runs.squares(w).items()
        assert found == ((0, 1 if w[1] == 7 else 40_000), 200_000)


def test_find_runs_takes_any_rows(spark):
    rows = [(1, None, 1), (2, "", 2), (3, " \t\n", 3), (4, "a " * 7, 4), (4, "a " * 7, 4), (None, "x\x0by z", None), (5, "ab cd " * 50_000 + "e", 5)]
    out = runs.find_runs(spark.createDataFrame(rows, "id int, text string, RUNS int")).collect()
    assert sorted(repr((r.id, [tuple(x) for x in r.runs], r.collapsed)) for r in out) == sorted(map(repr, [(1, [], ""), (2, [], ""), (3, [], ""), (4, [(0, 7, 1)], "a"), (4, [(0, 7, 1)], "a"), (None, [], "x y z"), (5, [(0, 100_000, 2)], "ab cd e")]))
    assert runs.find_runs(spark.createDataFrame([], "id int, text string")).count() == 0
    with pytest.raises(ValueError):
        runs.find_runs(spark.createDataFrame([], "text string"), exponent=1)


def test_query_runs(spark, small):
    got = {r.doc_id: r for r in queries.op11_runs(spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    assert len(got) == len(docs)
    seen = 0
    for d in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", d.text or "")
        n, h = len(w), zlib.crc32(str(d.doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
        found = brute(w)
        seen += len(found)
        best = min(found, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None,) * 3)
        r = got[d.doc_id]
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(found), *best, 1000 * best[1] // best[2] if found else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(dropped(w, found)).encode()).hexdigest()
    assert seen > 5
