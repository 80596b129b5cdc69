"""Quality rules, near-duplicates, passages and decontamination against plain versions."""

import os
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from quillwork.llm import decontaminate, minhash, quality, substrings
from quillwork.llm.arrowtext import grid
from quillwork.llm.storage import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(n)]


@pytest.fixture(scope="module")
def documents(spark, small):
    real = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    base = words(120, 1)
    near = []
    for k in range(60):  # a family of near copies
        w = list(base)
        for _ in range(k % 4):
            w[random.Random(k).randrange(len(w))] = f"x{k}"
        near.append((5000 + k, " ".join(w)))
    odd = [(6000, None), (6001, ""), (6002, " \n\t "), (6003, "one two"), (6004, "one  two"), (6005, "one two"), (6006, "a b c d e"), (6007, " ".join(words(4000, 2))), (6008, "w " * 300)]
    return real + near + odd


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS n_words", "2 AS spans", "3 AS class_id", "4 AS _row")


def plain_counts(text):
    w = WORD.findall(text or "")
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    held = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(held)


def longest_repeat(w):
    best = 0
    for i in range(len(w)):
        for j in range(i + 1, len(w)):
            n = 0
            while j + n < len(w) and w[i + n] == w[j + n]:
                n += 1
            best = max(best, n)
    return best


def test_quality(spark, documents):
    rows = documents + [(7000 + k, " ".join(random.Random(k).choices("abcd", k=k))) for k in range(60)]
    found = {r.doc_id: r for r in quality.quality(frame(spark, rows)).collect()}
    for d, t in rows:
        r = found[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_counts(t), d
        if d >= 7000:
            assert r.longest_repeat == longest_repeat(WORD.findall(t))
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
    assert quality.quality(frame(spark, rows).limit(0)).count() == 0


def bag(t):
    w = WORD.findall(t or "")
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def overlap(a, b):
    shared = sum((a & b).values())
    return shared / (sum(a.values()) + sum(b.values()) - shared) if a and b else 0.0


def plain_classes(rows):
    bags = {d: bag(t) for d, t in rows}
    index = {}
    for d, b in bags.items():
        for k in b:
            index.setdefault(k, set()).add(d)
    parent = {d: d for d in bags}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in {(a, b) for held in index.values() for a in held for b in held if a < b}:
        if overlap(bags[a], bags[b]) >= 0.8:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in bags}


def test_near_duplicates(spark, documents):
    rows = documents + documents[3:5]
    found = minhash.near_duplicates(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    want = plain_classes(documents)
    for r in found:
        assert (r.class_id, r.is_first) == (want[r.id], want[r.id] == r.id), r
    nothing = spark.createDataFrame([(None, "a b c d e f g h"), (None, None)], "doc_id long, text string")
    assert [(r.id, r.class_id, r.is_first) for r in minhash.near_duplicates(nothing).collect()] == [(None, None, True)] * 2
    assert minhash.near_duplicates(nothing.limit(0)).count() == 0


def test_signatures_estimate_weighted_similarity():
    runs = np.arange(1, 61, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    a, b = np.arange(60) % 7 + 1, (np.arange(60) * 3) % 7 + 1
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    doc = np.repeat([0, 1], 60)
    s = minhash.signatures(doc, np.concatenate([runs, runs]), np.concatenate([a, b]), 2, 4096)
    assert abs((s[0] == s[1]).mean() - want) < 4 * np.sqrt(want * (1 - want) / 4096)


def test_blocks_find_all_links(spark):
    """Large buckets cut into small blocks give the same components as pairwise comparison."""
    rng = random.Random(4)
    bags = {k: set(rng.sample(range(200), 60)) | set(range(1000, 1100 - k % 30)) for k in range(40)}
    rows = [(1, k, len(b), k, 40, np.array(sorted(b), np.uint32).tobytes()) for k, b in bags.items()]
    df = spark.createDataFrame([(*r[:4], 0, 1, 39, r[5]) for r in rows], "key long, rep long, n long, comp long, major long, many long, few long, bag binary")
    want = {(a, b) for a in bags for b in bags if a < b and len(bags[a] & bags[b]) / len(bags[a] | bags[b]) >= 0.45}

    def classes(edges):
        parent = {k: k for k in bags}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
        return [find(k) for k in bags]

    got = [(r.a, r.b) for r in minhash.overlaps(df, 0.45, block=7, strip=3).collect()]
    assert all((min(x), max(x)) in want for x in got)
    assert classes(got) == classes(want)


def test_passages(spark, documents):
    shared = words(70, 11)
    rows = documents + [(9000 + k, " ".join([*words(60 + k, 100 + k), *shared, *words(40, 200 + k)])) for k in range(8)] + [(9100, " ".join(shared[:49] + words(60, 300)))]
    marked = substrings.mark(frame(spark, rows)).collect()
    assert len(marked) == len(rows)
    seen = {}
    spans = {r.doc_id: r.spans for r in marked}
    for d, t in sorted(rows, key=lambda r: r[0]):
        w = WORD.findall(t or "")
        grams = [tuple(w[i : i + 50]) for i in range(len(w) - 49)]
        held = {j for i, g in enumerate(grams) if seen.get(g, d) < d for j in range(i, i + 50)}
        got = {j for s in spans[d] for j in range(s.start, s.end)}
        assert held <= got, d
        for g in grams:
            seen.setdefault(g, d)
    assert spans[9000] == [] and spans[9100] == []
    left = {r.doc_id: r.text for r in substrings.remove(substrings.mark(frame(spark, rows))).collect()}
    for d, t in rows:
        w = WORD.findall(t or "")
        got = {j for s in spans[d] for j in range(s.start, s.end)}
        assert WORD.findall(left[d] or "") == [x for j, x in enumerate(w) if j not in got]
        assert spans[d] or left[d] == t
    assert substrings.mark(frame(spark, rows).limit(0)).count() == 0


def test_passages_with_shared_boilerplate_inside(spark):
    # runs of the passage first occur in earlier documents with other surroundings: these become the heads of their buckets
    rows, want = [], set()
    for c in range(12):
        line = words(34, 5000 + c)
        inside = [*words(13, 5100 + c), *line, *words(13, 5200 + c)]
        rows.append((100 + c, " ".join([*words(80, 5300 + c), *line, *words(80, 5400 + c)])))
        rows += [(1000 * (k + 1) + c, " ".join([*words(30 + k, 5500 + 9 * c + k), *inside, *words(40, 5700 + 9 * c + k)])) for k in range(3)]
        want |= {(2000 + c, 31, 91), (3000 + c, 32, 92)}
    found = {r.doc_id: r.spans for r in substrings.mark(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(any(s.start <= a and s.end >= b for s in found[d]) for d, a, b in want)
    assert all(found[d] == [] for d in found if d < 2000)


def test_edited_passages(spark):
    # one word of 50 is another: 41 of 46 runs stay, an overlap of 41 / 51
    rows = []
    for c in range(300):
        shared = words(50, 8000 + c)
        edited = [*shared]
        edited[random.Random(c).randrange(5, 45)] = "edited"
        rows += [(c, " ".join([*words(25, 8400 + c), *shared, *words(25, 8800 + c)])), (1000 + c, " ".join([*words(c % 40, 9200 + c), *edited, *words(30, 9600 + c)]))]
    runs = {d: [tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)] for d, t in rows}
    found = {r.doc_id: r.spans for r in substrings.mark(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for c in range(300):
        at = [i for i, g in enumerate(runs[1000 + c]) if g in set(runs[c])]
        assert len(at) == 41 and [(s.start, s.end, s.source) for s in found[1000 + c]] == [(at[0], at[-1] + 5, c)], c
        assert found[c] == []


def test_blocks_name_enough_sources(spark):
    bag = lambda *x, fresh=1: np.array([2 * v + fresh for v in x], np.uint32).tobytes()
    base = range(100, 140)
    rows = [(1, k, k >= 5, bag(*base)) for k in range(600)] + [(1, 700, True, bag(*base, *range(40))), (1, 600, False, bag(*range(40))), (1, 701, True, bag(*range(36), *range(900, 980))), (2, 3, True, bag(*[7] * 40)), (2, 1, False, bag(7, 8)), (2, 2, False, bag(*range(50, 90)))]
    rows += [(3, 1, False, bag(*base)), (3, 2, True, bag(*base, fresh=0)), (3, 4, False, bag(*base))]  # nothing unmarked to find
    all_ = {1: 606, 2: 3, 3: 3}
    made = spark.createDataFrame([(k, r, o, all_[k], b) for k, r, o, b in rows], "key long, rep long, open boolean, all long, bag binary")
    for block in (2048, 200):
        found = [tuple(r) for r in substrings.meeting(made, 36, block).collect()]
        assert {a for a, _ in found} == {*range(5, 600), 700, 701, 3} and all(b < a for a, b in found) and (3, 1) in found
        assert (700, 600) in found and (701, 600) in found
        assert len(found) < 600 * 10 + 10
    with Scratch(spark) as scratch:
        left = {(r.key, r.rep): (r.open, len(r.bag) // 4) for r in substrings.sharing(scratch, made.drop("all"), 36).collect()}
    assert left[1, 701] == (True, 36) and left[1, 5] == (True, 40) and left[2, 3] == (True, 40) and left[2, 1] == (False, 1) and (2, 2) not in left and not any(k == 3 and o for (k, _), (o, _) in left.items())


def test_buckets_of_hot_lines_in_blocks(spark):
    """With buckets larger than a block the same words are marked."""
    line, shared = words(20, 1), words(60, 2)
    rows = [(k, " ".join([*words(60 + k % 7, 100 + k), *line, *words(60, 300 + k)])) for k in range(80)]
    rows += [(500 + k, " ".join([*words(30, 600 + k), *shared[:30], *line, *shared[30:], *words(30, 700 + k)])) for k in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {r.doc_id: r.spans for r in substrings.mark(df).collect()}
    split = {r.doc_id: r.spans for r in substrings.mark(df, block=8).collect()}
    assert whole == split
    assert all(whole[k] == [] for k in (*range(80), 500)) and all([(s.start, s.end) for s in whole[500 + k]] == [(30, 110)] for k in range(1, 6))


def test_compact_windows_cover_every_stretch_once():
    rng = np.random.default_rng(1)
    for n in (1, 2, 9, 30):
        values = rng.integers(0, 2**60, n, dtype=np.uint64)
        l, p, r = substrings.compact_windows(values, np.array([0, n]), 3)
        for i in range(n):
            for j in range(i + 2, n):
                hit = [k for k in range(len(l)) if l[k] <= i <= p[k] <= j < r[k]]
                assert len(hit) == 1 and p[hit[0]] == i + int(np.argmin(values[i : j + 1]))


def plain_tiles(a, b, least):
    ua, ub, total = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in ua and j + n not in ub:
                    n += 1
                best = max(best, (n, -i, -j))
        if best[0] < least:
            return total
        n, i, j = best[0], -best[1], -best[2]
        ua |= set(range(i, i + n))
        ub |= set(range(j, j + n))
        total += n


def test_tiling_is_greedy():
    rng = random.Random(5)
    for _ in range(60):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(3, 25))] for _ in range(2))
        index = decontaminate.Index([0], pa.array([" ".join(b)]), 3)
        got = decontaminate.scan(pa.array([" ".join(a)]), index, 0.0)[0]
        assert (got[0][1] * len(b) if got else 0) == pytest.approx(plain_tiles(a, b, 3))


def test_strips_give_the_same_runs():
    rng = random.Random(6)
    texts = pa.array([" ".join(rng.choice("ab") for _ in range(n)) for n in (90, 0, 40)])
    index = decontaminate.Index([0, 1], pa.array(["a b " * 12, "a " * 9]), 3)
    whole = decontaminate.diagonals(grid(texts), index)
    for limit in (1, 7, 100):
        assert all((x == y).all() for x, y in zip(whole, decontaminate.diagonals(grid(texts), index, limit), strict=True))


def test_one_word_repeated_in_text_and_item():
    index = decontaminate.Index([0], pa.array(["w " * 300]), 5)
    assert decontaminate.scan(pa.array(["w " * 60_000]), index, 0.5) == [[(0, 1.0)]]


def test_decontamination(spark, documents):
    item = words(60, 50)
    moved = item[40:] + item[20:40] + item[:20]
    rows = documents + [(8000, " ".join(words(30, 51) + moved + words(30, 52))), (8001, " ".join(w.upper() + "," for w in item)), (8002, " ".join(item[:20] + words(90, 53)))]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "too short"), (3, None), (None, "a"), (4, " ".join(words(55, 54)))], "item_id long, text string")
    plain = {r.doc_id: r for r in decontaminate.decontaminate(frame(spark, rows), bench).collect()}
    assert {d for d, r in plain.items() if r.contaminated} == {8000, 8001}
    assert plain[8000].best_item == 1 and plain[8001].coverage == 1.0
    blocks = {r.doc_id: r for r in decontaminate.decontaminate(frame(spark, rows), bench, block_bytes=200).collect()}
    assert blocks == plain
    assert not decontaminate.decontaminate(frame(spark, rows), bench.limit(0)).where("contaminated").count()


def test_groups_stay_whole():
    keys = [1] * 3 + [2] * 9 + [3] + [4] * 2 + [5] * 6
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[a:b]), pa.array([0] * (b - a)), pa.array([0] * (b - a)), pa.array(range(a, b))], names=["key", "i", "j", "n"]) for a, b in ((0, 2), (2, 2), (2, 7), (7, 12), (12, 21))]
    for rows in (1, 2, 5, 100):
        tables = list(substrings._whole_keys(iter(batches), rows))
        assert [n for t in tables for n in t["n"].to_pylist()] == list(range(21))
        assert all(a["key"][-1] != b["key"][0] for a, b in zip(tables[:-1], tables[1:], strict=True))
    assert list(substrings._whole_keys(iter([]))) == []


def test_scratch_leaves_the_session_and_deletes(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    with Scratch(spark) as scratch:
        a, b = scratch.cut(spark.range(3)), scratch.cut(spark.range(4))
        scratch.keep(b)
        gone = a.inputFiles()[0].removeprefix("file://")
    assert spark.conf.get(key) == before and b.count() == 4 and not os.path.exists(gone)


def test_grid_takes_sliced_and_null_texts():
    texts = pa.array(["skip", "a  b", None, "", " c\n"]).slice(1)
    g = grid(texts)
    assert np.diff(g.first).tolist() == [2, 0, 0, 1]
    assert g.words()[0] == grid(pa.array(["x a"])).words()[1]
