"""Hard negatives against brute force."""

import math
import random

import pytest
from oracle import compare
from pyspark.sql import functions as F
from quillwork.llm import negatives, oracles, queries


def brute(rows, positives=5, n=10, low=30, high=90, scale=256):
    rows = [(i, y, [math.floor(scale * x) for x in v]) for i, y, v in rows]
    out = []
    for a, y, v in rows:
        if a % 100:
            continue
        scores = sorted((-sum(p * q for p, q in zip(v, w, strict=True)), i, z == y) for i, z, w in rows if i != a)
        for s, i, _ in [x for x in scores if x[2]][:positives]:
            fit = [(t, j) for t, j, same in scores if not same and low * -s <= 100 * -t <= high * -s][:n]
            out += [(a, i, k, j, -s, -t) for k, (t, j) in enumerate(fit, 1)]
    return sorted(out)


def test_query_against_sql(spark, small):
    assert compare(queries.op12_negatives(spark, small), oracles.NEGATIVES, small) == ""


@pytest.mark.parametrize("values", [(-1, 0, 1), (-1.5, 0.25, 0.5, 2), (0, 1e-3)])
def test_ties_zeros_and_a_hot_label(spark, monkeypatch, values):
    rng = random.Random(len(values))
    rows = [(i, 1 if i % 3 == 0 else rng.randrange(4), [float(rng.choice(values)) for _ in range(6)]) for i in rng.sample(range(-500, 2500), 700)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(5)
    want = brute(rows)
    assert want
    assert sorted(map(tuple, negatives.mine(df, F.col("vec_id") % 100 == 0).collect())) == want
    monkeypatch.setattr(negatives, "ANCHOR_BYTES", 700)
    monkeypatch.setattr(negatives, "STRIP", 3)
    assert sorted(map(tuple, negatives.mine(df, F.col("vec_id") % 100 == 0).collect())) == want


def test_large_numbers_are_exact(spark):
    rows = [(0, 1, [3e7, 1.0]), (1, 1, [3e7, 3.0]), (2, 2, [2e7, 1.0]), (3, 2, [2e7, 2.0]), (4, 2, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert sorted(map(tuple, negatives.mine(df, F.col("vec_id") == 0, scale=2).collect())) == brute(rows, scale=2)
    huge = spark.createDataFrame([(0, 1, [1e12]), (1, 1, [1e12])], "vec_id long, label int, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        negatives.mine(huge, F.col("vec_id") == 0).collect()


def test_any_rows(spark):
    nan = math.nan
    rows = [(0, 1, [1.0, 0.0]), (0, 1, [1.0, 0.0]), (1, 1, [1.0]), (2, 2, [0.5, 9.0]), (2, 2, [0.5, 9.0]), (3, 2, None), (4, None, [0.5, 0.0]), (None, 2, [0.5, 0.0]), (5, 2, [nan, 0.0]), (6, 2, [0.5, math.inf]), (7, 2, [None, 0.5]), (8, 2, []), (9, 1, [-1.0, 0.0]), (100, 3, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<double>, id string, score int")
    ask = F.col("vec_id") % 100 == 0
    assert sorted(map(tuple, negatives.mine(df, ask).collect())) == [(0, 1, 1, 2, 65536, 32768)]
    assert negatives.mine(df.limit(0), ask).collect() == [] and negatives.mine(df, F.lit(False)).collect() == []
    with pytest.raises(ValueError):
        negatives.mine(df, ask, negatives=0)


def test_keys_sort_by_anchor_falling_score_and_id():
    import numpy as np

    rng = random.Random(3)
    rows = [tuple(rng.choice([-(2**62), -1, 0, 1, 5, 2**62]) for _ in range(3)) for _ in range(200)]
    keys = negatives.packed(*np.array(rows).T)
    assert [negatives.unpacked(k) for k in keys] == rows
    assert [negatives.unpacked(k) for k in sorted(keys)] == sorted(rows, key=lambda r: (r[0], -r[1], r[2]))
