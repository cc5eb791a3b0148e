import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ferrule.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<float>, units string, score long, win long"


def brute(rows, is_anchor, n_pos=5, n_neg=10):
    good = [(i, lab, [math.floor(256 * float(np.float32(x))) for x in v]) for i, lab, v in rows if None not in (i, lab, v) and all(x is not None and math.isfinite(np.float32(x)) for x in v)]
    out = []
    for i, lab, v in good:
        if not is_anchor(i):
            continue
        scored = sorted((-max(min(sum(a * b for a, b in zip(v, w, strict=True)), 2**63 - 1), -(2**63)), j, m) for j, m, w in good if j != i and len(w) == len(v))
        for p, j, _ in [s for s in scored if s[2] == lab][:n_pos]:
            fit = [s for s in scored if s[2] != lab and 30 * -p <= 100 * -s[0] <= 90 * -p][:n_neg]
            out += [(i, j, rank, k, -p, -s) for rank, (s, k, _) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, **more):
    df = spark.createDataFrame([(*r, "u", 1, 2) for r in rows], SCHEMA).repartition(3)
    got = negatives.mine(df, F.col("vec_id") % 10 == 0, **more)
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in got.collect())


def vectors(n, dim, seed=0, hot=0.4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    rows = []
    for i in range(n):
        lab = 0 if rng.random() < hot else int(rng.integers(6))
        v = centres[lab] + rng.normal(size=dim) * 1.2
        rows.append((i, lab, (v / np.linalg.norm(v)).astype(np.float32).tolist()))
    return rows


@pytest.mark.parametrize("dim", [64, 7])
def test_equals_brute_force(spark, dim):
    rows = vectors(400, dim)
    for i in range(100, 160):  # copies: ties
        rows[i] = (i, rows[i][1], rows[3][2])
    expected = brute(rows, lambda i: i % 10 == 0)
    assert len(expected) > 300
    assert mined(spark, rows) == expected
    assert mined(spark, rows, block_bytes=4096) == expected  # several blocks of anchors


def test_odd_rows_take_no_part(spark):
    rows = vectors(60, 5, seed=2)
    rows += [(None, 1, [0.1] * 5), (70, None, [0.1] * 5), (80, 1, None), (90, 1, [0.1, None, 0.0, 0.0, 0.0]), (61, 1, [float("nan")] * 5), (62, 1, [float("inf")] * 5)]
    rows += [(100, 1, []), (101, 1, []), (102, 2, []), (110, 3, [0.5] * 9), (111, 3, [0.4] * 9), (112, 4, [0.3] * 9), (63, 2, rows[5][2]), (63, 2, rows[5][2])]
    assert mined(spark, rows) == brute(rows, lambda i: i % 10 == 0)
    assert mined(spark, []) == []
    assert mined(spark, [(1, 1, [0.5])]) == []


def test_scores_beyond_doubles(spark):
    rng = random.Random(1)
    rows = [(i, i % 2, [float(np.float32(rng.uniform(0.5, 1) * 10.0 ** rng.choice([3, 6, 9, 20]))) for _ in range(3)]) for i in range(40)]
    assert mined(spark, rows) == brute(rows, lambda i: i % 10 == 0)


def test_bounds_hold_inner_products():
    rng = np.random.default_rng(4)
    x, q = np.floor(256 * rng.normal(size=(50, 30))), np.floor(256 * rng.normal(size=(20, 30)))
    wider = None
    for (mx, dx), (mq, dq) in zip(negatives._summaries(x), negatives._summaries(q), strict=True):
        middle, wide, exact = mx @ mq.T, dx @ dq.T, x @ q.T
        assert (abs(exact - middle) <= wide + 1e-6).all()
        assert wider is None or (middle + wide <= wider + 1e-6).all()  # levels refine each other
        wider = middle + wide
