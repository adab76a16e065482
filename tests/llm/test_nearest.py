import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from featurestats.llm import nearest

DDL = "vec_id bigint, embedding array<float>, label int, score string, bound string, slice string"


def brute(rows, is_query, top=5):
    best = {}
    for i, e in rows:
        if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e):
            v = [math.floor(256 * float(x)) for x in e]
            best[i] = max(best.get(i, v), v)
    out = []
    for q, a in best.items():
        if is_query(q):
            whole = {i: sum(x * y for x, y in zip(a, b)) for i, b in best.items() if i != q and len(a) == len(b)}
            scored = sorted((-min(max(s, -(2**63) + 1), 2**63 - 1), i) for i, s in whole.items())
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:top])]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, e, 0, "x", "x", "x") for i, e in rows], DDL)


def check(spark, rows, mod=50, top=5):
    df = frame(spark, rows)
    held = [(r[0], r[1]) for r in df.select("vec_id", "embedding").collect()]
    got = sorted(tuple(r) for r in nearest.top_k(df, F.col("vec_id") % mod == 0, top).collect())
    assert got == brute(held, lambda q: q % mod == 0, top)


def test_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = sorted(tuple(r) for r in nearest.top_k(df, F.col("vec_id") % 50 == 0).collect())
    assert got == brute([(r.vec_id, r.embedding) for r in df.collect()], lambda q: q % 50 == 0)


@pytest.mark.parametrize("size", [(7, 4), (32, 16)])
def test_clusters_copies_and_small_annuli(spark, monkeypatch, size):
    """Many annuli and slices; a third of the rows one vector; lengths far apart; negative products."""
    monkeypatch.setattr(nearest, "ANNULUS", size[0])
    monkeypatch.setattr(nearest, "SLICE", size[1])
    monkeypatch.setattr(nearest, "LANE", 3)
    monkeypatch.setattr(nearest, "PIVOTS", 6)
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (5, 6))
    rows = [(k, (centres[k % 5] * (1 + k % 7) + rng.normal(0, 0.05, 6)).astype(np.float32).tolist()) for k in range(260)]
    rows += [(1000 + k, [0.5, -0.25, 0.0, 0.0, 1.0, 0.0]) for k in range(130)] + [(2000 + k, [-3.0] * 6) for k in range(9)]
    check(spark, rows, 10)


def test_pruning_visits_few_annuli(spark, monkeypatch):
    """On clusters the bounds leave most annuli unread; the answer is that of brute force."""
    monkeypatch.setattr(nearest, "ANNULUS", 16)
    monkeypatch.setattr(nearest, "SLICE", 4)
    seen = []
    compare = nearest.compare
    monkeypatch.setattr(nearest, "compare", lambda work, pivots, top: (seen.append(work.where("turn = 1").count()), compare(work, pivots, top))[1])
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (20, 16))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    x = centres[np.arange(1600) % 20] + rng.normal(0, 0.01, (1600, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    check(spark, [(k, v) for k, v in enumerate(x.astype(np.float32).tolist())])
    n_annuli = 1600 / 16
    assert seen[0] < 0.3 * n_annuli * 32 / 4  # of all pairs of the slices (8 at least) and annuli (100 at least)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (50, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [-inf, 0.0]),
            (None, [9.0, 9.0]), (7, []), (100, []), (8, [1.0, 2.0, 3.0]), (150, [0.001, -0.001]), (9, [0.5, 0.25]), (9, [0.75, 0.0]), (-50, [-1.0, -1.0]), (10, [0.0, 0.0])]
    check(spark, rows)
    check(spark, [(0, [1.0])])
    check(spark, [(1, [1.0]), (2, [2.0])])
    check(spark, [])
    draw = random.Random(2)
    check(spark, [(k, [draw.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(3)]) for k in range(120)], 10, 7)  # ties everywhere


def test_huge_components(spark):
    """Products beyond floats' exact integers, and beyond a long, where scores stand at its ends."""
    check(spark, [(k, [float(2**22 + k), float(-(2**22) - 3 * k), 1.0]) for k in range(60)])
    check(spark, [(k, [2.0**30 * (1 + k / 64), 5.0]) for k in range(60)])
    df = frame(spark, [(0, [2.0**60]), (1, [2.0**60]), (2, [-(2.0**60)])])
    assert [tuple(r) for r in nearest.top_k(df, F.col("vec_id") % 50 == 0).orderBy("rank").collect()] == [(0, 1, 1, 2**63 - 1), (0, 2, 2, -(2**63) + 1)]


def test_bounds_hold():
    rng = np.random.default_rng(1)
    for _ in range(300):
        q, p, v = rng.normal(0, 100, (3, 4)).round()
        d, r = np.linalg.norm(q - p), np.linalg.norm(v - p)
        lo, hi = r - abs(rng.normal()), r + abs(rng.normal())
        gap = max(0.0, lo - d, d - hi)
        assert nearest.upper_bound(np.linalg.norm(q), q @ p, gap, np.linalg.norm(v), hi, np.minimum) >= q @ v
