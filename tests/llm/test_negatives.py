"""Hard negatives against brute force: ties, copies, nulls, groups of anchors, early ends of the walk."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from swatch.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, anchor_id long, q int"


def plain(rows, positives=5, negatives=3, low=50, high=95):
    """(anchor, positive, rank, negative, positive score, negative score) of (id, vector, label) rows."""
    taken = [(i, [math.floor(256 * float(np.float32(x))) for x in v], g) for i, v, g in rows
             if g is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = lambda t: (-t[0], t[1] is None, t[1] or 0)
    for k, (a, u, g) in enumerate(taken):
        if a is None or a % 50:
            continue
        scored = [(sum(x * y for x, y in zip(u, v)), i, h) for j, (i, v, h) in enumerate(taken) if j != k]
        for p, i, _ in sorted((t for t in scored if t[2] == g), key=order)[:positives]:
            fits = (t for t in scored if t[2] != g and low * p <= 100 * t[0] <= high * p)
            for rank, (s, n, _) in enumerate(sorted(fits, key=order)[:negatives], 1):
                yield a, i, rank, n, p, s


def key(r):
    return tuple((x is None, x or 0) for x in r)


def mined(spark, rows):
    df = spark.createDataFrame([(i, v, g, 1, 2) for i, v, g in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in negatives.mine_hard_negatives(df, F.col("vec_id") % 50 == 0).collect()), key=key)


@pytest.mark.parametrize("group_bytes", [negatives.GROUP_BYTES, 400])
def test_equals_brute_force(spark, monkeypatch, group_bytes):
    monkeypatch.setattr(negatives, "GROUP_BYTES", group_bytes)
    monkeypatch.setattr(negatives, "STEP", 16)
    monkeypatch.setattr(negatives, "CHUNK", 100)
    monkeypatch.setattr(negatives, "MEMBERS", 3)
    rng = random.Random(group_bytes)
    centres = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(4)]
    rows = [(i, [c + rng.gauss(0, .4) for c in centres[i % 4]], rng.randrange(3)) for i in range(600)]
    hot = [0.5, -0.25, 1.0, 0.0, 0.125]
    rows += [(1000 + i, hot, i % 2) for i in range(300)]  # a third of all rows are copies, so ids decide
    rows += [(150, rows[150][1], rows[150][2]), (None, hot, 1), (None, hot, 0), (2000, None, 1), (2050, hot, None),
             (2100, [1.0, None, 0., 0., 0.], 1), (2150, [float("nan")] * 5, 1), (2200, [float("inf"), 0., 0., 0., 0.], 1),
             (2250, [0.0] * 5, 1), (2300, hot[:3], 1), (2350, [-x for x in hot], 2)]
    want = sorted(plain(rows), key=key)
    assert len(want) > 100 and mined(spark, rows) == want


def test_nothing_and_large_components(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert negatives.mine_hard_negatives(empty, F.col("vec_id") % 50 == 0).count() == 0
    assert mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []  # no anchor
    big = [(0, [200000.0, 1.0], 1), (1, [190000.0, 3.0], 1), (2, [150000.0, 5.0], 2), (3, [150000.0, 5.5], 2)]
    assert mined(spark, big) == sorted(plain(big), key=key)  # sums beyond 2 ** 53


def test_walk_ends_early(monkeypatch):
    """Members leave the list once its bound proves that nothing later counts."""
    rng = np.random.default_rng(0)
    v = np.floor(256 * np.concatenate([rng.normal(0, .05, (3000, 8)) + np.eye(8)[i % 8] for i in range(2)]))
    group = negatives.Group(np.arange(10), ["a"] * 10, v[:10])
    group.window(np.full((10, 1), -np.inf), np.full((10, 1), np.inf), 5)
    group.begin()
    seen = []
    take = group.take
    monkeypatch.setattr(group, "take", lambda *a: (seen.append(len(a[0])), take(*a)))
    products = []
    real = negatives.walk
    monkeypatch.setattr(negatives, "walk", lambda g, m, *a: (products.append(len(a[0])), real(g, m, *a)))
    negatives.search_chunk(group, np.arange(6000), np.arange(6000), np.zeros(6000, int), v, True)
    assert sum(products) >= 6000 and len(seen) < 6  # of 24 steps
