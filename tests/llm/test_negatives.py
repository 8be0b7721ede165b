"""Hard negatives against brute force: clusters, copies, ties, odd rows."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.llm import negatives

SCHEMA = "id long, label long, x array<double>, score double, key string, v int, list int"


def brute(rows, asks, k=5, m=3):
    ok = [(i, c, [math.floor(256 * a) for a in x]) for i, c, x, *_ in rows if i is not None and c is not None and x is not None and all(a is not None and math.isfinite(a) for a in x)]
    out = []
    for a in (r for r in ok if asks(r[0])):
        met = [(b[0], b[1] == a[1], sum(p * q for p, q in zip(a[2], b[2], strict=True))) for b in ok if b is not a and len(b[2]) == len(a[2])]
        met.sort(key=lambda r: (-r[2], r[0]))
        for p in [r for r in met if r[1]][:k]:
            fit = [n for n in met if not n[1] and 50 * p[2] <= 100 * n[2] <= 95 * p[2]][:m]
            out += [(a[0], p[0], rank, n[0], p[2], n[2]) for rank, n in enumerate(fit, 1)]
    return Counter(out)


def mined(spark, rows, lists=None, by=10):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    all_rows = negatives.integers(df, "id", "x", F.col("label"))
    return Counter(map(tuple, negatives.mine(all_rows, all_rows.where(F.col("id") % by == 0), lists=lists).collect()))


def clustered(n, width, seed, spread=0.2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, width))
    return [(i, int(rng.integers(4)), (centres[i % 6] + spread * rng.normal(size=width)).round(2).tolist(), 0.5, "k", 1, 2) for i in range(n)]


@pytest.mark.parametrize("lists", [1, 5, 24])
def test_clusters(spark, lists):
    rows = clustered(400, 4, lists)
    assert mined(spark, rows, lists) == brute(rows, lambda i: i % 10 == 0)


def test_copies_ties_and_no_structure(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 32)
    monkeypatch.setattr(negatives, "FIRST", 1)
    monkeypatch.setattr(negatives, "GROWTH", 2)
    rng = np.random.default_rng(5)
    rows = [(i, i % 3, [1.0, 0.5, 0.25], 0.5, "k", 1, 2) for i in range(0, 300)]  # one vector in three labels
    rows += [(i, i % 3, rng.integers(-1, 3, 3).astype(float).tolist(), 0.5, "k", 1, 2) for i in range(300, 500)]
    assert mined(spark, rows, 7) == brute(rows, lambda i: i % 10 == 0)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    tail = (None, None, None, None)
    rows = [
        (0, 1, [1.0, 2.0], *tail), (10, 1, [1.0, 2.0], *tail), (1, 1, [1.5, 2.0], *tail), (2, 2, [0.7, 1.4], *tail), (3, 2, [0.9, 1.6], *tail), (4, None, [1.0, 1.0], *tail), (5, 1, None, *tail),
        (20, 2, [nan, 1.0], *tail), (30, 2, [inf, 1.0], *tail), (40, 2, [None, 1.0], *tail), (50, 1, [], *tail), (51, 1, [], *tail), (52, 2, [], *tail), (60, 3, [1.0, 1.0, 1.0], *tail),
        (61, 3, [1.0, 1.0, 2.0], *tail), (62, 4, [0.5, 1.0, 1.0], *tail), (None, 1, [1.0, 2.0], *tail), (70, 5, [0.0, 0.0], *tail), (71, 5, [0.0, 0.0], *tail), (72, 6, [0.0, 0.0], *tail),
        (80, 1, [-1.0, -2.0], *tail), (11, 2, [0.9, 1.6], *tail), (12, 2, [-0.9, 1e-9], *tail),
    ]
    want = brute(rows, lambda i: i % 10 == 0)
    assert len(want) > 5 and mined(spark, rows) == want
    assert mined(spark, [r for r in rows if r[1] is None]) == Counter()
    assert mined(spark, [], by=10) == Counter()


def test_lists_are_left_out(spark):
    """On clustered vectors most lists are never visited."""
    rows = clustered(1200, 8, 3, spread=0.05)
    df = negatives.integers(spark.createDataFrame(rows, SCHEMA), "id", "x", F.col("label"))
    seen, old = [], negatives._meet

    def counted(index, state, met, k, same, kind):
        seen.append((met.count(), len(index.centres)))
        return old(index, state, met, k, same, kind)

    negatives._meet = counted
    try:
        got = Counter(map(tuple, negatives.mine(df, df.where("id % 50 = 0"), lists=24).collect()))
    finally:
        negatives._meet = old
    assert got == brute(rows, lambda i: i % 50 == 0)
    assert sum(n for n, _ in seen) < 0.6 * 2 * 24 * 24


def test_query_equals_sql_on_more(spark, same):
    import duckdb

    from gleanery.llm import queries

    c = duckdb.connect()
    c.sql("create view embeddings as select * from '/root/testdata/sf0.01/embeddings.parquet'")
    same(queries.QUERIES["op12_hard_negatives"](spark, "/root/testdata/sf0.01"), c, negatives.SQL)
