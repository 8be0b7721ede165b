"""Passes over packed rows: what was packed comes back, and no pass leaves shuffle files behind."""

import glob
import os
import tempfile
import time

import numpy as np
import pyarrow as pa

from gleanery.operators import sums, trees
from gleanery.sources.tables import CLEANUP, kept

SCHEMA = "id long, c int, fold int, only int, v array<double>"


def made(n: int = 300, width: int = 4) -> list[tuple]:
    rng = np.random.default_rng(3)
    rows = [(i, i % 3, i % 4, None, rng.random(width).tolist()) for i in range(n)]
    return rows + [(-1 - i, i % 3, None, i % 4, rng.random(width).tolist()) for i in range(40)]


def shuffled(spark) -> set[str]:
    at = spark.sparkContext.getConf().get("spark.local.dir", tempfile.gettempdir())
    return set(glob.glob(os.path.join(at, "**", "shuffle_*.data"), recursive=True))


def test_packed_rows_come_back(spark, monkeypatch):
    monkeypatch.setattr(sums, "PACKED", 1000)
    rows = made()
    blocks = sums.packed(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(blocks) > 1
    batch = pa.RecordBatch.from_pydict({"block": [bytes(b.block) for b in blocks]})
    back = [r for one in sums.unpacked([batch]) for r in one.to_pylist()]
    key = lambda r: r[0]
    assert sorted((tuple(r[c] for c in ("id", "c", "fold", "only", "v")) for r in back), key=key) == sorted(rows, key=key)


def test_trees_leave_no_shuffle_files(spark):
    df = kept(spark.createDataFrame(made(), SCHEMA).repartition(3))
    bins = trees.Bins.fit(df, 4)  # a bounded sample, whose own shuffle isn't looked at
    before, setting = shuffled(spark), spark.conf.get(CLEANUP)
    trees.grow(df, [(k, t) for k in range(4) for t in range(2)], bins, 4, 3, 4, depth=3)
    for _ in range(50):
        left = shuffled(spark) - before
        if not left:
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(CLEANUP) == setting


def test_tables_leave_no_shuffle_files(spark):
    before = shuffled(spark)
    kept(spark.range(1000).repartition(4, "id"))
    for _ in range(50):
        left = shuffled(spark) - before
        if not left:
            break
        time.sleep(0.1)
    assert not left
