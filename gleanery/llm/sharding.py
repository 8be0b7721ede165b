"""Sharding by a Feistel permutation of global row numbers, with cycle walking.

Every row gets a global row number that depends on the rows' contents alone, a keyed permutation of 0..n-1
turns it into a position, and position = slot * shards + shard. So the shuffle is reproducible, shard and
slot follow from the row number by arithmetic (and back, by inverse()), and shards differ by one row at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_arrow, repeated, table, written

PRIME = (1 << 31) - 1
ROUNDS = 6
ROWS_A_BUCKET = 20_000


def _keys(seed: int) -> list[tuple[int, int]]:
    rng = np.random.default_rng(seed)
    return [(int(rng.integers(1 << 20, PRIME)), int(rng.integers(1, PRIME))) for _ in range(ROUNDS)]


def _half_bits(n: int) -> int:
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _round(x: np.ndarray, a: int, b: int, mask: int) -> np.ndarray:
    x = (x * a + b) % PRIME
    return ((x * (a ^ 0x2F0B4C47) + (x >> 7)) % PRIME ^ (x >> 11)) & mask


def permute(x: np.ndarray, n: int, seed: int = 0, back: bool = False) -> np.ndarray:
    """The place of each row number in a keyed permutation of 0..n-1, or the row number of each place.

    The Feistel network permutes the least 4**k >= n; whatever falls outside 0..n-1 walks on along its
    cycle until it is inside, fewer than four steps on average.
    """
    bits = _half_bits(n)
    mask, keys = (1 << bits) - 1, _keys(seed)
    out = np.asarray(x, np.int64).copy()
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> bits, out[todo] & mask
        for a, b in reversed(keys) if back else keys:
            if back:
                left, right = right ^ _round(left, a, b, mask), left
            else:
                left, right = right, left ^ _round(right, a, b, mask)
        out[todo] = left << bits | right
        todo = todo[out[todo] >= n]
    return out


def numbered(rows: DataFrame, key: list[str], buckets: int | None = None) -> tuple[DataFrame, int]:
    """The rows with `row_number` 0..n-1, and n. key: all columns of rows.

    Rows are counted by content, dealt into hashed buckets, and numbered within each by content; a bucket
    starts where those before it end. So no global sort is needed, no bucket grows with the data, and
    repeated rows, nulls and the order and partitioning of the input make no difference.
    """
    counted = written(rows.groupBy(*key).agg(F.count("*").alias("_copies")))
    n, distinct = counted.agg(F.coalesce(F.sum("_copies"), F.lit(0)), F.count("*")).first()
    buckets = buckets or max(1, distinct // ROWS_A_BUCKET)
    counted = counted.withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.groupBy("_bucket").agg(F.sum("_copies").alias("_sum"))
    starts = starts.select("_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_bucket").orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("_at", F.coalesce(F.sum("_copies").over(inside), F.lit(0))).join(starts, "_bucket")
    return repeated(placed, F.col("_copies"), "row_number", F.col("_start") + F.col("_at")).select(*key, "row_number"), n


def shard(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> DataFrame:
    """(id, size, text_crc32, row_number, shard, slot) of every row; other columns aren't read.

    size is the text's UTF-8 bytes plus 1, 1 for a null text, whose CRC is that of no bytes. Null and
    repeated ids and repeated rows are rows like any other; shards hold n // shards or one more row each,
    and slots run from 0 without gaps. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows, n = numbered(rows, ["doc_id", "size", "text_crc32"])

    def place(batches):
        for batch in batches:
            at = permute(batch.column("row_number").to_numpy(), n, seed)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array((at % shards).astype(np.int32)), pa.array(at // shards)],
                names=[*batch.schema.names, "shard", "slot"],
            )

    return map_arrow(rows, place, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, size long, text_crc32 long, row_number long, shard int, slot long")


def op7_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards, by the law of rows."""
    out = shard(table(spark, sf_dir, "documents"), 16)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number"
    )
