"""What the operators share: written tables, word patterns, row batches and connected components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import shared_dir

#: A word is a run of anything but ASCII blanks; the same set that bytes.split() splits at.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes that go to or come from Python at a time, unless a row has more.
BATCH_BYTES = 4 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, level: int = 3, partition_by: str | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage, survives lost executors.
    A column to partition by is read back last. The folder goes when the driver ends."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/gleanery-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", str(level)).parquet(at, partitionBy=partition_by)
    columns = [c for c in df.columns if c != partition_by] + [partition_by] * bool(partition_by)
    out = spark.read.schema(df.select(*columns).schema).parquet(at)
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    out._gleanery_at = at
    return out


def forget(df: DataFrame) -> None:
    """Delete the table that written() made; df can't be read afterwards."""
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._gleanery_at)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """The name, or a longer one that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Copies of a row that one array may name.
COPIES = 65_536


def repeated(df: DataFrame, n: Column, name: str, start: Column | None = None) -> DataFrame:
    """Each row n times, numbered from start (0); copies come in blocks, so no array is longer than COPIES."""
    blocks = df.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / COPIES)))).where(n > 0)
    first = F.col("_block") * COPIES
    at = F.explode(F.sequence(first, F.least(n, first + COPIES) - 1))
    out = blocks.withColumn(name, at).drop("_block")
    return out.withColumn(name, F.col(name) + start) if start is not None else out


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else. Pure-ASCII texts take the fast path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most max_bytes of the column, or of one row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if i > start and total + n > max_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow() with batches of a bounded number of bytes; the setting stays, as the frame runs later. Workers hand memory
    that a batch took back to the system."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]):
        pa.set_memory_pool(pa.system_memory_pool())
        return f(batches)

    return df.mapInArrow(run, schema)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node that an edge names; root is the least node reachable.

    Alternating stars: each large star hangs a node's greater neighbours under its least one, each small
    star does so with its lesser ones. Rounds grow with the logarithm of the longest path; each round is
    one minimum per node (combined before the shuffle) and one equi-join. Self links and repeated or null
    edges are ignored; no edges give an empty result.
    """
    spark = edges.sparkSession
    now = written(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    )
    before = None
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("u", "v", "m")
        pairs = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        new = written(pairs.where("u <> v").distinct())
        state = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        forget(now)
        now = new
        if state == before:
            break
        before = state
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
