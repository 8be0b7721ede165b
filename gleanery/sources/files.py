"""Reading and writing the tables that steps hand on: CSV, JSON, models."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.profiles import by_name, check_columns

SITE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("universidad", "tipo_institucion", "carrera", "tipo_carrera", "url", "tipo_extraccion", "selector")]
    + [T.StructField("verificar_ssl", T.BooleanType())]
)


def sites(spark: SparkSession, path: str) -> DataFrame:
    """A site table in Parquet, JSON lines or CSV; certificates are verified where nothing else is said."""
    if path.endswith(".csv"):
        df = spark.read.schema(SITE).option("header", True).option("sep", sniff(spark, path)).csv(path)
    else:
        df = spark.read.schema(SITE).format("json" if path.endswith((".json", ".jsonl")) else "parquet").load(path)
    return df.withColumn("verificar_ssl", F.coalesce("verificar_ssl", F.lit(True)))


def sniff(spark: SparkSession, path: str, candidates: str = ";,\t|") -> str:
    """The delimiter that the first line has most of; a comma if none. One line is read."""
    first = spark.read.text(path).limit(1).collect()
    line = first[0][0] if first else ""
    best = max(candidates, key=lambda c: (line.count(c), -candidates.index(c)))
    return best if line.count(best) else ","


def read_csv(spark: SparkSession, path: str, sep: str | None = None, schema=None, required=()) -> DataFrame:
    """A CSV table with a header; the delimiter is found out unless given, quoted fields may span lines. Empty fields are null. Missing
    columns are an error, a missing file Spark's own."""
    reader = spark.read.option("header", True).option("sep", sep or sniff(spark, path)).option("multiLine", True).option("escape", '"')
    df = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    check_columns(df, required)
    return df


def write_csv(df: DataFrame, path: str, sep: str = ";", quote_all: bool = True, bom: bool = False, order_by: str | None = None) -> None:
    """A CSV table with a header in as many files as df has partitions. bom: each file starts with a byte order mark, for spreadsheets.
    order_by: a column that rows are sorted by across files, nulls last."""
    if order_by:
        df = by_name(df, order_by)
    options = {"sep": sep, "quoteAll": str(quote_all).lower(), "escape": '"', "timestampFormat": "yyyy-MM-dd HH:mm:ss"}
    if not bom:
        df.write.mode("overwrite").options(header=True, **options).csv(path)
        return
    quoted = sep.join('"' + c.replace('"', '""') + '"' if quote_all else c for c in df.columns)
    head = "\ufeff" + quoted
    lines = df.select(F.to_csv(F.struct(*(F.col(f"`{c}`") for c in df.columns)), options).alias("value"))

    def with_head(batches):
        first = True
        for b in batches:
            values = b.column("value").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([head] * first + values)], names=["value"])
            first = False

    lines.mapInArrow(with_head, "value string").write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines; fields without a value are written as null."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def to_json(df: DataFrame, name: str = "json") -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias(name))


def save_model(model, path: str) -> None:
    """A fitted Spark model; classifiers.TextModel saves itself."""
    model.write().overwrite().save(path)
