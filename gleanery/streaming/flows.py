"""The steps that have a meaning on streams: cleaning row by row, and counts by class and time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_tokens, normalize, repair_encoding
from ..operators.labels import stop_list


def clean(stream: DataFrame, text_col: str, stop_words=()) -> DataFrame:
    """A stream of texts with `clean`, their tokens for analysis; stateless."""
    words = sorted(set(stop_words) or set(stop_list()))
    return stream.withColumn("clean", F.array_join(clean_tokens(repair_encoding(normalize(F.col(text_col))), words), " "))


def class_counts(stream: DataFrame, time_col: str, class_col: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows by class and window; what comes later than `late` is dropped, and so is the state it would need."""
    at = F.window(F.col(time_col), window)
    stream = stream.withColumn(time_col, F.col(time_col).cast("timestamp"))  # watermarks don't take times without a zone
    out = stream.withWatermark(time_col, late).groupBy(at.alias("w"), F.col(class_col).alias("cls")).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "cls", "n")
