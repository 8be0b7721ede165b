"""The corpus pipeline: quality, near-duplicates, mixture, pieces.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and all but the last return the
columns of documents. Each stage works on all that the one before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import mixing, pieces, quality, similar
from gleanery.llm.common import fresh, table, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts, with all their columns. It learns from the labelled ones among docs.

    Null and empty texts are scored like others. Rows with null or repeated ids and repeated rows are judged each by itself. Without labels every score is one
    half, which is accepted. An empty table gives an empty result.
    """
    score = fresh(docs, "_score")
    weights = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.with_score(docs, weights, name=score).where(F.col(score) >= quality.THRESHOLD).select(*(F.col(f"`{c}`") for c in docs.columns))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, with all its columns: that of the least id, nulls last. Texts are linked from a similarity
    of 0.8 of their five-word shingles on.

    Null and empty texts and texts without words are one group; of equal ids one row stays, by its text's hash. An empty table gives an empty result.
    """
    return similar.deduplicate(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: a row with all columns for each copy that is taken, in training order.

    Texts without words, null ones too, are not taken; a null source is a source of its own; rows with equal ids stand by size and text. An empty table
    gives an empty result.
    """
    return mixing.take(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of each row and its best segmentations, by id. Null and empty texts have no pieces; null and repeated ids and repeated rows are encoded
    each by itself. An empty table gives an empty result."""
    return pieces.encode_table(docs)


STAGES = [("quality", keep_quality), ("near-duplicates", drop_copies), ("mixture", mix_sources), ("pieces", encode)]
#: No SQL has the classifier, fingerprints or pieces; the pipeline is tested against its stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows: each stage works on all rows of the one before, written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
