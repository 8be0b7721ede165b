"""Quality classifier: hashed word n-gram logistic regression, follow-the-regularised-leader.

Words and word pairs hash to 2**bits weights, with a few features of the text's make-up. Training is online
FTRL-proximal over a bounded sample of labelled texts; scoring is one sparse dot product per text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, slices, table, words_of

BITS = 18
#: Labelled texts that a classifier is fitted on at most; those whose hashed ids come first.
MAX_TRAIN = 4096
FOLDS = 5
THRESHOLD = 0.3
#: Passes over the examples, more over few ones, so that steps come to LEAST_STEPS.
EPOCHS, LEAST_STEPS = 3, 6000
PAIR = np.uint64(0x9E3779B97F4A7C15)


class Hasher:
    """Texts to (index, value) arrays. The memo of word hashes is emptied when it is full."""

    def __init__(self, bits: int = BITS, memo: int = 1 << 17):
        self.shift, self.memo, self.full = np.uint64(64 - bits), {}, memo

    def hashes(self, words: list[bytes]) -> np.ndarray:
        memo = self.memo
        try:
            return np.array([memo[w] for w in words], np.uint64)
        except KeyError:
            if len(memo) > self.full:
                memo.clear()
            for w in words:
                if w not in memo:
                    memo[w] = xxhash.xxh64_intdigest(w)
            return np.array([memo[w] for w in words], np.uint64)

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Words and pairs weigh 1 / their number; then the bias and the make-up features."""
        words = words_of(text)
        n = len(words)
        raw = text or ""
        shape = shape_of(raw, words)
        at = [xxhash.xxh64_intdigest(b"\x00shape%d" % i) for i in range(len(shape))]
        index, value = np.array(at, np.uint64), np.array(shape)
        if n:
            one = self.hashes(words)
            two = (one[:-1] * PAIR ^ (one[1:] >> np.uint64(7))) * PAIR
            index = np.concatenate([one * PAIR, two, index])
            value = np.concatenate([np.full(n, 1 / n), np.full(n - 1, 1 / n), value])
        return (index >> self.shift).astype(np.int64), value


def shape_of(raw: str, words: list[bytes]) -> list[float]:
    """Make-up of a text: bias, length, distinct words, repeated lines, capitals, signs, digits, word length."""
    n, chars = len(words), max(1, len(raw))
    lines = [x for x in raw.split("\n") if x]
    data = np.frombuffer(raw.encode("utf-8", "surrogatepass"), np.uint8)
    upper = np.count_nonzero((data >= 65) & (data <= 90)) / chars
    digit = np.count_nonzero((data >= 48) & (data <= 57)) / chars
    sign = np.count_nonzero(((data >= 33) & (data <= 47) & (data != 44) & (data != 46)) | ((data >= 58) & (data <= 64)) | ((data >= 91) & (data <= 96)) | (data >= 123) & (data <= 126)) / chars
    distinct = len(set(words)) / n if n else 1.0
    again = 1 - len(set(lines)) / len(lines) if lines else 0.0
    return [1.0, float(n == 0), min(n, 50) / 50, np.log1p(n) / 10, distinct, again, min(10 * upper, 3.0), min(10 * digit, 3.0), min(10 * sign, 3.0), min(chars / max(n, 1), 40) / 10]


def fit(examples: Iterable[tuple[str | None, int]], bits: int = BITS, epochs: int = EPOCHS, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.01, l2: float = 0.01) -> np.ndarray:
    """FTRL-proximal over the examples, in their order, epochs times. Returns the weights."""
    hasher, rows = Hasher(bits), []
    for text, y in examples:  # 12 bytes for each different feature of a text
        at, where = np.unique((f := hasher(text))[0], return_inverse=True)
        rows.append((at.astype(np.int32), np.bincount(where, f[1]), y))
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    for _ in range(max(epochs, LEAST_STEPS // max(1, len(rows)))):
        for at, x, y in rows:
            zi, ni = z[at], n[at]
            w = np.where(np.abs(zi) > l1, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2), 0.0)
            g = (sigmoid(w @ x) - y) * x
            s = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[at] = zi + g - s * w
            n[at] = ni + g * g
    return np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2), 0.0)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    """Whether crc32 of the id as text is a multiple of folds; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = MAX_TRAIN) -> np.ndarray:
    """Weights from the labelled texts that aren't held out, max_train at most: those whose hashed ids come
    first, so the same for any partitioning. One task fits them. Null labels and null ids teach nothing; of an
    id's labels the greatest counts; of an id's rows the one whose text has the least hash. Null and empty texts are examples as others are.
    Without examples every score is one half. Other columns aren't read.
    """
    marks = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
    marks = marks.where(F.col("_id").isNotNull() & F.col("_y").isNotNull() & ~held_out(F.col("_id"))).groupBy("_id").agg(F.max("_y").alias("_y"))
    # Bounded: max_train rows of ids.
    marks = marks.withColumn("_key", F.md5(F.col("_id").cast("string"))).orderBy("_key", "_id").limit(max_train)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(marks), "_id")
    # One row of each id, so max_train bounds the rows too.
    texts = texts.groupBy("_id", "_key", "_y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), F.col("text").alias("text"))).alias("_t")).select("_key", "_y", "_t.text")
    texts = texts.repartition(1).sortWithinPartitions("_key", "text").select("text", "_y")

    def learn(batches):
        def examples():
            for b in batches:
                yield from zip(b.column("text").to_pylist(), b.column("_y").to_pylist(), strict=True)

        w = fit(examples())
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], names=["i", "w"])

    out = np.zeros(1 << BITS, np.float64)
    for i, w in map_arrow(texts, learn, "i long, w double").collect():  # 2**BITS weights at most
        out[i] = w
    return out


def with_score(docs: DataFrame, weights: np.ndarray, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with one more column: the probability of label 1, for null and empty texts too. A column of that
    name is replaced; all others, whatever they are called, stay as they are. Every row is scored by itself, so repeated ones get equal
    scores. An empty table stays empty."""
    docs = docs.drop(name)
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 2**BITS doubles

    def scored(batches: Iterator[pa.RecordBatch]):
        w, hasher = shared.value, Hasher()
        for b in slices(batches, text_col):
            out = []
            for text in b.column(text_col).to_pylist():
                index, value = hasher(text)
                out.append(float(sigmoid(w[index] @ value)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], names=[*b.schema.names, name])

    return map_arrow(docs, scored, f"{ddl(docs)}`{name}` double")


def ddl(df: DataFrame) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema.fields)


def classify(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted) of every row; only id and text are read."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = with_score(rows, weights).drop("text")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality."""
    docs = table(spark, sf_dir, "documents")
    return classify(docs, train(docs, table(spark, sf_dir, "labels")))
