"""SimHash near-duplicates with pigeonring candidates.

Two 64-bit fingerprints that differ in at most t bits, cut into m segments around a ring, have a chain of
consecutive segments from some start whose first l segments differ in at most l * t / m bits, for every l.
With m = t + 1 the chain's first segment is equal and its first two differ in at most one bit. Fingerprints
meet in buckets of such two-segment chains; inside a bucket longer chains and then the full distance decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import components, fresh, map_arrow, slices, table, words_of, written

SEED = 42
SHINGLE = 4
MAX_BITS = 4
#: Fingerprints of one bucket that a task holds at once; a larger bucket is dealt out in pairs of blocks.
BLOCK = 100_000


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    """Bit i is 1 if it is in over half of the shingles' hashes. No words: 0; fewer than k: one shingle."""
    words = words_of(text)
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= k:
        return xxhash.xxh64_intdigest(whole, SEED)
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=starts[1:])
    h, ends = xxhash.xxh64_intdigest, (starts[k:] - 1).tolist()
    n = len(ends)
    votes = np.zeros(64, np.int64)
    begin = starts[:n].tolist()
    for i in range(0, n, 65536):
        hashes = np.array([h(whole[a:b], SEED) for a, b in zip(begin[i : i + 65536], ends[i : i + 65536], strict=True)], "<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, text_col: str = "text", name: str = "_fp") -> DataFrame:
    """docs with its texts' fingerprints as signed longs, 0 for null and empty texts. A column of that name is replaced; all others, whatever
    they are called, stay as they are. An empty table stays empty."""
    docs = docs.drop(name)

    def add(batches: Iterator[pa.RecordBatch]):
        for b in slices(batches, text_col):
            fp = np.array([fingerprint(x) for x in b.column(text_col).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fp)], names=[*b.schema.names, name])

    ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema.fields)
    return map_arrow(docs, add, f"{ddl}`{name}` long")


def segments(t: int) -> list[tuple[int, int]]:
    """(shift, width) of t + 1 segments."""
    cuts = [64 * i // (t + 1) for i in range(t + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def bucket_keys(fp: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of each bucket a fingerprint stands in. A key is a start, its segment, and the next one.

    Next segments that differ in one bit differ in parity: the odd one alone also goes to the buckets of its
    neighbours, so each pair meets once, and an even one has a single key for each start.
    """
    rows, keys, segs = [], [], segments(t)
    every = np.arange(len(fp), dtype=np.int64)
    for s, (shift, width) in enumerate(segs):
        shift2, width2 = segs[(s + 1) % len(segs)]
        first = fp >> np.uint64(shift) & np.uint64((1 << width) - 1)
        second = fp >> np.uint64(shift2) & np.uint64((1 << width2) - 1)
        base = (np.uint64(s) << np.uint64(56)) | first << np.uint64(width2)
        rows.append(every)
        keys.append(base | second)
        odd = np.flatnonzero(np.bitwise_count(second) & 1)
        for bit in range(width2):
            rows.append(odd)
            keys.append(base[odd] | second[odd] ^ np.uint64(1 << bit))
    return np.concatenate(rows), np.concatenate(keys)


def within(a: np.ndarray, b: np.ndarray, start: int, t: int) -> np.ndarray:
    """Whether a and b pass the chain's budgets from a start, l * t / m of the first l segments, and then
    the full distance. The last chain is the whole ring, whose budget is t."""
    diff, segs = a ^ b, segments(t)
    mask, ok = np.uint64(0), np.ones(diff.shape, bool)
    for l in range(1, len(segs) + 1):  # noqa: E741
        shift, width = segs[(start + l - 1) % len(segs)]
        mask |= np.uint64(((1 << width) - 1) << shift)
        ok &= np.bitwise_count(diff & mask) * len(segs) <= l * t
        if not ok.any():
            break
    return ok


def bucket_links(fp: np.ndarray, start: int, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all that is joined by links within a bucket: each fingerprint found is linked with the
    one that found it, and only those not found yet are compared further. So dense buckets cost little."""
    left, out_a, out_b = np.arange(len(fp)), [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            near = within(fp[left], fp[i], start, t)
            found = left[near]
            if len(found):
                out_a.append(np.full(len(found), i))
                out_b.append(found)
                queue.extend(found.tolist())
                left = left[~near]
    empty = np.zeros(0, np.int64)
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (empty, empty)


def _links(batches: Iterator[pa.RecordBatch], t: int) -> Iterator[pa.RecordBatch]:
    """From rows sorted by bucket: links in each. A bucket's rows may span batches."""

    def solve(keys: np.ndarray, fp: np.ndarray):
        starts = np.flatnonzero(np.r_[True, np.any(keys[1:] != keys[:-1], axis=1)])
        sizes = np.diff(np.r_[starts, len(fp)])
        two = starts[sizes == 2]
        start_of = keys[:, 0] >> 56
        a, b = [], []
        for s in range(t + 1):
            i = two[start_of[two] == s]
            ok = within(fp[i], fp[i + 1], s, t) & (fp[i] != fp[i + 1])
            a.append(fp[i[ok]])
            b.append(fp[i[ok] + 1])
        for i, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            own = np.unique(fp[i : i + n])
            x, y = bucket_links(own, int(start_of[i]), t)
            a.append(own[x])
            b.append(own[y])
        a, b = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    held_k, held_f = np.zeros((0, 2), np.int64), np.zeros(0, np.uint64)
    for batch in batches:
        k = np.column_stack([batch.column("key").to_numpy(), batch.column("tile").to_numpy()])
        held_k, held_f = np.concatenate([held_k, k]), np.concatenate([held_f, batch.column("fp").to_numpy().view(np.uint64)])
        if not len(held_f):
            continue
        last = np.flatnonzero(np.any(held_k != held_k[-1], axis=1))
        cut = last[-1] + 1 if len(last) else 0
        if cut:
            yield solve(held_k[:cut], held_f[:cut])
            held_k, held_f = held_k[cut:], held_f[cut:]
    if len(held_f):
        yield solve(held_k, held_f)


def fingerprint_links(fps: DataFrame, t: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp, long) at t bits or fewer that join every
    component, t in 1..7. Links within a bucket that are implied by others aren't listed."""

    def expand(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            for i in range(0, len(fp), 4096):
                part = fp[i : i + 4096]
                row, key = bucket_keys(part, t)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(part[row].view(np.int64))], names=["key", "fp"])

    keyed = map_arrow(fps.select("fp"), expand, "key long, fp long")
    # Buckets beyond a block: each row goes to every pair of blocks that has its own.
    sizes = written(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block))
    if sizes.isEmpty():
        rows = keyed.withColumn("tile", F.lit(0).cast("long"))
    else:
        rows = keyed.join(sizes, "key", "left").withColumn("blocks", F.coalesce(F.ceil(F.col("n") / (block // 2)), F.lit(1)).cast("long"))
        rows = rows.withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("blocks")))
        pair = lambda j: F.least(F.col("mine"), j) * F.col("blocks") + F.greatest(F.col("mine"), j)
        rows = rows.select("key", "fp", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), pair)).alias("tile"))
    rows = rows.repartition("key", "tile").sortWithinPartitions("key", "tile")
    return map_arrow(rows, lambda batches: _links(batches, t), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", t: int = MAX_BITS) -> DataFrame:
    """(id, fingerprint, component_id) of every row; other columns aren't read.

    component_id: the least id reachable over links, nulls last; null only where all ids are null. Null and
    empty texts and texts without words share fingerprint 0. Rows with repeated ids each stand for themselves.
    An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = written(with_fingerprint(rows).drop("text"))
    reps = representatives(rows, t)
    out = rows.join(reps, "_fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), "component_id")


def representatives(rows: DataFrame, t: int = MAX_BITS) -> DataFrame:
    """(_fp, component_id, _keep_fp) of each distinct fingerprint of (doc_id, _fp): the least id of its
    component, and the least fingerprint that has it."""
    fps = written(rows.groupBy("_fp").agg(F.min("doc_id").alias("_low")))
    links = fingerprint_links(fps.select(F.col("_fp").alias("fp")), t)
    roots = components(links, "a", "b").withColumnsRenamed({"node": "_fp", "root": "_root"})
    known = written(fps.join(roots, "_fp", "left").withColumn("_root", F.coalesce("_root", "_fp")))
    least = known.groupBy("_root").agg(F.min(F.struct(F.col("_low").isNull().alias("n"), F.col("_low").alias("id"), F.col("_fp").alias("fp"))).alias("_min"))
    return known.join(least, "_root").select("_fp", F.col("_min.id").alias("component_id"), F.col("_min.fp").alias("_keep_fp"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", t: int = MAX_BITS) -> DataFrame:
    """One row of docs for each group of near-duplicates, its columns as they are, whatever their names: that of the least id,
    nulls last; of rows with equal ids and fingerprints the first by its text's hash. Null and empty texts and texts without words are one
    group. A group whose ids are all null keeps one row as well. An empty table gives an empty result.
    """
    fp = fresh(docs, "_fp")
    rows = written(with_fingerprint(docs, text_col, fp)).select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(fp).alias("fp"))
    rows = rows.select("fp", F.col("row").getField(id_col).alias("id"), "row")
    stay = representatives(rows.select(F.col("fp").alias("_fp"), F.col("id").alias("doc_id")), t).where("_fp = _keep_fp").select("_fp", F.col("component_id").alias("_id"))
    out = rows.join(stay, (F.col("fp") == F.col("_fp")) & F.col("id").eqNullSafe(F.col("_id")))
    one = Window.partitionBy("fp").orderBy(F.xxhash64(F.col("row").getField(text_col)))
    return out.withColumn("rank", F.row_number().over(one)).where("rank = 1").select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's group of near-duplicates."""
    return near_duplicates(table(spark, sf_dir, "documents"))
