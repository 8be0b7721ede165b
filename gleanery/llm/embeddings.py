"""Embedding near-duplicates by PCA-ordered tiled comparison.

Unit vectors are turned into principal axes, so leading dimensions hold most of a product. Two tiles of vectors
accumulate the leading dimensions first; what the rest can add is at most the product of the suffix norms
(Cauchy-Schwarz), and a pair stops once even that cannot reach the threshold. Unit vectors of cosine c are
sqrt(2 - 2c) apart at most. Tiles are boxes in the leading dimensions and the norm of the rest: two tiles meet only if their boxes are
that near, and a vector goes only to boxes that near to itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, map_arrow, table, written

THRESHOLD = 0.98
#: Vectors in a tile or so, those of it that are multiplied at a time, and dimensions accumulated at first.
TILE, BLOCK = 4096, 1024
LEAD = 8
#: Rounding of the bounds; the decision itself uses plain double products.
SLACK = 1e-9


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, width)


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def axes(vectors: DataFrame, width: int) -> np.ndarray:
    """Principal axes of the unit vectors, leading one first: a width x width sum from each task."""

    def gram(batches: Iterator[pa.RecordBatch]):
        total = np.zeros((width, width))
        for b in batches:
            x = unit(_matrix(b.column("v"), width))
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()])], names=["g"])

    parts = map_arrow(vectors.select("v"), gram, "g array<double>").select(F.posexplode("g").alias("i", "x"))
    total = np.zeros(width * width)
    for i, x in parts.groupBy("i").agg(F.sum("x")).collect():  # width**2 numbers
        total[i] = x
    # Rounded, so that the order of summing doesn't matter.
    return np.linalg.eigh(np.round(total.reshape(width, width), 6))[1][:, ::-1]


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their largest component first, so that nothing overflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def linked(a: np.ndarray, b: np.ndarray, pa_: np.ndarray, pb: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of a and b have a cosine of at least threshold. a, b: unit vectors; pa_, pb: along principal axes."""
    width = a.shape[1]
    rest_a = np.sqrt(np.maximum(np.cumsum((pa_ * pa_)[:, ::-1], axis=1)[:, ::-1], 0))
    rest_b = np.sqrt(np.maximum(np.cumsum((pb * pb)[:, ::-1], axis=1)[:, ::-1], 0))
    part = pa_[:, :LEAD] @ pb[:, :LEAD].T
    bound = part + np.outer(rest_a[:, LEAD], rest_b[:, LEAD]) if width > LEAD else part
    i, j = np.nonzero(bound >= threshold - SLACK)
    done = LEAD
    if len(i) * 4 > part.size:  # most go on: products of whole tiles cost less than chosen pairs
        i, j = np.nonzero(a @ b.T >= threshold - SLACK)
    else:
        part = part[i, j]
        while done < width and len(i):
            upto = min(2 * done, width)
            part = part + np.einsum("ij,ij->i", pa_[i, done:upto], pb[j, done:upto])
            go = part + (rest_a[i, upto] * rest_b[j, upto] if upto < width else 0) >= threshold - SLACK
            i, j, part, done = i[go], j[go], part[go], upto
    out = np.zeros((len(a), len(b)), bool)
    for k in range(0, len(i), 1 << 16):  # the cosine itself
        x, y = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
        out[x, y] = np.einsum("ij,ij->i", a[x], b[y]) >= threshold
    return out


def spanning(near: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what near (symmetric) joins; found ones aren't looked at again."""
    left, out = np.ones(len(near), bool), []
    for seed in range(len(near)):
        if not left[seed]:
            continue
        left[seed] = False
        queue = [seed]
        while queue:
            i = queue.pop()
            found = np.flatnonzero(near[i] & left)
            left[found] = False
            out += [(i, int(j)) for j in found]
            queue += found.tolist()
    return out


def cells(at: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """at (label, p, ...) with its `cell`; and (label, cell, parts, lo, hi) of each cell.

    p: leading coordinates and the norm of the rest. A grid as wide as linked vectors may be apart cuts the leading axes, one for every time
    that a label has thrice TILE vectors, so that a cell holds some TILE of them. A cell with more has several tiles of
    the same box: rows are dealt out by a hash, and no label is sorted.
    """
    width = (2 - 2 * threshold) ** 0.5 + 1e-9
    n = at.groupBy("label").agg(F.least(F.floor(F.greatest(F.log(F.count("*") / F.lit(TILE)) / math.log(3), F.lit(0.0))), F.lit(LEAD)).cast("int").alias("depth"))
    grid = F.transform(F.slice("p", F.lit(1), F.col("depth")), lambda x: F.floor((x + 1) / width).cast("int"))
    out = at.join(n, "label").withColumn("cell", F.when(F.col("depth") > 0, grid).otherwise(F.array(F.lit(0)))).drop("depth")
    places = range(len(at.select("p").first()[0]))
    edges = [f(F.col("p")[i]).alias(f"{name}{i}") for i in places for name, f in (("lo", F.min), ("hi", F.max))]
    boxes = out.groupBy("label", "cell").agg(F.ceil(F.count("*") / TILE).cast("int").alias("parts"), *edges)
    return out, boxes.select("label", "cell", "parts", F.array(*(f"lo{i}" for i in places)).alias("lo"), F.array(*(f"hi{i}" for i in places)).alias("hi"))


def apart(lo: Column, hi: Column, lo2: Column, hi2: Column) -> Column:
    """The squared distance of two boxes."""
    gap = F.zip_with(F.zip_with(lo2, hi, lambda a, b: a - b), F.zip_with(lo, hi2, lambda a, b: a - b), lambda a, b: F.greatest(a, b, F.lit(0.0)))
    return F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x)


def meetings(boxes: DataFrame, threshold: float) -> DataFrame:
    """(label, cell, other, parts, lo, hi, first): each cell with each that may hold a vector linked to one of its own, itself too; parts
    and box are the other's. Cells meet by the first coordinate, one step apart at most, and then by their boxes."""
    far = 2 - 2 * threshold + SLACK
    a = boxes.select("label", "cell", F.col("lo").alias("lo1"), F.col("hi").alias("hi1"), F.explode(F.array(*(F.col("cell")[0] + i for i in (-1, 0, 1)))).alias("k"))
    b = boxes.select(F.col("label"), F.col("cell").alias("other"), "parts", "lo", "hi", F.col("cell")[0].alias("k"))
    return a.join(b, ["label", "k"]).where(apart(F.col("lo1"), F.col("hi1"), F.col("lo"), F.col("hi")) <= far).select("label", "cell", "other", "parts", "lo", "hi")


def find(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) of every row; other columns aren't read.

    Rows of equal labels that aren't null link at cosine >= threshold. Null, zero and non-finite vectors link with
    nothing; vectors of unlike lengths don't link, whatever the number of lengths. Equal vectors of a label are compared
    once and counted as often as they occur. Ids may be null or repeated: each row counts, component_id is the least id that isn't null. An
    empty table gives an empty result.
    """
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.withColumn("ok", usable(F.col("v")) & F.col("label").isNotNull())
    most = rows.where("ok").groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if most is None:
        return _result(rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    width = most["n"]
    if rows.where(F.col("ok") & (F.size("v") != width)).isEmpty():
        return _of_width(rows, width, threshold)
    # Vectors of unlike lengths can't link: the length goes with the label. Lengths up to the same power of two are filled up with zeros, which leave
    # cosines as they are, and compared in one go: a number of goes that is bounded by the digits of a length.
    size = F.size("v")
    power = F.length(F.bin(size - 1))
    known = rows.where("ok").groupBy(power.alias("power")).agg(F.max(size).alias("most")).collect()
    parts = []
    for power_of, longest in known:
        some = rows.where(F.col("ok") & (power == power_of))
        filled = F.concat("v", F.array_repeat(F.lit(0.0), F.lit(longest) - size))
        parts.append(_of_width(some.select("vec_id", F.struct("label", size.alias("n")).alias("label"), filled.alias("v"), "ok"), longest, threshold))
    parts.append(_result(rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _result(df: DataFrame) -> DataFrame:
    return df.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def _of_width(rows: DataFrame, width: int, threshold: float) -> DataFrame:
    # -0.0 and 0.0 are one value here.
    key = F.transform("v", lambda x: x + F.lit(0.0))
    rows = rows.withColumn("v", F.when(F.col("ok"), key))
    distinct = rows.where("ok").groupBy("label", "v").agg(F.count("*").alias("copies"), F.min("vec_id").alias("low"))
    reps = written(distinct.withColumn("rep", F.monotonically_increasing_id()))
    turn = reps.sparkSession.sparkContext.broadcast(axes(reps, width))  # width**2 doubles
    lead = np.ascontiguousarray(turn.value[:, :LEAD])

    def place(batches):
        for b in batches:
            x = unit(_matrix(b.column("v"), width))
            p = x @ lead
            rest = np.sqrt(np.maximum(1 - (p * p).sum(1), 0)) if width > LEAD else np.zeros(len(p))
            flat = np.column_stack([p, rest]).ravel()
            ends = pa.array(np.arange(len(p) + 1, dtype=np.int32) * (lead.shape[1] + 1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(ends, pa.array(flat))], names=[*b.schema.names, "p"])

    label = reps.schema["label"].dataType.simpleString()
    at = map_arrow(reps.select("label", "v", "copies", "rep"), place, f"label {label}, v array<double>, copies long, rep long, p array<double>")
    at, boxes = cells(at, threshold)
    boxes = written(boxes)
    own = boxes.select("label", "cell", F.col("parts").alias("own_parts"))
    met = meetings(boxes, threshold).join(own, ["label", "cell"])
    met = met.groupBy("label", "cell", "own_parts").agg(F.collect_list(F.struct("other", "parts", "lo", "hi")).alias("others"))  # neighbouring cells
    sent = at.join(met, ["label", "cell"]).withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("own_parts")).cast("int"))
    near = F.filter("others", lambda o: apart(F.col("p"), F.col("p"), o["lo"], o["hi"]) <= 2 - 2 * threshold + SLACK)
    sent = sent.select("label", "rep", "copies", "v", "mine", "cell", F.explode(near).alias("o"))
    sent = sent.select("label", "rep", "copies", "v", "mine", "cell", "o.other", F.explode(F.sequence(F.lit(0), F.col("o.parts") - 1)).alias("j"))
    # A task is a pair of tiles; the lesser cell's comes first, within a cell the lesser tile.
    less, same = F.col("cell") < F.col("other"), F.col("cell") == F.col("other")
    swap = ~less & ~same
    met = sent.select(
        "label", "rep", "copies", "v", "mine", F.when(swap, F.col("other")).otherwise(F.col("cell")).alias("c"), F.when(swap, F.col("cell")).otherwise(F.col("other")).alias("c2"),
        (~same).cast("int").alias("kind"), F.when(less, F.col("mine")).when(same, F.least("mine", "j")).otherwise(F.col("j")).alias("i"),
        F.when(less, F.col("j")).when(same, F.greatest("mine", "j")).otherwise(F.col("mine")).alias("j"), swap.cast("int").alias("side"),
    )
    key = ["label", "c", "c2", "i", "j"]
    met = met.withColumns({"c": F.array_join("c", ","), "c2": F.array_join("c2", ",")}).repartition(*key).sortWithinPartitions(*key)

    def compare(batches: Iterator[pa.RecordBatch]):
        for group in groups(batches, key):
            rep, copies = group.column("rep").to_numpy(), group.column("copies").to_numpy()
            x = unit(_matrix(group.column("v").combine_chunks(), width))
            y = x @ turn.value
            kind, i, j = (group.column(c)[0].as_py() for c in ("kind", "i", "j"))
            mine, side = group.column("mine").to_numpy(), group.column("side").to_numpy()
            s, t = np.flatnonzero(side == 0 if kind else mine == i), np.flatnonzero(side == 1 if kind else mine == j)
            itself, count, ends = kind == 0 and i == j, np.zeros(len(rep), np.int64), []
            for m in range(0, len(s), BLOCK):
                for n in range(m if itself else 0, len(t), BLOCK):
                    a, b = s[m : m + BLOCK], t[n : n + BLOCK]
                    near = linked(x[a], x[b], y[a], y[b], threshold)
                    if itself and m == n:
                        near |= near.T
                        np.fill_diagonal(near, False)
                        count[a] += near @ copies[b]
                        ends += [(a[k], a[l]) for k, l in spanning(near)]
                    elif near.any():
                        count[a] += near @ copies[b]
                        count[b] += copies[a] @ near
                        both, own = np.r_[a, b], np.zeros((len(a) + len(b),) * 2, bool)
                        own[: len(a), len(a) :] = near
                        own[len(a) :, : len(a)] = near.T
                        ends += [(both[k], both[l]) for k, l in spanning(own)]
            some = np.flatnonzero(count)
            one, two = (rep[[e[k] for e in ends]] if ends else np.zeros(0, np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.r_[rep[some], one]), pa.array([None] * len(some) + two.tolist(), pa.int64()), pa.array(count[some].tolist() + [0] * len(ends), pa.int64())], names=["a", "b", "n"]
            )

    found = written(map_arrow(met, compare, "a long, b long, n long"))
    counts = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    roots = components(found.where("b is not null"), "a", "b").withColumnsRenamed({"node": "rep", "root": "root"})
    known = reps.select("rep", "label", "v", "copies", "low").join(counts, "rep", "left").join(roots, "rep", "left")
    known = known.withColumn("root", F.coalesce("root", "rep"))
    known = written(known)
    least = known.groupBy("root").agg(F.min("low").alias("component_id"))
    known = known.join(least, "root").select(
        F.col("label").alias("_l"), F.col("v").alias("_v"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
    )
    out = rows.join(known, F.col("ok") & (F.col("label") == F.col("_l")) & (F.col("v") == F.col("_v")), "left")
    return _result(out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("_l").isNotNull(), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id")))


def groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Tables of equal keys from sorted batches."""
    held: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        held = t if held is None else pa.concat_tables([held, t])
        while held.num_rows:
            n = run(held, key)
            if n == held.num_rows:
                break
            yield held.slice(0, n)
            held = held.slice(n)
    if held is not None and held.num_rows:
        yield held


def run(t: pa.Table, key: list[str]) -> int:
    """How many rows at the start have the first one's key; rows are sorted, so a bisection finds it."""
    first = [t.column(c)[0].as_py() for c in key]
    low, high = 1, t.num_rows
    while low < high:
        mid = (low + high + 1) // 2
        if [t.column(c)[mid - 1].as_py() for c in key] == first:
            low = mid
        else:
            high = mid - 1
    return low


def op6_pca_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links and component within its label."""
    return find(table(spark, sf_dir, "embeddings"))


SQL = """
with v as (select vec_id, label, cast(embedding as double[]) as x from embeddings),
p as (select a.vec_id as i, b.vec_id as j from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
      where list_dot_product(a.x, b.x) / sqrt(list_dot_product(a.x, a.x)) / sqrt(list_dot_product(b.x, b.x)) >= 0.98),
c as (with recursive r(i, j) as (select vec_id, vec_id from v union select r.i, p.j from r join p on r.j = p.i) select i, min(j) as c from r group by i)
select vec_id, (select count(*) from p where i = vec_id) as n_links, c as component_id, vec_id = c as kept from v join c on i = vec_id
"""
