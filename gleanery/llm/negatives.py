"""Hard-negative mining over k-means inverted lists.

A score is the inner product of integer vectors. Vectors lie in the list of their nearest centroid, which keeps the radius of its farthest vector: by
Cauchy-Schwarz a query q scores q.c + |q| r in a list at most and q.c - |q| r at least. A query visits lists by that upper bound, leaves
out those that can't meet its window of scores, and stops once the bound is strictly below its k-th score. Lists are visited in rounds of growing
numbers; each round is one join of queries and lists, dealt out in blocks of both, so no task holds more than two blocks. What is
found is exact: the centroids come from a sample and decide nothing but how many lists are visited.

Equal vectors of a label are one: each keeps only as many of its least ids as a result can name, and its anchors search once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_arrow, table, written

#: Rows whose id this divides have another label; anchors' ids; positives and negatives of each; a component's factor; classes.
NOISY, ANCHORS, POSITIVES, NEGATIVES, SCALE, CLASSES = 7, 50, 5, 3, 256, 10
#: Rows that centroids are fitted on at most, those whose hashed vectors come first, and lists at most.
SAMPLE, LISTS = 65_536, 1024
#: Vectors of a list, and queries, that meet at a time.
BLOCK = 4096
#: Lists that the first round visits, and how many times more each next one does.
FIRST, GROWTH = 4, 8
#: Vectors as long as this take no part, so that scores fit a long.
LONGEST = 1 << 29
#: Bounds are computed in doubles; this part of them is allowed for rounding.
SLACK = 1e-9


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def _matrix(column: pa.Array, rows: int, kind=np.float64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(rows, -1) if rows else np.zeros((0, 0), kind)


def integers(vectors: DataFrame, id_col: str, vector_col: str, label: Column, scale: int = SCALE) -> DataFrame:
    """(id, label, v, key) of the rows that take part: floor(scale * x) of each component, and a digest of label and vector."""
    rows = vectors.select(F.col(id_col).alias("id"), label.alias("label"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("label").isNotNull() & usable(F.col("v")))
    scaled = F.transform("v", lambda x: x * scale)
    # Far beyond LONGEST nothing is rounded to a long.
    short = F.aggregate(scaled, F.lit(0.0), lambda s, x: s + x * x) < float(LONGEST) ** 2
    rows = rows.withColumn("v", F.when(short, scaled)).where("v is not null").withColumn("v", F.transform("v", lambda x: F.floor(x).cast("long")))
    return rows.withColumn("key", F.md5(F.concat_ws(",", F.col("label").cast("string"), F.array_join("v", ","))))


def centroids(groups: DataFrame, width: int, total: int, lists: int | None = None, sample: int = SAMPLE) -> np.ndarray:
    """Centres of the total vectors of this width, by k-means over a bounded sample: the least digests."""
    some = written(groups.where(F.size("v") == width).select("key", "v").orderBy("key").limit(sample).select(array_to_vector(F.col("v").cast("array<double>")).alias("features")))
    n = min(total, sample)
    k = lists or max(1, min(LISTS, int(total**0.5 / 2)))
    if k == 1 or n <= 1 or width == 0:
        return np.zeros((1, width))
    return np.array([c for c in KMeans(k=min(k, n), seed=7, maxIter=8, initMode="random").fit(some).clusterCenters()])


def assigned(groups: DataFrame, centres: np.ndarray) -> DataFrame:
    """groups with `list` and `far`, the distance to its centre. Vectors of another width are a list of that width, -1 - width."""
    shared = groups.sparkSession.sparkContext.broadcast(centres)  # LISTS rows at most
    width = centres.shape[1]

    def near(batches: Iterator[pa.RecordBatch]):
        c = shared.value
        square = (c * c).sum(1)
        for b in batches:
            sizes = b.column("v").value_lengths().to_numpy()
            at, far = -1 - sizes.astype(np.int64), np.zeros(len(sizes))
            own = np.flatnonzero(sizes == width)
            if len(own):
                x = _matrix(b.column("v").take(pa.array(own)), len(own))
                at[own] = (square - 2 * x @ c.T).argmin(1) if width else 0
                far[own] = np.sqrt(((x - c[at[own]]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at), pa.array(far)], names=[*b.schema.names, "list", "far"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in groups.schema)
    return map_arrow(groups, near, f"{fields}, list long, far double")


class Index:
    """Inverted lists of (key, label, v, ids) in the shared folder, their radii by list and by label and list."""

    def __init__(self, groups: DataFrame, lists: int | None = None):
        """groups: one row for each different label and vector, ids: its least ones."""
        most = groups.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
        self.width = most["n"] if most else 0
        self.centres = centroids(groups, self.width, most["count"], lists) if most else np.zeros((1, 0))
        self.rows = written(assigned(groups, self.centres))
        sizes = self.rows.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"), F.max("far").alias("radius"))
        self.sizes = written(sizes)
        radii = {r["list"]: r["radius"] for r in self.sizes.where("list >= 0").collect()}  # LISTS rows at most
        self.radius = np.array([radii.get(i, -1.0) for i in range(len(self.centres))])
        self.by_label = written(self.rows.where("list >= 0").groupBy("label", "list").agg(F.max("far").alias("radius")).groupBy("label").agg(F.collect_list(F.struct("list", "radius")).alias("own")))
        self.deal = F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")


def search(index: Index, queries: DataFrame, k: int, same: bool) -> DataFrame:
    """(key, window, id, score): the k rows of highest score in each window of each query, ties by id.

    queries: (key, label, v, windows array<struct<low long, high long>>); keys are unique. same: rows of the query's label, else of the others.
    Rows of another width don't meet. Fewer than k are given where there are no more.
    """
    kind = queries.schema["label"].dataType.simpleString()
    spark = queries.sparkSession
    state = queries.select("key", "label", "v", "windows")
    state = state.join(index.by_label, "label", "left") if same else state.withColumn("own", F.lit(None).cast("array<struct<list:long,radius:double>>"))
    state = written(state.withColumns({"seen": F.array().cast("array<long>"), "kth": F.transform("windows", lambda w: F.lit(None).cast("long"))}))
    found, size = None, FIRST
    shared = spark.sparkContext.broadcast((index.centres, index.radius))  # LISTS rows at most

    def visits(batches: Iterator[pa.RecordBatch]):
        centres, radius = shared.value
        norms = np.sqrt((centres * centres).sum(1))
        for b in batches:
            keys, lists = [], []
            widths = b.column("v").value_lengths().to_numpy()
            for i, (key, v, windows, own, seen, kth) in enumerate(zip(*(b.column(c).to_pylist() for c in ("key", "v", "windows", "own", "seen", "kth")), strict=True)):
                if widths[i] != centres.shape[1]:
                    new = [-1 - int(widths[i])] if not seen else []
                else:
                    q = np.array(v, np.float64)
                    r = radius
                    if same:
                        r = np.full(len(centres), -1.0)
                        for o in own or []:
                            r[o["list"]] = o["radius"]
                    length = np.sqrt(q @ q)
                    middle, reach = centres @ q, length * r
                    slack = SLACK * length * (norms + np.maximum(r, 0)) + 0.5
                    high, low = middle + reach + slack, middle - reach - slack
                    some = np.zeros(len(centres), bool)
                    for w, t in zip(windows, kth, strict=True):
                        if w["low"] <= w["high"]:  # strictly below the k-th score: nothing there, not even a tie
                            some |= (high >= (w["low"] if t is None else max(w["low"], t))) & (low <= w["high"])
                    some &= r >= 0
                    some[np.array([s for s in seen if s >= 0], np.int64)] = False
                    new = np.flatnonzero(some)
                    new = new[np.argsort(-high[new], kind="stable")][:size].tolist()
                keys += [key] * len(new)
                lists += new
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(lists, pa.int64())], names=["key", "list"])

    while True:
        met = written(map_arrow(state.select("key", "v", "windows", "own", "seen", "kth"), visits, "key string, list long"))
        if met.isEmpty():
            break
        got = _meet(index, state, met, k, same, kind)
        rank = F.row_number().over(Window.partitionBy("key", "window").orderBy(F.desc("score"), "id"))
        both = got if found is None else found.unionByName(got)
        found = written(both.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r"))
        last = found.groupBy("key", "window").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") == k)
        last = last.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("window", "least"))).alias("last"))  # windows of a query
        new = met.groupBy("key").agg(F.collect_list("list").alias("new"))  # LISTS at most
        state = state.join(last, "key", "left").join(new, "key", "left")
        state = written(state.select("key", "label", "v", "windows", "own", F.concat("seen", F.coalesce("new", F.array().cast("array<long>"))).alias("seen"), F.transform("windows", lambda w, i: F.col("last")[i]).alias("kth")))
        size *= GROWTH
    if found is None:
        return spark.createDataFrame([], "key string, window int, id long, score long")
    return found


def _meet(index: Index, state: DataFrame, met: DataFrame, k: int, same: bool, kind: str) -> DataFrame:
    """(key, window, id, score): the k best of each block of a list for each window of the queries that visit it."""
    blocks = met.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).join(index.sizes.select("list", "parts"), "list")
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = met.join(blocks, "list").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).withColumn("part", upto("parts"))
    left = left.select("key", "list", "part", "block").join(state.select("key", F.col("label").alias("label"), "v", "windows", "kth"), "key")
    right = index.rows.join(blocks, "list").withColumn("part", index.deal).withColumn("block", upto("blocks")).select("list", "part", "block", "label", "v", "ids")
    fields = ["list", "part", "block"]

    def best(q: pa.Table, rows: pa.Table) -> pa.Table:
        keys, windows, ids, scores = [], [], [], []
        if q.num_rows and rows.num_rows:
            owner = np.repeat(np.arange(rows.num_rows), rows.column("ids").combine_chunks().value_lengths().to_numpy())
            own_ids = rows.column("ids").combine_chunks().flatten().to_numpy()
            order = np.argsort(own_ids, kind="stable")
            owner, own_ids = owner[order], own_ids[order]
            x, y = _matrix(q.column("v").combine_chunks(), q.num_rows, np.int64), _matrix(rows.column("v").combine_chunks(), rows.num_rows, np.int64)
            names = {}
            codes = [np.array([names.setdefault(v, len(names)) for v in t.column("label").to_pylist()], np.int64) for t in (q, rows)]
            wanted, least = q.column("windows").to_pylist(), q.column("kth").to_pylist()
            plain = max(np.sqrt((x.astype(float) ** 2).sum(1)).max(), 1) * max(np.sqrt((y.astype(float) ** 2).sum(1)).max(), 1) < 2**52
            for lo in range(0, q.num_rows, 512):
                part = x[lo : lo + 512]
                # Products of doubles are exact below 2**53.
                s = (part.astype(float) @ y.T.astype(float)).astype(np.int64) if plain else part @ y.T
                for i, row in enumerate(s, lo):
                    fit = (codes[1] == codes[0][i]) == same
                    for w, (window, t) in enumerate(zip(wanted[i], least[i], strict=True)):
                        low = window["low"] if t is None else max(window["low"], t)
                        ok = np.flatnonzero(fit & (row >= low) & (row <= window["high"]))
                        if len(ok) > k:
                            ok = ok[row[ok] >= np.partition(row[ok], -k)[-k]]
                        if not len(ok):
                            continue
                        mask = np.zeros(len(row), bool)
                        mask[ok] = True
                        some = np.flatnonzero(mask[owner])
                        some = some[np.argsort(-row[owner[some]], kind="stable")[:k]]
                        keys += [i] * len(some)
                        windows += [w] * len(some)
                        ids += own_ids[some].tolist()
                        scores += row[owner[some]].tolist()
        name = q.column("key").combine_chunks().take(pa.array(keys, pa.int64())) if q.num_rows else pa.array([], pa.string())
        return pa.table({"key": name.cast(pa.string()), "window": pa.array(windows, pa.int32()), "id": pa.array(ids, pa.int64()), "score": pa.array(scores, pa.int64())})

    return left.groupBy(*fields).cogroup(right.groupBy(*fields)).applyInArrow(best, "key string, window int, id long, score long")


def least_ids(rows: DataFrame, n: int) -> DataFrame:
    """(key, label, v, ids): the n least ids of each label and vector. Ranks are cut before the shuffle too, so copies aren't gathered."""
    rank = F.row_number().over(Window.partitionBy("key").orderBy("id"))
    few = rows.withColumn("_r", rank).where(F.col("_r") <= n)
    return few.groupBy("key").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.sort_array(F.collect_list("id")).alias("ids"))


def mine(
    rows: DataFrame, anchors: DataFrame, low: tuple[int, int] = (50, 100), high: tuple[int, int] = (95, 100), positives: int = POSITIVES, negatives: int = NEGATIVES, lists: int | None = None
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every anchor.

    rows: (id, label, v, key) as integers() gives them; anchors: those of them that ask. An anchor's positives are the `positives` rows of its
    label with the highest scores, not itself; for each, its negatives are the `negatives` best rows of other labels whose score is at least low and at most high of
    the positive's (numerator, denominator). Ids may be null (such rows take no part) or repeated (each row counts, and of those with an anchor's id the first is taken for the anchor);
    vectors of unlike widths don't meet. No anchors, or an empty table, give an empty result.
    """
    rows = written(rows.where("id is not null"))
    index = Index(written(least_ids(rows, positives + 1)), lists)
    asked = written(anchors.where("id is not null").select("id", "key", "label", "v"))
    whole = F.array(F.struct(F.lit(-(1 << 62)).cast("long").alias("low"), F.lit(1 << 62).cast("long").alias("high")))
    queries = asked.groupBy("key").agg(F.first("label").alias("label"), F.first("v").alias("v")).withColumn("windows", whole)
    near = search(index, queries, positives + 1, same=True)
    near = written(near.groupBy("key").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("n"), "id"))).alias("near")))  # positives + 1 of each
    scores = F.array_sort(F.array_distinct(F.transform("near", lambda p: -p["n"])))
    (a, b), (c, d) = (_lowest(*part) for part in (low, high))
    window = lambda s: F.struct(_up(s * a, b).alias("low"), _down(s * c, d).alias("high"))
    asking = near.select("key", scores.alias("scores")).join(queries.drop("windows"), "key").withColumn("windows", F.transform("scores", window))
    asking = written(asking)
    wrong = search(index, asking.select("key", "label", "v", "windows"), negatives, same=False)
    wrong = wrong.groupBy("key", "window").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("n"), "id"))).alias("wrong"))  # negatives of each
    wrong = wrong.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("window", "wrong"))).alias("by"))
    ready = near.join(asking.select("key", "scores"), "key").join(wrong, "key", "left")
    # Anchors of one vector are dealt out, each part with the few rows it needs.
    deal, parts = F.pmod(F.xxhash64("id"), F.lit(16)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(15)))
    every = asked.select("id", "key", deal.alias("_p")).join(ready.withColumn("_p", parts), ["key", "_p"])
    own = F.array_position(F.transform("near", lambda p: p["id"]), F.col("id"))
    others = F.when(own > 0, F.concat(F.slice("near", F.lit(1), (own - 1).cast("int")), F.slice("near", (own + 1).cast("int"), F.lit(positives + 1)))).otherwise(F.col("near"))
    out = every.withColumn("p", F.explode(F.slice(others, 1, positives)))
    place = (F.array_position("scores", -F.col("p.n")) - 1).cast("int")
    out = out.select(F.col("id").alias("anchor_id"), F.col("p.id").alias("positive_id"), (-F.col("p.n")).alias("positive_score"), F.posexplode(F.col("by")[place]).alias("at", "w"))
    return out.select("anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), F.col("w.id").alias("negative_id"), "positive_score", (-F.col("w.n")).alias("negative_score"))


def _lowest(a: int, b: int) -> tuple[int, int]:
    by = math.gcd(a, b)
    return a // by, b // by


def _down(x: Column, by: int) -> Column:
    """x / by, rounded down, in longs."""
    return F.call_function("div", x - F.pmod(x, F.lit(by).cast("long")), F.lit(by).cast("long"))


def _up(x: Column, by: int) -> Column:
    return -_down(-x, by)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every vector whose id is divisible by ANCHORS, against all."""
    label = F.when(F.col("vec_id") % NOISY == 0, (F.col("label") + 1) % CLASSES).otherwise(F.col("label")).cast("long")
    rows = integers(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", label)
    return mine(rows, rows.where(F.col("id") % ANCHORS == 0))


SQL = f"""
with raw as (select vec_id, label, cast(embedding as double[]) as x from embeddings where label is not null and embedding is not null),
d as (select vec_id as id, case when vec_id % {NOISY} = 0 then (label + 1) % {CLASSES} else label end as label, list_transform(x, lambda c: floor({SCALE} * c)) as v
      from raw where len(list_filter(x, lambda c: c is null or isnan(c) or isinf(c))) = 0),
s as (select a.id as a, b.id as b, a.label = b.label as same, cast(list_dot_product(a.v, b.v) as bigint) as score from d a join d b on a.id <> b.id where a.id % {ANCHORS} = 0),
p as (select * from (select a, b, score, row_number() over (partition by a order by score desc, b) as r from s where same) where r <= {POSITIVES}),
n as (select p.a, p.b, p.score as positive_score, s.b as neg, s.score as negative_score, row_number() over (partition by p.a, p.b order by s.score desc, s.b) as rank
      from p join s on s.a = p.a and not s.same and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score)
select a as anchor_id, b as positive_id, cast(rank as integer) as rank, neg as negative_id, positive_score, negative_score from n where rank <= {NEGATIVES}
"""
