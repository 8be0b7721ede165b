"""Mixing sources to target weights along a time-varying curriculum. DataFrame operations only.

Each source has a weight schedule over training time 0..1. Its integral is the source's share of all
words, its running integral the source's token demand so far. Documents of a source stand in a hashed order;
the words before a document, against the demand, say when training reaches it: the inverse of the running
integral. Sorting by that position gives the training order of all sources together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import n_words, table, written

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
#: Documents above this part of their source are dealt first, so that small ones settle the rest.
LARGE = 0.01
#: Hash buckets that the rows of one source are dealt to, two hexadecimal digits for every so many rows.
ROWS_A_BUCKET = 20_000


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, max_repeats: int = MAX_REPEATS, schedules: DataFrame | None = None) -> DataFrame:
    """(source, source_size, weight, target): shares of all words by weight, at most max_repeats sizes each.

    sizes: (source, source_size), one row per source, so of a bounded size. Weights go to sources by code
    point, null last, again from the first when they run out. Excess goes to the other sources by weight
    until none is above: all that are not full stand at one level of target per weight, found from sums in
    the order in which sources fill up. A source without words has target 0.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    out = sizes.withColumn("weight", weight)
    if schedules is not None:
        out = out.join(schedules.select("_source", F.element_at("_c", -1).alias("_own")), F.col("source").eqNullSafe(F.col("_source")), "left")
        out = out.withColumn("weight", F.greatest(F.coalesce("_own", "weight"), F.lit(1e-12))).drop("_source", "_own")
    out = out.withColumn("_cap", (F.lit(max_repeats) * F.col("source_size")).cast("double"))
    fill = Window.orderBy(F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after, whole = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    left = F.sum("source_size").over(whole).cast("double") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    out = out.withColumn("_level", left / F.sum("weight").over(after))
    out = out.withColumn("_level", F.max(F.when(F.col("_level") * F.col("weight") <= F.col("_cap"), F.col("_level"))).over(whole))
    target = F.least(F.col("_cap"), F.coalesce(F.col("_level"), F.lit(0.0)) * F.col("weight"))
    return out.select("source", "source_size", "weight", target.alias("target"))


def demand_time(part: Column, slope: Column) -> Column:
    """When the running integral of 1 + slope * (2t - 1), slope in -1..1, reaches part of the whole."""
    b = F.lit(1.0) - slope
    root = b + F.sqrt(F.greatest(b * b + F.lit(4.0) * slope * part, F.lit(0.0)))
    return F.when(root > 0, F.least(F.lit(2.0) * part / root, F.lit(1.0))).otherwise(0.0)


def schedule_table(spark: SparkSession, schedules: dict) -> DataFrame:
    """(_source, _t, _w, _c) of schedules {source: [(time, weight), ...]}: points with the running integrals up to them. Weights
    are straight between points, constant before the first and after the last, none below zero. One row for each source named."""
    rows = []
    for source, points in schedules.items():
        points = sorted((float(t), float(w)) for t, w in points)
        if not points or points[0][0] < 0 or points[-1][0] > 1 or min(w for _, w in points) < 0:
            raise ValueError(f"a schedule needs points with times from 0 to 1 and weights of 0 or more: {source}")
        points = [(0.0, points[0][1])] * (points[0][0] > 0) + points + [(1.0, points[-1][1])] * (points[-1][0] < 1)
        c = [0.0]
        for (t0, w0), (t1, w1) in zip(points, points[1:]):
            c.append(c[-1] + (t1 - t0) * (w0 + w1) / 2)
        rows.append((source, [t for t, _ in points], [w for _, w in points], c))
    return spark.createDataFrame(rows, "_source string, _t array<double>, _w array<double>, _c array<double>")


def scheduled_time(part: Column, t: Column, w: Column, c: Column) -> Column:
    """When the running integral of a schedule, c at times t with weights w, reaches part (0..1) of the whole."""
    at, due = F.element_at, part * F.element_at(c, -1)
    i = F.greatest(F.least(F.size(F.filter(c, lambda x: x <= due)), F.size(c) - 1), F.lit(1)).cast("int")
    span, w0, rest = at(t, i + 1) - at(t, i), at(w, i), F.greatest(due - at(c, i), F.lit(0.0))
    bend = F.coalesce(2 * (at(w, i + 1) - w0) / F.nullif(span, F.lit(0.0)), F.lit(0.0))
    root = w0 + F.sqrt(F.greatest(w0 * w0 + bend * rest, F.lit(0.0)))
    return F.least(at(t, i) + F.when(root > 0, F.least(2 * rest / root, span)).otherwise(0.0), F.lit(1.0))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple = WEIGHTS, max_repeats: int = MAX_REPEATS, carry: bool = False, schedules: dict | None = None,
) -> DataFrame:
    """Every document with size, source_size, target, copies, taken and positions, not yet sorted.

    copies: whole passes over the source, and one more for the documents that come first in their source's
    order, until the target is met to the nearest document. Large documents are settled first against their
    own part of the target, then small ones against what is left. positions: the times of the copies. The
    order is that of md5(id, text's hash), so runs agree and neither null nor repeated ids gather in one bucket.
    Null texts and texts without words have size 0 and are not taken. A null source is a source of its own.
    The weights' slopes make heavier sources more frequent late in training: 1 + slope * (2t - 1), with
    slopes that balance out over all words. schedules, {source: [(time, weight), ...]}, replace that for the sources they name: a
    schedule's integral is the source's weight, its inverse gives the positions. Others keep the weight of their place.
    carry: the columns of docs come along in a struct `_row`.
    """
    key = F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.xxhash64(text_col).cast("string")))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), key.alias("_key"),
        *([F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")] if carry else []),
    )
    small = written(rows.select("source", "size", "_key"))
    totals = small.groupBy("source").agg(F.sum("size").alias("source_size"))
    own = schedule_table(docs.sparkSession, schedules) if schedules else None
    goal = targets(totals, weights, max_repeats, own)
    whole = Window.partitionBy()
    some = lambda x: F.nullif(x, F.lit(0.0))  # one source has no slope, and no words have no mean
    mean = F.sum(F.col("weight") * F.col("target")).over(whole) / some(F.sum("target").over(whole))
    slope = (F.col("weight") - mean) / some(F.max(F.abs(F.col("weight") - mean)).over(whole))
    goal = goal.withColumn("slope", F.coalesce(slope, F.lit(0.0)))
    goal = goal.withColumn("_passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    goal = written(goal.withColumn("_extra", F.col("target") - F.col("_passes") * F.col("source_size")))

    digits = len(f"{small.count() // ROWS_A_BUCKET:x}")
    bucket = F.substring("_key", 1, digits)
    little = F.when(F.col("size") <= F.lit(LARGE) * F.col("source_size"), F.col("size")).otherwise(0)
    # Sums by bucket replace a running sum over a whole source; a source has 16**digits buckets.
    sums = small.join(goal.select(F.col("source").alias("_s"), "source_size"), F.col("source").eqNullSafe(F.col("_s")))
    sums = sums.groupBy("_s", bucket.alias("_b")).agg(F.sum("size").alias("_sum"), F.sum(little).alias("_sum_little"))
    in_order = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ahead = lambda c: F.coalesce(F.sum(c).over(in_order), F.lit(0))
    sums = written(sums.select("_s", "_b", ahead("_sum").alias("_before"), ahead("_sum_little").alias("_before_little")))

    out = rows.withColumn("_bucket", bucket).join(goal.withColumnRenamed("source", "_s2"), F.col("source").eqNullSafe(F.col("_s2"))).drop("_s2")
    order = ["_key", "doc_id", "size"]
    running = Window.partitionBy("source", "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumns({"_at": F.coalesce(F.sum("size").over(running), F.lit(0)), "_at_little": F.coalesce(F.sum(little).over(running), F.lit(0))})
    out = out.join(sums, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b"))).drop("_s", "_b")
    # Large documents are picked one by one; small ones take what is left of the target.
    picks = written(pick_large(small, goal))
    done = picks.groupBy("_d").agg(F.max("_taken_large").alias("_taken_large"))
    out = out.join(done, F.col("source").eqNullSafe(F.col("_d")), "left").drop("_d")
    picked = picks.where("_pick_key is not null").drop("_taken_large")
    out = out.join(picked, F.col("source").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_pick_key")) & (F.col("size") == F.col("_pick_size")), "left")
    fits = F.col("_before_little") + F.col("_at_little") + F.col("size") / 2 <= F.col("_extra") - F.coalesce("_taken_large", F.lit(0))
    more = F.col("_pick_key").isNotNull() | (fits & (F.col("size") > 0) & (F.col("size") <= F.lit(LARGE) * F.col("source_size")))
    out = out.withColumn("copies", (F.col("_passes") + more.cast("int")).cast("int")).withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))
    before = F.col("_before") + F.col("_at")
    part = lambda k: F.least((before + k * F.col("source_size")) / F.nullif(F.col("target"), F.lit(0.0)), F.lit(1.0))
    when = lambda k: demand_time(part(k), F.col("slope"))
    if own is not None:
        out = out.join(own, F.col("source").eqNullSafe(F.col("_source")), "left")
        when = lambda k: F.when(F.col("_t").isNotNull(), scheduled_time(part(k), F.col("_t"), F.col("_w"), F.col("_c"))).otherwise(demand_time(part(k), F.col("slope")))
    times = F.when((F.col("copies") > 0) & (F.col("size") > 0), F.transform(F.sequence(F.lit(0), F.col("copies") - 1), when))
    return out.select(
        "doc_id", "source", "size", "source_size", "target", "copies", "taken", F.coalesce(times, F.array().cast("array<double>")).alias("positions"),
        *(["_row"] if carry else []),
    )


def pick_large(small: DataFrame, goal: DataFrame) -> DataFrame:
    """(_d, _pick_key, _pick_size, _taken_large): the large documents taken once more, largest first: each
    is taken if that brings the source nearer to its due so far. A source has fewer than 1 / LARGE of them,
    so the list is bounded. Rows of one id and size go together.
    """
    g = goal.select(F.col("source").alias("_d"), "source_size", "_extra")
    rows = small.join(g, F.col("source").eqNullSafe(F.col("_d"))).where(F.col("size") > F.lit(LARGE) * F.col("source_size"))
    rows = rows.groupBy("_d", "_key", "size").agg(F.count("*").alias("_n"), F.first(F.col("_extra") / F.col("source_size")).alias("_part"))
    item = F.struct((F.col("size") * F.col("_n")).alias("w"), F.col("_key").alias("k"), F.col("size").alias("s"))
    lists = rows.groupBy("_d").agg(F.sort_array(F.collect_list(item), asc=False).alias("_items"), F.first("_part").alias("_part"))
    start = "named_struct('due', cast(0 as double), 'got', cast(0 as bigint), 'picks', cast(array() as array<struct<k: string, s: bigint>>))"
    step = (
        "named_struct('due', a.due + x.w * _part, 'got', a.got + if(a.got + x.w / 2.0D <= a.due + x.w * _part, x.w, 0L),"
        " 'picks', if(a.got + x.w / 2.0D <= a.due + x.w * _part, array_append(a.picks, named_struct('k', x.k, 's', x.s)), a.picks))"
    )
    done = lists.select("_d", F.expr(f"aggregate(_items, {start}, (a, x) -> {step})").alias("_a"))
    picks = done.select("_d", F.col("_a.got").alias("_taken_large"), F.explode_outer("_a.picks").alias("_p"))
    return picks.select("_d", F.col("_p.k").alias("_pick_key"), F.col("_p.s").alias("_pick_size"), "_taken_large")


def training_order(mixed: DataFrame) -> DataFrame:
    """Range-sorted by the first position, documents that are not taken (null and empty texts among them) last; ids, nulls first, then sizes part ties.
    Repeated rows are all kept. An empty table stays empty."""
    first = F.try_element_at("positions", F.lit(1))
    return mixed.orderBy(first.asc_nulls_last(), "doc_id", "size")


def take(docs: DataFrame, **kw) -> DataFrame:
    """Rows of docs as the mixture has them, with all their columns, whatever their names: one for each copy taken, range-sorted by position, then id and size.

    Null and empty texts have no words and are not taken. Null sources are one source; null and repeated ids and repeated rows are taken as rows
    of their own. An empty table gives an empty result.
    """
    copies = mix(docs, carry=True, **kw).select("_row", "doc_id", "size", F.explode("positions").alias("_position"))
    return copies.orderBy("_position", "doc_id", "size").select("_row.*")


def op3_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by weights 5, 2, 1, in training order."""
    out = training_order(mix(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "copies", F.transform("positions", lambda x: F.round(x, 9)).alias("positions"))
