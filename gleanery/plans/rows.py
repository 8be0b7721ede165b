"""Queries over rows: labels, quality checks, distributions, folds, oversampling, metrics, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import FOLDS, NEIGHBOURS, SEED
from ..functions import text as text_functions
from ..functions.html import extractor, page_text
from ..functions.text import annotation, label, technician
from ..operators import classifiers, folds, metrics, profiles, report, vectors
from ..sources.tables import kept
from .texts import permutation_parts, scored, table
from ..operators import homogeneity, keyness

#: Programme names of every kind, by the part's size.
KINDS = ("Ingeniería Civil en ", "Ingeniería de Ejecución en ", "Ingeniería en ", "Técnico en ", "Analista de ", "Ejecución para Técnicos, Civil en ", "tecnicos de ")


def programmes(spark, sf_dir) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("p_size") % len(KINDS) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 10 == 9, None).otherwise(F.concat(kind, "p_name")).alias("carrera"))


PROGRAMMES = "with a as (select p_partkey, case when p_size % 10 = 9 then null else [" + ", ".join(f"'{k}'" for k in KINDS) + f"][p_size % {len(KINDS)} + 1] || p_name end as carrera from part) "


def label_rule(spark, sf_dir):
    return programmes(spark, sf_dir).select("p_partkey", label(F.col("carrera")).alias("grado"))


def technician_filter(spark, sf_dir):
    return programmes(spark, sf_dir).where(~technician(F.col("carrera")))


def attempts(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    rows = o.select(
        "o_orderkey", F.when(F.col("o_orderpriority").startswith("1"), "selenium").otherwise("css").alias("kind"),
        F.when(F.col("o_orderstatus") == "F", F.lit(" ")).otherwise(F.col("o_orderpriority")).alias("t1"), F.when(F.col("o_orderstatus") == "O", "timeout").alias("e1"),
        F.when(F.col("o_custkey") % 3 == 0, F.lit("")).otherwise(F.lit("second")).alias("t2"), F.when(F.col("o_custkey") % 5 == 0, "refused").alias("e2"),
    )
    return profiles.fallback(rows, "kind", "t1", "e1", "t2", "e2").select("o_orderkey", "profile", "method", "error")


ATTEMPTS = """
with a as (select o_orderkey, starts_with(o_orderpriority, '1') as swap, case when o_orderstatus = 'O' then null when o_orderstatus = 'F' then ' ' else o_orderpriority end as r,
             case when o_orderstatus = 'O' then 'timeout' else 'no text found' end as er, case when o_custkey % 5 = 0 then null when o_custkey % 3 = 0 then '' else 'second' end as s,
             case when o_custkey % 5 = 0 then 'refused' else 'no text found' end as es from orders),
b as (select o_orderkey, case when swap then s else r end as x, case when swap then r else s end as y, case when swap then 'selenium' else 'requests' end as nx,
        case when swap then 'requests' else 'selenium' end as ny, case when swap then es else er end as ex, case when swap then er else es end as ey from a),
c as (select *, trim(coalesce(x, '')) <> '' as first, case when trim(coalesce(x, '')) <> '' then x when y is not null then y when x is not null then x else '' end as profile from b)
select o_orderkey, profile, case when first then nx when y is not null then ny when x is not null then nx else '' end as method,
  case when length(profile) > 0 then '' else nx || ': ' || ex || ' | ' || ny || ': ' || ey end as error from c"""


def qa_summary(spark, sf_dir):
    return profiles.summary(table(spark, sf_dir, "documents"), "text")


def duplicates_by_source_text(spark, sf_dir):
    return profiles.duplicates(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "source", "text").select("doc_id", "source")


def duplicates_by_url(spark, sf_dir):
    return profiles.duplicates(table(spark, sf_dir, "pages").select("page_id", "url"), "url").select("page_id", "url")


def shortest_texts(spark, sf_dir):
    """A quality report's ten shortest texts."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("chars"))
    return d.orderBy("chars", "doc_id").limit(10)


def class_distribution(spark, sf_dir):
    return profiles.distribution(table(spark, sf_dir, "documents"), "lang")


def crosstab_orders(spark, sf_dir):
    return profiles.crosstab(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority", PRIORITIES)


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def class_totals_rollup(spark, sf_dir):
    return profiles.with_total(table(spark, sf_dir, "documents"), "lang")


def class_share(spark, sf_dir):
    return profiles.share(table(spark, sf_dir, "customer"), "c_mktsegment")


def class_counts(spark, sf_dir):
    """How many classes there are, and how many have too few rows for folds."""
    n = table(spark, sf_dir, "conversations").groupBy("role").count()
    return n.agg(F.count("*").alias("classes"), F.count_if(F.col("count") < 5).alias("too_small"))


def unlabelled(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


def stratified_folds(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.struct("conv_id", "turn").alias("at"))
    return folds.stratified(c, ["conv_id", "turn"], "role", "at")


FOLDS_SQL = f"""
with f as (select role, min(conv_id * 1000000 + turn) as first from conversations group by role)
select conv_id, turn, role as cls, cast((row_number() over (order by first, role, md5(concat_ws('|', '{SEED}', conv_id, turn)), conv_id, turn) - 1) % 5 as integer) as fold
from conversations join f using (role)"""


def smote_sizes(spark, sf_dir):
    return folds.smote_plan(table(spark, sf_dir, "embeddings"), "label")


def smote_samples(spark, sf_dir):
    s = folds.smote(table(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding")
    return s.select("cls", "sample", "base", "neighbour", F.round("u", 6).alias("u"), F.aggregate("v", F.lit(0.0), lambda a, x: a + F.round(x * 10000)).cast("long").alias("v_sum"), F.round(F.element_at("v", 1), 6).alias("v_first"), F.round(F.element_at("v", -1), 6).alias("v_last"))


SMOTE = f"""
with d as (select vec_id as id, label as cls, cast(embedding as double[]) as v from embeddings),
n as (select cls, count(*) as n, (select max(c) from (select count(*) as c from d group by cls)) - count(*) as need from d group by cls),
p as (select id, cls, n, need, row_number() over (partition by cls order by md5(concat_ws('|', '{SEED}', id)), id) - 1 as place from d join n using (cls) where need > 0),
s as (select id, cls, unnest(range(place, need, n)) as sample from p where place < need),
h as (select *, cast('0x' || substr(md5(concat_ws('|', '{SEED}', 'neighbour', cls, sample)), 1, 8) as bigint) % {NEIGHBOURS} + 1 as rank,
        cast('0x' || substr(md5(concat_ws('|', '{SEED}', 'u', cls, sample)), 1, 8) as bigint) / cast(4294967296 as double) as u from s),
k as (select a.id, b.id as neighbour, row_number() over (partition by a.id order by round(list_distance(a.v, b.v), 9), b.id) as rank
      from d a join d b on a.cls = b.cls and a.id <> b.id where a.cls in (select cls from n where need > 0))
select h.cls, sample, h.id as base, neighbour, round(u, 6) as u, cast(list_sum(list_transform(list_zip(a.v, b.v), lambda p: round((p[1] + u * (p[2] - p[1])) * 10000))) as bigint) as v_sum,
  round(a.v[1] + u * (b.v[1] - a.v[1]), 6) as v_first, round(a.v[-1] + u * (b.v[-1] - a.v[-1]), 6) as v_last
from h join k on h.id = k.id and h.rank = k.rank join d a on a.id = h.id join d b on b.id = neighbour"""


def knn3_predict(spark, sf_dir):
    """Classes of the rows whose id is divisible by 50, by their three nearest of all others."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cls"), F.col("embedding").cast("array<double>").alias("v"))
    near = folds.nearest(rows, rows.where("id % 50 = 0"), NEIGHBOURS, same_class=False)
    return folds.vote(near, rows.select("id", "cls")).withColumnRenamed("qid", "id")


KNN = f"""
with d as (select vec_id as id, label as cls, cast(embedding as double[]) as v from embeddings),
k as (select a.id, b.cls, row_number() over (partition by a.id order by round(list_distance(a.v, b.v), 9), b.id) as r from d a join d b on a.id <> b.id where a.id % 50 = 0),
c as (select id, cls, count(*) as n from k where r <= {NEIGHBOURS} group by 1, 2)
select id, cls as predicted from (select *, row_number() over (partition by id order by n desc, cls) as r from c) where r = 1"""


def predictions(spark, sf_dir) -> DataFrame:
    guess = F.when(F.col("l_linestatus") == "O", "N").when(F.col("l_quantity") > 25, "A").otherwise("R")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("actual"), guess.alias("predicted"), (F.col("l_orderkey") % 5).cast("int").alias("fold"), F.concat(F.lit("m"), (F.col("l_partkey") % 4).cast("string")).alias("model")
    )


PRED = "with p as (select l_returnflag as actual, case when l_linestatus = 'O' then 'N' when l_quantity > 25 then 'A' else 'R' end as predicted, cast(l_orderkey % 5 as integer) as fold, 'm' || (l_partkey % 4) as model from lineitem)"


def _by(keys: str) -> str:
    """The SQL of per-class numbers by keys."""
    k = keys + ", " if keys else ""
    using = f"using ({k}label)"
    return f""",
l as (select distinct {k}unnest([actual, predicted]) as label from p),
a as (select {k}actual as label, count(*) as a, count(*) filter (actual = predicted) as tp from p group by all),
q as (select {k}predicted as label, count(*) as p from p group by all),
c as (select {k}label, coalesce(tp, 0) as tp, coalesce(a, 0) as support, coalesce(tp / cast(nullif(p, 0) as double), 0) as precision, coalesce(tp / cast(nullif(a, 0) as double), 0) as recall,
        coalesce(2 * tp / cast(nullif(coalesce(a, 0) + coalesce(p, 0), 0) as double), 0) as f1 from l left join a {using} left join q {using}),
m as (select {k}cast(sum(support) as bigint) as n, sum(tp) / cast(sum(support) as double) as accuracy, avg(recall) filter (support > 0) as balanced_accuracy, avg(f1) as f1_macro,
        avg(precision) as precision_macro, avg(recall) as recall_macro from c group by {keys or '()'})"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else c for c, t in df.dtypes))


def confusion_matrix(spark, sf_dir):
    return metrics.confusion(predictions(spark, sf_dir))


def confusion_normalized(spark, sf_dir):
    out = metrics.normalized(metrics.confusion(predictions(spark, sf_dir)))
    return _rounded(out.withColumn("note", annotation(F.col("n"), F.round("share", 6))))


def classification_report(spark, sf_dir):
    return _rounded(metrics.report(metrics.by_class(metrics.confusion(predictions(spark, sf_dir)))))


def pooled_metrics(spark, sf_dir):
    return _rounded(metrics.scores(metrics.by_class(metrics.confusion(predictions(spark, sf_dir)))))


def fold_metrics(spark, sf_dir):
    p = predictions(spark, sf_dir)
    return _rounded(metrics.scores(metrics.by_class(metrics.confusion(p, ["fold"]), ["fold"]), ["fold"]))


def fold_summary(spark, sf_dir):
    p = predictions(spark, sf_dir)
    return _rounded(metrics.fold_summary(metrics.scores(metrics.by_class(metrics.confusion(p, ["fold"]), ["fold"]), ["fold"])))


def model_ranking(spark, sf_dir):
    by, p = ["model", "fold"], predictions(spark, sf_dir)
    each = metrics.scores(metrics.by_class(metrics.confusion(p, by), by), by)
    return _rounded(metrics.ranking(_rounded(metrics.fold_summary(each, ["model"]))))


SUMMARY = ", ".join(f"round({f}({c}), 6) as {c}_{n}" for c in metrics.MEASURES for f, n in (("avg", "mean"), ("stddev_pop", "std")))


def html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", page_text("html").alias("text"))


def html_context_extract(spark, sf_dir):
    """The contents under titles that name the words; pages without one give none."""
    f = extractor(("the", "der"), ("la",))
    return table(spark, sf_dir, "pages").select("page_id", f("html", F.lit("-")).alias("x")).select("page_id", "x.text", "x.step")


def html_selector_extract(spark, sf_dir):
    f = extractor()
    return table(spark, sf_dir, "pages").select("page_id", f("html", F.lit("article p, div > p:nth-child(1)")).alias("x")).select("page_id", "x.text", "x.step")


# Pages of a few lines each: (name, page, selector, text, step).
PAGES = (
    ("selector", "<div id='a'><p class='x'>Uno <b>dos</b></p><p>tres</p></div><p>fuera</p>", "#a p", "Uno dos tres", "selector"),
    ("child", "<div><p>uno</p><section><p>dos</p></section></div>", "div > p", "uno", "selector"),
    ("attribute", "<p data-k='v'>si</p><p>no</p>", "p[data-k=v]", "si", "selector"),
    ("nth", "<ul><li>a</li><li>b</li></ul>", "li:nth-child(2)", "b", "selector"),
    ("no hit, then title", "<h2>Perfil de egreso</h2><p>texto  uno</p><p>dos</p>", ".none", "texto uno dos", "priority"),
    ("priority title", "<h2>PERFIL DE EGRESO</h2><p>uno</p><ul><li>dos</li></ul><h2>Otro</h2><p>tres</p>", "-", "uno dos", "priority"),
    ("priority before secondary", "<h2>Competencias</h2><p>uno</p><h3>Perfil de egreso</h3><p>dos</p>", "", "dos", "priority"),
    ("secondary title", "<h3>Campo laboral</h3><p>uno</p>", "-", "uno", "secondary"),
    ("next block", "<div><strong>Perfil profesional</strong></div><div>bloque</div>", "-", "bloque", "priority"),
    ("stop at a heading", "<h2>Perfil de egreso</h2><p>uno</p><h3>fin</h3><p>dos</p>", "-", "uno", "priority"),
    ("entities and spaces", "<p id='t'>a&nbsp;b &amp; c\n\td</p>", "#t", "a b & c d", "selector"),
    ("nothing", "<h2>Otra cosa</h2><p>uno</p>", "-", "", "none"),
    ("empty", "", "p", "", "none"),
)


def html_cases(spark, sf_dir):
    """Small pages with what their extraction gives."""
    f = extractor()
    pages = spark.createDataFrame([(n, h, s) for n, h, s, _, _ in PAGES], "name string, html string, selector string")
    return pages.select("name", f("html", "selector").alias("x")).select("name", "x.text", "x.step")


PAGES_SQL = "select * from (values " + ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in (n, t, st)) + ")" for n, _, _, t, st in PAGES) + ") as t(name, text, step)"


def duplicates_by_customer_priority(spark, sf_dir):
    return profiles.duplicates(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), "o_custkey", "o_orderpriority")


def profile_columns(spark, sf_dir):
    """Customers as profiles: blank names left out, nulls filled, columns found by their names, in order, one moved, all repaired."""
    c = table(spark, sf_dir, "customer")
    name = F.when(F.col("c_custkey") % 7 == 0, None).when(F.col("c_custkey") % 5 == 0, F.lit(" ")).otherwise(F.concat(F.lit("Ã±and "), "c_name"))
    rows = c.select(F.col("c_custkey").cast("string").alias("url"), name.alias("carrera"), F.when(F.col("c_nationkey") > 3, F.col("c_mktsegment")).alias("universidad"))
    assert profiles.find_column(rows.columns, ("Universidad ",)) == "universidad"
    return profiles.place_after(text_functions.repair_all(profiles.fill_text(profiles.in_order(profiles.usable(rows, "carrera")))), "universidad", "carrera")


def class_order(spark, sf_dir):
    """Known classes in their order, then the others sorted."""
    found = [r[0] for r in table(spark, sf_dir, "orders").select("o_orderpriority").distinct().collect()]
    return spark.createDataFrame(list(enumerate(profiles.class_order(("5-LOW", "9-NONE", "2-HIGH"), found))), "place long, cls string")


def embedded(spark, sf_dir) -> DataFrame:
    rows = classifiers.coded(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"), "label")
    return rows.select(F.col("vec_id").alias("id"), "c", F.col("embedding").cast("array<double>").alias("v"))


def pca_projection(spark, sf_dir):
    return classifiers.pca(embedded(spark, sf_dir), 64)


def lda_projection(spark, sf_dir):
    return classifiers.discriminant_axes(embedded(spark, sf_dir), 64)


def _judged(predictions: DataFrame) -> DataFrame:
    """Means and deviations of each model's measures over folds."""
    by, p = ["model", "fold"], predictions.select("model", "fold", F.col("c").alias("actual"), "predicted")
    return metrics.fold_summary(metrics.scores(metrics.by_class(metrics.confusion(p, by), by), by), ["model"])


def benchmark_models(spark, sf_dir, names=classifiers.NAMES, n_folds: int = FOLDS):
    """The ranking of all models over the embeddings."""
    rows = embedded(spark, sf_dir)
    parts = folds.stratified(rows.withColumn("at", F.col("id")), ["id"], "c", "at", n_folds).select("id", "fold")
    return _rounded(metrics.ranking(_judged(classifiers.cross_validated(rows, parts, names, n_folds))))


def out_of_fold_simple(spark, sf_dir):
    """Predictions of nearest neighbours and naive Bayes for every embedding, each by the other folds, without oversampling."""
    rows = embedded(spark, sf_dir)
    parts = folds.stratified(rows.withColumn("at", F.col("id")), ["id"], "c", "at").select("id", "fold")
    return classifiers.cross_validated(rows, parts, ("knn", "naive_bayes"), oversample=False)


SIMPLE = f"""
with d as (select vec_id as id, dense_rank() over (order by cast(label as varchar)) - 1 as c, cast(embedding as double[]) as v from embeddings),
first as (select c, min(id) as first from d group by c),
f as (select id, c, v, (row_number() over (order by first, c, md5(concat_ws('|', '{SEED}', id)), id) - 1) % {FOLDS} as fold from d join first using (c)),
near as (select a.id, a.c, a.fold, b.c as o, row_number() over (partition by a.id order by round(list_distance(a.v, b.v), 9), b.id) as r from f a join f b on a.fold <> b.fold),
votes as (select id, c, fold, o, count(*) as n from near where r <= {NEIGHBOURS} group by all),
knn as (select id, c, fold, o as predicted, row_number() over (partition by id order by n desc, o) as r from votes),
x as (select id, c, fold, unnest(range(len(v))) as i, unnest(v) as x from f),
k as (select unnest(range({FOLDS})) as k),
low as (select k, least(min(x), 0) as low from x join k on fold <> k group by k),
s as (select k, c, i, sum(x - low) + 1 as s from x join low on fold <> k group by k, c, i),
lp as (select k, c as o, i, ln(s / sum(s) over (partition by k, c)) as lp from s),
pri as (select k, c as o, ln(count(*) / cast(sum(count(*)) over (partition by k) as double)) as p from f join k on fold <> k group by k, c),
sc as (select id, x.c, fold, lp.o, sum((x - low) * lp) + max(p) as s from x join lp on lp.k = fold and lp.i = x.i join low on low.k = fold join pri on pri.k = fold and pri.o = lp.o group by id, x.c, fold, lp.o),
nb as (select id, c, fold, o as predicted, row_number() over (partition by id order by s desc, o) as r from sc)
select 'knn' as model, cast(fold as integer) as fold, id, cast(c as integer) as c, cast(predicted as integer) as predicted from knn where r = 1
union all select 'naive_bayes', cast(fold as integer), id, cast(c as integer), cast(predicted as integer) from nb where r = 1"""


def text_folds(spark, sf_dir, n_folds: int = FOLDS) -> DataFrame:
    docs = vectors.documents(table(spark, sf_dir, "documents"), "doc_id", "lang", "text").withColumn("id", F.col("id").cast("long"))
    ids = classifiers.coded(docs.select("id", "cls"), "cls")
    parts = folds.stratified(ids.withColumn("at", F.col("id")), ["id"], "c", "at", n_folds).select("id", F.col("cls").alias("c"), "fold")
    return kept(docs.join(kept(parts), "id"))  # tokens are read in several passes


def judged_texts(spark, sf_dir, names=classifiers.NAMES, n_folds: int = FOLDS) -> DataFrame:
    return _judged(classifiers.cross_validated_texts(text_folds(spark, sf_dir, n_folds), names, n_folds))


def benchmark_texts(spark, sf_dir, names=classifiers.NAMES, n_folds: int = FOLDS):
    """The ranking of all models over the documents by language, with a vocabulary for each fold."""
    return _rounded(metrics.ranking(judged_texts(spark, sf_dir, names, n_folds)))


def consolidated_report(spark, sf_dir):
    cells, sizes = scored(spark, sf_dir)
    totals = profiles.with_total(table(spark, sf_dir, "documents"), "lang").withColumnRenamed("lang", "cls")
    best = report.winner(judged_texts(spark, sf_dir).withColumnRenamed("f1_macro_mean", "f1_macro"), "f1_macro")
    test = homogeneity.permutation_test(*permutation_parts(spark, sf_dir))
    return report.consolidated(totals, best, test, report.terms_by_class(keyness.top_terms(cells, sizes)))


QUERIES = {
    "label_rule": (label_rule, PROGRAMMES + "select p_partkey, case when contains(lower(carrera), 'civil') then 'Civil' when contains(lower(carrera), 'ejecu') then 'Ejecución' else 'Informática' end as grado from a"),
    "technician_filter": (technician_filter, PROGRAMMES + r"select * from a where carrera is null or not (regexp_matches(lower(carrera), '^\s*t[eé]cnico([^\p{L}\p{N}_]|$)') or regexp_matches(lower(carrera), '(^|[^\p{L}\p{N}_])analista([^\p{L}\p{N}_]|$)'))"),
    "method_fallback": (attempts, ATTEMPTS),
    "qa_summary": (qa_summary, "select count(*) as total, count(*) filter (n = 0) as empty, count(*) filter (n > 0 and n < 150) as short, count(*) filter (n >= 150) as ready from (select length(trim(coalesce(text, ''))) as n from documents)"),
    "duplicates_by_source_text": (duplicates_by_source_text, "select doc_id, source from (select *, count(*) over (partition by source, text) as n from documents) where n > 1"),
    "duplicates_by_url": (duplicates_by_url, "select page_id, url from (select *, count(*) over (partition by url) as n from pages) where n > 1"),
    "shortest_texts": (shortest_texts, "select doc_id, cast(length(text) as bigint) as chars from documents order by chars, doc_id limit 10"),
    "class_distribution": (class_distribution, "select lang, count(*) as n from documents group by lang"),
    "crosstab_orders": (crosstab_orders, "select o_orderstatus, " + ", ".join(f"count(*) filter (o_orderpriority = '{p}') as \"{p}\"" for p in PRIORITIES) + " from orders group by 1"),
    "class_totals_rollup": (class_totals_rollup, "select coalesce(lang, 'Total') as lang, count(*) as n from documents where lang is not null group by rollup(lang)"),
    "class_share": (class_share, "select c_mktsegment, count(*) as n, round(100.0 * count(*) / cast(sum(count(*)) over () as double), 1) as percent from customer group by 1"),
    "class_counts": (class_counts, "select count(*) as classes, count(*) filter (n < 5) as too_small from (select count(*) as n from conversations group by role)"),
    "unlabelled": (unlabelled, "select doc_id from documents where doc_id not in (select doc_id from labels)"),
    "stratified_folds": (stratified_folds, FOLDS_SQL),
    "smote_sizes": (smote_sizes, "select label as cls, count(*) as n, max(count(*)) over () - count(*) as need from embeddings group by label"),
    "smote_samples": (smote_samples, SMOTE),
    "knn3_predict": (knn3_predict, KNN),
    "confusion_matrix": (confusion_matrix, PRED + " select a.label as actual, b.label as predicted, count(p.actual) as n from (select distinct unnest([actual, predicted]) as label from p) a cross join (select distinct unnest([actual, predicted]) as label from p) b left join p on p.actual = a.label and p.predicted = b.label group by 1, 2"),
    "confusion_normalized": (confusion_normalized, PRED + ", c as (select a.label as actual, b.label as predicted, count(p.actual) as n from (select distinct unnest([actual, predicted]) as label from p) a cross join (select distinct unnest([actual, predicted]) as label from p) b left join p on p.actual = a.label and p.predicted = b.label group by 1, 2), s as (select *, round(coalesce(n / cast(nullif(sum(n) over (partition by actual), 0) as double), 0), 6) as share from c) select actual, predicted, n, share, printf('%d' || chr(10) || '%.1f%%', n, share * 100) as note from s"),
    "classification_report": (classification_report, PRED + _by("") + """
        select label, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, cast(support as double) as support from c
        union all select 'accuracy', round(accuracy, 6), round(accuracy, 6), round(accuracy, 6), round(accuracy, 6) from m
        union all select 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), cast(sum(support) as double) from c
        union all select 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), cast(sum(support) as double) from c"""),
    "pooled_metrics": (pooled_metrics, PRED + _by("") + " select n, " + ", ".join(f"round({c}, 6) as {c}" for c in metrics.MEASURES) + " from m"),
    "fold_metrics": (fold_metrics, PRED + _by("fold") + " select fold, n, " + ", ".join(f"round({c}, 6) as {c}" for c in metrics.MEASURES) + " from m"),
    "fold_summary": (fold_summary, PRED + _by("fold") + f" select {SUMMARY} from m"),
    "model_ranking": (model_ranking, PRED + _by("model, fold") + f", r as (select model, {SUMMARY} from m group by model) select *, row_number() over (order by f1_macro_mean desc, balanced_accuracy_mean desc, accuracy_mean desc, model) as place from r"),
    "html_cases": (html_cases, PAGES_SQL),
    "duplicates_by_customer_priority": (duplicates_by_customer_priority, "select o_orderkey, o_custkey, o_orderpriority from (select *, count(*) over (partition by o_custkey, o_orderpriority) as n from orders) where n > 1"),
    "profile_columns": (profile_columns, "select 'ñand ' || c_name as carrera, case when c_nationkey > 3 then c_mktsegment else '' end as universidad, cast(c_custkey as varchar) as url from customer where c_custkey % 7 <> 0 and c_custkey % 5 <> 0"),
    "class_order": (class_order, "select row_number() over (order by case cls when '5-LOW' then 0 when '2-HIGH' then 1 else 2 end, cls) - 1 as place, cls from (select distinct o_orderpriority as cls from orders)"),
    "out_of_fold_simple": (out_of_fold_simple, SIMPLE),
    "html_text": (html_text, None),
    "html_context_extract": (html_context_extract, None),
    "html_selector_extract": (html_selector_extract, None),
    "pca_projection": (pca_projection, None),
    "lda_projection": (lda_projection, None),
    "benchmark_models": (benchmark_models, None),
    "benchmark_texts": (benchmark_texts, None),
    "consolidated_report": (consolidated_report, None),
}
