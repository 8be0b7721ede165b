"""Queries over texts: vocabulary, vectors, keyness, similarity, naive Bayes, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import CHART_TERMS, CUSTOM_STOP_WORDS, MOJIBAKE, PERMUTATIONS, SEED
from ..functions.text import clean_tokens, fraction, normalize, number, repair_encoding, slug, column_name, suspicious
from ..operators import classifiers, cosine, homogeneity, keyness, report, vectors


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str):
    """(documents, vocabulary, counts, class sizes) of the documents by language."""
    docs = vectors.documents(table(spark, sf_dir, "documents"), "doc_id", "lang", "text")
    vocab, counts = vectors.fitted(docs)
    return docs, vocab, counts, vectors.class_sizes(docs)


TOK = r"""
with tok as (select doc_id as id, lang as cls, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') as t from documents
             where lang is not null and trim(lang) <> '' and text is not null and trim(text) <> ''),
g as (select id, cls, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) as term from tok),
tf as (select id, cls, term, count(*) as tf from g group by id, cls, term),
voc as (select term, cast(sum(tf) as bigint) as cf, count(*) as df from tf group by term
        having count(*) >= 2 and count(*) <= cast(0.85 as double) * (select count(*) from tok) order by cf desc, term limit 400),
w as (select id, cls, term, tf, df from tf join voc using (term)),
sizes as (select cls, count(*) as n_docs from tok group by cls)"""
VEC = (
    TOK
    + """,
raw as (select id, cls, term, tf * (ln((cast(1 as double) + (select count(*) from tok)) / (1 + df)) + 1) as x from w),
vec as (select id, cls, term, x / sqrt(sum(x * x) over (partition by id)) as x from raw)"""
)
CEN = VEC + """,
cen as (select cls, term, sum(x) / max(n_docs) as x from vec join sizes using (cls) group by cls, term)"""


def vocabulary_400(spark, sf_dir):
    return vectors.vocabulary(vectors.documents(table(spark, sf_dir, "documents"), "doc_id", "lang", "text")).select("term", "df", "cf")


def tfidf_vectors(spark, sf_dir):
    _, _, counts, _ = corpus(spark, sf_dir)
    return vectors.tfidf(counts).select("id", "cls", "term", F.round("x", 6).alias("x"))


def centroid_similarity(spark, sf_dir):
    _, _, counts, sizes = corpus(spark, sf_dir)
    out = vectors.centroid_similarity(vectors.centroids(vectors.tfidf(counts), sizes), sizes)
    return out.select("class_a", "class_b", F.round("similarity", 6).alias("similarity"))


def intra_inter_similarity(spark, sf_dir):
    _, _, counts, sizes = corpus(spark, sf_dir)
    out = homogeneity.pair_means(homogeneity.class_sums(vectors.tfidf(counts)), sizes, [])
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


def document_cosine(spark, sf_dir):
    """Documents whose id is divisible by 50 against all others."""
    out = vectors.document_cosine(vectors.documents(table(spark, sf_dir, "documents"), "doc_id", "lang", "text"), "id % 50 = 0")
    return out.select("id_a", "id_b", F.round("similarity", 6).alias("similarity"))


#: Cosine from which documents count as linked.
LINKED = 0.8


def cosine_links(spark, sf_dir):
    """How many others are near each document, for all documents."""
    docs = vectors.documents(table(spark, sf_dir, "documents"), "doc_id", "lang", "text")
    if vectors.one_row_each(docs):
        return cosine.cosine_links(docs, None, vectors.vocabulary_alone(docs), LINKED)
    vocab, counts = vectors.fitted(docs)
    return cosine.cosine_links(docs, counts, vocab, LINKED)


LINKS = VEC + f""",
l as (select a.id as a, b.id as b from vec a join vec b using (term) where a.id <> b.id group by 1, 2 having round(sum(a.x * b.x), {cosine.DECIMALS}) >= {LINKED}),
n as (select a as id, count(*) as n from l group by a)
select id, coalesce(n, 0) as n_links from tok left join n using (id)"""


KEY = TOK + """,
grid as (select cls, term, coalesce(f, 0) as f, coalesce(docs, 0) as docs from sizes cross join voc
         left join (select cls, term, cast(sum(tf) as bigint) as f, count(*) as docs from w group by cls, term) using (cls, term)),
rel as (select *, f / cast(sum(f) over (partition by cls) as double) as rel, cast(sum(f) over (partition by term) as bigint) as total from grid),
z as (select *, coalesce((rel - avg(rel) over (partition by term)) / nullif(stddev_samp(rel) over (partition by term), 0), 0) as z from rel),
ok as (select cls, term, round(z, 6) as z, f, rel, total, docs, n_docs, cast(greatest(2, ceil(cast(0.1 as double) * n_docs)) as bigint) as threshold from z join sizes using (cls)),
top as (select *, row_number() over (partition by cls order by z desc, term) as rank from ok where docs >= threshold and z > 0)
"""


def scored(spark, sf_dir):
    _, vocab, counts, sizes = corpus(spark, sf_dir)
    return keyness.z_scores(keyness.grid(counts, sizes, vocab)), sizes


def keyness_top15(spark, sf_dir):
    cells, sizes = scored(spark, sf_dir)
    return keyness.top_terms(cells, sizes)


def keyness_chart(spark, sf_dir):
    cells, sizes = scored(spark, sf_dir)
    return keyness.top_terms(cells, sizes, CHART_TERMS).select("cls", (CHART_TERMS - F.col("rank") + 1).alias("bar"), "term", "z")


def keyness_scores(spark, sf_dir):
    cells, _ = scored(spark, sf_dir)
    return cells.select("cls", "term", "f", "docs", F.round("rel", 8).alias("rel"), "total", F.round("z", 6).alias("z"))


def report_terms(spark, sf_dir):
    cells, sizes = scored(spark, sf_dir)
    return report.terms_by_class(keyness.top_terms(cells, sizes)).select("cls", F.array_join("terms", ", ").alias("terms"))


def multinomial_nb_predict(spark, sf_dir):
    docs, vocab, counts, sizes = corpus(spark, sf_dir)
    prior, terms = classifiers.naive_bayes_tables(counts, sizes, vocab)
    return classifiers.naive_bayes_predict(docs, counts, prior, terms)


NB = TOK + """,
cells as (select cls, term, coalesce(f, 0) as f from sizes cross join voc left join (select cls, term, sum(tf) as f from w group by cls, term) using (cls, term)),
lp as (select cls, term, ln((f + cast(1 as double)) / (sum(f) over (partition by cls) + count(*) over (partition by cls))) as lp from cells),
s as (select w.id, lp.cls, sum(tf * lp) as s from w join lp using (term) group by w.id, lp.cls),
p as (select cls, ln(n_docs / cast((select count(*) from tok) as double)) as prior from sizes),
b as (select tok.id, tok.cls as actual, p.cls, round(prior + coalesce(s, 0), 6) as score from tok cross join p left join s on s.id = tok.id and s.cls = p.cls)
select id, actual, cls as predicted from (select *, row_number() over (partition by id order by score desc, cls) as r from b) where r = 1"""


def permutation_parts(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    rows = homogeneity.unit_terms(v, "vec_id", "label", "embedding")
    docs = v.where("label is not null and embedding is not null").select(F.col("label").cast("string").alias("cls"))
    seen = homogeneity.pair_means(homogeneity.class_sums(rows), vectors.class_sizes(docs), [])
    return seen, homogeneity.permutation_differences(v, "vec_id", "label", "embedding", PERMUTATIONS, SEED)


def permutation_test(spark, sf_dir):
    out = homogeneity.permutation_test(*permutation_parts(spark, sf_dir))
    return out.select(*(F.round(c, 8).alias(c) if t == "double" else c for c, t in out.dtypes))


PERM = f"""
with d as (select vec_id as id, cast(label as varchar) as cls, cast(embedding as double[]) as v, sqrt(list_sum(list_transform(cast(embedding as double[]), lambda x: x * x))) as norm
           from embeddings where label is not null and embedding is not null),
u as (select id, cls, unnest(range(1, len(v) + 1)) as term, unnest(v) / norm as x from d where norm > 0),
ids as (select id, cls from d), sizes as (select cls, count(*) as n from ids group by cls),
b as (select cls, sum(n) over (order by cls) - n as low, sum(n) over (order by cls) as high from sizes),
k as (select id, cast('0x' || substr(md5(concat_ws('|', '{SEED}', id)), 1, 8) as bigint) % {homogeneity.PRIME} as x from ids),
co as (select perm, list(cast('0x' || substr(md5(concat_ws('|', '{SEED}', perm, i)), 1, 8) as bigint) % {homogeneity.PRIME} order by i) as c
       from (select unnest(range(1, {PERMUTATIONS + 1})) as perm) cross join (select unnest(range(4)) as i) group by perm),
y as (select perm, id, (((c[1] * x + c[2]) % {homogeneity.PRIME} * x + c[3]) % {homogeneity.PRIME} * x + c[4]) % {homogeneity.PRIME} as y from k cross join co),
ranked as (select perm, id, row_number() over (partition by perm order by y, id) as r from y),
dealt as (select 0 as perm, id, cls from ids union all select perm, id, b.cls from ranked join b on r > low and r <= high),
s as (select perm, dealt.cls, term, sum(x) as s from u join dealt using (id) group by all),
own as (select perm, sum(s * s) as own2 from s group by perm),
whole as (select perm, sum(s * s) as all2 from (select perm, term, sum(s) as s from s group by all) group by perm),
nn as (select (select count(*) from d where norm > 0) as q, (select count(*) from d) as n, (select sum(n * (n - 1) / 2) from sizes) as ip),
m as (select perm, (own2 - q) / 2 / ip as intra, ((all2 - q) / 2 - (own2 - q) / 2) / (n * (n - 1) / 2 - ip) as inter from own join whole using (perm) cross join nn),
o as (select intra, inter, intra - inter as observed from m where perm = 0), p as (select intra - inter as difference from m where perm > 0)
select round(any_value(intra), 8) as intra, round(any_value(inter), 8) as inter, round(any_value(observed), 8) as observed, count(*) as permutations,
  count(*) filter (round(difference, 12) >= round(observed, 12)) as extremes, round(avg(difference), 8) as null_mean, round(stddev_pop(difference), 8) as null_std,
  round((count(*) filter (round(difference, 12) >= round(observed, 12)) + 1) / cast(count(*) + 1 as double), 8) as p_value,
  (count(*) filter (round(difference, 12) >= round(observed, 12)) + 1) / cast(count(*) + 1 as double) < 0.05 as significant
from p cross join o"""


def clean_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(clean_tokens(F.col("text"), CUSTOM_STOP_WORDS), " ").alias("clean"))


STOP_SQL = "[" + ", ".join(f"'{w}'" for w in CUSTOM_STOP_WORDS) + "]"
CLEAN = rf"""
select doc_id, array_to_string(list_filter(regexp_extract_all(regexp_replace(lower(coalesce(text, '')), '(https?://|www\.)\S+|\S+@\S+', ' ', 'g'), '[\p{{L}}\p{{N}}_]+'),
  lambda w: length(w) >= 3 and regexp_full_match(w, '\p{{L}}+') and not list_contains({STOP_SQL}, w)), ' ') as clean from documents"""


def normalized_text(spark, sf_dir):
    """Texts with zero-width and no-break spaces put in, and taken out again."""
    dirty = F.concat(F.lit("​ \t"), F.replace("text", F.lit(". "), F.lit(".  \n")), F.lit(" "))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(normalize(dirty)).alias("digest"))


NORMAL = r"""
select doc_id, md5(coalesce(trim(regexp_replace(replace(replace(text, chr(8203), ''), chr(160), ' '), '[\s\x0B\x{0085}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')), '')) as digest from documents"""


def repaired_text(spark, sf_dir):
    """Texts broken by the wrong charset, found and repaired."""
    broken = F.decode(F.encode(F.trim("text"), "UTF-8"), "ISO-8859-1")
    rows = table(spark, sf_dir, "documents").select("doc_id", broken.alias("text"))
    return rows.select("doc_id", suspicious(rows.select("text"), MOJIBAKE).alias("suspect"), F.md5(repair_encoding(F.col("text"))).alias("digest"))


REPAIRED = r"select doc_id, coalesce(strlen(text) > length(text), false) as suspect, md5(trim(text)) as digest from documents"


def parsed_numbers(spark, sf_dir):
    text = F.concat(F.replace((F.col("p_size") + F.lit(0.5)).cast("string"), F.lit("."), F.lit(",")), F.lit(" %"))
    x = number(text)
    return table(spark, sf_dir, "part").select("p_partkey", x.alias("number"), F.round(fraction(x), 6).alias("fraction"), fraction(number(F.lit("n/a"))).alias("none"))


def plain_names(spark, sf_dir):
    name = F.concat(F.lit(" Ñandú "), F.col("p_type"), F.lit(" (%) "), F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", column_name(name).alias("name"), slug(F.col("p_type")).alias("slug"))


QUERIES = {
    "keyness_top15": (keyness_top15, KEY + "select cls, rank, term, z, f as count_class, round(rel, 8) as share_class, total as count_all, docs, n_docs, round(docs / cast(n_docs as double), 6) as support, threshold from top where rank <= 15"),
    "keyness_chart": (keyness_chart, KEY + "select cls, 10 - rank + 1 as bar, term, z from top where rank <= 10"),
    "keyness_scores": (keyness_scores, KEY + "select cls, term, f, docs, round(rel, 8) as rel, total, round(z, 6) as z from z"),
    "vocabulary_400": (vocabulary_400, TOK + " select term, df, cf from voc"),
    "tfidf_vectors": (tfidf_vectors, VEC + " select id, cls, term, round(x, 6) as x from vec"),
    "centroid_similarity": (centroid_similarity, CEN + """ select a.cls as class_a, b.cls as class_b, round(sum(a.x * b.x) / max(na) / max(nb), 6) as similarity
        from (select *, sqrt(sum(x * x) over (partition by cls)) as na from cen) a join (select *, sqrt(sum(x * x) over (partition by cls)) as nb from cen) b using (term) group by 1, 2"""),
    "intra_inter_similarity": (intra_inter_similarity, VEC + """,
        s as (select cls, term, sum(x) as s, sum(x * x) as q from vec group by 1, 2),
        k as (select (select count(*) from tok) as n, (select sum(n_docs * (n_docs - 1) / 2) from sizes) as ip, (select sum(q) from s) as q, (select sum(s * s) from s) as own2,
              (select sum(t * t) from (select sum(s) as t from s group by term)) as all2),
        m as (select (own2 - q) / 2 / ip as intra, ((all2 - q) - (own2 - q)) / 2 / (n * (n - 1) / 2 - ip) as inter from k)
        select round(intra, 6) as intra, round(inter, 6) as inter, round(intra - inter, 6) as difference from m"""),
    "document_cosine": (document_cosine, VEC + " select a.id as id_a, b.id as id_b, round(sum(a.x * b.x), 6) as similarity from vec a join vec b using (term) where a.id % 50 = 0 and a.id <> b.id group by 1, 2"),
    "cosine_links": (cosine_links, LINKS),
    "report_terms": (report_terms, KEY + "select cls, string_agg(term, ', ' order by rank) as terms from top where rank <= 15 group by cls"),
    "multinomial_nb_predict": (multinomial_nb_predict, NB),
    "permutation_test": (permutation_test, PERM),
    "clean_texts": (clean_texts, CLEAN),
    "normalized_text": (normalized_text, NORMAL),
    "repaired_text": (repaired_text, REPAIRED),
    "parsed_numbers": (parsed_numbers, "select p_partkey, cast(p_size + 0.5 as double) as number, round(case when p_size + 0.5 > 1 then (p_size + 0.5) / 100 else p_size + 0.5 end, 6) as fraction, cast(null as double) as none from part"),
    "plain_names": (plain_names, r"select p_partkey, trim(regexp_replace(translate(lower(trim(' Ñandú ' || p_type || ' (%) ' || p_name)), 'áéíóúñ', 'aeioun'), '[^a-z0-9]+', ' ', 'g')) as name, replace(translate(lower(p_type), 'áéíóú', 'aeiou'), ' ', '_') as slug from part"),
}
