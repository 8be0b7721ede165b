"""URL rules by hashed expressions. DataFrame operations only.

A rule is a host and a path prefix. Each URL is expanded into the expressions a rule that fits it would
have, every suffix of its host at a dot with every prefix of its path of a length that some rule has. Both
sides hash theirs with SHA-256; an equi-join on the first 4 bytes finds candidates, the full digest
confirms them, and the longest rule decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, table, written

#: (verdict, rule); host up to the first slash, the path's prefix from there.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Parts that each expression's URLs are dealt to, so that the URLs under a common suffix don't meet in one task.
SALTS = 16
#: Distinct lengths that rules' paths may have; the expansion's width.
MAX_LENGTHS = 4096


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path. Null or without `://`: both empty."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), UPPER, LOWER), F.coalesce(path, F.lit(""))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame([(v, r[: r.index("/")], r[r.index("/") :], r) for v, r in rules], "verdict string, host string, path string, rule string")


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", id_col: str = "page_id", otherwise: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) of every row; other columns aren't read.

    rules: verdict, host (lower case), path, rule. Of equal expressions a block wins. URLs no rule fits, null
    and malformed ones among them, get `otherwise` and a null rule. Rows with null or repeated ids are judged
    each by itself; no rules, or an empty table, work as well. Any input will do, shuffled ones too. Rules' paths may have MAX_LENGTHS different lengths; more raise ValueError.
    """
    rules = rules.where("host is not null and path is not null")
    # Lengths of rules' paths: bounded, and checked.
    lengths = [r[0] for r in rules.select(F.char_length("path")).distinct().orderBy(F.char_length("path")).limit(MAX_LENGTHS + 1).collect()]
    if len(lengths) > MAX_LENGTHS:
        raise ValueError(f"rules have paths of more than {MAX_LENGTHS} lengths")
    host, path = split_url(F.col(url_col))
    # Written, as rows are read twice by their number: another evaluation of pages may number them otherwise.
    urls = written(pages.select(F.monotonically_increasing_id().alias("_n"), F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path")))
    # Plain columns first: a lambda that holds an expression computes it again for every element.
    tries = urls.withColumn("_labels", F.split("host", r"\."))
    suffixes = F.transform(F.sequence(F.lit(1), F.size("_labels")), lambda i: F.array_join(F.slice("_labels", i, F.size("_labels")), "."))
    prefixes = F.transform(
        F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda k: k <= F.char_length("path")), lambda k: F.substring(F.col("path"), F.lit(1), k)
    )
    tries = tries.select("_n", prefixes.alias("_prefixes"), F.explode(suffixes).alias("_h")).select("_n", F.explode(F.transform("_prefixes", lambda p: F.concat(F.col("_h"), p))).alias("_try"))
    digest = lambda c: F.sha2(c, 256)
    tries = tries.withColumn("_full", digest("_try")).withColumn("_short", F.substring("_full", 1, 8)).drop("_try").withColumn("_salt", F.pmod("_n", F.lit(SALTS)).cast("int"))
    known = rules.select(digest(F.concat("host", "path")).alias("_rule_full"), F.struct(F.char_length("rule").alias("n"), F.col("verdict"), F.col("rule")).alias("_best"))
    known = known.groupBy("_rule_full").agg(F.max("_best").alias("_best")).withColumn("_short", F.substring("_rule_full", 1, 8))
    known = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hit = tries.join(known, ["_short", "_salt"]).where(F.col("_full") == F.col("_rule_full")).select("_n", "_best")
    # URLs stay whether or not a rule fits: their own rows don't go through the join.
    blank = hit.schema["_best"].dataType
    both = urls.withColumn("_best", F.lit(None).cast(blank)).unionByName(hit, allowMissingColumns=True).withColumn("_own", F.col("host").isNotNull())
    best = both.groupBy("_n").agg(*(F.max(F.when(F.col("_own"), F.col(c))).alias(c) for c in ("page_id", "host", "path")), F.max("_best").alias("_best"))
    return best.select("page_id", "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(otherwise)).alias("verdict"))


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL under the five rules."""
    return judge(table(spark, sf_dir, "pages"), rule_table(spark))


SQL = """
with u as (select page_id, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages),
h as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path, row_number() over () as n from u),
r(verdict, rh, rp, rule) as (values """ + ", ".join(f"('{v}', '{r[:r.index('/')]}', '{r[r.index('/'):]}', '{r}')" for v, r in RULES) + """),
m as (select n, arg_max(rule, length(rule)) as rule, arg_max(verdict, length(rule)) as verdict from h join r
      on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by n)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from h left join m using (n)
"""
