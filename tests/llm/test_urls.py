"""URL verdicts on inputs that aren't plain scans: shuffled, joined and united rows."""

from pyspark.sql import functions as F

from gleanery.llm import url_filter

from .test_more import as_counter, judged


def urls(n=4000):
    hosts = ("a.example.org", "example.org", "x.com", "b.de", "EXAMPLE.ORG")
    paths = ("/es/p", "/en/1", "/fr/", "/de/x", "", "/en/2?a=/es/")
    return [(i, f"http://{hosts[i % 5]}{paths[i % 6]}{i if i % 3 else ''}" if i % 97 else None) for i in range(n)]


def test_verdicts_stay_with_their_urls_whatever_the_input(spark):
    rows = urls()
    want = as_counter((i, *judged(u, url_filter.RULES)) for i, u in rows)
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("html", F.lit("x"))
    other = spark.createDataFrame([(i,) for i, _ in rows], "page_id long").repartition(5)
    inputs = {
        "repartitioned": pages.repartition(7),
        "twice repartitioned": pages.repartition(3).repartition(5),
        "united": pages.where("page_id % 2 = 0").unionByName(pages.where("page_id % 2 = 1").repartition(3)),
        "joined": pages.hint("shuffle_hash").join(other, "page_id"),
    }
    for name, df in inputs.items():
        assert as_counter(url_filter.judge(df, url_filter.rule_table(spark)).collect()) == want, name


def test_verdicts_over_repartitioned_pages(spark, data, duck):
    pages = spark.read.parquet(f"{data}/pages.parquet").repartition(5)
    got = as_counter(url_filter.judge(pages, url_filter.rule_table(spark)).select("page_id", "host", "path", "rule", "verdict").collect())
    assert got == as_counter(duck.sql(f"select page_id, host, path, rule, verdict from ({url_filter.SQL})").fetchall())
