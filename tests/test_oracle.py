"""Every query that has SQL, against DuckDB: all on the smallest tables, those over texts and vectors on larger ones too."""

import glob
import os

import pytest

from gleanery.plans import catalogue

LARGER = "/root/testdata/sf0.01"
NAMES = ("keyness_top15", "tfidf_vectors", "centroid_similarity", "multinomial_nb_predict", "permutation_test", "smote_samples", "knn3_predict")


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_equals_sql(name, spark, data, duck, same):
    same(catalogue.QUERIES[name](spark, data), duck, catalogue.ORACLE[name])


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql_on_more(name, spark, same):
    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{LARGER}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    same(catalogue.QUERIES[name](spark, LARGER), c, catalogue.ORACLE[name])


@pytest.mark.parametrize("name", ["html_text", "html_context_extract", "html_selector_extract", "pca_projection", "lda_projection"])
def test_query_runs(name, spark, data):
    assert catalogue.QUERIES[name](spark, data).count() > 0
