import math

import duckdb
import pytest

import __spark_entry__ as entry
from lumenframe.plans import catalog

SF = "/root/testdata/sf0.001"
NAMES = ["ratings_parse", "ratings_sampled", "sim_loglikelihood", "sim_pearson", "similarity_topk", "libsvm_parse_multi", "column_stats", "logreg_gd_5", "auc", "sfo_gains", "rf_split_quality", "rf_eval", "kmeans_lloyd_2", "stopword_filter"]


def plain(v):
    return float(f"{v:.7g}") + 0.0 if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "supplier", "part", "documents", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalog.queries()[name](spark, SF)
    want = con.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    assert got == sorted((tuple(map(plain, r)) for r in want.fetchall()), key=str)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
