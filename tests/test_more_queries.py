"""Further queries against their SQL, and histograms, forests and sparse descent against plain Python."""

from __future__ import annotations

import math
import random
import struct

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import forest, logistic
from lumenframe.operators.histograms import Histogram, histograms
from lumenframe.plans import catalog, catalog_more
from lumenframe.sources import text as sources

SF = "/root/testdata/sf0.001"
NAMES = [n for n, f in catalog.queries().items() if f.__module__ == catalog_more.__name__]


def plain(v):
    return float(f"{v:.9g}") + 0.0 if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.parametrize("name", [*NAMES, "flatten_to_vector", "ensemble_partition", "ensemble_eval", "rf_split_candidates", "rf_level", "rf_bootstrap", "rf_eval"])
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "supplier", "part", "customer", "nation", "documents", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalog.queries()[name](spark, SF)
    want = con.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    assert got == sorted((tuple(map(plain, r)) for r in want.fetchall()), key=str)


def test_histogram_example():
    # The worked example of Ben-Haim and Tom-Tov, "A Streaming Parallel Decision Tree Algorithm" (2010).
    h = Histogram(5)
    for x in (23, 19, 10, 16, 36, 2, 9, 32, 30):
        h.update(x)
    assert [round(c, 4) for c in h.centres] == [2, 9.5, 17.5, 23, 32.6667] and h.counts == [1, 2, 2, 1, 3]
    assert h.sum(15) == pytest.approx(1 + 2 / 2 + 2 * (15 - 9.5) / 8) and h.sum(99) == 9 and h.sum(1) == 0
    again = Histogram.parse(str(h))
    assert (again.centres, again.counts, again.size) == (h.centres, h.counts, 5)


def test_histogram_parts_and_merges():
    draw = random.Random(4)
    values = [draw.gauss(0, 1) for _ in range(4000)]
    parts = [Histogram(60) for _ in range(4)]
    for i, v in enumerate(values):
        parts[i % 4].update(v)
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.merge(p)
    assert whole.total() == 4000 and whole.low == min(values) and whole.high == max(values)
    cuts = whole.uniform(10)
    assert cuts == sorted(cuts) and len(cuts) == 9
    for j, c in enumerate(cuts, 1):
        assert abs(sum(v <= c for v in values) / 4000 - j / 10) < 0.02
        assert whole.sum(c) == pytest.approx(400 * j, rel=0.02)
    assert Histogram(5).uniform(10) == []
    weighted = Histogram(5)
    weighted.update(1.0, 7)
    weighted.update(1.0, 3)
    assert weighted.counts == [10]


def test_candidates_follow_counts(spark):
    rows = spark.createDataFrame([(0, 0, 0, float(v), 0, 1000 if v < 10 else 1) for v in range(100)], "tree int, node long, feature int, value double, label int, n long")
    (exact,) = forest.candidates(rows).collect()
    assert exact.splits == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0] or exact.splits[0] <= 1.0 and exact.splits[-1] <= 9.0
    (sketched,) = forest.candidates(rows, how="histogram").collect()
    assert len(sketched.splits) >= 5 and max(sketched.splits) < 12
    (found,) = histograms(rows, ["feature"], weight="n", size=8).collect()
    assert sum(found.counts) == 10_090 and len(found.centres) == 8


def test_walks_equal_joins(spark):
    rng = np.random.default_rng(2)
    samples = spark.createDataFrame([(i, int(x[0] > 0), x.tolist()) for i, x in enumerate(rng.normal(size=(300, 4)))], "id long, label int, features array<double>")
    trees = forest.build(samples, 4, trees=3, min_items=5, max_depth=6)
    walked, joined = (sorted(map(tuple, f.select("id", "tree", "vote").collect())) for f in (forest.traverse(samples, trees), forest._traverse_by_joins(samples, trees, 60)))
    assert walked == joined and len(walked) == 900
    assert forest.accuracy(samples, trees).first().accuracy > 0.7


def test_sparse_descent_equals_dense(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 5)) * (rng.random((60, 5)) < 0.5)
    y = (x.sum(1) > 0).astype(int)
    rows = spark.createDataFrame([(i, int(y[i]), d, float(x[i, d])) for i in range(60) for d in range(5) if x[i, d]], "id long, label int, dim int, value double")
    dense = spark.createDataFrame([(int(y[i]), x[i].tolist()) for i in range(60)], "label int, features array<double>")
    got = {r.dim: r.weight for r in logistic.sparse_descent(rows, iterations=4, rate=1.5, mean=True, n=60).collect()}
    assert [got[d] for d in range(5)] == pytest.approx(logistic.gradient_descent(dense, 5, iterations=4, rate=1.5, mean=True))


def test_idx_images(spark, tmp_path):
    pixels = np.random.default_rng(1).integers(0, 256, (2500, 6), dtype=np.uint8)
    labels = (np.arange(2500) % 10).astype(np.uint8)
    (tmp_path / "images").write_bytes(struct.pack(">iiii", 2051, 2500, 2, 3) + pixels.tobytes())
    (tmp_path / "labels").write_bytes(struct.pack(">ii", 2049, 2500) + labels.tobytes())
    got = sources.read_idx_images(spark, f"{tmp_path}/images", f"{tmp_path}/labels").orderBy("id").collect()
    assert [r.label for r in got] == labels.tolist()
    assert np.allclose([r.features for r in got], pixels / 256) and F is not None
