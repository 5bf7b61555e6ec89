"""A forest grown in tasks is that of the native steps level by level, and needs few plans."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from lumenframe.operators import forest
from lumenframe.plans import catalog

SCHEMA = "id long, label int, features array<double>"


def by_levels(samples, features, *, trees, min_items, max_depth, bins=10, mode="paper", reuse_features=False):
    """(tree, node, feature, split, label) by ``grow_level`` alone."""
    spark = samples.sparkSession
    members = forest.bootstrap(samples, trees).select("tree", F.lit(0).cast("long").alias("node"), "id", "n")
    open_nodes, out = [(t, 0, []) for t in range(trees)], []
    for depth in range(max_depth + 1):
        nodes = forest.subspace(spark.createDataFrame(open_nodes, "tree int, node long, used array<int>"), features, forest.subspace_size(features))
        done, members = forest.grow_level(samples, members, nodes, min_items=min_items if depth < max_depth else 2**62, bins=bins, mode=mode)
        rows = done.collect()
        out += [tuple(r)[:5] for r in rows]
        open_nodes = [(r.tree, child, r.used if reuse_features else [*r.used, r.feature]) for r in rows if r.feature is not None for child in (2 * r.node + 1, 2 * r.node + 2)]
        if not open_nodes:
            break
    return sorted(out, key=lambda r: r[:2])


def rows_of(df):
    return sorted((tuple(r) for r in df.select("tree", "node", "feature", "split", "label").collect()), key=lambda r: r[:2])


@pytest.fixture(scope="module")
def samples(spark):
    draw = random.Random(5)
    rows = []
    for i in range(300):
        x = [draw.gauss(0, 1), float(draw.randint(0, 3)), draw.choice([-0.0, 0.0, 1.0, math.nan]), round(draw.random(), 1), 7.0]
        rows.append((i * 3, int(x[0] > 0) + int(x[1] > 1) * draw.randint(0, 1), x))
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.mark.parametrize("options", [{}, {"mode": "as_coded", "reuse_features": True}, {"bins": 3, "max_depth": 2}])
def test_forest_is_that_of_the_levels(spark, samples, options):
    options = {"trees": 2, "min_items": 8, "max_depth": 4} | options
    want = by_levels(samples, 5, **options)
    assert sum(r[2] is not None for r in want) > 4
    for subtree_values in (forest.SUBTREE_VALUES, 300, 0):
        assert rows_of(forest.build(samples, 5, subtree_values=subtree_values, **options)) == want


def test_building_plans_little(spark, samples):
    """Levels planned one by one took more than the driver's memory (F3, F4): before, 7 jobs or more for each level."""
    store = spark._jsparkSession.sharedState().statusStore()
    count = lambda: store.executionsCount()
    before = count()
    deep = rows_of(forest.build(samples, 5, trees=2, min_items=1, max_depth=20, reuse_features=True))
    taken = count() - before
    assert max(r[1] for r in deep) > 2**8 and taken <= 10


@pytest.mark.parametrize("subtree_values", [forest.SUBTREE_VALUES, 0])
def test_nulls_go_right(spark, subtree_values):
    """Null features are on the side of a split that samples with nulls are sent to when they are voted on."""
    rows = [(i, int(i >= 40), [float(i) if i < 40 else None]) for i in range(80)]
    trees = forest.build(spark.createDataFrame([*rows, (80, 1, None)], SCHEMA), 1, min_items=5, subtree_values=subtree_values)
    root = trees.where("node = 0").first()
    assert root.feature == 0 and {r.node: r.label for r in trees.where("node > 0").collect()}[2] == 1


@pytest.mark.parametrize("how", ["percentile", "histogram"])
@pytest.mark.parametrize("subtree_values", [forest.SUBTREE_VALUES, 0])
def test_forest_of_awkward_samples(spark, how, subtree_values):
    build = lambda rows: rows_of(forest.build(spark.createDataFrame(rows, SCHEMA), 2, trees=2, min_items=1, how=how, subtree_values=subtree_values))
    assert build([]) == []
    assert build([(1, 5, [1.0, 2.0])]) == [(t, 0, None, None, 5) for t in (0, 1)]
    assert {r[4] for r in build([(i, 4, [float(i), math.nan]) for i in range(9)])} == {4}
    with pytest.raises(Exception, match="features"):
        build([(1, 5, [1.0]), (2, 5, [1.0])])


def test_rf_build_reaches_counts_all(spark):
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    got = catalog.queries()["rf_build_reaches"](spark, "/root/testdata/sf0.001").collect()
    # before, 32
    assert sorted(map(tuple, got)) == [(0, 500), (1, 500)] and store.executionsCount() - before <= 12
