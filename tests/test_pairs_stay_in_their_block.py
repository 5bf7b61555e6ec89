"""What is made of pairs is made in their block, and what was shuffled for stored tables does not stay on disk."""

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import similarity
from lumenframe.plans import catalog
from lumenframe.session import store

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ratings(spark):
    draw = random.Random(8)
    rows = [(u, i, float(draw.randint(1, 3))) for u in range(30) for i in range(50) if draw.random() < 0.3]
    return spark.createDataFrame(rows, "user long, item int, rating double").cache()


def small_blocks(monkeypatch, entries=1 << 22):
    monkeypatch.setattr(similarity, "BLOCK", 400)
    monkeypatch.setattr(similarity, "_PAIRS", 60)
    monkeypatch.setattr(similarity, "_ENTRIES", entries)


@pytest.mark.parametrize(("measure", "threshold", "entries"), [*((m, None, 1 << 22) for m in similarity.MEASURES), ("euclidean", 0.13, 1 << 22), ("tanimoto", None, 100), ("pearson", -0.1, 100)])
def test_most_similar_of_each_item(spark, monkeypatch, ratings, measure, threshold, entries):
    small_blocks(monkeypatch, entries)
    whole = similarity.similarities(ratings, measure, threshold=threshold)
    kept = similarity.similarities(ratings, measure, threshold=threshold, most=4)
    assert kept.schema == whole.schema and kept.groupBy("i").count().where("count > 4").count() == 0
    # a similarity of zero but for the order of a sum may fall on either side
    want, got = (sorted(tuple(r) for r in similarity.top_k(x, 4).collect() if threshold is not None or r.similarity > 1e-9) for x in (whole, kept))
    assert want and [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want], abs=1e-12)


def test_top_of_runs():
    draw = np.random.default_rng(4)
    # ties, zeros of either sign, values that differ beyond 32 bits, and infinite ones
    pool = np.array([-np.inf, -2.0, -1e-300, -0.0, 0.0, 1e-300, 0.5, 0.5 + 1e-12, 0.5 + 2e-12, 3.0, 1e300, np.inf])
    for k in (1, 3, 10):
        i, value = np.sort(draw.integers(0, 40, 900)), pool[draw.integers(0, len(pool), 900)]
        want = sorted(p for g in range(40) for p in sorted(np.flatnonzero(i == g), key=lambda p: (-value[p], p))[:k])
        assert similarity._top(i, value, k).tolist() == want
    assert similarity._top(np.array([], int), np.array([]), 3).tolist() == []


@pytest.mark.parametrize("entries", [1 << 22, 100])
def test_totals_equal_those_of_joined_pairs(spark, monkeypatch, ratings, entries):
    small_blocks(monkeypatch, entries)
    measures = [m.name for m in similarity.MEASURES.values() if m.scale == "identity"]
    # whether a likelihood ratio of zero counts depends on the order of a sum
    both = lambda r: r.n_both if r.measure != "loglikelihood" else None
    got = {(r.measure, str(r.i)): (r.total, both(r)) for r in similarity.totals(ratings, measures).collect() if r.total > 1e-9}
    # items that are not whole numbers are joined; with leading zeros they are in the same order
    other = similarity.totals(ratings.withColumn("item", F.format_string("%03d", "item")), measures)
    want = {(r.measure, str(int(r.i))): (pytest.approx(r.total), both(r)) for r in other.collect() if r.total > 1e-9}
    assert want and got == want


def test_topk_query_ranks_few_pairs(spark, monkeypatch):
    seen, top_k = [], similarity.top_k
    monkeypatch.setattr(similarity, "top_k", lambda similar, k: seen.append(similar) or top_k(similar, k))
    assert catalog.queries()["similarity_topk"](spark, SF).count()
    assert seen[0].groupBy("i").count().agg(F.max("count")).first()[0] == 10


def test_totals_query_shuffles_no_sums_of_pairs(spark):
    plan = catalog.queries()["similarity_totals"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Aggregate" not in plan and not re.search(r"hashpartitioning\(i#", plan)


def test_store_leaves_no_shuffle_files(spark):
    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for k in range(files.size()) if (name := files.apply(k).getName()).startswith("shuffle_")}

    before = shuffled()
    df = spark.range(10_000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    stored = store(df)
    until = time.time() + 20
    while shuffled() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffled() - before
    # neither the table nor what it was made of is lost
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, df.collect()))
