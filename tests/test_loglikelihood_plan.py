"""The number of users is a literal of the likelihood ratio: joined to the pairs it took the formula into a join condition, ten times slower."""

import pytest

from lumenframe.operators import similarity


@pytest.mark.parametrize("threshold", [None, 0.5])
def test_loglikelihood_joins_nothing_to_its_pairs(spark, threshold):
    ratings = spark.createDataFrame([(u, i, 1.0) for u in range(12) for i in range(8) if (u * i + u) % 5 != 1], "user long, item long, rating double")
    found = similarity.similarities(ratings, "loglikelihood", threshold=threshold)
    assert found.count()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_loglikelihood_of_no_ratings(spark):
    assert similarity.similarities(spark.createDataFrame([], "user long, item long, rating double"), "loglikelihood").count() == 0
