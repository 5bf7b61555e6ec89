import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.functions import numeric, strings
from lumenframe.operators import clustering, forest, logistic, sfo, similarity, stats


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_logistic_and_likelihood(spark):
    assert [one(spark, numeric.logistic(F.lit(float(z)))) for z in (0, 1000, -1000)] == [0.5, 1.0, 0.0]
    ll = lambda y, p: one(spark, numeric.log_likelihood(F.lit(y), F.lit(p)))
    assert ll(0, 1.0) == pytest.approx(-16.118, abs=1e-3)
    assert ll(1, 0.0) == pytest.approx(-744.44, abs=1e-2)
    assert one(spark, numeric.classify(F.lit(0.5), 0.4)) == 0


def test_small_functions(spark):
    assert one(spark, F.array(*numeric.heap_children(F.lit(2)))) == [5, 6]
    assert one(spark, numeric.gini(F.array(F.lit(0.5), F.lit(0.5)))) == 0.5
    assert one(spark, numeric.entropy(F.array(F.lit(1.0), F.lit(0.0)))) == 0
    assert one(spark, numeric.add_padded(F.array(F.lit(1), F.lit(2)), F.array(F.lit(1)))) == [2, 2]
    assert one(spark, numeric.is_regular(F.lit(0.0))) is False
    assert one(spark, strings.tokens(strings.replace_non_word(strings.lower_ascii(F.lit("A-b  c_D"))))) == ["a", "b", "c_d"]
    assert one(spark, strings.without_stop_words(F.array(F.lit("the"), F.lit("tree")))) == ["tree"]


@pytest.mark.parametrize("name", numeric.DISTANCE_CODES)
def test_distances(spark, name):
    a, b = np.array([1.0, 2.0, 3.0]), np.array([2.0, 0.0, 3.5])
    d = a - b
    want = {
        "squared_euclidean": d @ d,
        "cosine": 1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b),
        "chebyshev": 2.0,
        "euclidean": np.linalg.norm(d),
        "manhattan": abs(d).sum(),
        "mahalanobis": np.linalg.norm(d),
        "minkowski": (abs(d) ** 3).sum() ** (1 / 3),
        "tanimoto": 1 - a @ b / (a @ a + b @ b - a @ b),
        "weighted_euclidean": np.linalg.norm(d),
        "weighted_manhattan": abs(d).sum(),
    }[name]
    lit = lambda v: F.array(*map(F.lit, map(float, v)))
    assert one(spark, numeric.distance(name, lit(a), lit(b), inverse=np.eye(3).tolist())) == pytest.approx(want)


def test_tanimoto_of_shared_users(spark):
    rows = [(u, 1, 1.0) for u in (1, 2, 3)] + [(u, 2, 1.0) for u in (2, 3, 4)]
    ratings = spark.createDataFrame(rows, "user long, item long, rating double")
    got = similarity.similarities(ratings, "tanimoto", symmetric=True).collect()
    assert sorted((r.i, r.j, r.similarity) for r in got) == [(1, 2, 0.5), (2, 1, 0.5)]
    with pytest.raises(ValueError):
        similarity.similarities(ratings, "none")


@pytest.mark.parametrize("measure", list(similarity.MEASURES))
def test_similarities_are_bounded(spark, measure):
    rng = np.random.default_rng(0)
    rows = {(int(u), int(i)): float(r) for u, i, r in zip(rng.integers(0, 20, 200), rng.integers(0, 15, 200), rng.integers(1, 6, 200))}
    ratings = spark.createDataFrame([(u, i, r) for (u, i), r in rows.items()], "user long, item long, rating double")
    got = similarity.similarities(ratings, measure).collect()
    assert got and all(0 < r.similarity <= (20 if measure == "cooccurrence" else 1 + 1e-9) for r in got)
    top = similarity.top_k(similarity.similarities(ratings, measure), 3).collect()
    assert max(r["rank"] for r in top) <= 3


def test_sampling_is_a_function_of_the_rows(spark):
    ratings = spark.range(2000).select((F.col("id") % 500).alias("user"), (F.col("id") % 4).alias("item"), F.lit(1.0).alias("rating"))
    a = similarity.sample_down(ratings, 50)
    assert {tuple(r) for r in a.collect()} == {tuple(r) for r in similarity.sample_down(ratings.repartition(7), 50).collect()}
    assert 100 < a.count() < 320


def classified(spark, n=400):
    rng = np.random.default_rng(3)
    x = np.c_[np.ones(n), rng.normal(size=(n, 2))]
    y = (rng.random(n) < 1 / (1 + np.exp(-x @ [0.3, 1.0, -2.0]))).astype(int)
    return x, y, spark.createDataFrame([(i, int(b), a.tolist()) for i, (a, b) in enumerate(zip(x, y))], "id long, label int, features array<double>")


def test_gradient_is_the_derivative(spark):
    x, y, df = classified(spark)
    w = [0.1, -0.2, 0.3]
    loss = lambda v: -sum(b * math.log(1 / (1 + math.exp(-a @ v))) + (1 - b) * math.log(1 - 1 / (1 + math.exp(-a @ v))) for a, b in zip(x, y))
    got = {r.dim: r.gradient for r in logistic.gradient(df, w).collect()}
    for d in range(3):
        step = np.eye(3)[d] * 1e-5
        assert got[d] == pytest.approx((loss(np.array(w) + step) - loss(np.array(w) - step)) / 2e-5, abs=1e-3)


def test_newton_and_lbfgs_agree(spark):
    x, y, df = classified(spark)
    w = logistic.newton(df, 3, iterations=8)
    p = 1 / (1 + np.exp(-x @ w))
    assert np.abs(x.T @ (p - y)).max() < 1e-6
    assert logistic.lbfgs(df) == pytest.approx(w, abs=1e-3)
    small = logistic.gradient_descent(df, 3, iterations=3, rate=0.5, mean=True)
    v = np.zeros(3)
    for _ in range(3):
        v -= 0.5 * x.T @ (1 / (1 + np.exp(-x @ v)) - y) / len(x)
    assert small == pytest.approx(v.tolist())


def test_metrics(spark):
    _, _, df = classified(spark)
    scored = logistic.predict(df, [0.3, 1.0, -2.0])
    rows = scored.select("label", "p", "predicted").collect()
    pairs = [(a.p > b.p) + 0.5 * (a.p == b.p) for a in rows if a.label for b in rows if not b.label]
    assert stats.auc(scored).first().auc == pytest.approx(np.mean(pairs))
    c = stats.confusion(scored).first()
    assert c.tp + c.tn == stats.accuracy(scored).first().correct
    assert stats.mean_deviation(scored).first()[0] == pytest.approx(np.mean([abs(r.label - r.p) for r in rows]))


def test_statistics_and_normalisation(spark):
    df = spark.createDataFrame([(1.0, -3.0, 5.0), (2.0, -1.0, 5.0), (3.0, 1.0, 5.0)], "a double, b double, c double")
    by = {r.name: r for r in stats.column_stats(df, ["a", "b"]).collect()}
    assert (by["a"].mean, by["b"].mean, by["a"].span, by["b"].span) == (2, -1, 2, 4)
    assert [r.c for r in stats.range_normalise(df, ["c"]).collect()] == [0, 0, 0]


def test_linear_regression(spark):
    df = spark.createDataFrame([(float(x), 2.0 * x + 1) for x in range(9)], "x double, y double")
    assert logistic.linear_regression(df, ["x"], "y") == pytest.approx([1.0, 2.0])
    assert logistic.pseudo_inverse(np.diag([2.0, -4.0])) @ np.diag([2.0, -4.0]) == pytest.approx(np.eye(2))


def test_votes(spark):
    votes = lambda *p, how="weighted_as_coded": one(spark, logistic.vote(F.array(*map(F.lit, p)), how))
    assert votes(0.45, 0.45, 0.6) == 0
    assert votes(0.1, 0.1, 0.6) == 1
    assert votes(0.1, 0.1, 0.6, how="majority") == 0


def test_ensemble_learns(spark):
    _, _, df = classified(spark)
    rows = logistic.train_ensemble(logistic.random_partition(df, 3), rate=0.5).collect()
    assert {r.model for r in rows} == {0, 1, 2}
    assert min(r.online_accuracy for r in rows) > 0.6


def test_forward_selection_finds_the_feature(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(200):
        y = i % 2
        rows += [(i, y, 0, 1.0)] if rng.random() < 0.5 else []
        rows += [(i, y, 1, 1.0)] if y and rng.random() < 0.9 or rng.random() < 0.2 else []
        rows.append((i, y, 2, 0.5))
    data = spark.createDataFrame(rows, "id int, label int, dim int, value double")
    model = spark.createDataFrame([], "dim int, weight double")
    selector = sfo.Selector(data, data, model)
    selector.forward_feature_selection(1)
    chosen = selector.model.collect()
    assert [r.dim for r in chosen] == [1] and chosen[0].weight > 0
    assert selector.retrain_base_model(iterations=2).count() == 1
    selector.reset_model()
    assert selector.model.count() == 0 and selector.counters == {"computed": 1, "added": 1}


def test_histogram_of_the_published_example(spark):
    df = spark.createDataFrame([(float(v),) for v in (23, 19, 10, 16, 36, 2, 9, 32, 30)], "v double").coalesce(1)
    got = forest.histogram(df, "v", 5).orderBy("p").collect()
    assert [(round(r.p, 4), r.m) for r in got] == [(2, 1), (9.5, 2), (17.5, 2), (23, 1), (32.6667, 3)]
    bars = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.lit(float(m)).alias("m")) for p, m in ((2, 1), (9.5, 2), (17.5, 2), (23, 1), (32.6667, 3))])
    assert one(spark, forest.histogram_sum(bars, 15.0)) == pytest.approx(1 + 1 + (2 + 2) / 2 * 5.5 / 8)
    assert one(spark, forest.histogram_sum(bars, 99.0)) == 9


def test_forest_separates(spark):
    rng = np.random.default_rng(1)
    x = rng.random((300, 3))
    samples = spark.createDataFrame([(i, int(v[1] > 0.5), v.tolist()) for i, v in enumerate(x)], "id long, label int, features array<double>")
    trees = forest.build(samples, 3, trees=5, min_items=5, max_depth=4)
    votes = forest.majority_vote(forest.traverse(samples, trees))
    right = votes.join(samples, "id").where("predicted = label").count()
    assert right > 240
    drawn = forest.bootstrap(samples, 2)
    assert [r.n for r in drawn.groupBy("tree").agg(F.sum("n").alias("n")).collect()] == [300, 300]


def test_split_quality_modes(spark):
    counts = spark.createDataFrame([(0, 0, 0, 1.0, 0, 4, 0), (0, 0, 0, 1.0, 1, 0, 4)], "tree int, node long, feature int, split double, label int, n_left long, n_right long")
    assert forest.qualities(counts).first().quality == pytest.approx(0.5)
    assert forest.qualities(counts, "as_coded").first().quality == pytest.approx(0.0)


def points(spark):
    rng = np.random.default_rng(2)
    x = np.r_[rng.normal(0, 0.1, (60, 2)), rng.normal(3, 0.1, (60, 2))]
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, point array<double>")


def test_kmeans(spark):
    df = points(spark)
    centres = clustering.lloyd(df, [(0, [0.5, 0.5]), (1, [2.0, 2.0])], 3)
    assert np.allclose([v for _, v in centres], [[0, 0], [3, 3]], atol=0.1)
    assert clustering.cluster_weights(df, centres).agg(F.sum("weight")).first()[0] == 120
    assert clustering.ball_step(df, centres).count() == 2
    assert clustering.total_cost(df, centres).first().cost < 30


def test_one_pass_keeps_mass_and_bound(spark):
    df = points(spark).repartition(3)
    sketch = clustering.one_pass(df, kappa=5).cache()
    assert sketch.agg(F.sum("weight")).first()[0] == pytest.approx(120)
    assert max(r["count"] for r in sketch.groupBy("part").count().collect()) <= 5
    found = clustering.ball_kmeans(sketch, 2, plus_plus=True).collect()
    assert sorted(round(r.point[0]) for r in found) == [0, 3]
    train, test = clustering.split_test(df, 0.25)
    assert train.count() + test.count() == 120
