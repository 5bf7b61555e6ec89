"""Single-feature optimisation: forward selection for logistic regression on sparse rows (id, label, dim, value).

For each unused feature a coefficient is fitted alone, given the base model; its gain is that of
the log-likelihood of test rows that have the feature. Only non-zero entries travel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.numeric import log_likelihood, logistic
from lumenframe.session import cut, small, store

#: Added to x . w where gains are computed.
INTERCEPT = 1.0


def base_scores(vectors: DataFrame, model: DataFrame) -> DataFrame:
    """(id, z): x . w of each row under the base model."""
    return vectors.join(small(model), "dim", "left").groupBy("id").agg(F.sum(F.col("value") * F.coalesce("weight", F.lit(0.0))).alias("z"))


def records(vectors: DataFrame, model: DataFrame) -> DataFrame:
    """(id, dim, y, x, z) of the non-zero entries of features that the base model lacks."""
    rows = vectors.where("value <> 0").join(base_scores(vectors, model), "id")
    return rows.join(small(model.select("dim")), "dim", "left_anti").select("id", "dim", F.col("label").alias("y"), F.col("value").alias("x"), "z")


def coefficients(train: DataFrame, *, iterations: int = 5, tolerance: float = 1e-6, penalty: float = 0.0, min_records: int = 0) -> DataFrame:
    """(dim, coefficient): Newton's method for all features at once; one that has converged stays."""
    beta = None
    for _ in range(iterations):
        rows = train.withColumn("beta", F.lit(0.0)).withColumn("done", F.lit(False)) if beta is None else train.join(small(beta), "dim")
        p = logistic(F.col("z") + F.col("x") * F.col("beta"))
        sums = rows.groupBy("dim", "beta", "done").agg(
            F.sum((p - F.col("y")) * F.col("x")).alias("g"), F.sum(F.col("x") * F.col("x") * p * (1 - p)).alias("h"), F.count(F.lit(1)).alias("n")
        )
        g, h = F.col("g") + 2 * penalty * F.col("beta"), F.col("h") + 2 * penalty
        step = F.when(F.col("done") | (h == 0), 0.0).otherwise(g / F.nullif(h, F.lit(0.0)))
        beta = cut(sums.where(F.col("n") >= min_records).select("dim", (F.col("beta") - step).alias("beta"), (F.abs(step) < tolerance).alias("done")))
    return beta.select("dim", F.col("beta").alias("coefficient"))


def gains(test: DataFrame, coefs: DataFrame, metric: str = "log_likelihood", n: int | None = None) -> DataFrame:
    """(dim, gain, coefficient) over test records (of ``records``); features with coefficient 0 have none.

    The gain is that of the log-likelihood, or the drop in the mean deviation |y - p| over ``n`` test rows.
    """
    rows = test.join(small(coefs.where("coefficient <> 0")), "dim")
    p_before, p_after = logistic(F.col("z") + INTERCEPT), logistic(F.col("z") + F.col("x") * F.col("coefficient") + INTERCEPT)
    if metric == "mean_deviation":
        if n is None:
            raise ValueError("the mean deviation needs the number of test rows")
        gain = F.sum(F.abs(F.col("y") - p_before) - F.abs(F.col("y") - p_after)) / n
    else:
        gain = F.sum(log_likelihood(F.col("y"), p_after) - log_likelihood(F.col("y"), p_before))
    return rows.groupBy("dim").agg(gain.alias("gain")).join(coefs, "dim").select("dim", "gain", "coefficient")


def best(found: DataFrame, k: int = 1) -> DataFrame:
    return found.orderBy(F.desc("gain"), "dim").limit(k)


def forward_selection(train: DataFrame, test: DataFrame, model: DataFrame, *, steps: int, per_step: int = 1, iterations: int = 5) -> DataFrame:
    """The model (dim, weight, step) after adding the best features ``steps`` times."""
    model = model.withColumn("step", F.lit(0))
    for step in range(1, steps + 1):
        now = model.select("dim", "weight")
        rows = store(records(train, now))
        found = gains(rows if test is train else records(test, now), coefficients(rows, iterations=iterations))
        model = cut(model.unionByName(best(found, per_step).select("dim", F.col("coefficient").alias("weight"), F.lit(step).alias("step"))))
    return model


def retrain(train: DataFrame, model: DataFrame, *, iterations: int = 10, rate: float = 0.1) -> DataFrame:
    """Gradient descent (mean gradient) on the model's features together."""
    kept = store(train.join(small(model.select("dim")), "dim"))
    n = train.select("id").distinct().count()
    for _ in range(iterations):
        z = base_scores(kept, model)
        sums = kept.join(z, "id").groupBy("dim").agg(F.sum((logistic(F.col("z")) - F.col("label")) * F.col("value")).alias("g"))
        model = cut(model.join(small(sums), "dim", "left").withColumn("weight", F.col("weight") - F.coalesce("g", F.lit(0.0)) * rate / n).drop("g"))
    return model


class Selector:
    """Stateful front end: compute gains, add the best features, retrain, look at counters."""

    def __init__(self, train: DataFrame, test: DataFrame, model: DataFrame):
        self.train, self.test, self.start = train, test, model
        self.counters: dict[str, int] = {"computed": 0, "added": 0}
        self.reset_model()

    def reset_model(self) -> None:
        self.model, self.found = self.start, None

    def compute_gains(self, iterations: int = 5) -> DataFrame:
        self.counters["computed"] += 1
        self.found = gains(records(self.test, self.model), coefficients(records(self.train, self.model), iterations=iterations))
        return self.found

    def add_best(self, k: int = 1) -> DataFrame:
        self.counters["added"] += k
        self.model = cut(self.model.unionByName(best(self.found, k).select("dim", F.col("coefficient").alias("weight"))))
        return self.model

    def forward_feature_selection(self, steps: int, per_step: int = 1) -> DataFrame:
        for _ in range(steps):
            self.compute_gains()
            self.add_best(per_step)
        return self.model

    def retrain_base_model(self, **options) -> DataFrame:
        self.model = retrain(self.train, self.model, **options)
        return self.model
