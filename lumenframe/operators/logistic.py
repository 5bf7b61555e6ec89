"""Logistic and linear regression over arrays of features (array<double>, bias first if any).

A step is one aggregation over the data: sums of a fixed number of columns, which need no shuffle
but that of one row per task. Beyond ``WIDE`` features the sums are matrix products of batches, since an
expression per cell would be a plan of thousands. Models are of feature count and stay on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions.numeric import classify, dot, logistic
from lumenframe.session import cut, small

#: Beyond so many features sums are taken by matrix products.
WIDE = 48


def round_class(value: Column) -> Column:
    """The class nearest to a linear prediction, halves upwards."""
    return F.floor(value + 0.5).cast("int")


def linear(features: Column, weights: Sequence[float]) -> Column:
    """x . w; unrolled for a few features, which keeps it in generated code."""
    if len(weights) > 16:
        return dot(features, F.array(*[F.lit(float(w)) for w in weights]))
    out = F.lit(0.0)
    for d, w in enumerate(weights):
        out = out + features[d] * float(w)
    return out


def predict(df: DataFrame, weights: Sequence[float], features: str = "features", intercept: float = 0.0, threshold: float = 0.5) -> DataFrame:
    """Adds ``p`` and ``predicted``."""
    return df.withColumn("p", logistic(linear(F.col(features), weights) + intercept)).withColumn("predicted", classify(F.col("p"), threshold))


def _wide(rows: DataFrame, size: int, second: bool) -> DataFrame:
    """(i, sums, n): each task's sums of v x (i is 0), or of v x_i x for each i, over rows (v, x), and their number.

    Rows whose v or x is null count but add nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((size, size) if second else (1, size)), 0
        for batch in batches:
            n += batch.num_rows
            held = batch.filter(pc.and_(batch.column("v").is_valid(), batch.column("x").is_valid()))
            if not held.num_rows:
                continue
            v = held.column("v").to_numpy(zero_copy_only=False)
            x = held.column("x").flatten().to_numpy(zero_copy_only=False).reshape(held.num_rows, -1)[:, :size]
            total += x.T @ (x * v[:, None]) if second else (v @ x)[None]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(list(total)), pa.array(np.full(len(total), n))], ["i", "sums", "n"])

    return rows.select(F.col("v").cast("double"), F.col("x").cast("array<double>")).mapInArrow(run, "i int, sums array<double>, n long")


def gradient(df: DataFrame, weights: Sequence[float], features: str = "features", label: str = "label") -> DataFrame:
    """(dim, gradient): sum over rows of (p - y) x, with ``n`` rows."""
    error = logistic(linear(F.col(features), weights)) - F.col(label)
    if len(weights) > WIDE:
        sums = _wide(df.select(error.alias("v"), F.col(features).alias("x")), len(weights), False)
        by = sums.select("n", F.posexplode("sums").alias("dim", "part")).groupBy("dim")
        return by.agg(F.sum("part").alias("gradient"), F.sum("n").alias("n"))
    rows = df.select(error.alias("e"), F.col(features).alias("x"))
    sums = rows.agg(F.array(*[F.struct(F.lit(d).alias("dim"), F.sum(F.col("e") * F.col("x")[d]).alias("gradient"), F.count(F.lit(1)).alias("n")) for d in range(len(weights))]).alias("g"))
    return sums.select(F.inline("g"))


def hessian(df: DataFrame, weights: Sequence[float], features: str = "features") -> DataFrame:
    """(i, j, value): sum over rows of x_i x_j p (1 - p), for i <= j."""
    p = logistic(linear(F.col(features), weights))
    rows = df.select((p * (1 - p)).alias("v"), F.col(features).alias("x"))
    if len(weights) > WIDE:
        parts = _wide(rows, len(weights), True).select("i", F.posexplode("sums").alias("j", "part")).where("i <= j")
        return parts.groupBy("i", "j").agg(F.sum("part").alias("value"))
    cells = [(i, j) for i in range(len(weights)) for j in range(i, len(weights))]
    sums = rows.agg(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.sum(F.col("x")[i] * F.col("x")[j] * F.col("v")).alias("value")) for i, j in cells]).alias("h"))
    return sums.select(F.inline("h"))


def gradient_descent(df: DataFrame, size: int, *, iterations: int = 1, rate: float = 1.0, mean: bool = False, initial: Sequence[float] | None = None, features: str = "features", label: str = "label") -> list[float]:
    """Batch gradient descent with a fixed number of steps; ``mean`` divides the gradient by the rows."""
    w = np.zeros(size) if initial is None else np.array(initial, float)
    for _ in range(iterations):
        rows = sorted(gradient(df, w, features, label).collect())
        g = np.array([r["gradient"] for r in rows])
        w = w - rate * (g / rows[0]["n"] if mean else g)
    return w.tolist()


def sparse_scores(rows: DataFrame, model: DataFrame) -> DataFrame:
    """Adds ``z``, x . w of the row's vector, to sparse rows (id, label, dim, value); dims that the model (dim, weight) lacks weigh 0."""
    weighed = rows.join(small(model.select("dim", "weight")), "dim", "left")
    return weighed.withColumn("z", F.sum(F.col("value") * F.coalesce("weight", F.lit(0.0))).over(Window.partitionBy("id"))).drop("weight")


def sparse_predict(rows: DataFrame, model: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(id, label, p, predicted) of vectors that have an entry."""
    by = sparse_scores(rows, model).groupBy("id").agg(F.first("label").alias("label"), logistic(F.first("z")).alias("p"))
    return by.withColumn("predicted", classify(F.col("p"), threshold))


def sparse_gradient(rows: DataFrame, model: DataFrame) -> DataFrame:
    """(dim, gradient): sums over sparse rows of (p - y) x. One shuffle by id, and one of a row per dim and task."""
    error = logistic(F.col("z")) - F.col("label")
    return sparse_scores(rows, model).groupBy("dim").agg(F.sum(error * F.col("value")).alias("gradient"))


def sparse_descent(rows: DataFrame, *, iterations: int = 1, rate: float = 1.0, mean: bool = False, n: int | None = None, initial: DataFrame | None = None) -> DataFrame:
    """The model (dim, weight) after batch gradient descent over sparse rows, whatever the number of dims.

    ``mean`` divides by ``n``, the number of vectors, those without entries among them (by default those that have some).
    """
    rows = cut(rows.select("id", "label", "dim", "value"))
    model = rows.select("dim").distinct().withColumn("weight", F.lit(0.0)) if initial is None else initial
    if mean and n is None:
        n = rows.select("id").distinct().count()
    for _ in range(iterations):
        step = sparse_gradient(rows, model).select("dim", (F.col("gradient") * (-rate / n if mean else -rate)).alias("weight"))
        model = cut(model.select("dim", "weight").unionByName(step).groupBy("dim").agg(F.sum("weight").alias("weight")))
    return model


def newton(df: DataFrame, size: int, *, iterations: int = 5, penalty: float = 0.0, features: str = "features", label: str = "label") -> list[float]:
    """Newton-Raphson; the penalty, over the rows, is on all but the first weight."""
    w = np.zeros(size)
    for _ in range(iterations):
        rows = sorted(gradient(df, w, features, label).collect())
        n = rows[0]["n"]
        h = np.zeros((size, size))
        for r in hessian(df, w, features).collect():
            h[r["i"], r["j"]] = h[r["j"], r["i"]] = r["value"] / n
        free = np.r_[0.0, np.ones(size - 1)] * penalty / n
        w = w - np.linalg.solve(h + np.diag(free), np.array([r["gradient"] for r in rows]) / n + free * w)
    return w.tolist()


def lbfgs(df: DataFrame, features: str = "features", label: str = "label", iterations: int = 100, penalty: float = 0.0) -> list[float]:
    """Quasi-Newton fit by Spark's own solver; the first feature is the bias."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rest = F.slice(F.col(features), F.lit(2), F.size(features) - 1)
    rows = df.select(array_to_vector(rest).alias("features"), F.col(label).cast("double").alias("label"))
    fit = LogisticRegression(standardization=False, maxIter=iterations, regParam=penalty, tol=1e-10).fit(rows)
    return [fit.intercept, *fit.coefficients.toArray().tolist()]


def gram(df: DataFrame, predictors: Sequence[str], target: str, bias: bool = True) -> DataFrame:
    """(i, j, value): sums of products of predictors (0 is the bias), the target being the last."""
    x = [*([F.lit(1.0)] if bias else []), *[F.col(c).cast("double") for c in predictors], F.col(target).cast("double")]
    cells = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    sums = df.agg(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.sum(x[i] * x[j]).alias("value")) for i, j in cells]).alias("g"))
    return sums.select(F.inline("g"))


def linear_regression(df: DataFrame, predictors: Sequence[str], target: str, bias: bool = True) -> list[float]:
    """Least squares by the pseudo-inverse of the normal equations."""
    size = len(predictors) + bias
    full = np.zeros((size + 1, size + 1))
    for r in gram(df, predictors, target, bias).collect():
        full[r["i"], r["j"]] = full[r["j"], r["i"]] = r["value"]
    return (np.linalg.pinv(full[:size, :size]) @ full[:size, size]).tolist()


def pseudo_inverse(matrix: np.ndarray) -> np.ndarray:
    return np.linalg.pinv(np.asarray(matrix, float))


def random_partition(df: DataFrame, parts: int, id_col: str = "id", seed: int = 0, how: str = "hash") -> DataFrame:
    """Adds ``part`` in [0, parts), a function of the id: uniform (``hash``), or the remainder of an integer id (``modulo``)."""
    value = F.xxhash64(F.col(id_col), F.lit(seed)) if how == "hash" else F.col(id_col)
    return df.withColumn("part", F.pmod(value, F.lit(parts)).cast("int"))


# The online learner's defaults.
SGD = {"alpha": 1.0, "step_offset": 1000, "decay": 0.1, "penalty": 3e-6, "rate": 15.0}


def _sgd(x: np.ndarray, y: np.ndarray, alpha: float, step_offset: int, decay: float, penalty: float, rate: float) -> tuple[np.ndarray, float]:
    """Online gradient descent with an L1 penalty and an annealed rate; also the share that was right before being learned."""
    w, right = np.zeros(x.shape[1]), 0
    for t in range(len(x)):
        p = 1.0 / (1.0 + np.exp(-np.clip(x[t] @ w, -500, 500)))
        right += (p >= 0.5) == (y[t] == 1)
        step = rate * alpha**t * (t + 1 + step_offset) ** -(1.0 - decay)
        w += step * (y[t] - p) * x[t]
        w = np.sign(w) * np.maximum(np.abs(w) - step * penalty, 0.0)
    return w, right / max(1, len(x))


def train_ensemble(df: DataFrame, *, part_col: str = "part", id_col: str = "id", features: str = "features", label: str = "label", **options) -> DataFrame:
    """(model, dim, weight, online_accuracy): a learner per partition, in order of the id."""
    chosen = SGD | options

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        w, right = _sgd(np.array(rows["x"].tolist(), float), rows["y"].to_numpy(), **chosen)
        return pd.DataFrame({"model": rows["part"].iloc[0], "dim": np.arange(len(w), dtype=np.int32), "weight": w, "online_accuracy": right})

    chosen_rows = df.select(F.col(part_col).cast("int").alias("part"), F.col(id_col).alias("id"), F.col(features).alias("x"), F.col(label).alias("y"))
    return chosen_rows.groupBy("part").applyInPandas(learn, "model int, dim int, weight double, online_accuracy double")


def ensemble_predict(df: DataFrame, models: dict[int, Sequence[float]], features: str = "features") -> DataFrame:
    """Adds ``ps``, the models' probabilities."""
    return df.withColumn("ps", F.array(*[logistic(linear(F.col(features), models[m])) for m in sorted(models)]))


def vote(ps: Column, how: str = "weighted_as_coded") -> Column:
    """Class by the models' votes; weighted votes count by the probability of class 1, for either class."""
    one = lambda p: p if how == "weighted_as_coded" else F.lit(1.0)
    votes = F.aggregate(
        ps,
        F.struct(F.lit(0.0).alias("no"), F.lit(0.0).alias("yes")),
        lambda acc, p: F.struct((acc["no"] + F.when(p < 0.5, one(p)).otherwise(0.0)).alias("no"), (acc["yes"] + F.when(p >= 0.5, one(p)).otherwise(0.0)).alias("yes")),
    )
    return (votes["yes"] > votes["no"]).cast("int")


def evaluate(df: DataFrame, ps: str = "ps", label: str = "label") -> DataFrame:
    """(model, total, correct) of each of the models of ``ensemble_predict``."""
    rows = df.select(F.col(label).alias("label"), F.posexplode(ps).alias("model", "p"))
    return rows.groupBy("model").agg(F.count(F.lit(1)).alias("total"), F.sum(((F.col("p") >= 0.5) == (F.col("label") == 1)).cast("long")).alias("correct"))


def merged(models: dict[int, Sequence[float]]) -> list[float]:
    """The mean of the models' weights."""
    return np.mean([models[m] for m in sorted(models)], axis=0).tolist()
