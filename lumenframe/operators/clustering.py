"""k-means: Lloyd and ball steps as expressions, a one-pass sketch per partition.

Centres are of the size of a model: they are collected and become literals, so assigning points is
a projection, and an update one aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.functions.numeric import distance, dot

Centres = list[tuple[int, list[float]]]

# The codes by which searchers of nearest centres are chosen.
SEARCHERS = ("brute", "projection", "fast_projection", "lsh")
#: Beyond so many centres, batches are multiplied with them.
MANY = 32


def collect_centres(centres: DataFrame, id_col: str = "cid", vector: str = "point") -> Centres:
    return sorted((r[0], list(r[1])) for r in centres.select(F.col(id_col).cast("int"), F.col(vector).cast("array<double>")).collect())


def _literal(v: list[float]) -> Column:
    return F.array(*map(F.lit, map(float, v)))


def assign(points: DataFrame, centres: Centres, metric: str = "squared_euclidean", point: str = "point", searcher: str | int = "brute", **options) -> DataFrame:
    """Adds ``cid`` and ``dist`` of the nearest centre, ties to the smaller id.

    A few centres are an expression each, many are searched by a matrix product a batch. All ``SEARCHERS``
    (by name or place) give the exact answer, which the approximate ones of that name only come near.
    """
    if searcher not in SEARCHERS and searcher not in range(len(SEARCHERS)):
        raise ValueError(f"unknown searcher: {searcher}")
    if len(centres) > MANY and metric in ("squared_euclidean", "euclidean"):
        return _assign_batches(points, centres, metric, point)
    # |x - c|^2 = |x|^2 - 2 x.c + |c|^2 would lose digits; the difference is taken as it stands
    each = [F.struct(distance(metric, F.col(point), _literal(c), **options).alias("dist"), F.lit(cid).alias("cid")) for cid, c in centres]
    best = F.array_min(F.array(*each))
    return points.withColumn("__best", best).withColumn("cid", F.col("__best.cid")).withColumn("dist", F.col("__best.dist")).drop("__best")


def _assign_batches(points: DataFrame, centres: Centres, metric: str, point: str) -> DataFrame:
    """``assign`` for many centres: products name the centres that may be nearest, and differences decide among them."""
    held = points.sparkSession.sparkContext.broadcast((np.array([cid for cid, _ in centres], np.int32), np.array([c for _, c in centres], float)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, c = held.value
        squares = (c * c).sum(1)
        for batch in batches:
            cid, dist = np.zeros(batch.num_rows, np.int32), np.full(batch.num_rows, np.nan)
            values = batch.column("__x")
            ok = np.flatnonzero(values.is_valid().to_numpy(zero_copy_only=False))
            x = values.flatten().to_numpy(zero_copy_only=False).reshape(len(ok), -1) if len(ok) else np.zeros((0, c.shape[1]))
            for lo in range(0, len(ok), 512):
                rows = x[lo : lo + 512]
                size = (rows * rows).sum(1)
                rough = size[:, None] - 2 * rows @ c.T + squares
                # far more than the products' rounding
                slack = 1e-9 * (size + squares.max())
                at, which = np.nonzero(rough <= (rough.min(1) + slack)[:, None])
                if not len(at):
                    continue
                exact = ((rows[at] - c[which]) ** 2).sum(1)
                order = np.lexsort((ids[which], exact, at))
                first = order[np.r_[True, at[order][1:] != at[order][:-1]]]
                cid[ok[lo + at[first]]], dist[ok[lo + at[first]]] = ids[which[first]], exact[first]
            if metric == "euclidean":
                dist = np.sqrt(dist)
            none = np.isnan(dist)
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(cid, mask=none), pa.array(dist, mask=none)], [*names, "cid", "dist"])

    kept = points.drop("cid", "dist")
    names = kept.columns
    schema = T.StructType([*kept.schema.fields, T.StructField("cid", T.IntegerType()), T.StructField("dist", T.DoubleType())])
    return kept.withColumn("__x", F.col(point).cast("array<double>")).mapInArrow(run, schema)


def update(assigned: DataFrame, dims: int, point: str = "point", weight: Column | None = None) -> DataFrame:
    """(cid, weight, point): weighted means of the points of each centre."""
    w = F.lit(1.0) if weight is None else weight
    sums = [(F.sum(F.col(point)[d] * w) / F.sum(w)) for d in range(dims)]
    return assigned.groupBy("cid").agg(F.sum(w).alias("weight"), F.array(*sums).alias("point"))


def _moved(now: Centres, new: DataFrame) -> Centres:
    """New centres; one without points stays where it was."""
    return sorted((dict(now) | dict(collect_centres(new))).items())


def lloyd(points: DataFrame, centres: Centres, iterations: int, metric: str = "squared_euclidean") -> Centres:
    for _ in range(iterations):
        centres = _moved(centres, update(assign(points, centres, metric), len(centres[0][1])))
    return centres


def trimmed(assigned: DataFrame, centres: Centres, trim: float, metric: str = "euclidean") -> DataFrame:
    """Points nearer to their centre than ``trim`` times the distance of its nearest other centre."""
    c = {cid: np.array(v) for cid, v in centres}
    near = {a: min((float(np.linalg.norm(c[a] - c[b])) for b in c if b != a), default=float("inf")) for a in c}
    if metric == "squared_euclidean":
        near = {a: d * d for a, d in near.items()}
    limit = F.element_at(F.create_map(*[F.lit(x) for a, d in near.items() for x in (a, d)]), F.col("cid"))
    return assigned.where(F.col("dist") < trim * limit)


def ball_step(points: DataFrame, centres: Centres, trim: float = 0.9, metric: str = "euclidean") -> DataFrame:
    """(cid, weight, point) of a trimmed Lloyd step."""
    return update(trimmed(assign(points, centres, metric), centres, trim, metric), len(centres[0][1]))


def cluster_weights(points: DataFrame, centres: Centres, metric: str = "squared_euclidean", weight: str | None = None) -> DataFrame:
    w = F.lit(1.0) if weight is None else F.col(weight)
    return assign(points, centres, metric).groupBy("cid").agg(F.sum(w).alias("weight"))


def total_cost(points: DataFrame, centres: Centres, metric: str = "euclidean") -> DataFrame:
    return assign(points, centres, metric).agg(F.sum("dist").alias("cost"))


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((x[:, None, :] - c[None]) ** 2).sum(-1), 0))


def _sketch(x: np.ndarray, w: np.ndarray, kappa: int, limit: float, increment: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, float]:
    """Facility location in one pass: a point opens a centre with probability w d / limit, else joins the nearest; too many centres raise the limit and are sketched again."""
    centres, weights = [], []
    for point, weight in zip(x, w, strict=True):
        if not centres:
            centres.append(point.copy())
            weights.append(weight)
            continue
        d = _distances(point[None], np.array(centres))[0]
        near = int(d.argmin())
        if rng.random() < min(1.0, weight * d[near] / limit):
            centres.append(point.copy())
            weights.append(weight)
        else:
            total = weights[near] + weight
            centres[near] += (point - centres[near]) * (weight / total)
            weights[near] = total
        while len(centres) > kappa:
            limit += increment
            c, v, _ = _sketch(np.array(centres), np.array(weights), len(centres), limit, increment, rng)
            centres, weights = list(c), list(v)
    return np.array(centres), np.array(weights), limit


def one_pass(points: DataFrame, *, kappa: int = 7, limit: float = 1.3, increment: float = 0.1, seed: int = 0, id_col: str = "id", point: str = "point") -> DataFrame:
    """(part, weight, point): at most ``kappa`` weighted centres of each partition, read in its order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        rng, state, now = np.random.default_rng([seed, part]), None, limit
        for batch in batches:
            if not len(batch):
                continue
            x, w = np.array(batch["x"].tolist(), float), batch["w"].to_numpy(float)
            if state is not None:
                x, w = np.r_[state[0], x], np.r_[state[1], w]
            c, v, now = _sketch(x, w, kappa, now, increment, rng)
            state = (c, v)
        if state is not None:
            yield pd.DataFrame({"part": part, "weight": state[1], "point": list(state[0])})

    weight = F.col("weight") if "weight" in points.columns else F.lit(1.0)
    rows = points.select(F.col(id_col).alias("id"), F.col(point).cast("array<double>").alias("x"), weight.cast("double").alias("w")).sortWithinPartitions("id")
    return rows.mapInPandas(run, "part int, weight double, point array<double>")


def _ball(x: np.ndarray, w: np.ndarray, k: int, iterations: int, trim: float, plus_plus: bool, rng: np.random.Generator) -> np.ndarray:
    chosen = [int(rng.choice(len(x), p=w / w.sum()))]
    while len(chosen) < min(k, len(x)):
        odds = w * (_distances(x, x[chosen]).min(1) ** 2 if plus_plus else np.ones(len(x)))
        odds[chosen] = 0
        if odds.sum() <= 0:
            break
        chosen.append(int(rng.choice(len(x), p=odds / odds.sum())))
    c = x[chosen].copy()
    for _ in range(iterations):
        d = _distances(x, c)
        near = d.argmin(1)
        apart = _distances(c, c) + np.diag(np.full(len(c), np.inf))
        use = d[np.arange(len(x)), near] < trim * apart.min(1)[near]
        new = c.copy()
        for j in range(len(c)):
            mine = use & (near == j)
            if mine.any():
                new[j] = np.average(x[mine], axis=0, weights=w[mine])
        if np.allclose(new, c):
            break
        c = new
    return c


def ball_kmeans(sketch: DataFrame, k: int = 5, *, iterations: int = 10, trim: float = 0.9, runs: int = 10, plus_plus: bool = False, seed: int = 0, test_share: float = 0.0, correct_weights: bool = True) -> DataFrame:
    """(cid, weight, point): the best of ``runs`` restarts on a sketch (weight, point), by weighted cost.

    With a ``test_share`` the centres are those of the other sketch points and the cost is that of the held-out
    ones, whose weights are added to their nearest centres' if ``correct_weights``. A sketch has a few centres
    per partition; sketch a large one again first.
    """
    if not 0 <= test_share < 1:
        raise ValueError("test_share is a share of the points, less than all")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["part", "weight"])
        x, w = np.array(rows["point"].tolist(), float), rows["weight"].to_numpy(float)
        rng = np.random.default_rng(seed)
        held = np.zeros(len(x), bool)
        if test_share:
            n = int(test_share * len(x))
            if not 0 < n < len(x):
                raise ValueError(f"{test_share} of {len(x)} points leaves none to learn from or to test on")
            held[rng.permutation(len(x))[:n]] = True
        tried = [_ball(x[~held], w[~held], k, iterations, trim, plus_plus, rng) for _ in range(runs)]
        judge = held if test_share else ~held
        c = min(tried, key=lambda c: float((w[judge] * _distances(x[judge], c).min(1)).sum()))
        counted = np.ones(len(x), bool) if correct_weights else ~held
        near = _distances(x[counted], c).argmin(1)
        return pd.DataFrame({"cid": np.arange(len(c), dtype=np.int32), "weight": np.bincount(near, w[counted], len(c)), "point": list(c)})

    rows = sketch.select("part", "weight", "point").withColumn("one", F.lit(1))
    return rows.groupBy("one").applyInPandas(run, "cid int, weight double, point array<double>")


def split_test(points: DataFrame, share: float, id_col: str = "id", seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Training and test points, by a hash of the id."""
    test = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(10_000)) < int(share * 10_000)
    return points.where(~test), points.where(test)


def cosine_to(point: Column, centre: list[float]) -> Column:
    return dot(point, _literal(centre))
