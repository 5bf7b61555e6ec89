"""Column statistics, normalisation and validation metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.session import cut


def column_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, mean, low, high, span) of numeric columns, in one pass."""
    one = lambda c: F.struct(F.lit(c).alias("name"), F.avg(c).alias("mean"), F.min(c).alias("low"), F.max(c).alias("high"), (F.max(c) - F.min(c)).alias("span"))
    return df.agg(F.array(*map(one, columns)).alias("s")).select(F.inline("s"))


def range_normalise(df: DataFrame, columns: list[str], stats: DataFrame | None = None) -> DataFrame:
    """(x - mean) / (max - min) by the frame's own or given statistics; a range of 0 gives 0."""
    rows = (column_stats(df, columns) if stats is None else stats).collect()
    by = {r["name"]: r for r in rows}
    scaled = {c: (F.col(c) - by[c]["mean"]) / by[c]["span"] if by[c]["span"] else F.lit(0.0) for c in columns}
    return df.withColumns(scaled)


def map_label(y: Column, positive) -> Column:
    return F.when(y == positive, 1).otherwise(0)


def confusion(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """One row: tp, tn, fp, fn of classes 0 and 1, class 1 being positive."""
    count = lambda y, p: F.sum(((F.col(label) == y) & (F.col(predicted) == p)).cast("long"))
    return df.agg(count(1, 1).alias("tp"), count(0, 0).alias("tn"), count(0, 1).alias("fp"), count(1, 0).alias("fn"))


def accuracy(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"), F.sum((F.col(label) == F.col(predicted)).cast("long")).alias("correct"), F.avg((F.col(label) == F.col(predicted)).cast("double")).alias("accuracy"))


def mean_deviation(df: DataFrame, label: str = "label", p: str = "p") -> DataFrame:
    return df.agg(F.avg(F.abs(F.col(label) - F.col(p))).alias("mean_deviation"))


def auc(df: DataFrame, label: str = "label", score: str = "p") -> DataFrame:
    """Area under the ROC curve. Rows are counted per score first; scores are ranked in sampled ranges, so that no task sorts them all, however they lie."""
    by = df.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))
    by = by.withColumn("neg", F.col("n") - F.col("pos"))
    by = cut(by.repartitionByRange("s").withColumn("range", F.spark_partition_id()))
    sums = by.groupBy("range").agg(F.sum("neg").alias("range_neg"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("below_range", F.coalesce(F.sum("range_neg").over(before), F.lit(0)))
    within = Window.partitionBy("range").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    ranked = by.join(F.broadcast(sums), "range").withColumn("below", F.col("below_range") + F.coalesce(F.sum("neg").over(within), F.lit(0)))
    total = F.sum("pos").cast("double") * F.sum("neg")
    return ranked.agg((F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)) / F.nullif(total, F.lit(0.0))).alias("auc"))
