"""Inputs of the queries, derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.session import store, table

#: Weights of a fixed model over the tabular features (bias first).
WEIGHTS = [-0.5, 0.8, -0.3, 0.4, 0.1]


def rating_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user, item, rating, line) of every line item."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_linenumber")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(F.col("o_custkey").alias("user"), F.col("l_partkey").alias("item"), F.col("l_quantity").alias("rating"), F.col("l_linenumber").alias("line"))


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenframe.operators.similarity import dedupe

    return dedupe(rating_rows(spark, sf_dir))


def tabular(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as (l_orderkey, l_linenumber, label, features) with a bias."""
    rows = table(spark, sf_dir, "lineitem")
    features = F.array(F.lit(1.0), F.col("l_quantity") / 50, F.col("l_extendedprice") / 1e5, F.col("l_discount") * 10, F.col("l_tax") * 10)
    return rows.select("l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").cast("int").alias("label"), features.alias("features"))


def vectors(spark: SparkSession, sf_dir: str, positive: int = 1) -> DataFrame:
    """Embeddings as (id, label, cls, point); label is one against the rest."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("id"), (F.col("label") == positive).cast("int").alias("label"), F.col("label").alias("cls"), F.col("embedding").cast("array<double>").alias("point"))


def first_centres(points: DataFrame) -> DataFrame:
    """The point of the least id of each class, as its centre."""
    return points.groupBy(F.col("cls").alias("cid")).agg(F.min_by("point", "id").alias("point"))


def token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, dim, value): all words of labelled documents, their whole counts scaled by 5; dims in order of the words.

    A vertical tab is part of a word, as in the SQL, whose ``\\s`` does not match it.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").join(table(spark, sf_dir, "labels").where("quality is not null").select("doc_id", "quality"), "doc_id")
    words = docs.select(F.col("doc_id").alias("id"), F.col("quality").alias("label"), F.explode(F.split("text", r"[ \t\n\f\r]+")).alias("token")).where("token <> ''")
    counts = store(words.groupBy("id", "label", "token").agg(F.count(F.lit(1)).alias("n")))
    # numbered within ranges, then over the ranges' sizes: no task holds the whole vocabulary
    ranged = store(counts.select("token").distinct().repartitionByRange("token").withColumn("range", F.spark_partition_id()))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("size")).withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0))).drop("size")
    place = F.row_number().over(Window.partitionBy("range").orderBy("token")) - 1
    dims = ranged.withColumn("place", place).join(F.broadcast(sizes), "range").select("token", (F.col("before") + F.col("place")).cast("int").alias("dim"))
    return counts.join(dims, "token").select("id", "label", "dim", (F.col("n") / 5).alias("value"))


def base_model(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(3, 0.5), (7, -0.25)], "dim int, weight double")


def order_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as (id, label, features): number of lines, quantity, least discount, largest tax; label: any line returned."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id"))
    out = rows.agg(
        F.max((F.col("l_returnflag") == "R").cast("int")).alias("label"), F.count(F.lit(1)).cast("double").alias("f0"), F.sum("l_quantity").alias("f1"), F.min("l_discount").alias("f2"), F.max("l_tax").alias("f3")
    )
    return out.select("id", "label", F.array("f0", "f1", "f2", "f3").alias("features"))


def models(dims: int = 64, count: int = 3) -> dict[int, list[float]]:
    """Fixed weights of an ensemble."""
    return {m: [((d * 7 + m * 13) % 11 - 5) / 10 for d in range(dims)] for m in range(count)}
