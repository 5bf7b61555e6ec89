"""Sinks, and readers of what they wrote."""

from __future__ import annotations

import base64
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, sep: str = ",", mode: str = "error") -> None:
    df.write.mode(mode).csv(path, sep=sep)


def write_many(frames: dict[str, DataFrame], folder: str, mode: str = "error") -> None:
    """Several results of one plan; what they share should be persisted by the caller."""
    for name, df in frames.items():
        df.write.mode(mode).parquet(f"{folder}/{name}")


def similarity_text(similar: DataFrame) -> DataFrame:
    """A line of the item and a line ``j:similarity`` (6 decimals) for each similar one, as one value per item."""
    entry = F.struct("j", F.format_string("%d:%f", "j", "similarity").alias("t"))
    lines = F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["t"])
    return similar.groupBy("i").agg(lines.alias("l")).select(F.concat_ws("\n", F.col("i").cast("string"), F.array_join("l", "\n")).alias("value"))


def gains_text(gains: DataFrame) -> DataFrame:
    return gains.select(F.concat_ws(" ", "dim", "gain", "coefficient").alias("value"))


def read_gains(spark: SparkSession, path: str) -> DataFrame:
    """``dim gain coefficient`` lines of a file or directory, best first."""
    part = F.split("value", " ")
    rows = spark.read.text(path).select(part[0].cast("int").alias("dim"), part[1].cast("double").alias("gain"), part[2].cast("double").alias("coefficient"))
    return rows.orderBy(F.desc("gain"), "dim")


def forest_text(forest: DataFrame) -> DataFrame:
    """``tree node feature split label`` lines; what a node lacks is ``-``."""
    field = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    return forest.select(F.concat_ws(" ", *map(field, ("tree", "node", "feature", "split", "label"))).alias("value"))


def read_forest(spark: SparkSession, path: str) -> DataFrame:
    """The forest of ``forest_text`` lines of a file or directory."""
    part = F.split("value", " ")
    kinds = {"tree": "int", "node": "long", "feature": "int", "split": "double", "label": "int"}
    return spark.read.text(path).select(*[F.nullif(part[i], F.lit("-")).cast(kind).alias(name) for i, (name, kind) in enumerate(kinds.items())])


def model_text(model: DataFrame) -> DataFrame:
    """``dim weight`` lines of a model."""
    return model.select(F.concat_ws(" ", F.col("dim").cast("string"), F.col("weight").cast("string")).alias("value"))


def read_model(spark: SparkSession, path: str) -> DataFrame:
    part = F.split("value", " ")
    return spark.read.text(path).select(part[0].cast("int").alias("dim"), part[1].cast("double").alias("weight"))


def encode_model(model: DataFrame) -> str:
    """A model-sized table as text that fits a command line."""
    return base64.b64encode(json.dumps([model.dtypes, [list(r) for r in model.collect()]]).encode()).decode()


def decode_model(spark: SparkSession, text: str) -> DataFrame:
    types, rows = json.loads(base64.b64decode(text))
    return spark.createDataFrame([tuple(r) for r in rows], ", ".join(f"`{n}` {t}" for n, t in types))
