"""Text sources: typed rows from lines, without schema inference.

Every parser takes a DataFrame with a column of lines and returns named, typed columns; the
``read_*`` functions put ``spark.read.text`` before it. Sparse features are long rows
(id, label, dim, value) with zeros dropped; indices are taken verbatim.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row (value) per line of a file or directory."""
    return spark.read.text(path)


def parse_ratings(lines: DataFrame, line: str = "value") -> DataFrame:
    """``user,item[,rating]`` lines; the rating is 1.0 where missing."""
    part = F.split(F.col(line), ",")
    return lines.select(
        F.trim(part[0]).cast("long").alias("user"),
        F.trim(F.get(part, F.lit(1))).cast("long").alias("item"),
        F.coalesce(F.trim(F.get(part, F.lit(2))).cast("double"), F.lit(1.0)).alias("rating"),
    )


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    return parse_ratings(read_lines(spark, path))


def _sparse(entries: Column) -> Column:
    """Array of (dim, value) from ``dim:value`` strings."""
    return F.transform(entries, lambda e: F.struct(F.substring_index(e, ":", 1).cast("int").alias("dim"), F.substring_index(e, ":", -1).cast("double").alias("value")))


def parse_libsvm(lines: DataFrame, *, id_col: str, line: str = "value", multi_label: bool = True, positive_class: int | None = None, num_features: int | None = None) -> DataFrame:
    """``label[,label] dim:value ...`` lines as (id, label, dim, value).

    Single labels are 1 if the label is 1; with ``multi_label`` 1 if any equals ``positive_class``.
    A dim at or beyond ``num_features``, if given, is an error.
    """
    if multi_label and positive_class is None:
        raise ValueError("positive_class is needed for lines of several labels")
    tokens = F.filter(F.split(F.col(line), r"\s+"), lambda t: t != "")
    names = F.transform(F.split(tokens[0], ","), lambda t: F.regexp_replace(t, r"^\+", "").cast("int"))
    label = F.array_contains(names, positive_class) if multi_label else names[0] == 1
    rows = lines.select(F.col(id_col).alias("id"), label.cast("int").alias("label"), F.explode(_sparse(F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))))).alias("e"))
    rows = rows.select("id", "label", "e.dim", "e.value").where("value <> 0")
    if num_features is not None:
        rows = rows.withColumn("dim", F.when(F.col("dim") < num_features, F.col("dim")).otherwise(F.raise_error(F.lit("dim beyond num_features")).cast("int")))
    return rows


def parse_rcv1_vectors(lines: DataFrame, line: str = "value") -> DataFrame:
    """``docid dim:value ...`` lines as (id, dim, value)."""
    tokens = F.filter(F.split(F.col(line), r"\s+"), lambda t: t != "")
    rows = lines.select(tokens[0].cast("long").alias("id"), F.explode(_sparse(F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))))).alias("e"))
    return rows.select("id", "e.dim", "e.value").where("value <> 0")


def parse_rcv1_labels(lines: DataFrame, category: str, line: str = "value") -> DataFrame:
    """Ids of documents of a category from ``CATEGORY docid 1`` lines (any case)."""
    part = F.split(F.col(line), r"\s+")
    return lines.where(F.upper(part[0]) == category.upper()).select(part[1].cast("long").alias("id")).distinct()


def label_by_id(vectors: DataFrame, positive: DataFrame) -> DataFrame:
    """Adds label: 1 for ids among ``positive``, else 0."""
    return vectors.join(positive.select("id", F.lit(1).alias("label")), "id", "left").withColumn("label", F.coalesce("label", F.lit(0)))


def flatten(rows: DataFrame, num_features: int, by: str = "id") -> DataFrame:
    """(``by``, vector): the dense vector of the (dim, value) rows of each key; absent dims are 0."""
    if num_features is None or num_features < 1:
        raise ValueError("num_features must be given")
    held = rows.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("dim", F.col("value").cast("double")))).alias("m"))
    return held.select(by, F.transform(F.sequence(F.lit(0), F.lit(num_features - 1)), lambda d: F.coalesce(F.try_element_at("m", d), F.lit(0.0))).alias("vector"))


def select_matrix(table: DataFrame, predictors: list[str], target: str | None = None, bias: bool = False) -> DataFrame:
    """Numeric columns in the requested order, a bias column of ones first, the target last; unknown names are an error."""
    missing = [c for c in [*predictors, *([target] if target else [])] if c not in table.columns]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    chosen = [F.col(c).cast("double").alias(c) for c in predictors]
    return table.select(*([F.lit(1.0).alias("bias")] if bias else []), *chosen, *([F.col(target).cast("double").alias("target")] if target else []))


def read_csv_matrix(spark: SparkSession, path: str, predictors: list[str], target: str | None = None, bias: bool = False) -> DataFrame:
    """``select_matrix`` of a CSV file with a header; names may be quoted, values padded."""
    table = spark.read.csv(path, header=True, quote='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return select_matrix(table, predictors, target, bias)


def parse_samples(lines: DataFrame, line: str = "value") -> DataFrame:
    """``index label f1 f2 ...`` lines as (id, label, features)."""
    part = F.filter(F.split(F.col(line), r"\s+"), lambda t: t != "")
    return lines.select(part[0].cast("long").alias("id"), part[1].cast("int").alias("label"), F.slice(part, 3, F.greatest(F.size(part) - 2, F.lit(0))).cast("array<double>").alias("features"))


def parse_points(lines: DataFrame, line: str = "value", sep: str = ",") -> DataFrame:
    """``x1,x2,...`` lines as arrays; with ``sep='|'`` the first field is an id and the last is empty."""
    part = F.filter(F.split(F.col(line), r"\Q" + sep + r"\E"), lambda t: F.trim(t) != "")
    if sep == "|":
        return lines.select(part[0].cast("long").alias("id"), F.slice(part, 2, F.size(part) - 1).cast("array<double>").alias("point"))
    return lines.select(part.cast("array<double>").alias("point"))


def scale_labelled(samples: DataFrame, divisor: float, keep_labels: list[int] | None = None) -> DataFrame:
    """Image samples with values over ``divisor`` (255 or 256), optionally of some labels only."""
    kept = samples if keep_labels is None else samples.where(F.col("label").isin(keep_labels))
    return kept.withColumn("features", F.transform("features", lambda x: x / divisor))


def read_idx_images(spark: SparkSession, images: str, labels: str, divisor: float = 256.0) -> DataFrame:
    """Samples (id, label, features) from a pair of idx files (up to 2 GB each) of images and labels.

    A file is read by one task, which cuts it into records batch by batch; no row carries more than its own.
    """

    def cut(head: int, record: Callable[[bytes], int], divide: float | None) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for content in batch.column(0):
                    raw = np.frombuffer(content.as_buffer(), np.uint8)
                    n, size = int.from_bytes(raw[4:8].tobytes(), "big"), record(raw[:head].tobytes())
                    rows = raw[head : head + n * size].reshape(n, size)
                    for lo in range(0, n, 1024):
                        some = rows[lo : lo + 1024]
                        ids = pa.array(np.arange(lo, lo + len(some)))
                        if divide is None:
                            yield pa.RecordBatch.from_arrays([ids, pa.array(some[:, 0].astype(np.int32))], ["id", "label"])
                        else:
                            flat = pa.array(some.reshape(-1) / divide)
                            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(np.arange(0, len(some) * size + 1, size, dtype=np.int32)), flat)], ["id", "features"])

        return run

    pixels = lambda head: int.from_bytes(head[8:12], "big") * int.from_bytes(head[12:16], "big")
    content = lambda path: spark.read.format("binaryFile").load(path).select("content")
    points = content(images).mapInArrow(cut(16, pixels, divisor), "id long, features array<double>")
    names = content(labels).mapInArrow(cut(8, lambda _: 1, None), "id long, label int")
    return points.join(names, "id").select("id", "label", "features")


def weight_vector(spark: SparkSession, num_features: int, initial: float = 0.0) -> DataFrame:
    """A model (dim, weight) of a constant weight."""
    if num_features < 1:
        raise ValueError("num_features must be positive")
    return spark.range(num_features).select(F.col("id").cast("int").alias("dim"), F.lit(float(initial)).alias("weight"))


def empty_model(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "dim int, weight double")


def single_value(spark: SparkSession, schema: str, *values) -> DataFrame:
    """A table of one row, to be joined by broadcast."""
    return F.broadcast(spark.createDataFrame([values], schema))


def generated(spark: SparkSession, n: int, **columns: Column) -> DataFrame:
    """``n`` rows of columns computed from ``id`` (0 to n-1)."""
    return spark.range(n).select(*[c.alias(name) for name, c in columns.items()])
