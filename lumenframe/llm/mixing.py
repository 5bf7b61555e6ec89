"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame expressions only.

Each document draws u in (0, 1) from a hash of its id and gets the key -ln(u) / quality weight.
Within a source, documents stand in order of their keys; a source whose budget is e times its size
and a rest takes every document e times, then documents in order until the rest is filled; the
document at its edge is taken in part.

The order within a source is summed in two levels: keys fall into ranges of some thousand
documents, the ranges' sums are accumulated, then each range on its own, so that no task holds a
whole source.

Defined results: null texts have size 0; a null source is a source, after all others; documents of
size 0 take nothing; a null id draws as the text 'null'; repeated rows are taken one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.llm._store import stash

WORD = r"[^\x20\x09-\x0D]+"
#: Documents in a range of keys, about.
_RANGE = 4096
#: Tables of sources of more rows than this are joined by a shuffle, not broadcast.
_BROADCAST_ROWS = 10_000


def text_quality(text: Column) -> Column:
    """Weight from 0.1 to 1: falls with the share of characters such as * # $ % & ! | in a text."""
    whole = F.greatest(F.length(text), F.lit(1))
    junk = (whole - F.length(F.translate(text, "*#$%&!|", ""))) / whole
    return F.coalesce(F.greatest(F.lit(0.1), F.lit(1.0) - junk * 4.0), F.lit(0.1))


def draw(doc_id: Column, seed: str) -> Column:
    """Uniform in (0, 1), a function of the id and the seed."""
    digest = F.md5(F.concat(F.lit(seed), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_targets(sources: DataFrame, weights: tuple[float, ...], max_epochs: int) -> DataFrame:
    """Adds ``target`` to (source, source_size): shares of the whole by weight, at most ``max_epochs`` sizes each, the excess reshared.

    In order of the level at which they stop, sources stop one after the other; the level of those
    that never stop is what is left over their weights.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (place % len(weights) + 1).cast("int")))
    weighed = weighed.withColumn("most", (F.col("source_size") * max_epochs).cast("double"))
    before = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    heft = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    levelled = weighed.withColumn("level", left / heft)
    level = F.min(F.when(F.col("most") / F.col("weight") >= F.col("level"), F.struct((F.col("most") / F.col("weight")).alias("at"), "level"))).over(everything)
    return levelled.withColumn("level", level["level"]).withColumn("target", F.least("most", F.col("weight") * F.col("level"))).drop("weight", "most", "level")


def mix_sources(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (1.0, 2.0, 3.0),
    max_epochs: int = 3,
    quality: Column | None = None,
    seed: str = "mix-1",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """What a mixture takes of each document.

    Sources by code point weigh ``weights`` in turn. Returns a row for each document: its id,
    ``source``, ``size`` (words), ``source_size``, ``target`` (of its source), ``taken`` (words
    with repeats) and the columns named in ``carry`` (``doc_`` before names that clash).
    """
    own = (id_col, "source", "size", "source_size", "target", "taken")
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    weight = text_quality(F.col(text_col)) if quality is None else quality
    base = docs.select(
        F.col(id_col).alias("__id"), F.col(source_col).alias("source"), size.alias("size"), weight.alias("__w"), draw(F.col(id_col), seed).alias("__u"), *[F.col(c).alias(f"__c_{c}") for c in carry]
    )
    base = stash(base.withColumn("__key", -F.log("__u") / F.col("__w")).drop("__u"), "mix-keys")
    sums = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("__n"), F.avg("__w").alias("__mean"))
    sources = stash(source_targets(sums, weights, max_epochs), "mix-sources").withColumnRenamed("source", "__source")
    if sources.count() <= _BROADCAST_ROWS:
        sources = F.broadcast(sources)
    ranges = F.greatest(F.lit(1.0), F.ceil(F.col("__n") / _RANGE).cast("double"))
    placed = base.join(sources, F.col("source").eqNullSafe(F.col("__source")), "left").withColumn("__source", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))
    placed = placed.withColumn("__range", F.least(F.floor((1 - F.exp(-F.col("__key") * F.col("__mean"))) * ranges), ranges - 1).cast("long"))
    in_range = placed.groupBy("__source", "__range").agg(F.sum("size").alias("__sum"))
    so_far = Window.partitionBy("__source").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    in_range = in_range.withColumn("__before", F.coalesce(F.sum("__sum").over(so_far), F.lit(0))).drop("__sum")
    within = Window.partitionBy("__source", "__range").orderBy("__key", "__id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ordered = placed.join(in_range, ["__source", "__range"]).withColumn("__before", F.col("__before") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.col("target") - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.floor(rest) - F.col("__before")))
    return ordered.select(F.col("__id").alias(id_col), "source", "size", "source_size", "target", taken.cast("long").alias("taken"), *[F.col(f"__c_{c}").alias(c if c not in own else f"doc_{c}") for c in carry])
