"""Benchmark decontamination by a prefix-filtered set join.

A *window* is ``window`` consecutive words of an item (a shorter item is one window). A text
contains a window if it contains all of the window's shingles in order, so the necessary prefix
of a window is a single shingle, and the rarest one gives the fewest candidates.

1. A bit set of the items' shingles, sized by their number, is tested against every text; what passes is
   kept as runs of words. A run holds every occurrence of every window whole.
2. The shingles of the runs are counted; each window's rarest shingle is its prefix.
3. Runs and windows join on the prefix; positional and length bounds give the only place where
   the window can start in the run, and the words there are compared.

Defined results: null or empty texts have no words, null or empty items no window; items with the
same id count once; a repeated document row gives a repeated result row; null ids are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm import _text as tx
from lumenframe.llm._store import few, stash

#: Two to these powers are the least and the most bits that the shingle filter has (2 and 32 MB): every shingle of every
#: text is tested, so few may pass by chance; beyond some 4 million shingles of items more runs are kept than need be.
LEAST_LOG2, FILTER_LOG2 = 24, 28
WORD_SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_AS_SPACES = bytes(0x20 if b in WORD_SEPARATORS else b + 32 * (0x41 <= b <= 0x5A) for b in range(256))


def _size_salt(size: int) -> np.uint64:
    return np.uint64(size * 0x9E3779B97F4A7C15 % (1 << 64))


def _item_shingles(window: int, shingle: int) -> Callable:
    """Hashes of the items' shingles, and their sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, fold = tx.byte_classes(WORD_SEPARATORS), tx.lower_ascii()
        for batch in batches:
            text = tx.column(batch.column(0))
            for lo, hi in tx.chunks(text):
                w = tx.words(text, lo, hi, classes, fold)
                count = np.diff(w.first)
                for size in range(1, shingle + 1):
                    whole = count[w.row] == size if size < shingle else count[w.row] >= shingle
                    n = len(w.row) - size + 1
                    if n < 1 or not whole.any():
                        continue
                    use = tx.within_row(w.row, size) & whole[:n]
                    found = np.unique(tx.windows(w.hash, size)[use] ^ _size_salt(size))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), size, np.int64)), pa.array(found.view(np.int64))], ["size", "hash"])

    return run


def _runs(packed, sizes: list[int]) -> Callable:
    """Each text's number of words, and its runs of words inside shingles that pass the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, fold = tx.byte_classes(WORD_SEPARATORS), tx.lower_ascii()
        bits = tx.BitSet.read(packed.value)
        for batch in batches:
            text = tx.column(batch.column("__text"))
            n_words, found = np.zeros(batch.num_rows, np.int64), [[] for _ in range(batch.num_rows)]
            for lo, hi in tx.chunks(text):
                w = tx.words(text, lo, hi, classes, fold)
                n_words[lo:hi] = np.diff(w.first)
                n = len(w.row)
                cover = np.zeros(n + 1, np.int64)
                for size in sizes:
                    if n >= size:
                        hit = np.flatnonzero(tx.within_row(w.row, size) & bits.has(tx.windows(w.hash, size) ^ _size_salt(size)))
                        np.add.at(cover, hit, 1)
                        np.add.at(cover, hit + size, -1)
                inside = np.zeros(n + 2, bool)
                inside[1:-1] = np.cumsum(cover[:n]) > 0
                if not inside.any():
                    continue
                turn = inside[1:] != inside[:-1]
                turn[1:n] |= inside[2 : n + 1] & (w.row[1:] != w.row[:-1])
                cuts = np.flatnonzero(turn)
                for a, b in zip(cuts, [*cuts[1:], n], strict=True):
                    if a < b and inside[a + 1]:
                        words = text.data[w.start[a] : w.end[b - 1]].tobytes().translate(_AS_SPACES).split()
                        row = int(w.row[a])
                        found[lo + row].append({"at": int(a - w.first[row]), "words": b" ".join(words).decode("utf-8", "replace")})
            runs = pa.array(found, pa.list_(pa.struct([("at", pa.int64()), ("words", pa.string())])))
            keep = [batch.column(0), batch.column(1)]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(n_words), runs], ["__id", "__th", "n_words", "runs"])

    return run


def _shingles(words: Column, size: Column, window: int = 0) -> Column:
    """Array of (at, shingle, words around it, its place in these); sizes above the number of words give none."""
    last = F.size(words) - size

    def one(i: Column) -> Column:
        low = F.greatest(i - window + 1, F.lit(0))
        around = [F.slice(words, low + 1, 2 * window).alias("around"), (i - low).alias("place")] if window else []
        return F.struct(i.alias("at"), F.array_join(F.slice(words, i + 1, size), " ").alias("shingle"), *around)

    return F.when((last >= 0) & (size > 0), F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), one))


def decontaminate(
    docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, shingle: int = 5
) -> DataFrame:
    """Where texts contain windows of items.

    Returns a row for each row of ``docs``: its id, ``text_hash`` (xxhash64 of the text),
    ``n_words``, ``n_hit`` (words inside any occurrence), ``items`` (sorted ids, as strings, of
    items with an occurring window), ``spans`` (merged ranges of hit words, end exclusive) and
    ``contaminated``.
    """
    spark = docs.sparkSession
    shingle = min(shingle, window)
    item = items.select(F.col(item_col).alias("item"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))
    hashes = stash(item.select("text").mapInArrow(_item_shingles(window, shingle), "size long, hash long").distinct(), "decontaminate-shingles")
    sizes = sorted(r["size"] for r in hashes.select("size").distinct().collect())
    packed = spark.sparkContext.broadcast(tx.collect_bits(hashes, "hash", tx.bits_for(64 * hashes.count(), FILTER_LOG2, LEAST_LOG2)))

    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.col(id_col).alias("__id"), F.xxhash64(text).alias("__th"), text.alias("__text"))
    id_type = source.schema["__id"].dataType.simpleString()
    scanned = stash(
        source.mapInArrow(_runs(packed, sizes), f"__id {id_type}, __th long, n_words long, runs array<struct<at: long, words: string>>"),
        "decontaminate-runs",
    )

    run = scanned.where(F.size("runs") > 0).dropDuplicates(["__id", "__th"]).select("__id", "__th", F.posexplode("runs").alias("run", "r"))
    run = run.select("__id", "__th", F.col("r.at").alias("run_at"), F.split("r.words", " ").alias("words"))

    # windows and their shingles
    plain = F.regexp_extract_all(F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))
    win = item.select("item", plain.alias("w")).where(F.size("w") > 0)
    win = win.select("item", "w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))).alias("o"))
    win = win.select("item", F.slice("w", F.col("o") + 1, window).alias("w")).distinct()
    win = win.select("item", F.size("w").alias("len"), F.array_join("w", " ").alias("window"), F.explode(_shingles(F.col("w"), F.least(F.size("w"), F.lit(shingle)))).alias("s"))
    win = win.select("item", "len", "window", F.col("s.at").alias("offset"), F.col("s.shingle").alias("shingle"))

    parts = [
        run.select("__id", "__th", "run_at", F.explode(_shingles(F.col("words"), F.lit(size), window)).alias("s")).select(
            "__id", "__th", (F.col("run_at") + F.col("s.at")).alias("at"), F.col("s.shingle").alias("shingle"), F.col("s.around").alias("around"), F.col("s.place").alias("place")
        )
        for size in sizes
    ]
    if not parts:
        parts = [run.select("__id", "__th", "run_at", F.lit("").alias("shingle"), F.col("words").alias("around"), F.lit(0).alias("place")).where("false").withColumnRenamed("run_at", "at")]
    at = parts[0]
    for more in parts[1:]:
        at = at.unionByName(more)

    rarity = at.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    ranked = win.join(rarity, "shingle").groupBy("item", "window", "len")
    prefix = ranked.agg(F.min(F.struct("n", "shingle", "offset")).alias("p"), F.count(F.lit(1)).alias("present"))
    # a window with a shingle that no text has cannot occur
    needed = F.greatest(F.col("len") - shingle + 1, F.lit(1))
    prefix = prefix.where(F.col("present") == needed).select("item", "window", "len", F.col("p.shingle").alias("shingle"), F.col("p.offset").alias("offset"))
    near = at.join(prefix, "shingle").withColumn("begin", F.col("place") - F.col("offset"))
    near = near.where((F.col("begin") >= 0) & (F.col("begin") + F.col("len") <= F.size("around")))
    near = near.where(F.array_join(F.slice("around", F.col("begin") + 1, F.col("len")), " ") == F.col("window"))
    near = near.withColumn("a", F.col("at") - F.col("offset"))
    hit = near.groupBy("__id", "__th").agg(
        F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"),
        F.array_sort(F.collect_set(F.struct("a", (F.col("a") + F.col("len")).alias("b")))).alias("found"),
    )
    merged = F.aggregate(
        "found",
        F.lit(None).cast("array<struct<a: bigint, b: bigint>>"),
        lambda acc, x: F.when(acc.isNull(), F.array(x))
        .when(F.element_at(acc, -1)["b"] >= x["a"], F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["a"].alias("a"), F.greatest(F.element_at(acc, -1)["b"], x["b"]).alias("b")))))
        .otherwise(F.concat(acc, F.array(x))),
    )
    hit = hit.select(F.col("__id").alias("h_id"), F.col("__th").alias("h_th"), "items", merged.alias("spans"))
    out = scanned.select("__id", "__th", "n_words").join(hit, F.col("__id").eqNullSafe(F.col("h_id")) & (F.col("__th") == F.col("h_th")), "left")
    n_hit = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["b"] - x["a"]), F.lit(0).cast("long"))
    return out.select(
        F.col("__id").alias(id_col),
        F.col("__th").alias("text_hash"),
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<a: bigint, b: bigint>>")).alias("spans"),
        (n_hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that have a window of an item."""
    found = decontaminate(docs, items, id_col=id_col, text_col=text_col, **options).where("contaminated")
    found = stash(found.select(F.col(id_col).alias("__f_id"), F.col("text_hash").alias("__f_hash")).distinct(), "contaminated")
    same = F.col(id_col).eqNullSafe(F.col("__f_id")) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col("__f_hash"))
    return docs.join(few(found), same, "left_anti")
