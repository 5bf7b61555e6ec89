"""Quality by importance resampling.

Words, runs of punctuation and pairs of neighbours (all repeated tokens being one pair) hash into
``2**BUCKETS_LOG2`` buckets. One bag model is of all documents, one of target documents (labelled 1). A
document's log importance weight is the sum over its n-grams of the log ratio of the two; beyond
``LENGTH`` n-grams it is tempered to that many, so that a long text counts by its mean. Gumbel noise of scale
1 is added to the log weights, and the k largest are a draw of k documents without replacement, each in
proportion to its weight.

``k`` is a parameter, as is ``fraction`` of the documents with a weight. By default k is the number of
documents whose weight is on the target's side of the level that parts labelled texts best, each rated
by the model of the other fold.

The raw model counts every document. The target model reads at most ``sample`` labelled texts, of
least hash of their id, and backs off to the raw model.

Defined results: null and empty texts, and any without n-grams, have no weight (null) and are not
kept; with no labelled text of either class all others are kept by default; equal rows (same id and text) draw
the same noise and fare equally, so that a tie at the edge may keep more than k; a null id draws by its text;
labels that are null or of unknown documents are not learned from; columns keep their names, whatever they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm import _text as tx
from lumenframe.llm._store import stash

BUCKETS_LOG2 = 18
_PIECE = 4096
#: N-grams beyond which a text's log weight grows no more, but is the mean times this.
LENGTH = 64
_BINS = 4096

#: The pair of any token and itself.
_REPEATED = np.uint64(0x5851F42D4C957F2D)
#: 0 for white space, 1 for letters, digits and _, 2 for other marks.
_KINDS = np.array([0 if b in b" \t\n\x0b\x0c\r" else 1 if b >= 0x80 or bytes([b]).isalnum() or b == 0x5F else 2 for b in range(256)], np.uint8)


def _ngrams(text: tx.Column, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of each token and of each pair of tokens."""
    w = tx.words(text, lo, hi, _KINDS, tx.lower_ascii())
    if not len(w.row):
        return w.row, w.row
    pair = tx.within_row(w.row, 2)
    two = np.where(w.hash[1:] == w.hash[:-1], _REPEATED, tx.windows(w.hash, 2))
    hashes = np.concatenate([w.hash, two[pair]])
    return np.concatenate([w.row, w.row[:-1][pair]]), (hashes >> np.uint64(64 - BUCKETS_LOG2)).astype(np.int64)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's counts: kind 0 of all rows, 1 and 2 of target rows of either fold; in pieces of buckets."""
    counts = np.zeros((3, 1 << BUCKETS_LOG2), np.int64)
    for batch in batches:
        text, kind = tx.column(batch.column("text")), batch.column("kind").to_numpy()
        for lo, hi in tx.chunks(text):
            row, bucket = _ngrams(text, lo, hi)
            counts[0] += np.bincount(bucket, minlength=counts.shape[1])
            of = kind[lo + row]
            for k in (1, 2):
                if (of == k).any():
                    counts[k] += np.bincount(bucket[of == k], minlength=counts.shape[1])
    yield _pieces(counts)


def _pieces(counts: np.ndarray) -> pa.RecordBatch:
    kinds, pieces = counts.shape[0], counts.shape[1] // _PIECE
    return pa.RecordBatch.from_arrays(
        [pa.array(np.repeat(np.arange(kinds, dtype=np.int32), pieces)), pa.array(np.tile(np.arange(pieces, dtype=np.int32), kinds)), pa.array([x.tobytes() for x in counts.reshape(-1, _PIECE)], pa.binary())],
        ["kind", "piece", "counts"],
    )


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for kind, piece, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            have = sums.setdefault((kind, piece), np.zeros(_PIECE, np.int64))
            have += np.frombuffer(counts, np.int64)
    keys = list(sums)
    yield pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([sums[k].tobytes() for k in keys], pa.binary())], ["kind", "piece", "counts"]
    )


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket; the target backs off to the raw model with the weight of a tenth of its own size."""
    p = (raw + 0.5) / (raw.sum() + 0.5 * len(raw))
    back = 0.1 * target.sum() + 1.0
    return (np.log((target + back * p) / (target.sum() + back)) - np.log(p)).astype(np.float32)


def _rate(shared) -> Callable:
    """Adds the number of n-grams and the sums of log ratios by the whole model and, for labelled rows, by the model of the other fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, first, second = shared.value
        for batch in batches:
            text, fold = tx.column(batch.column("text")), batch.column("fold").to_numpy()
            n, ratio, crossed = np.zeros(batch.num_rows), np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for lo, hi in tx.chunks(text):
                row, bucket = _ngrams(text, lo, hi)
                n[lo:hi] = np.bincount(row, minlength=hi - lo)
                ratio[lo:hi] = np.bincount(row, whole[bucket], hi - lo)
                of = fold[lo + row]
                for k, other in ((0, second), (2, first)):
                    use = of == k
                    if use.any():
                        crossed[lo:hi] += np.bincount(row[use], other[bucket[use]], hi - lo)
            none = n == 0
            keep = [i for i, name in enumerate(batch.schema.names) if name not in ("text", "fold")]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in keep], pa.array(n, mask=none), pa.array(ratio, mask=none), pa.array(crossed, mask=none | (fold < 0))],
                [*[batch.schema.names[i] for i in keep], "n", "ratio", "crossed"],
            )

    return run


def _level(crossed: np.ndarray, good: np.ndarray) -> float:
    """The cut that parts the two classes with the fewest errors, halfway between the ratios around it."""
    order = np.argsort(crossed, kind="stable")
    x, y = crossed[order], good[order]
    wrong = np.r_[0, np.cumsum(y)] + np.r_[np.cumsum((1 - y)[::-1])[::-1], 0]
    best = np.flatnonzero(wrong == wrong.min())[0]
    if best == 0:
        return -np.inf
    return float(x[best - 1] if best == len(x) else (x[best - 1] + x[best]) / 2)


def _kth_largest(keys: DataFrame, k: int) -> float:
    """By histograms that narrow in on it; no task sorts all keys."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    if low is None or k <= 0:
        return float("inf")
    while True:
        step = (high - low) / _BINS
        if step <= 0 or low + step == low:
            return low
        place = F.least(F.floor((F.col("key") - low) / step), F.lit(_BINS - 1))
        bins = keys.where((F.col("key") >= low) & (F.col("key") <= high)).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
        for row in sorted(bins.collect(), key=lambda r: -r["bin"]):
            if k <= row["n"]:
                break
            k -= row["n"]
        else:
            return low
        if row["low"] == row["high"] or k == row["n"]:
            return row["low"]
        low, high = row["low"], row["high"]


def gumbel_top_k(weighed: DataFrame, k: int, *id_cols: str, weight_col: str = "log_weight", seed: int = 7) -> DataFrame:
    """Adds ``kept``: a draw of ``k`` rows without replacement in proportion to exp(``weight_col``); null weights are never drawn.

    The noise of a row is a function of ``id_cols`` and ``seed``.
    """
    u = (F.shiftrightunsigned(F.xxhash64(*id_cols, F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    keyed = weighed.withColumn("__key", F.col(weight_col) - F.log(-F.log(u)))
    cut = _kth_largest(keyed.where("__key is not null").select(F.col("__key").alias("key")), k)
    return keyed.withColumn("kept", F.coalesce(F.col("__key") >= F.lit(cut), F.lit(False))).drop("__key")


def tempered(total: Column, n: Column) -> Column:
    """Log weights of texts of ``n`` n-grams from the sums of their log ratios."""
    return total * F.least(F.lit(1.0), F.lit(float(LENGTH)) / n)


def _drawn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int, seed: int, k: int | None, fraction: float | None, carry: tuple[str, ...]) -> DataFrame:
    """(__id, log_ratio, log_weight, kept and, by number, the columns in ``carry``)."""
    spark = docs.sparkSession
    label = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("good")).where("id is not null and good in (0, 1)")
    label = label.groupBy("id").agg(F.min("good").alias("good")).withColumn("fold", (F.crc32(F.col("id").cast("string")) % 3).cast("int"))
    label = label.where("fold <> 1").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample)
    source = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *[F.col(c).alias(f"__c{i}") for i, c in enumerate(carry)])
    known = source.join(F.broadcast(label), F.col("__id") == F.col("id"), "left").drop("id")
    kind = F.when(F.col("good") == 1, F.when(F.col("fold") == 0, 1).otherwise(2)).otherwise(0)
    tallied = known.select("text", kind.alias("kind")).mapInArrow(_tally, "kind int, piece int, counts binary")
    found = tallied.repartition("kind", "piece").mapInArrow(_added, "kind int, piece int, counts binary").toArrow()
    counts = np.zeros((3, 1 << BUCKETS_LOG2), np.int64)
    for of, piece, raw in zip(*(c.to_pylist() for c in found.columns), strict=True):
        counts[of, piece * _PIECE : (piece + 1) * _PIECE] += np.frombuffer(raw, np.int64)
    models = spark.sparkContext.broadcast((log_ratios(counts[0], counts[1] + counts[2]), log_ratios(counts[0], counts[1]), log_ratios(counts[0], counts[2])))
    prepared = known.select("__id", *[f"__c{i}" for i in range(len(carry))], F.xxhash64("text").alias("__th"), F.coalesce("good", F.lit(-1)).alias("good"), F.coalesce("fold", F.lit(-1)).alias("fold"), "text")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in prepared.schema if f.name not in ("text", "fold"))
    rated = prepared.mapInArrow(_rate(models), f"{schema}, n double, ratio double, crossed double")
    rated = rated.withColumn("log_weight", tempered(F.col("ratio"), F.col("n"))).withColumn("crossed", tempered(F.col("crossed"), F.col("n")))
    rated = stash(rated.withColumn("log_ratio", F.col("ratio") / F.col("n")).drop("ratio", "n"), "quality")
    weighed = rated.where("log_weight is not null")
    if k is None and fraction is not None:
        k = round(fraction * weighed.count())
    if k is None:
        seen = rated.where("good >= 0 and crossed is not null").select("good", "crossed").toArrow()
        level = _level(seen["crossed"].to_numpy(), seen["good"].to_numpy()) if len(set(seen["good"].to_pylist())) == 2 else -np.inf
        k = weighed.where(F.col("log_weight") >= F.lit(level)).count()
    return gumbel_top_k(rated, k, "__id", "__th", seed=seed).select("__id", "log_ratio", "log_weight", "kept", *[f"__c{i}" for i in range(len(carry))])


_SAMPLE = 20_000


def resample_quality(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = _SAMPLE, seed: int = 7, k: int | None = None, fraction: float | None = None
) -> DataFrame:
    """Returns for each row of ``docs`` its id, ``log_ratio`` (per n-gram, target over raw), ``log_weight`` and ``kept``.

    Labels whose crc32 of the id modulo 3 is 1 are held out.
    """
    drawn = _drawn(docs, labels, id_col, text_col, label_col, sample, seed, k, fraction, ())
    return drawn.select(F.col("__id").alias(id_col), "log_ratio", "log_weight", "kept")


def keep_drawn(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = _SAMPLE, seed: int = 7, k: int | None = None, fraction: float | None = None
) -> DataFrame:
    """The rows of ``docs`` that the sampling keeps, with all their columns."""
    drawn = _drawn(docs, labels, id_col, text_col, label_col, sample, seed, k, fraction, tuple(docs.columns))
    return drawn.where("kept").select(*[F.col(f"__c{i}").alias(c) for i, c in enumerate(docs.columns)])
