"""Toxicity by class-conditional Kneser-Ney models of letters.

Two interpolated Kneser-Ney models of the letters of words, one of toxic and one of ordinary texts,
have counts of their own for a letter after ``ORDER - 1`` others, and share all continuation
counts below, to which rare expressions back off. The classes' counts are of labelled texts, the
shared counts of all documents. What neither class has seen therefore counts alike in both.

A word's log-likelihood ratio is that of its letters. A toxic text is one some of whose words
(``TOXIC_WORDS``) are drawn from the toxic model and the others from the ordinary one; the
log-likelihood ratio of that against the ordinary model, normalised by length, of the worst passage is
the only thing a text is scored by. A logistic curve of one variable, fitted on labelled texts that
the models have not seen (two folds), maps it to 0..1.

Learning reads at most ``sample`` labelled texts of each class, those of least hash of their id.
Labels, language, source and id are no inputs of a score.

The shared probabilities are needed for the labelled texts' n-grams only, but rest on all
documents': each task reduces its documents to distinct n-grams; these and the labelled ones meet by the
three letters before the last, of which orders from four on need no others. Orders up to three
are counted by Spark into a table of the alphabet's size.

Defined results: null and empty texts, and texts without letters, get the curve's value for a text
without evidence; labels that are null or of unknown documents are not learned from; if a class has
no labelled text, every score is the share of the toxic label, or 0; repeated rows are scored alike;
texts are scored whole, whatever their length; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm import _text as tx
from lumenframe.llm._store import stash

ORDER = 8
#: Orders up to this one come from a table of all n-grams of that order.
TABLED = 3
#: Bits of a letter's code: 1 to 26 the alphabet, 27 a word's edge, above other scripts' letters by their last byte.
_BITS = 6
_EDGE = np.uint64(27)
_CODES = np.array([27 if b < 0x61 or 0x7A < b < 0x80 else b - 0x60 if b < 0x80 else 28 + b % 36 for b in range(256)], np.uint64)
#: Taken off a class's count of one, two, three or more texts; off any shared count.
DISCOUNTS, SHARED_DISCOUNT = np.array([0.0, 0.98, 1.5, 1.9]), 0.75
#: Share of a toxic text's words that are of the toxic model.
TOXIC_WORDS = 0.003
#: Words of a passage; words without evidence that are added to each.
PASSAGE, PRIOR = 1024, 20
#: Words an executor remembers the ratio of, and has seen, as powers of two.
_CACHE_LOG2, _SEEN_LOG2 = 20, 18
#: N-grams a task holds before it writes them out.
_HELD = 1 << 20
SEPARATORS = bytes([*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])


def _low(order: int) -> np.uint64:
    return np.uint64((1 << (_BITS * order)) - 1)


def _letters(text: tx.Column, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of words' letters, with an edge before and after each word; place in the word; the word's number."""
    size = end - start + 2
    word = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(word)) - np.repeat(np.cumsum(size) - size, size)
    at = np.minimum(np.maximum(start[word] + place - 1, 0), max(0, len(text.data) - 1))
    edge = (place == 0) | (place == size[word] - 1)
    raw = tx.lower_ascii()[text.data[at]] if len(text.data) else np.zeros(len(at), np.uint8)
    keep = edge | (raw < 0xC0)  # of a letter of several bytes the first doesn't count
    letter, word, edge = np.where(edge, _EDGE, _CODES[raw])[keep], word[keep], edge[keep]
    head = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.zeros(0, np.int64)
    place = np.arange(len(word)) - np.repeat(head, np.diff(np.r_[head, len(word)]))
    return letter, place, word


def grams(letter: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The n-gram that ends at each letter, the last one in the lowest bits; edges stand before a word's beginning."""
    keys = letter.copy()
    for back in range(1, ORDER):
        before = np.full(len(letter), _EDGE)
        before[back:] = letter[: max(0, len(letter) - back)]
        keys |= np.where(place >= back, before, _EDGE) << np.uint64(_BITS * back)
    return keys


def _word_grams(text: tx.Column, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of words and the number of each one's word."""
    letter, place, word = _letters(text, start, end)
    keep = place > 0
    return grams(letter, place)[keep], word[keep]


def _types(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct n-grams of a task's documents (or of runs of them, if they are many)."""
    classes = tx.byte_classes(SEPARATORS)
    seen = np.zeros(1 << _SEEN_LOG2, np.uint64)
    held, size = [], 0
    for batch in batches:
        text = tx.column(batch.column("text"))
        for lo, hi in tx.chunks(text):
            w = tx.words(text, lo, hi, classes, tx.lower_ascii())
            slot = (w.hash >> np.uint64(64 - _SEEN_LOG2)).astype(np.int64)
            new = np.flatnonzero(seen[slot] != w.hash)
            if not len(new):
                continue
            seen[slot[new]] = w.hash[new]
            one = new[np.unique(w.hash[new], return_index=True)[1]]
            held.append(np.unique(_word_grams(text, w.start[one], w.end[one])[0]))
            size += len(held[-1])
            if size >= _HELD:
                held = [np.unique(np.concatenate(held))]
                size = len(held[0])
                if size >= _HELD // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(held[0].view(np.int64))], ["gram"])
                    held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(held)).view(np.int64))], ["gram"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled texts' n-grams by class and fold; a word counts once in a text."""
    classes = tx.byte_classes(SEPARATORS)
    for batch in batches:
        text = tx.column(batch.column("text"))
        cell = (batch.column("toxic").to_numpy() * 2 + batch.column("fold").to_numpy()).astype(np.uint64)
        for lo, hi in tx.chunks(text):
            w = tx.words(text, lo, hi, classes, tx.lower_ascii())
            if not len(w.row):
                continue
            once = np.unique(np.c_[w.row.astype(np.uint64), w.hash], axis=0, return_index=True)[1]
            gram, word = _word_grams(text, w.start[once], w.end[once])
            of = cell[lo + w.row[once[word]]]
            keys, counts = np.unique(gram << np.uint64(2) | of, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array((keys >> np.uint64(2)).view(np.int64)), pa.array((keys & np.uint64(3)).astype(np.int32)), pa.array(counts)], ["gram", "cell", "n"])


def _pooled(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    head = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[head], np.add.reduceat(values, head) if len(head) else values[:0]


def _found(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def tabled(gram: np.ndarray, continuations: np.ndarray) -> np.ndarray:
    """Shared probabilities of all n-grams of order ``TABLED``, from the numbers of different letters before those there are."""
    counts = [np.zeros(1 << (_BITS * order)) for order in range(1, TABLED + 1)]
    counts[-1][gram.astype(np.int64)] = continuations
    for order in range(TABLED - 1, 0, -1):
        counts[order - 1] = (counts[order].reshape(-1, 1 << (_BITS * order)) > 0).sum(0).astype(float)
    p = np.full(1 << _BITS, 1.0 / (1 << _BITS))
    for order, c in enumerate(counts, 1):
        # the letter is the lowest digit of an n-gram, the letters before it are its context
        c = c.reshape(-1, 1 << _BITS)
        p = np.tile(p, len(c) * (1 << _BITS) // len(p)).reshape(c.shape) if order > 1 else p.reshape(c.shape)
        total = c.sum(1, keepdims=True)
        p = np.where(total > 0, (np.maximum(c - SHARED_DISCOUNT, 0) + SHARED_DISCOUNT * (c > 0).sum(1, keepdims=True) * p) / np.maximum(total, 1), p).reshape(-1)
    return p.astype(np.float32)


def shared_probabilities(types: np.ndarray, asked: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Probability of the last letter of each n-gram of ``asked`` after ``ORDER - 2`` others, by continuation counts of distinct ``types``."""
    levels, now = [], np.unique(types)
    for order in range(ORDER - 1, TABLED, -1):
        now, continuations = np.unique(now & _low(order), return_counts=True)
        context, total = _pooled(now >> np.uint64(_BITS), np.c_[continuations, np.ones(len(now))].astype(float))
        levels.append((order, now, continuations, context, total))
    p = table[(asked & _low(TABLED)).astype(np.int64)].astype(float)
    for order, keys, continuations, context, total in reversed(levels):
        own = asked & _low(order)
        at, has = _found(context, own >> np.uint64(_BITS))
        if not len(context):
            continue
        c, seen = _found(keys, own)
        count = np.where(seen, continuations[c], 0)
        p = np.where(has, (np.maximum(count - SHARED_DISCOUNT, 0) + SHARED_DISCOUNT * total[at, 1] * p) / total[at, 0], p)
    return p


def _joined(table) -> Callable:
    """Adds shared probabilities to the labelled n-grams (those with counts) of a task, which holds all n-grams of some contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, asked = [], []
        for batch in batches:
            gram, labelled = batch.column("gram").to_numpy().view(np.uint64), batch.column("n0").is_valid().to_numpy(zero_copy_only=False)
            types.append(gram[~labelled])
            if labelled.any():
                asked.append(batch.filter(pa.array(labelled)))
        if not asked:
            return
        rows = pa.Table.from_batches(asked)
        p = shared_probabilities(np.concatenate(types), rows.column("gram").to_numpy().view(np.uint64), table.value)
        for batch in rows.append_column("shared", pa.array(p.astype(np.float32))).select(["gram", "shared", "n0", "n1", "n2", "n3"]).to_batches():
            yield batch

    return run


class Events(NamedTuple):
    """N-grams of labelled texts with their shared probabilities."""

    gram: np.ndarray
    shared: np.ndarray


class Model(NamedTuple):
    """Log ratios (toxic over ordinary) of n-grams, and of any other letter after contexts that were seen; both sorted."""

    grams: np.ndarray
    ratios: np.ndarray
    contexts: np.ndarray
    others: np.ndarray


def fit(events: Events, counts: np.ndarray) -> Model:
    """The ratios of two Kneser-Ney models with common backoff, from counts (toxic, ordinary) of n-grams."""
    order = np.argsort(events.gram)
    gram, shared, counts = events.gram[order], events.shared[order].astype(float), counts[order].astype(float)
    context = gram >> np.uint64(_BITS)
    head = np.flatnonzero(np.r_[True, context[1:] != context[:-1]]) if len(gram) else np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(head)), np.diff(np.r_[head, len(gram)]))
    off = np.minimum(counts, DISCOUNTS[np.minimum(counts, 3).astype(int)])
    total, taken = (np.add.reduceat(x, head) if len(head) else x[:0] for x in (counts, off))
    weight = np.where(total > 0, taken / np.maximum(total, 1), 1.0)  # of the shared probability
    p = np.where(total[of] > 0, (counts - off) / np.maximum(total[of], 1), 0.0) + weight[of] * shared[:, None]
    ratio, other = (np.log(x[:, 0]) - np.log(x[:, 1]) for x in (p, weight))
    return Model(gram, ratio.astype(np.float32), context[head], other.astype(np.float32))


def ratios(model: Model, text: tx.Column, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio (toxic over ordinary) of each word."""
    gram, word = _word_grams(text, start, end)
    value = np.zeros(len(gram))
    if len(model.grams):
        at, has = _found(model.contexts, gram >> np.uint64(_BITS))
        value = np.where(has, model.others[at], 0)
        at, has = _found(model.grams, gram)
        value = np.where(has, model.ratios[at], value)
    return np.bincount(word, value, len(start))


class _Remembered:
    """Words' ratios, kept by hash in a table of fixed size."""

    def __init__(self, model: Model):
        self.model = model
        self.keys, self.values = np.zeros(1 << _CACHE_LOG2, np.uint64), np.zeros(1 << _CACHE_LOG2, np.float32)

    def of(self, text: tx.Column, w: tx.Words) -> np.ndarray:
        slot = (w.hash >> np.uint64(64 - _CACHE_LOG2)).astype(np.int64)
        out = self.values[slot]
        missed = np.flatnonzero(self.keys[slot] != w.hash)
        if len(missed):
            _, one, back = np.unique(w.hash[missed], return_index=True, return_inverse=True)
            new = missed[one]
            value = np.concatenate([ratios(self.model, text, w.start[x], w.end[x]) for x in np.array_split(new, len(new) // 50_000 + 1)]).astype(np.float32)
            self.keys[slot[new]], self.values[slot[new]] = w.hash[new], value
            out[missed] = value[back]
        return out


def evidence(known: _Remembered, text: tx.Column, lo: int, hi: int, classes: np.ndarray) -> np.ndarray:
    """Of each row the length-normalised log-likelihood ratio of its worst passage, on a scale for the curve; 0 without words."""
    w = tx.words(text, lo, hi, classes, tx.lower_ascii())
    out = np.zeros(hi - lo)
    if not len(w.row):
        return out
    word = np.log1p(TOXIC_WORDS * np.expm1(np.minimum(known.of(text, w).astype(float), 30)))
    count = np.diff(w.first)
    has = np.flatnonzero(count)
    sums, at = np.r_[0, np.cumsum(word)], np.arange(len(word))
    stop = np.minimum(at + PASSAGE, w.first[w.row + 1])
    mean = (sums[stop] - sums[at]) / (np.minimum(PASSAGE, count[w.row]) + PRIOR)
    out[has] = np.maximum.reduceat(mean, w.first[:-1][has])
    return np.log1p(1000 * np.maximum(out, 0))


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and level of a logistic regression on one variable, with a slight ridge on the slope."""
    z = np.c_[x, np.ones(len(x))]
    ridge, beta = np.diag([1e-2, 1e-6]), np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def _crossed(shared) -> Callable:
    """Evidence of labelled texts by the model of the other fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [_Remembered(m) for m in shared.value]
        classes = tx.byte_classes(SEPARATORS)
        for batch in batches:
            text, fold = tx.column(batch.column("text")), batch.column("fold").to_numpy()
            x = np.zeros(batch.num_rows)
            for lo, hi in tx.chunks(text):
                first, second = (evidence(k, text, lo, hi, classes) for k in known)
                x[lo:hi] = np.where(fold[lo:hi] == 0, second, first)
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(x)], ["toxic", "x"])

    return run


def _scored(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, (slope, level) = shared.value
        known, classes = _Remembered(model), tx.byte_classes(SEPARATORS)
        for batch in batches:
            text, x = tx.column(batch.column("text")), np.zeros(batch.num_rows)
            for lo, hi in tx.chunks(text):
                x[lo:hi] = evidence(known, text, lo, hi, classes)
            score = 1 / (1 + np.exp(-np.clip(slope * x + level, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("__id"), batch.column("__part"), pa.array(score)], ["__id", "__part", "score"])

    return run


def third(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3: 1 is held out."""
    return F.crc32(doc_id.cast("string")) % 3


def score_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 5_000) -> DataFrame:
    """Returns id, ``held_out`` and ``score`` for each row of ``docs``; learns only from labels that aren't held out."""
    spark = docs.sparkSession
    label = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).where("id is not null and toxic in (0, 1)")
    label = label.groupBy("id").agg(F.max("toxic").alias("toxic")).withColumn("fold", third(F.col("id"))).where("fold <> 1")
    label = label.withColumn("fold", (F.col("fold") == 2).cast("int"))
    least = [label.where(f"toxic = {c}").orderBy(F.xxhash64("id"), "id").limit(sample) for c in (0, 1)]
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    known = docs.select(F.col(id_col).alias("id"), text)
    learn = stash(known.join(F.broadcast(least[0].unionByName(least[1])), "id").select("text", "toxic", "fold"), "toxicity-sample")
    cells = [F.sum(F.when(F.col("cell") == c, F.col("n")).otherwise(0)).alias(f"n{c}") for c in range(4)]
    counted = stash(learn.mapInArrow(_count, "gram long, cell int, n long").groupBy("gram").agg(*cells), "toxicity-counts")

    types = stash(docs.select(text).mapInArrow(_types, "gram long"), "toxicity-grams")
    longer, letters = (1 << (_BITS * (TABLED + 1))) - 1, (1 << (_BITS * TABLED)) - 1
    ends = types.select((F.col("gram").bitwiseAND(F.lit(longer))).alias("g")).distinct().groupBy(F.col("g").bitwiseAND(F.lit(letters)).alias("g")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    table = spark.sparkContext.broadcast(tabled(ends["g"].to_numpy(), ends["n"].to_numpy()))
    none = [F.lit(None).cast("long").alias(f"n{c}") for c in range(4)]
    both = types.select("gram", *none).unionByName(counted).repartition(F.shiftright("gram", _BITS).bitwiseAND(F.lit(letters)))
    # the n-grams of a single text too: nothing is cut off the labelled counts
    events = both.mapInArrow(_joined(table), "gram long, shared float, " + ", ".join(f"n{c} long" for c in range(4))).toArrow()
    n = [events[f"n{c}"].to_numpy() for c in range(4)]
    asked = Events(events["gram"].to_numpy().view(np.uint64), events["shared"].to_numpy())

    source = docs.select(F.col(id_col).alias("__id"), third(F.col(id_col)).alias("__part"), text)
    held_out = F.coalesce(F.col("__part") == 1, F.lit(False)).alias("held_out")
    toxic, ordinary = int(n[2].sum() + n[3].sum()), int(n[0].sum() + n[1].sum())
    if not toxic or not ordinary:
        return source.select(F.col("__id").alias(id_col), held_out, F.lit(1.0 if toxic else 0.0).alias("score"))
    folds = []
    for f in (0, 1):
        use = n[2 + f] + n[f] > 0
        folds.append(fit(Events(asked.gram[use], asked.shared[use]), np.c_[n[2 + f][use], n[f][use]]))
    seen = learn.mapInArrow(_crossed(spark.sparkContext.broadcast(folds)), "toxic int, x double").toArrow()
    curve = _curve(seen["x"].to_numpy(), seen["toxic"].to_numpy().astype(float))
    whole = spark.sparkContext.broadcast((fit(asked, np.c_[n[2] + n[3], n[0] + n[1]]), curve))
    id_type = source.schema["__id"].dataType.simpleString()
    scored = source.mapInArrow(_scored(whole), f"__id {id_type}, __part long, score double")
    return scored.select(F.col("__id").alias(id_col), held_out, "score")
