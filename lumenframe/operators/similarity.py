"""Item-item similarity from (user, item, rating) rows.

Pairs are never shuffled. Items are cut into ranges of about ``BLOCK`` pairs; a block gets of each of its
users the ratings from its own first item on, with the statistics of their items, and sums all pairs whose
smaller item is in it, some items at a time. So what moves is at most a row per user and block. Where only sums
or the most similar items are wanted, they are made of the pairs there and then, and no pair leaves its block.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.session import small, store

#: Ratings of a user in a row; a user of more is dealt over rows.
HEAVY = 2_000
#: Pairs of a block of items, about, and the most blocks.
BLOCK, MOST_BLOCKS = 1 << 22, 4096
#: Pairs that are summed at a time, and ratings that a block holds before it sums them.
_PAIRS, _ENTRIES = 1 << 18, 1 << 22
#: Whole numbers below this have x ln x from a table by the C library, as DuckDB has it; numpy's logarithm differs in the last place of some.
_LOGS = 1 << 20
_WHOLE = ("tinyint", "smallint", "int", "bigint")


@dataclass(frozen=True)
class Measure:
    """How a similarity is formed: ``scale`` of ratings, products or counts, and the final formula."""

    name: str
    scale: str = "identity"
    counts: bool = False


MEASURES = {
    m.name: m
    for m in (
        Measure("euclidean"),
        Measure("cosine", "unit"),
        Measure("pearson", "centred"),
        Measure("tanimoto", counts=True),
        Measure("cityblock", counts=True),
        Measure("cooccurrence", counts=True),
        Measure("loglikelihood", counts=True),
    )
}


def dedupe(ratings: DataFrame, how: str = "sum", order: str | None = None) -> DataFrame:
    """One rating per user and item; zeros vanish, as absent entries are zeros. ``last`` takes that of the largest ``order``."""
    if how == "last":
        if order is None:
            raise ValueError("the last rating needs an order")
        merged = F.max_by("rating", order)
    else:
        merged = {"sum": F.sum, "max": F.max, "min": F.min}[how]("rating")
    return ratings.groupBy("user", "item").agg(merged.alias("rating")).where("rating <> 0")


def item_stats(ratings: DataFrame) -> DataFrame:
    """Per item: ratings, largest, sums of absolute values and of squares."""
    r = F.col("rating")
    return ratings.groupBy("item").agg(F.count(F.lit(1)).alias("nnz"), F.max(r).alias("largest"), F.sum(F.abs(r)).alias("l1"), F.sum(r * r).alias("l2sq"))


def user_count(ratings: DataFrame) -> DataFrame:
    return ratings.agg(F.countDistinct("user").alias("n_users"))


def uniform(seed: str, *parts: Column) -> Column:
    """In [0, 1), a function of the parts and the seed alone."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *[p.cast("string") for p in parts])), 1, 13), 16, 10).cast("double") / float(1 << 52)


def sample_down(ratings: DataFrame, most: int, by: str = "item", seed: str = "0") -> DataFrame:
    """Keeps each rating with probability min(most, n) / n, n being its item's (or user's) number."""
    n = ratings.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    kept = ratings.join(n, by).where(uniform(seed, F.col("user"), F.col("item")) < F.least(F.lit(most), F.col("n")) / F.col("n"))
    return kept.select("user", "item", "rating")


def scaled(ratings: DataFrame, scale: str) -> DataFrame:
    """Ratings as the measure takes them: as they are, of unit length per item, or centred first."""
    if scale == "identity":
        return ratings
    mean = F.avg("rating") if scale == "centred" else F.lit(0.0)
    sums = ratings.groupBy("item").agg(mean.alias("mean"), F.sum(F.col("rating") * F.col("rating")).alias("sq"), F.count(F.lit(1)).alias("n"))
    length = F.sqrt(F.greatest(F.col("sq") - F.col("n") * F.col("mean") * F.col("mean"), F.lit(0.0)))
    value = F.when(length > 1e-9, (F.col("rating") - F.col("mean")) / length).otherwise(0.0)
    return ratings.join(sums, "item").select("user", "item", value.alias("rating"))


def cooccurrence(ratings: DataFrame) -> DataFrame:
    """(i, j, dot, n_both) of items i < j rated by the same users."""
    return _pairs(store(ratings.select("user", "item", "rating")), ["rating"])


def _by_block(ratings: DataFrame, held: list[str]) -> bool:
    """Whether ``_pairs`` goes by blocks: items must be whole numbers, ratings numbers."""
    kinds = {f.name: f.dataType.simpleString() for f in ratings.schema}
    return kinds["item"] in _WHOLE and ("rating" not in held or kinds["rating"] in (*_WHOLE, "float", "double"))


def _pairs(ratings: DataFrame, held: list[str], finish: Callable | None = None, returned: str = "") -> DataFrame:
    """(i, j, n_both) of items i < j with common users.

    With ``rating`` among the columns ``held`` also ``dot``; any other is a number of the item and comes as ``_i`` and ``_j``.
    Only by blocks: ``finish`` gets these columns as arrays, of some items i all pairs in order of i and j, and makes of
    them the columns ``returned``.
    """
    kinds = {f.name: f.dataType.simpleString() for f in ratings.schema}
    by_block = _by_block(ratings, held)
    ratings = ratings.where("user is not null and item is not null")
    if not by_block:
        return _pairs_by_join(ratings, held)
    entry = F.struct(F.col("item").cast("long").alias("item"), *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in held))
    # stored: they are counted, ranged and dealt, and what was shuffled to make them goes
    users = store(ratings.groupBy("user").agg(F.sort_array(F.collect_list(entry)).alias("entries")).where("size(entries) > 1").select("entries"))
    total = users.agg(F.sum(F.expr("size(entries) * (size(entries) - 1.0D) / 2"))).first()[0] or 0.0
    blocks = int(min(max(1, -(-total // BLOCK)), MOST_BLOCKS))
    bounds = users.select(F.explode("entries.item").alias("item")).agg(F.percentile_approx("item", [k / blocks for k in range(1, blocks)], max(10_000, 20 * blocks))).first()[0] if blocks > 1 else []
    lists = "".join(f", {c} array<double>" for c in held)
    dealt = users.mapInArrow(_deal(np.array(bounds, np.int64), held, HEAVY), f"block int, k int, start int, item array<bigint>{lists}")
    dealt = dealt.repartition(blocks, "block").sortWithinPartitions("block")
    numbers = [c for c in held if c != "rating"]
    out = ["i long", "j long", "n_both long", *(["dot double"] if "rating" in held else []), *(f"{c}_{e} double" for c in numbers for e in "ij")]
    pairs = dealt.mapInArrow(_sum(held, finish), returned or ", ".join(out))
    pairs = pairs.withColumns({e: F.col(e).cast(kinds["item"]) for e in "ij" if e in pairs.columns})
    return pairs.withColumn("dot", F.col("dot").cast("long")) if "dot" in pairs.columns and kinds["rating"] in _WHOLE else pairs


def _pairs_by_join(ratings: DataFrame, held: list[str]) -> DataFrame:
    """``_pairs`` of items that are not whole numbers: a self-join on the user, summed by pair."""
    a, b = (ratings.select("user", F.col("item").alias(e), *(F.col(c).alias(f"{c}_{e}") for c in held)) for e in "ij")
    sums = [F.sum(F.col("rating_i") * F.col("rating_j")).alias("dot")] if "rating" in held else []
    numbers = [F.first(f"{c}_{e}").cast("double").alias(f"{c}_{e}") for c in held if c != "rating" for e in "ij"]
    return a.join(b, "user").where("i < j").groupBy("i", "j").agg(F.count(F.lit(1)).alias("n_both"), *sums, *numbers)


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The whole numbers from each of ``first`` on, ``count`` of them, one range after the other."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())


def _deal(bounds: np.ndarray, held: list[str], heavy: int) -> Callable:
    """Rows of a user and block: the user's ``k`` ratings in the block and those to pair them with, from ``start`` on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("entries")
            cuts, fields = lists.offsets.to_numpy(), lists.values
            item = fields.field("item").to_numpy()
            columns = [item, *(fields.field(c).to_numpy() for c in held)]
            lo, hi = cuts[0], cuts[-1]
            at = np.arange(lo, hi)
            block = np.searchsorted(bounds, item[lo:hi], "right").astype(np.int32)
            user = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
            place = at - cuts[:-1][user]
            new = np.r_[True, (block[1:] != block[:-1]) | (user[1:] != user[:-1]) | (place[1:] % heavy == 0)]
            s = at[new]
            t, end, block = np.r_[s[1:], hi], cuts[1:][user[new]], block[new]
            # (first and end of own ratings, first and end of the others): next to each other, or in pieces
            whole = np.flatnonzero((end - s <= heavy) & (end - s > 1))
            rows = [np.stack([s[whole], t[whole], t[whole], end[whole], block[whole], 0 * whole])]
            for x in np.flatnonzero(end - s > heavy):
                first = np.r_[t[x], np.arange(t[x], end[x], heavy)]
                last = np.minimum(np.r_[t[x], first[1:] + heavy], end[x])
                rows.append(np.stack([np.broadcast_to(v, len(first)) for v in (s[x], t[x])] + [first, last, np.full(len(first), block[x]), np.arange(len(first)) > 0]))
            own, own_end, first, last, block, apart = np.concatenate(rows, 1)
            k, size = own_end - own, own_end - own + last - first
            part = np.cumsum(size) // (1 << 19)
            for lo, hi in zip(*(lambda c: (c[:-1], c[1:]))(np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(k)]), strict=True):
                if lo == hi:
                    continue
                use = slice(lo, hi)
                places = _ranges(np.stack([own[use], first[use]], 1).reshape(-1), np.stack([k[use], last[use] - first[use]], 1).reshape(-1))
                offsets = pa.array(np.r_[0, np.cumsum(size[use])].astype(np.int32))
                out = [pa.ListArray.from_arrays(offsets, pa.array(c[places])) for c in columns]
                start = np.where(apart[use] > 0, k[use], 0)
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)) for c in (block[use], k[use], start)] + out, ["block", "k", "start", "item", *held])

    return run


def _sum(held: list[str], finish: Callable | None) -> Callable:
    """Sums by pair of the rows of ``_deal``, sorted by block, or what ``finish`` makes of them."""
    names = ["i", "j", "n_both", *(["dot"] if "rating" in held else []), *(f"{c}_{e}" for c in held if c != "rating" for e in "ij")]
    numbers = [x for x, c in enumerate(held) if c != "rating"]
    rating = held.index("rating") if "rating" in held else None

    def sums(rows: list[tuple]) -> Iterator[list[np.ndarray]]:
        """The sums of some rows, all of an item i in one part."""
        k, start, size = (np.concatenate(x) for x in list(zip(*rows, strict=True))[:3])
        item, *values = (np.concatenate(x) for x in list(zip(*rows, strict=True))[3:])
        ids, index, code = np.unique(item, return_index=True, return_inverse=True)
        end = np.cumsum(size)
        own = _ranges(end - size, k)
        row = np.repeat(np.arange(len(k)), k)
        first = np.maximum(own + 1, (end - size + start)[row])
        count = end[row] - first
        order = np.argsort(code[own], kind="stable")
        own, first, count = own[order], first[order], count[order]
        upto = np.cumsum(count)
        # parts end where an item ends
        heads = np.flatnonzero(np.diff(code[own], prepend=-1))
        before = (upto - count)[heads] // _PAIRS
        cuts = np.r_[heads[np.flatnonzero(np.diff(before, prepend=-1))], len(own)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            a, b = np.repeat(own[lo:hi], count[lo:hi]), _ranges(first[lo:hi], count[lo:hi])
            key = code[a] * len(ids) + code[b]
            if rating is None:
                key = np.sort(key[code[a] < code[b]])
            else:
                product = values[rating][a] * values[rating][b]
                use = np.flatnonzero(code[a] < code[b])
                use = use[np.argsort(key[use], kind="stable")]
                key, product = key[use], product[use]
            if not len(key):
                continue
            head = np.flatnonzero(np.diff(key, prepend=-1))
            i, j = np.divmod(key[head], len(ids))
            out = [ids[i], ids[j], np.diff(np.r_[head, len(key)])]
            if rating is not None:
                out.append(np.add.reduceat(product, head))
            yield out + [values[x][index[e]] for x in numbers for e in (i, j)]

    def merged(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
        columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
        order = np.lexsort(columns[1::-1])
        columns = [c[order] for c in columns]
        head = np.flatnonzero(np.r_[True, (np.diff(columns[0]) != 0) | (np.diff(columns[1]) != 0)])
        added = 3 if rating is None else 4
        return [np.add.reduceat(c, head) if 2 <= x < added else c[head] for x, c in enumerate(columns)]

    def block(found: Iterator[tuple]) -> Iterator[list[np.ndarray]]:
        rows, parts, entries = [], [], 0
        for row in found:
            rows.append(row)
            entries += len(row[3])
            if entries >= _ENTRIES:
                # more than a task should hold: sums so far, added up with the later ones
                done = list(sums(rows))
                parts = [merged(parts + done)] if parts or done else []
                rows, entries = [], 0
        if not parts:
            yield from sums(rows) if rows else ()
        else:
            yield merged(parts + (list(sums(rows)) if rows else []))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple]]:
        for batch in batches:
            if not batch.num_rows:
                continue
            number, k, start = (batch.column(c).to_numpy() for c in ("block", "k", "start"))
            cuts = batch.column("item").offsets.to_numpy()
            values = [batch.column(c).values.to_numpy() for c in ("item", *held)]
            ends = np.r_[0, np.flatnonzero(np.diff(number)) + 1, len(number)]
            for lo, hi in zip(ends[:-1], ends[1:], strict=True):
                yield number[lo], (k[lo:hi].astype(np.int64), start[lo:hi].astype(np.int64), np.diff(cuts[lo : hi + 1]).astype(np.int64), *(v[cuts[lo] : cuts[hi]] for v in values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in groupby(pieces(batches), key=lambda x: x[0]):
            for columns in block(row for _, row in found):
                out = dict(zip(names, columns, strict=True))
                out = out if finish is None else finish(out)
                for lo in range(0, len(next(iter(out.values()))), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + (1 << 16)]) for c in out.values()], list(out))

    return run


@dataclass(frozen=True)
class _Maths:
    """What formulas need of the kind of values that they take."""

    double: Callable
    sqrt: Callable
    positive: Callable
    xlogx: Callable


@cache
def _xlogx_table() -> np.ndarray:
    return np.array([0.0, *(x * math.log(x) for x in range(1, _LOGS))])


def _xlogx(x: np.ndarray) -> np.ndarray:
    """x ln x of whole numbers, 0 for those not above 0."""
    out, large = _xlogx_table()[np.clip(x, 0, _LOGS - 1).astype(np.int64)], x >= _LOGS
    return np.where(large, x * np.log(np.maximum(x, 1.0)), out) if np.any(large) else out


_OF_COLUMNS = _Maths(lambda x: x.cast("double"), F.sqrt, lambda x: F.greatest(x, F.lit(0.0)), lambda x: F.when(x > 0, x * F.log(x)).otherwise(0.0))
_OF_ARRAYS = _Maths(lambda x: x.astype(np.float64), np.sqrt, lambda x: np.maximum(x, 0.0), _xlogx)


def _formula(measure: str, dot, both, a: dict, b: dict, n, maths: _Maths):
    """The similarity, of columns or of arrays."""
    if measure == "euclidean":
        return 1.0 / (1.0 + maths.sqrt(maths.positive(a["l2sq"] - 2 * dot + b["l2sq"])))
    if measure in ("cosine", "pearson"):
        return dot
    both = maths.double(both)
    if measure == "cooccurrence":
        return both
    na, nb = maths.double(a["nnz"]), maths.double(b["nnz"])
    if measure == "tanimoto":
        return both / (na + nb - both)
    if measure == "cityblock":
        return 1.0 / (1.0 + na + nb - 2 * both)

    def entropy(*counts, total):
        """Unnormalised: x ln x of the total of the counts, less that of each."""
        out = maths.xlogx(total)
        for c in counts:
            out = out - maths.xlogx(c)
        return out

    k11, k12, k21, k22 = both, nb - both, na - both, n - na - nb + both
    # sums of whole numbers: k11 + k12 is nb, and so on
    ratio = 2.0 * (entropy(nb, n - nb, total=n) + entropy(na, n - na, total=n) - entropy(k11, k12, k21, k22, total=n))
    return 1.0 - 1.0 / (1.0 + maths.positive(ratio))


#: What a formula takes of both items.
_NUMBERS = {"euclidean": ["l2sq"], "tanimoto": ["nnz"], "cityblock": ["nnz"], "loglikelihood": ["nnz"]}


def _with_numbers(values: DataFrame, ratings: DataFrame, numbers: list[str]) -> DataFrame:
    """``values`` with numbers of ``item_stats`` of ``ratings``."""
    return values.join(small(store(item_stats(ratings).select("item", *numbers))), "item") if numbers else values


def _value(measure: str) -> Column:
    numbers = lambda e: {c: F.col(f"{c}_{e}") for c in _NUMBERS.get(measure, [])}
    n = F.col("n_users").cast("double") if measure == "loglikelihood" else F.lit(0.0)
    dot = F.lit(0.0) if MEASURES[measure].counts else F.col("dot")
    return _formula(measure, dot, F.col("n_both"), numbers("i"), numbers("j"), n, _OF_COLUMNS)


def _value_of(measure: str, pairs: dict[str, np.ndarray], n_users: int) -> np.ndarray:
    """``_value`` of arrays."""
    numbers = lambda e: {c: pairs[f"{c}_{e}"] for c in _NUMBERS.get(measure, [])}
    return _formula(measure, pairs.get("dot"), pairs["n_both"], numbers("i"), numbers("j"), np.float64(n_users), _OF_ARRAYS)


def _kept(value: np.ndarray, threshold: float | None) -> np.ndarray:
    # not a number is above all numbers, as Spark has it
    return np.isnan(value) | (value > 0 if threshold is None else value >= threshold)


def _totalled(measures: list[str], n_users: int) -> Callable:
    """For ``_pairs``: (measure, i, total, n_both) of the pairs of positive similarity."""

    def finish(pairs: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        head = np.flatnonzero(np.r_[True, pairs["i"][1:] != pairs["i"][:-1]])
        found = []
        for m in measures:
            value = _value_of(m, pairs, n_users)
            use = _kept(value, None)
            some = np.flatnonzero(np.logical_or.reduceat(use, head))
            total, both = (np.add.reduceat(np.where(use, x, x.dtype.type(0)), head)[some] for x in (value, pairs["n_both"]))
            found.append((np.full(len(some), m), pairs["i"][head[some]], total, both))
        return {c: np.concatenate(x) for c, x in zip(("measure", "i", "total", "n_both"), zip(*found, strict=True), strict=True)}

    return finish


def totals(ratings: DataFrame, measures: list[str]) -> DataFrame:
    """(measure, i, total, n_both) over all items j > i of positive similarity; the pairs are found once for all measures.

    For measures that take ratings as they are.
    """
    if any(MEASURES[m].scale != "identity" for m in measures):
        raise ValueError("measures must take the same ratings")
    ratings = store(ratings.select("user", "item", "rating"))
    held, n_users = ["rating", "nnz", "l2sq"], user_count(ratings).first().n_users
    values = _with_numbers(ratings, ratings, held[1:])
    if _by_block(values, held):
        return _pairs(values, held, _totalled(measures, n_users), "measure string, i long, total double, n_both long")
    pairs = _pairs(values, held).withColumn("n_users", F.lit(n_users))
    pairs = pairs.select("i", "n_both", *(_value(m).alias(m) for m in measures))
    sums = [f(F.when(F.col(m) > 0, c)).alias(f"{m}_{name}") for m in measures for name, f, c in (("total", F.sum, F.col(m)), ("both", F.sum, F.col("n_both")))]
    each = [F.struct(F.lit(m).alias("measure"), F.col(f"{m}_total").alias("total"), F.col(f"{m}_both").alias("n_both")) for m in measures]
    rows = pairs.groupBy("i").agg(*sums).select("i", F.explode(F.array(*each)).alias("x"))
    return rows.select("x.measure", "i", "x.total", "x.n_both").where("n_both is not null")


def _top(i: np.ndarray, value: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest values of each run of equal i, in order; ties to the first."""
    if not len(i) or np.isnan(value).any():
        return np.arange(len(i))
    value = value + 0.0
    head = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
    size = np.diff(np.r_[head, len(i)])
    run = np.repeat(np.arange(len(head)), size)
    # few can be among them: as floats of 32 bits, turned into whole numbers of reverse order, up to the k-th
    with np.errstate(over="ignore"):
        bits = value.astype(np.float32).view(np.uint32)
    place = np.where(bits >> 31, bits, np.uint32(0x7FFFFFFF) - bits)
    key = np.sort((run.astype(np.uint64) << np.uint64(32)) | place)
    last = key[head + np.minimum(k, size) - 1].astype(np.uint32)
    use = np.flatnonzero(place <= last[run])
    use = use[np.lexsort((-value[use], run[use]))]
    first = np.flatnonzero(np.diff(run[use], prepend=-1))
    rank = np.arange(len(use)) - np.repeat(first, np.diff(np.r_[first, len(use)]))
    return np.sort(use[rank < k])


def _most_similar(measure: str, threshold: float | None, n_users: int, k: int) -> Callable:
    """For ``_pairs``: (i, j, n_both, similarity) of the k most similar items j of each i."""

    def finish(pairs: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        value = _value_of(measure, pairs, n_users)
        use = np.flatnonzero(_kept(value, threshold))
        use = use[_top(pairs["i"][use], value[use], k)]
        return {c: pairs[c][use] for c in ("i", "j", "n_both")} | {"similarity": value[use].astype(np.float64)}

    return finish


def similarities(ratings: DataFrame, measure: str = "euclidean", *, threshold: float | None = None, min_both: int = 1, symmetric: bool = False, as_coded: bool = False, most: int | None = None) -> DataFrame:
    """(i, j, similarity) of pairs of items with common users; i < j unless ``symmetric``.

    Without a threshold similarities must be positive. A threshold also prunes pairs whose counts
    cannot reach it. ``as_coded`` leaves cosine and pearson without their normalisation. ``most``: for a
    ``top_k`` of so many, pairs that it would not keep may be left out.
    """
    if measure not in MEASURES:
        raise ValueError(f"unknown measure: {measure}")
    how = MEASURES[measure]
    # far smaller than its pairs, and read for counts, statistics and lists
    ratings = store(ratings.select("user", "item", "rating"))
    numbers = _NUMBERS.get(measure, [])
    held = ([] if how.counts else ["rating"]) + numbers
    values = _with_numbers(ratings if as_coded else scaled(ratings, how.scale), ratings, numbers)
    n_users = user_count(ratings).first().n_users if measure == "loglikelihood" else 0
    if most is not None and min_both == 1 and not symmetric and _by_block(values, held):
        return _pairs(values, held, _most_similar(measure, threshold, n_users, most), "i long, j long, n_both long, similarity double")
    pairs = _pairs(values, held)
    if min_both > 1:
        pairs = pairs.where(F.col("n_both") >= min_both)
    if measure == "tanimoto" and threshold is not None:
        # at most the smaller count can be common
        pairs = pairs.where(F.least("nnz_i", "nnz_j") >= threshold * F.greatest("nnz_i", "nnz_j"))
    if measure == "loglikelihood":
        # a literal: as a joined row the filter below would become a join condition, too long to be compiled
        pairs = pairs.withColumn("n_users", F.lit(n_users))
    out = pairs.select("i", "j", "n_both", _value(measure).alias("similarity"))
    out = out.where(F.col("similarity") > 0) if threshold is None else out.where(F.col("similarity") >= threshold)
    if symmetric:
        out = out.unionByName(out.select(F.col("j").alias("i"), F.col("i").alias("j"), "n_both", "similarity"))
    return out


def top_k(similar: DataFrame, k: int = 100) -> DataFrame:
    """The k most similar items of each item, ties to smaller items, with their rank."""
    order = Window.partitionBy("i").orderBy(F.desc("similarity"), "j")
    return similar.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
