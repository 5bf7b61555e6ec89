"""Exact top-k search by exhaustive term-at-a-time accumulation.

Queries are taken in blocks of ``block`` vectors, the only data that every executor holds. Each
pass reads all candidates: a task turns some thousand of them into postings (component, rows,
weights); for each component in turn the queries that have it scatter weight times postings into
dense arrays of integer scores. A partition around the k-th score selects; selections merge within
the task, then by query over all tasks.

Defined results: vectors that are null or hold null or non-finite components take no part; missing
trailing components count as zero; all rows with the query's id are its own and never answer it;
repeated candidate rows each answer; a query id with several vectors asks with the least of them; scores
that might not fit in 64 bits are an error, never a wrong number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.llm._store import stash

_CANDIDATES, _QUERIES = 4096, 64
#: Above this share of rows a component's postings are held as a dense row, zeros included.
_DENSE = 0.25


def _matrix(values: pa.ListArray) -> np.ndarray:
    """Vectors as rows, short ones padded by zeros."""
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    count = np.diff(values.offsets.to_numpy())
    width = int(count.max()) if len(count) else 0
    if len(count) and (count == width).all():
        return flat.reshape(len(count), width)
    out = np.zeros((len(count), width), np.int64)
    out[np.repeat(np.arange(len(count)), count), np.concatenate([np.arange(c) for c in count] or [np.zeros(0, np.int64)])] = flat
    return out


def _accumulate(q: np.ndarray, x: np.ndarray, kind: type) -> np.ndarray:
    """Scores of queries (rows of ``q``) against candidates (rows of ``x``), component by component."""
    scores = np.zeros((len(q), len(x)), kind)
    room = np.empty_like(scores)
    for d in range(min(q.shape[1], x.shape[1])):
        asks, posting = q[:, d].astype(kind), x[:, d]
        who = np.flatnonzero(asks)
        rows = np.flatnonzero(posting)
        if not len(who) or not len(rows):
            continue
        if len(rows) < _DENSE * len(x):
            scores[np.ix_(who, rows)] += np.multiply.outer(asks[who], posting[rows].astype(kind))
        elif len(who) == len(q):
            np.multiply.outer(asks, posting.astype(kind), out=room)
            scores += room
        else:
            scores[who] += np.multiply.outer(asks[who], posting.astype(kind))
    return scores


def _best(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k highest scores of each query, ties to smaller ids."""
    order = np.lexsort((ids, -scores, query))
    query, ids, scores = query[order], ids[order], scores[order]
    head = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.zeros(0, np.int64)
    rank = np.arange(len(query)) - np.repeat(head, np.diff(np.r_[head, len(query)]))
    keep = rank < k
    return query[keep], ids[keep], scores[keep]


def _search(shared, k: int) -> Callable:
    def block(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, ...]:
        bound = int(np.abs(q).max(initial=0)) * int(np.abs(x).max(initial=0)) * max(1, q.shape[1])
        if bound >= 2**63 - 1:
            raise OverflowError("inner products beyond 64 bits: choose a smaller scale")
        kind = np.int32 if bound < 2**31 - 1 else np.int64
        least = np.iinfo(kind).min
        parts = []
        for lo in range(0, len(q), _QUERIES):
            scores = _accumulate(q[lo : lo + _QUERIES], x, kind)
            scores[q_ids[lo : lo + _QUERIES, None] == ids[None, :]] = least
            if len(ids) > k:
                limit = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k]
                who, what = np.nonzero((scores >= limit[:, None]) & (scores > least))
            else:
                who, what = np.nonzero(scores > least)
            parts.append(_best(who + lo, ids[what], scores[who, what].astype(np.int64), k))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q = shared.value
        have = (np.zeros(0, np.int64),) * 3
        for batch in batches:
            ids, vectors = batch.column("__id").to_numpy(), batch.column("__v")
            for lo in range(0, batch.num_rows, _CANDIDATES):
                new = block(q_ids, q, ids[lo : lo + _CANDIDATES], _matrix(vectors.slice(lo, _CANDIDATES)))
                have = _best(*(np.concatenate(x) for x in zip(have, new, strict=True)), k)
        yield pa.RecordBatch.from_arrays([pa.array(q_ids[have[0]]), pa.array(have[1]), pa.array(have[2])], ["query_id", "vec_id", "score"])

    return run


def quantised(vector: Column, scale: float) -> Column:
    """floor(scale * component), as double; null where the vector can't take part."""
    doubles = vector.cast("array<double>")
    usable = vector.isNotNull() & F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(usable, F.transform(doubles, lambda x: F.floor(x * scale).cast("long")))


def _blocks(queries: DataFrame, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    held: list = []

    def made() -> tuple[np.ndarray, np.ndarray]:
        return np.array([r[0] for r in held], np.int64), _matrix(pa.array([r[1] for r in held], pa.list_(pa.int64())))

    for row in queries.toLocalIterator():
        held.append(row)
        if len(held) == size:
            yield made()
            held = []
    if held:
        yield made()


def topk(vectors: DataFrame, queries: DataFrame, *, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 4096) -> DataFrame:
    """Each query's ``k`` candidates of the highest integer inner product: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession

    def usable(df: DataFrame) -> DataFrame:
        return df.select(F.col(id_col).alias("__id"), quantised(F.col(vector_col), scale).alias("__v")).where("__id is not null and __v is not null")

    candidates = usable(vectors)
    asks = usable(queries).groupBy("__id").agg(F.min("__v").alias("__v"))
    found, several = None, False
    for part in _blocks(asks, block):
        shared = spark.sparkContext.broadcast(part)
        some = candidates.mapInArrow(_search(shared, k), "query_id long, vec_id long, score long")
        if found is not None:
            found = stash(found, "topk") if not several else found
            some, several = stash(some, "topk"), True
            shared.unpersist()
        found = some if found is None else found.unionByName(some)
    if found is None:
        found = spark.createDataFrame([], "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
