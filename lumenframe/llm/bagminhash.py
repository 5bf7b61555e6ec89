"""Near duplicates by BagMinHash: weighted MinHash of multisets of word shingles.

Each shingle with count c owns the unit cells 0 to c-1 of a weight axis. Cells come in dyadic
blocks; a block is one Poisson process in time of a rate equal to its width, whose points fall on
a random cell and a random component of the signature. A component keeps the earliest point on a
cell that the text has, so two texts agree in it with the probability of their weighted Jaccard
similarity. Points are made only up to a time by which all components are filled, about
m (ln m + 5) points for a text of any length.

1. Equal texts are one node. Signatures are cut into bands; nodes that agree in a band share a
   bucket. Each bucket names one node, another in each band, for its others to pair with.
2. Of the pairs whose signatures agree enough each node's best few are verified on the texts'
   shingles; they connect most of each component.
3. Buckets that still hold several components compare the nodes outside the largest with all
   others, block by block, by signature; of the pairs that could reach the threshold a block gives
   only a spanning forest, which puts every such pair in one group. Groups of several components
   are compared block by block on their shingles, as matrix products, and give only a spanning
   forest of the links. So a link between nodes of a bucket is never lost, and pairs are never
   written out. Blocks are bounded in rows and bytes.

Components are found by hooking to lower neighbours and pointer jumping; each task reduces what it
holds to stars.

Defined results: texts without words are classes of their own; a text of fewer words than a
shingle is one shingle; a row's class id is the least id in its class (null if all are null);
nodes are told apart by 64 bits of hash. At similarity 0.8 a pair of texts misses all 32 bands
of 4 with probability 5e-8; at 0.8 exactly a pair is dropped by its signatures with less than 1e-6.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.llm import _text as tx
from lumenframe.llm._store import few, stash

COMPONENTS, BANDS = 128, 32
#: Components that must agree for a pair to be verified: over five deviations below 0.8 of all.
AGREEING = 77
#: Bits of the filter of nodes with company, at most, as a power of two; beyond it more texts get bags than need them.
_FILTER_LOG2 = 28
#: Nodes, and bytes of signatures or bags, of a block.
_BLOCK, _BLOCK_BYTES = 256, 1 << 20
#: Columns of the matrices that blocks are compared by.
_COLUMNS = 4096
#: Pairs of a node that are verified first.
_FIRST = 3
#: Edges that a task holds before it reduces them.
_HELD = 1 << 18
_GOLDEN = 0x9E3779B97F4A7C15


def shingles(text: tx.Column, lo: int, hi: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each shingle of rows ``lo`` to ``hi``, repeats included."""
    w = tx.words(text, lo, hi, tx.byte_classes())
    count = np.diff(w.first)
    rows, hashes = [], []
    if len(w.row) >= size:
        inside = tx.within_row(w.row, size)
        rows.append(w.row[: len(inside)][inside])
        hashes.append(tx.windows(w.hash, size)[inside])
    for n in range(1, size):
        short = np.flatnonzero(count == n)
        if len(short):
            rows.append(short)
            hashes.append(tx.windows(w.hash, n)[w.first[short]])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(rows), np.concatenate(hashes)


def counted(row: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row, with counts."""
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    head = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])]) if len(row) else np.zeros(0, np.int64)
    return row[head], hashes[head], np.diff(np.r_[head, len(row)])


def signatures(row: np.ndarray, hashes: np.ndarray, count: np.ndarray, n: int, m: int = COMPONENTS) -> np.ndarray:
    """BagMinHash signatures (times as 64-bit hashes) of ``n`` multisets; rows without shingles stay 0."""
    total = np.bincount(row, count, n)
    limit = m * (np.log(m) + 5) / np.maximum(total, 1)
    best = np.full(n * m, np.inf)
    todo = total > 0
    while todo.any():
        use = todo[row]
        r, h, c = row[use], hashes[use], count[use]
        blocks = np.where(c == 1, 1, np.floor(np.log2(np.maximum(c - 1, 1))).astype(np.int64) + 2)
        e = np.repeat(np.arange(len(r)), blocks)
        block = np.arange(len(e)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = np.where(block == 0, 0, 1 << np.maximum(block - 1, 0))
        width = np.where(block == 0, 1, start)
        r, c = r[e], c[e]
        seed = tx.mix(h[e] + (block + 1).astype(np.uint64) * np.uint64(_GOLDEN))
        time, step = np.zeros(len(e)), 0
        while len(seed):
            step += 1
            point = tx.mix(seed + np.uint64(step * 0xD1B54A32D192ED03 % (1 << 64)))
            time = time - np.log(((point >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) / width
            live = time <= limit[r]
            seed, time, r, c, start, width, point = seed[live], time[live], r[live], c[live], start[live], width[live], point[live]
            place = tx.mix(point ^ np.uint64(_GOLDEN))
            cell = start + ((place & np.uint64(0xFFFFFFFF)).astype(np.float64) / (1 << 32) * width).astype(np.int64)
            mine = cell < c
            component = ((place >> np.uint64(32)) % np.uint64(m)).astype(np.int64)
            np.minimum.at(best, (r * m + component)[mine], time[mine])
        table = best.reshape(n, m)
        todo &= np.isinf(table).any(1)
        limit[todo] *= 2
    table = best.reshape(n, m)
    out = tx.mix(table.view(np.uint64))
    out[total == 0] = 0
    return out


def _sign(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, signed = tx.column(batch.column("__text")), []
            has = np.zeros(batch.num_rows, bool)
            for lo, hi in tx.chunks(text):
                row, h, c = counted(*shingles(text, lo, hi, size))
                has[lo + row] = True
                short = (signatures(row, h, c, hi - lo) >> np.uint64(48)).astype(np.uint16)
                signed += [x.tobytes() for x in short]
            node = pa.array(batch.column("__node").to_numpy(), mask=~has)
            yield pa.RecordBatch.from_arrays([batch.column("__id"), node, pa.array([s if ok else None for s, ok in zip(signed, has, strict=True)], pa.binary())], ["__id", "node", "sig"])

    return run


def _signature_rows(column: pa.Array) -> np.ndarray:
    col = tx.column(column)
    return np.frombuffer(col.data[col.offsets[0] : col.offsets[-1]].tobytes(), np.uint16).reshape(-1, COMPONENTS)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = _signature_rows(batch.column("sig")).astype(np.uint64).reshape(batch.num_rows, BANDS, -1)
        key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(_GOLDEN), (batch.num_rows, BANDS))
        for j in range(sig.shape[2]):
            key = tx.mix(key ^ sig[:, :, j])
        yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(np.repeat(batch.column("node").to_numpy(), BANDS))], ["key", "node"])


def _agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many components each pair's signatures share; pairs of too few go."""
    for batch in batches:
        if not batch.num_rows:
            continue
        same = (_signature_rows(batch.column("sig_a")) == _signature_rows(batch.column("sig_b"))).sum(1)
        keep = np.flatnonzero(same >= AGREEING)
        yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(keep)), batch.column("b").take(pa.array(keep)), pa.array(same[keep].astype(np.int32))], ["a", "b", "same"])


def _multisets(packed, size: int) -> Callable:
    """Bags, sorted 64-bit shingle hashes, of the texts whose nodes have company."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = tx.BitSet.read(packed.value)
        for batch in batches:
            text, node = tx.column(batch.column("__text")), batch.column("__node").to_numpy()
            first = np.zeros(len(node), bool)
            first[np.unique(node, return_index=True)[1]] = True
            use = wanted.has(node.view(np.uint64)) & first
            for lo, hi in tx.chunks(text):
                if not use[lo:hi].any():
                    continue
                row, h = shingles(text, lo, hi, size)
                keep = use[lo + row]
                row, h = row[keep], h[keep]
                order = np.lexsort((h, row))
                row, h = row[order], h[order]
                at = np.searchsorted(row, np.arange(hi - lo + 1))
                has = np.flatnonzero(use[lo:hi])
                yield pa.RecordBatch.from_arrays([pa.array(node[lo + has]), pa.array([h[at[i] : at[i + 1]].tobytes() for i in has], pa.binary())], ["node", "bag"])

    return run


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted multisets of 64-bit values."""
    (a_value, a_count), (b_value, b_count) = (np.unique(x, return_counts=True) for x in (a, b))
    _, i, j = np.intersect1d(a_value, b_value, assume_unique=True, return_indices=True)
    both = int(np.minimum(a_count[i], b_count[j]).sum())
    return both / max(1, len(a) + len(b) - both)


def distinct(values: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Multisets (sorted by row and value) as sets: the k-th repeat of a value is a value of its own."""
    new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (values[1:] != values[:-1])]) if len(row) else np.zeros(0, np.int64)
    nth = (np.arange(len(row)) - np.repeat(new, np.diff(np.r_[new, len(row)]))).astype(np.uint64)
    return np.where(nth == 0, values, tx.mix(values + nth * np.uint64(_GOLDEN)))


class _Binary(NamedTuple):
    """A binary column of 64-bit values; ``of(i)`` is row ``i``."""

    values: np.ndarray
    at: np.ndarray

    @classmethod
    def read(cls, array: pa.Array) -> _Binary:
        col = tx.column(array)
        return cls(col.data[col.offsets[0] : col.offsets[-1]].view(np.uint64), (col.offsets - col.offsets[0]) // 8)

    def of(self, i: int) -> np.ndarray:
        return self.values[self.at[i] : self.at[i + 1]]


def _verified(threshold: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = _Binary.read(batch.column("bag_a")), _Binary.read(batch.column("bag_b"))
            n, m = np.diff(a.at), np.diff(b.at)
            near = np.flatnonzero(np.minimum(n, m) >= threshold * np.maximum(n, m) - 1e-9)
            at = pa.array([i for i in near if similarity(a.of(i), b.of(i)) >= threshold - 1e-12], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at)], ["a", "b"])

    return run


class _Block(NamedTuple):
    """Some nodes with labels, signatures and, where they are needed, bags."""

    node: np.ndarray
    label: np.ndarray
    sig: np.ndarray
    bags: _Binary | None


def _blocks(column: pa.ListArray) -> list[_Block]:
    """The blocks of a column of arrays of structs, as views of its buffers."""
    held, cuts = column.values, column.offsets.to_numpy()
    node, label = held.field("node").to_numpy(), held.field("label").to_numpy()
    sig = _signature_rows(held.field("sig"))
    bags = _Binary.read(held.field("bag")) if held.type.get_field_index("bag") >= 0 else None
    return [_Block(node[lo:hi], label[lo:hi], sig[lo:hi], bags and _Binary(bags.values, bags.at[lo : hi + 1])) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]


def _forest(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels of the rows and columns of a bipartite graph, the least row of each component; -1 without links."""
    n = len(links)
    rows = np.where(links.any(1), np.arange(n), n)
    while True:
        columns = np.where(links, rows[:, None], n).min(0, initial=n)
        new = np.minimum(rows, np.where(links, columns[None, :], n).min(1, initial=n))
        if (new == rows).all():
            return np.where(rows < n, rows, -1), np.where(columns < n, columns, -1)
        rows = new


def _could_link(a: _Block, b: _Block) -> np.ndarray:
    """Which pairs of two blocks are of different labels and agree enough."""
    out = a.label[:, None] != b.label[None, :]
    for i in range(len(out)):
        out[i] &= (b.sig == a.sig[i]).sum(1) >= AGREEING
    return out


def overlaps(a: _Binary, b: _Binary) -> np.ndarray:
    """Sizes of the multiset intersections of each bag of ``a`` with each of ``b``, as products of incidence matrices."""
    rows = [np.repeat(np.arange(len(c.at) - 1), np.diff(c.at)) for c in (a, b)]
    bags = [distinct(c.values[c.at[0] : c.at[-1]], row) for c, row in zip((a, b), rows, strict=True)]
    common = np.intersect1d(*bags)
    out = np.zeros((len(a.at) - 1, len(b.at) - 1), np.float32)
    sides = []
    for values, row, n in zip(bags, rows, out.shape, strict=True):
        at = np.minimum(np.searchsorted(common, values), max(0, len(common) - 1))
        hit = np.flatnonzero(common[at] == values) if len(common) else np.zeros(0, np.int64)
        order = hit[np.argsort(at[hit], kind="stable")]
        sides.append((at[order], row[order], n))
    for lo in range(0, len(common), _COLUMNS):
        parts = []
        for at, row, n in sides:
            i, j = np.searchsorted(at, (lo, lo + _COLUMNS))
            part = np.zeros((n, min(_COLUMNS, len(common) - lo)), np.float32)
            part[row[i:j], at[i:j] - lo] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out


def _links(threshold: float) -> Callable:
    """Which pairs of two blocks are links between labels, on their bags."""

    def links(a: _Block, b: _Block) -> np.ndarray:
        both = overlaps(a.bags, b.bags).astype(np.float64)
        sizes = np.diff(a.bags.at)[:, None] + np.diff(b.bags.at)[None, :]
        return (a.label[:, None] != b.label[None, :]) & (both >= (threshold - 1e-12) * (sizes - both))

    return links


def _span(links: Callable[[_Block, _Block], np.ndarray]) -> Callable:
    """A spanning forest of what ``links`` finds between two blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ends: list[list[np.ndarray]] = [[], []]
            for a, b in zip(_blocks(batch.column("left")), _blocks(batch.column("right")), strict=True):
                rows, columns = _forest(links(a, b))
                for nodes, label in ((a.node, rows), (b.node, columns)):
                    use = (label >= 0) & (nodes != a.node[np.maximum(label, 0)])
                    ends[0].append(nodes[use])
                    ends[1].append(a.node[label[use]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ends], ["a", "b"])

    return run


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Components of a graph as pairs of a node and the least node of its component, without the least nodes' own."""
    ids, at = np.unique(np.r_[a, b], return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    top = np.arange(len(ids))
    while True:
        low, high = np.minimum(top[a], top[b]), np.maximum(top[a], top[b])
        if (low == high).all():
            own = np.flatnonzero(top != np.arange(len(ids)))
            return ids[own], ids[top[own]]
        np.minimum.at(top, high, low)
        while (top[top] != top).any():
            top = top[top]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The components of a task's own edges (each row joins all its nodes) as stars (u, v) around their least nodes v."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        nodes = [c.to_numpy() for c in batch.columns]
        for one, other in zip(nodes[:-1], nodes[1:], strict=True):
            held.append((one, other))
            size += len(one)
        if size >= _HELD:
            u, v = stars(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held, size = [(u, v)], len(u)
            if size >= _HELD // 2:
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
                held, size = [], 0
    if held:
        u, v = stars(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def star_rows(rows: DataFrame, find: Callable | None = None) -> DataFrame:
    """Each task's edges as stars (u, v); ``find`` makes the edges of ``rows`` first, in the same Python worker."""
    return rows.mapInArrow((lambda batches: _stars(find(batches))) if find else _stars, "u long, v long")


def components(now: DataFrame) -> DataFrame:
    """(node, label) of the nodes of an undirected graph given as ``star_rows``, but for those that are their own labels.

    A label is the least node of its component. Each round gives every node its least lower
    neighbour's least lower neighbour, and joins all its neighbours to that; each task reduces what it
    has to stars before and after. A node has at first a row of each task that holds it. So tasks that read
    the rows of several reduce them again, and equal rows count once, before any join by node.
    """
    now = stash(star_rows(stash(now, "cc")).distinct(), "cc")
    while True:
        lower = now.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("most"))
        above = lower.select(F.col("u").alias("m"), F.col("m").alias("w"))
        found = stash(lower.join(above, "m", "left").select("u", F.coalesce("w", "m").alias("root"), (F.col("w").isNotNull() | (F.col("most") > F.col("m"))).alias("busy")), "cc")
        if found.where("busy").isEmpty():
            return found.select(F.col("u").alias("node"), F.col("root").alias("label"))
        now = stash(star_rows(now.join(found, "u").select("u", "v", "root")), "cc")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """Returns for each row of ``docs`` its id, ``text_hash`` and ``class_hash`` (null without words), ``class_id`` and ``class_size`` (rows in its class)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.col(id_col).alias("__id"), F.xxhash64(text).alias("__node"), text.alias("__text"))
    id_type = source.schema["__id"].dataType.simpleString()
    signed = stash(source.mapInArrow(_sign(shingle), f"__id {id_type}, node long, sig binary"), "signatures")
    nodes = signed.where("node is not null").groupBy("node").agg(F.first("sig").alias("sig"))
    bands = stash(nodes.mapInArrow(_bands, "key long, node long"), "bands")
    # the node a bucket names is the least under an order of the bucket's own
    named = bands.groupBy("key").agg(F.min(F.expr("node ^ key")).alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = stash(bands.join(named.select("key", F.expr("least ^ key").alias("head")), "key"), "buckets")
    company = stash(nodes.join(shared.select("node").distinct(), "node", "left_semi"), "company")

    packed = spark.sparkContext.broadcast(tx.collect_bits(company, "node", tx.bits_for(company.count(), _FILTER_LOG2)))
    bags = source.select("__node", "__text").mapInArrow(_multisets(packed, shingle), "node long, bag binary")
    bags = stash(bags.groupBy("node").agg(F.first("bag").alias("bag")), "bags")

    def with_bags(pairs: DataFrame) -> DataFrame:
        one = pairs.select("a", "b").join(bags.select(F.col("node").alias("a"), F.col("bag").alias("bag_a")), "a")
        return one.join(bags.select(F.col("node").alias("b"), F.col("bag").alias("bag_b")), "b").select("a", "b", "bag_a", "bag_b")

    pairs = shared.where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct()
    rated = pairs.join(company.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), "a").join(company.select(F.col("node").alias("b"), F.col("sig").alias("sig_b")), "b")
    rated = rated.select("a", "b", "sig_a", "sig_b").mapInArrow(_agree, "a long, b long, same int")
    order = Window.partitionBy("a").orderBy(F.desc("same"), "b")
    best = stash(rated.withColumn("place", F.row_number().over(order)).where(F.col("place") <= _FIRST).select("a", "b"), "pairs")
    labels = components(star_rows(with_bags(best), _verified(threshold)))

    def labelled(rows: DataFrame) -> DataFrame:
        return rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))

    # groups of several components: the nodes outside the largest against all, in blocks of a bounded size
    def mixed(rows: DataFrame, by: str, held: DataFrame, size: Column) -> DataFrame:
        sized = rows.join(held, "node").withColumn("bytes", size)
        sizes = sized.groupBy(by, "label").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
        several = sizes.groupBy(by).agg(F.max(F.struct("n", "label", "bytes")).alias("most"), F.count(F.lit(1)).alias("labels"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
        blocks = lambda n, size: F.greatest(F.ceil(n / _BLOCK), F.ceil(size / _BLOCK_BYTES))
        several = several.where("labels > 1").select(
            by,
            F.col("most.label").alias("largest"),
            blocks(F.col("n"), F.col("bytes")).alias("all_blocks"),
            blocks(F.col("n") - F.col("most.n"), F.col("bytes") - F.col("most.bytes")).alias("asking_blocks"),
        )
        return stash(sized.join(several, by).drop("bytes"), "mixed")

    def pairs_of_blocks(rows: DataFrame, by: str, *held: str) -> DataFrame:
        def blocks(some: DataFrame, count: str, name: str) -> DataFrame:
            return some.groupBy(by, F.pmod(F.xxhash64("node", F.lit(count)), F.col(count)).alias("salt")).agg(F.collect_list(F.struct("node", "label", *held)).alias(name)).drop("salt")

        return blocks(rows.where("label <> largest"), "asking_blocks", "left").join(blocks(rows, "all_blocks", "right"), by).select("left", "right")

    unsettled = mixed(labelled(shared.select("key", "node")), "key", company, F.length("sig"))
    groups = components(star_rows(pairs_of_blocks(unsettled, "key", "sig"), _span(_could_link)))
    groups = groups.select("node", F.col("label").alias("grp")).unionByName(groups.select(F.col("label").alias("node"), F.col("label").alias("grp")).distinct())
    grouped = mixed(labelled(groups), "grp", company.join(bags, "node"), F.length("bag"))
    found = star_rows(pairs_of_blocks(grouped, "grp", "sig", "bag"), _span(_links(threshold)))
    labels = components(found.unionByName(labels.select(F.col("node").alias("u"), F.col("label").alias("v"))))

    member = signed.select("__id", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    classes = member.where("node is not null").groupBy("label").agg(F.min("__id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    out = member.join(classes, "label", "left")
    return out.select(
        F.col("__id").alias(id_col),
        F.col("node").alias("text_hash"),
        F.col("label").alias("class_hash"),
        F.when(F.col("node").isNull(), F.col("__id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"),
    )


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without all but one row of each class: the one of the least id. Texts without words stay."""
    classes = stash(near_duplicates(docs, id_col=id_col, text_col=text_col, **options), "classes").where("text_hash is not null")
    row = F.struct(F.col(id_col).alias("id"), F.col("text_hash").alias("hash"))
    kept = classes.groupBy("class_hash").agg(F.min(row).alias("kept"))
    gone = classes.where("class_size > 1").withColumn("row", row).join(kept, "class_hash").where("row <> kept")
    gone = stash(gone.select(F.col("row.id").alias("__g_id"), F.col("row.hash").alias("__g_hash")).distinct(), "copies")
    marked = docs.withColumn("__hash", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    out = marked.join(few(gone), F.col(id_col).eqNullSafe(F.col("__g_id")) & (F.col("__hash") == F.col("__g_hash")), "left_anti")
    if classes.groupBy(id_col, "text_hash").count().where("count > 1").isEmpty():
        return out.drop("__hash")
    worded = F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return out.where(worded).dropDuplicates([id_col, "__hash"]).unionByName(out.where(~worded)).drop("__hash")
