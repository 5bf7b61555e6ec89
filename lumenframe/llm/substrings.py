"""Removal of long passages that an earlier document has, by prefix-partitioned suffix trees.

The trees are sparse: of all suffixes only those at *anchors* are in them. In any ``window`` of words
the anchor is the place of the 16 words of least hash; equal windows have it at the same offset. So a
repeat of ``window`` words or more holds an anchor whose suffixes, in both documents, agree to the right
of it for ``d`` words or more and to the left for ``window - d``.

1. The 16-word prefixes of the suffixes at anchors are counted over all documents (pre-aggregated in each
   task). Those of a single document are leaves; a bit set of the others goes to the executors.
2. The suffixes under a prefix form a group, with the words around the anchor. A prefix of more than
   ``hot`` suffixes would not fit in memory and gets longer ones: of ``window`` words, from each start of
   a window about the anchor. There the whole group is one deep node, of which only the least owner
   matters, and each task reduces it to one row before the shuffle.
3. Each group's subtree is built as a suffix array with the lengths of common prefixes; a second one of
   the words before the anchor, read backwards, tells how far repeats extend to the left. The internal
   nodes of depth ``d`` of the one and of depth ``window - d`` of the other are cut out; where they
   meet is a maximal repeat, and its occurrences other than in its least document are marked.
4. Marks join the documents, and covered words go.

Defined results: null and empty texts have no words; a null id is neither earlier nor later than
any other, so such rows keep all words; rows with the same id aren't earlier than each other; extra
columns are ignored. Words are compared by 32 bits of their hash, so passages of 50 words by 1,600 (longer
prefixes: 64 bits of the hash of the window).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm import _text as tx
from lumenframe.llm._store import stash

#: Two to this power is the most bits that a filter of repeated prefixes has (32 MB for each of two).
FILTER_LOG2 = 28
ANCHOR_WORDS = 16
#: Suffixes that a task sorts at once, about; a single group has ``hot`` at most.
_SORTED = 1 << 15


def _first_least(grams: np.ndarray, width: int) -> np.ndarray:
    """Place of the first least of each ``width`` consecutive values."""
    at, have = np.arange(len(grams)), 1
    while have < width:
        step = min(have, width - have)
        a, b = at[:-step], at[step:]
        at = np.where(grams[b] < grams[a], b, a)
        have += step
    return at


def _anchors(w: tx.Words, window: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with a common anchor: first window, last window, the anchor's hash, row, place."""
    n = len(w.row)
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, none.astype(np.uint64), none, none
    grams = tx.windows(w.hash, ANCHOR_WORDS)
    at = _first_least(grams, window - ANCHOR_WORDS + 1)
    good = tx.within_row(w.row, window)
    change = np.ones(n - window + 2, bool)
    change[1:-1] = (at[1:] != at[:-1]) | (good[1:] != good[:-1])
    cuts = np.flatnonzero(change)
    first, last = cuts[:-1], cuts[1:] - 1
    use = good[first]
    first, last = first[use], last[use]
    return first, last, grams[at[first]], w.row[first], at[first]


def _count_anchors(window: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = tx.byte_classes()
        for batch in batches:
            text, ids = tx.column(batch.column("__text")), batch.column("__id").to_numpy(zero_copy_only=False)
            hashes, owners = [], []
            for lo, hi in tx.chunks(text):
                _, _, h, row, _ = _anchors(tx.words(text, lo, hi, classes), window)
                hashes.append(h)
                owners.append(ids[lo + row])
            if not hashes:
                continue
            h, owner = np.concatenate(hashes), np.concatenate(owners)
            order = np.argsort(h, kind="stable")
            h, owner = h[order], owner[order]
            heads = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
            if len(heads):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[heads].view(np.int64)), pa.array(np.minimum.reduceat(owner, heads)), pa.array(np.maximum.reduceat(owner, heads)), pa.array(np.diff(np.r_[heads, len(h)]))],
                    ["h", "lo", "hi", "n"],
                )

    return run


def _ranges(row: np.ndarray, start: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Marked windows (in order) at consecutive places of one row become one range: index of its first window, start, end."""
    if not len(row):
        return row, start, start
    head = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (np.diff(start) != 1)])
    tail = np.r_[head[1:], len(row)] - 1
    return head, start[head], start[tail] + window


_FOUND = "kind int, key long, __id long, __th long, a long, b long, anchor int, words binary"


def _suffixes(packed, window: int) -> Callable:
    """Suffixes under repeated prefixes. Kind 0: at an anchor, with the words of the windows about it; 1: a window with a hot anchor; 2: a range that is marked already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = tx.byte_classes()
        repeated, hot = (tx.BitSet.read(x) for x in packed.value)
        for batch in batches:
            text, ids, ths = tx.column(batch.column("__text")), batch.column("__id").to_numpy(zero_copy_only=False), batch.column("__th").to_numpy()
            for lo, hi in tx.chunks(text):
                w = tx.words(text, lo, hi, classes)
                first, last, h, row, at = _anchors(w, window)
                use = repeated.has(h)
                first, last, h, row, at = first[use], last[use], h[use], row[use], at[use]
                if not len(h):
                    continue
                base, is_hot = w.first[row], hot.has(h)
                codes = (w.hash >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
                cold = ~is_hot
                words = [codes[i:j].tobytes() for i, j in zip(first[cold], last[cold] + window, strict=True)]
                yield _found(0, h[cold], ids[lo + row[cold]], ths[lo + row[cold]], (first - base)[cold], (last - base)[cold] + window, (at - first)[cold], pa.array(words, pa.binary()))
                if is_hot.any():
                    count = (last - first + 1)[is_hot]
                    place = np.repeat(first[is_hot], count) + _within(count)
                    r = np.repeat(row[is_hot], count)
                    full, own, th, start = tx.windows(w.hash, window)[place], ids[lo + r], ths[lo + r], place - w.first[r]
                    _, node = np.unique(full, return_inverse=True)
                    least = np.full(node.max() + 1, np.iinfo(np.int64).max)
                    np.minimum.at(least, node, own)
                    later = np.flatnonzero(own > least[node])
                    head, a, b = _ranges(r[later], start[later], window)
                    yield _found(2, full[later[head]], own[later[head]], th[later[head]], a, b)
                    stays = own == least[node]
                    yield _found(1, full[stays], own[stays], th[stays], start[stays], start[stays] + window)

    return run


def _within(count: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of groups of so many."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count, count)


def _found(kind: int, key, owner, th, a, b, anchor=None, words=None) -> pa.RecordBatch:
    n = len(key)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n, kind, np.int32)),
            pa.array(key.view(np.int64)),
            pa.array(owner),
            pa.array(th),
            pa.array(a.astype(np.int64)),
            pa.array(b.astype(np.int64)),
            pa.nulls(n, pa.int32()) if anchor is None else pa.array(anchor.astype(np.int32)),
            pa.nulls(n, pa.binary()) if words is None else words,
        ],
        ["kind", "key", "__id", "__th", "a", "b", "anchor", "words"],
    )


def suffix_array(group: np.ndarray, words: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of suffixes (rows of ``words``, 0 behind their ends) within groups, and of each the length of its common prefix with the one before; -1 between groups."""
    # two words a key, the earlier one above the later, else prefixes of odd length would not lie together
    packed = words[:, : words.shape[1] // 2 * 2].astype(np.uint64)
    packed = packed[:, ::2] << np.uint64(32) | packed[:, 1::2]
    keys = [*([words[:, -1]] if words.shape[1] % 2 else []), *packed.T[::-1], group]
    order = np.lexsort(keys)
    one, two = order[:-1], order[1:]
    differ = words[one] != words[two]
    common = np.where(differ.any(1), differ.argmax(1), words.shape[1]) if words.shape[1] else np.zeros(len(one), np.int64)
    common = np.where(group[one] == group[two], np.minimum(common, np.minimum(length[one], length[two])), -1)
    return order, np.r_[-1, common]


def _nodes(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """Of each suffix the node of a depth that it hangs from."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < depth)
    return out


def repeats(group: np.ndarray, owner: np.ndarray, words: np.ndarray, at: np.ndarray, anchor: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows (suffix, start among its words), in order, that also start in a smaller owner's words.

    ``words[at[i]:at[i + 1]]`` are suffix ``i``'s words, with its anchor at ``anchor[i]``.
    """
    size = np.diff(at)
    ahead, behind = size - anchor, anchor
    widest = window - ANCHOR_WORDS
    column = np.arange(window)
    place = (at[:-1] + anchor)[:, None] + column
    right = np.where(column < ahead[:, None], words[np.minimum(place, len(words) - 1)], 0)
    column = np.arange(widest)
    left = np.where(column < behind[:, None], words[np.maximum((at[:-1] + anchor - 1)[:, None] - column, 0)], 0)
    forward, backward = suffix_array(group, right, ahead), suffix_array(group, left, behind)
    marked = np.zeros((len(group), widest + 1), bool)
    for back in range(widest + 1):
        use = np.flatnonzero((ahead >= window - back) & (behind >= back))
        if not len(use):
            continue
        node = (_nodes(*forward, window - back) * (len(group) + 1) + _nodes(*backward, back))[use]
        order = np.argsort(node, kind="stable")
        head = np.flatnonzero(np.r_[True, np.diff(node[order]) != 0])
        least = np.minimum.reduceat(owner[use[order]], head)
        marked[use[order], widest - back] = owner[use[order]] > np.repeat(least, np.diff(np.r_[head, len(use)]))
    row, start = np.nonzero(marked)
    return row, start - widest + anchor[row]


def _subtrees(window: int) -> Callable:
    """Marks within groups of suffixes; rows come ordered by group."""

    def solve(rows: pa.Table) -> pa.RecordBatch:
        key, owner = rows.column("key").to_numpy(), rows.column("__id").to_numpy()
        head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        several = np.minimum.reduceat(owner, head) < np.maximum.reduceat(owner, head)
        rows = rows.filter(pa.array(np.repeat(several, np.diff(np.r_[head, len(key)])))).combine_chunks()
        key, owner = rows.column("key").to_numpy(), rows.column("__id").to_numpy()
        if len(key):
            raw = tx.column(rows.column("words"))
            words = raw.data[raw.offsets[0] : raw.offsets[-1]].view(np.uint32)
            group = np.cumsum(np.r_[True, key[1:] != key[:-1]])
            row, start = repeats(group, owner, words, (raw.offsets - raw.offsets[0]) // 4, rows.column("anchor").to_numpy().astype(np.int64), window)
            first, a, b = _ranges(row, rows.column("a").to_numpy()[row] + start, window)
            row = row[first]
        else:
            row = a = b = np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(owner[row], pa.int64()), pa.array(rows.column("__th").to_numpy()[row], pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["__id", "__th", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size < _SORTED:
                continue
            rows = pa.Table.from_batches(held)
            key = rows.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))  # the last group may go on
            if cut:
                yield solve(rows.slice(0, cut))
            held = rows.slice(cut).combine_chunks().to_batches()
            size = sum(x.num_rows for x in held)
        if held:
            yield solve(pa.Table.from_batches(held))

    return run


def _keep(id_type: pa.DataType) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, marks = batch.column("__text").cast(pa.binary()), batch.column("marks")
            n_words, n_removed, kept = [], [], []
            offsets = marks.offsets.to_numpy()
            a, b = marks.values.field("a").to_numpy(), marks.values.field("b").to_numpy()
            has = marks.is_valid().to_numpy(zero_copy_only=False)
            for i, text in enumerate(texts):
                words = text.as_py().split()
                n_words.append(len(words))
                if has[i]:
                    cover = np.zeros(len(words) + 1, np.int64)
                    np.add.at(cover, a[offsets[i] : offsets[i + 1]], 1)
                    np.add.at(cover, b[offsets[i] : offsets[i + 1]], -1)
                    keep = np.cumsum(cover[:-1]) == 0
                    words = [x for x, k in zip(words, keep.tolist(), strict=True) if k]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column("__id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["__id", "n_words", "n_removed", "kept"])

    return run


def dedup_substrings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 50, hot: int = 20_000) -> DataFrame:
    """Texts without the passages of ``window`` words or more that start in a document with a smaller id.

    Ids are integers. Returns a row for each row of ``docs``: its id, ``n_words``, ``n_removed``
    and ``kept`` (the words left, joined by one space).
    """
    if window < ANCHOR_WORDS:
        raise ValueError(f"window must be at least {ANCHOR_WORDS}")
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.col(id_col).cast("long").alias("__id"), F.xxhash64(text).alias("__th"), text.alias("__text"))
    named = source.where(F.col("__id").isNotNull())
    counted = named.select("__id", "__text").mapInArrow(_count_anchors(window), "h long, lo long, hi long, n long")
    repeated = counted.groupBy("h").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).where("lo < hi")
    repeated = stash(repeated.select("h", (F.col("n") > hot).alias("hot")), "prefixes")
    log2 = tx.bits_for(repeated.count(), FILTER_LOG2)
    packed = spark.sparkContext.broadcast([tx.collect_bits(x, "h", log2) for x in (repeated, repeated.where("hot"))])

    suffixes = stash(named.mapInArrow(_suffixes(packed, window), _FOUND), "suffixes")
    cold = suffixes.where("kind = 0").select("key", "__id", "__th", "a", "anchor", "words").repartition("key").sortWithinPartitions("key")
    marks = cold.mapInArrow(_subtrees(window), "__id long, __th long, a long, b long")
    long_prefix = suffixes.where("kind = 1").select("key", "__id", "__th", "a", "b")
    least = long_prefix.groupBy("key").agg(F.min("__id").alias("least"))
    later = long_prefix.join(least, "key").where("__id > least")
    marks = marks.unionByName(later.select("__id", "__th", "a", "b")).unionByName(suffixes.where("kind = 2").select("__id", "__th", "a", "b"))
    marks = marks.groupBy("__id", "__th").agg(F.collect_list(F.struct("a", "b")).alias("marks"))
    marks = marks.select(F.col("__id").alias("m_id"), F.col("__th").alias("m_th"), "marks")
    joined = source.join(marks, (F.col("__id") == F.col("m_id")) & (F.col("__th") == F.col("m_th")), "left").select("__id", "__text", "marks")
    out = joined.mapInArrow(_keep(pa.int64()), "__id long, n_words long, n_removed long, kept string")
    return out.withColumnRenamed("__id", id_col)
