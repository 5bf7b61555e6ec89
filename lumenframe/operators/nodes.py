"""Nodes of a forest as arrays: the best split of a node from counts, subtrees grown whole, walks of batches to open nodes.

The results are those of the native steps in ``forest`` (``subspace``, ``candidates``, ``qualities``,
``best_splits``, ``majority``) to the bit, but for the sketches of ``how="histogram"``, which merge in another order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lumenframe.operators.histograms import Histogram

#: Below this a split gains nothing.
LEAST_GAIN = 1e-12
Key = tuple[int, int]


@dataclass(frozen=True)
class Rules:
    """How nodes are split."""

    features: int
    size: int
    min_items: int
    bins: int
    max_depth: int
    seed: str
    mode: str
    how: str
    reuse_features: bool

    def dims(self, key: Key, used: tuple[int, ...]) -> list[int]:
        """The node's subspace, as ``forest.subspace`` draws it."""
        rest = set(range(self.features)) - set(used)
        hashed = sorted((hashlib.md5(f"{self.seed}:{key[0]}:{key[1]}:{d}".encode()).hexdigest(), d) for d in rest)
        return [d for _, d in hashed[: self.size]]

    def splits(self, best: tuple | None, key: Key) -> bool:
        """Whether a node is split by its best split; else it is a leaf."""
        least = max(1, self.min_items)
        return best is not None and depth(key) < self.max_depth and min(best[2], best[3]) >= least and best[4] > LEAST_GAIN

    def path(self, used: tuple[int, ...], feature: int) -> tuple[int, ...]:
        return used if self.reuse_features else (*used, feature)


def depth(key: Key) -> int:
    return (key[1] + 1).bit_length() - 1


def children(key: Key) -> tuple[Key, Key]:
    return (key[0], 2 * key[1] + 1), (key[0], 2 * key[1] + 2)


def matrix(column: pa.Array | pa.ChunkedArray, features: int) -> np.ndarray:
    """Rows of ``features`` at least, as a matrix; a null is NaN, which goes right at every split."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    sizes = {n for c in chunks for n in pc.unique(pc.list_value_length(c)).to_pylist()}
    if len(sizes) > 1 or min(sizes, default=features) < features:
        raise ValueError(f"rows of {sorted(sizes)} features, not of {features}")
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in chunks]
    return np.concatenate([*flat, np.empty(0)]).reshape(-1, *(sizes or {features}))


def coded(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, list]:
    """Codes of a column's values, and the values, null first and then in order."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    held = column.dictionary_encode(null_encoding="encode")
    values = held.dictionary.to_pylist()
    order = sorted(range(len(values)), key=lambda i: (values[i] is not None, values[i]))
    rank = np.empty(len(values), np.int64)
    rank[order] = np.arange(len(values))
    return rank[held.indices.to_numpy(zero_copy_only=False)], [values[i] for i in order]


def split_points(values: np.ndarray, n: np.ndarray, rules: Rules) -> np.ndarray:
    """Boundaries of equally full bins, as ``forest.candidates`` finds them."""
    found, inverse = np.unique(values, return_inverse=True)
    counts = np.bincount(inverse, weights=n).astype(np.int64)
    if rules.how == "histogram":
        from lumenframe.operators.forest import _boundaries

        sketch = Histogram(4 * rules.bins)
        for value, count in zip(found.tolist(), counts.tolist(), strict=True):
            if value == value:
                sketch.update(value, count)
        points = np.unique(_boundaries(sketch.centres, sketch.counts, rules.bins))
        return points[points < sketch.high]
    upto = np.cumsum(counts)
    crossed = np.zeros(len(found), bool)
    for k in range(1, rules.bins):
        place = np.ceil(upto[-1] * (k / rules.bins))
        crossed |= (upto >= place) & (upto - counts < place)
    return found[:-1][crossed[:-1]] + 0.0


def best_split(found: Iterable[tuple[int, np.ndarray, np.ndarray]], mode: str) -> tuple | None:
    """(feature, split, n_left, n_right, quality), the best over (feature, splits, counts by bin and label); None without splits."""
    rows = []
    for feature, splits, counts in found:
        if not len(splits):
            continue
        left = np.cumsum(counts, axis=0)[: len(splits)]
        right = counts.sum(axis=0) - left
        squares = lambda c: (c.astype(float) ** 2).sum(axis=1)
        l, r = left.sum(axis=1), right.sum(axis=1)
        n, l2, r2 = (l + r).astype(float), squares(left), squares(right)
        if mode == "paper":
            # a side without rows takes nothing off
            gini = lambda c2, c: np.where(c > 0, 1.0 - c2 / np.maximum(c * c, 1.0), 0.0)
            quality = (1.0 - squares(left + right) / (n * n)) - l / n * gini(l2, l.astype(float)) - r / n * gini(r2, r.astype(float))
        else:
            a, b = 1.0 - l2 / (n * n), 1.0 - r2 / (n * n)
            quality = a - 0.5 * a - 0.5 * b
        rows += zip([feature] * len(splits), splits.tolist(), l.tolist(), r.tolist(), quality.tolist(), strict=True)
    if not rows:
        return None
    top = max(row[4] for row in rows)
    # qualities are compared as rounded to 12 digits, halves up; ties to the smaller feature, then split
    rounded = lambda q: Decimal(repr(q)).quantize(Decimal("1e-12"), ROUND_HALF_UP)
    return min((row for row in rows if row[4] >= top - 1e-11), key=lambda row: (-rounded(row[4]), row[0], row[1]))


def grow(x: np.ndarray, codes: np.ndarray, labels: list, n: np.ndarray, key: Key, used: tuple[int, ...], rules: Rules) -> Iterator[tuple]:
    """(tree, node, feature, split, label) of a node and all below it, from the node's members."""
    stack = [(key, used, np.arange(len(n)))]
    while stack:
        key, used, rows = stack.pop()
        by_label = np.bincount(codes[rows], weights=n[rows], minlength=len(labels)).astype(np.int64)
        best = None
        # no search where no split can be kept
        if depth(key) < rules.max_depth and by_label.sum() >= 2 * max(1, rules.min_items) and not (rules.mode == "paper" and np.count_nonzero(by_label) == 1):
            best = best_split(_counted(x, codes, n, rows, rules.dims(key, used), len(labels), rules), rules.mode)
        if not rules.splits(best, key):
            yield (*key, None, None, labels[int(by_label.argmax())])
            continue
        feature, split = best[:2]
        yield (*key, feature, split, None)
        to_left = x[rows, feature] <= split
        for child, kept in zip(children(key), (to_left, ~to_left), strict=True):
            stack.append((child, rules.path(used, feature), rows[kept]))


def _counted(x, codes, n, rows, dims, labels, rules) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for d in dims:
        values = x[rows, d]
        splits = split_points(values, n[rows], rules)
        at = np.searchsorted(splits, values, side="left") * labels + codes[rows]
        yield d, splits, np.bincount(at, weights=n[rows], minlength=(len(splits) + 1) * labels).astype(np.int64).reshape(-1, labels)


class Walk:
    """The inner nodes grown so far as arrays; takes the members in a batch to those of the nodes ``targets`` that they reach."""

    def __init__(self, inner: dict[Key, tuple[int, float]], targets: list[Key], features: int):
        number = {key: i for i, key in enumerate([*inner, *targets])}
        self.features, self.inner = features, len(inner)
        self.feature = np.array([f for f, _ in inner.values()], np.int64)
        self.split = np.array([s for _, s in inner.values()], float)
        self.left, self.right = (np.array([number.get(children(key)[k], -1) for key in inner], np.int64) for k in (0, 1))
        self.root = {key[0]: i for key, i in number.items() if key[1] == 0}
        self.tree, self.node = np.array([t for t, _ in targets], np.int32), np.array([k for _, k in targets], np.int64)

    def members(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(matrix of features, row, target, n): the batch's members that reach a target, in order of the target."""
        x = matrix(batch.column("features"), self.features)
        drawn = batch.column("drawn")
        row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(drawn).to_numpy(zero_copy_only=False))
        tree, n = (pc.struct_field(drawn.flatten(), k).to_numpy(zero_copy_only=False) for k in ("tree", "n"))
        found, inverse = np.unique(tree, return_inverse=True)
        at = np.array([self.root.get(int(t), -1) for t in found], np.int64)[inverse]
        moving = np.flatnonzero((at >= 0) & (at < self.inner))
        while len(moving):
            now = at[moving]
            at[moving] = np.where(x[row[moving], self.feature[now]] <= self.split[now], self.left[now], self.right[now])
            moving = moving[(at[moving] >= 0) & (at[moving] < self.inner)]
        there = np.flatnonzero(at >= self.inner)
        there = there[np.argsort(at[there], kind="stable")]
        return x, row[there], at[there] - self.inner, n[there].astype(np.int64)

    def batch(self, target: np.ndarray, schema: pa.Schema, *columns: pa.Array) -> pa.RecordBatch:
        """A batch of tree and node of the targets, and further columns."""
        return pa.RecordBatch.from_arrays([pa.array(self.tree[target]), pa.array(self.node[target]), *columns], schema=schema)


def summed(n: np.ndarray, *codes: tuple[np.ndarray, int]) -> tuple[np.ndarray, ...]:
    """The distinct combinations of codes (each with how many there can be) and the sum of ``n`` of each."""
    at = np.zeros(len(n), np.int64)
    for code, size in codes:
        at = at * size + code
    found, inverse = np.unique(at, return_inverse=True)
    sums = np.bincount(inverse, weights=n, minlength=len(found)).astype(np.int64)
    out = []
    for _, size in reversed(codes):
        found, code = np.divmod(found, size)
        out.append(code)
    return (*reversed(out), sums)
