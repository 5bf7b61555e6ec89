"""Random forests grown level by level.

State is in tables: samples (id, label, features), node members (tree, node, id, n: how often the
bootstrap drew the sample), nodes (tree, node, feature, split, label). A level bins each member's
value of each feature of the node's subspace by the node's candidate splits, counts (bin, label),
and forms left and right counts as running sums over the bins: rows are read once, not once per
candidate.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.operators import nodes, stats
from lumenframe.operators.histograms import Histogram, histograms
from lumenframe.operators.similarity import uniform
from lumenframe.session import BROADCAST_ROWS, cut, small, store

# Defaults of the builder.
MIN_ITEMS, BINS = 70, 10
#: Builders by name, and where their split candidates come from; the plan by levels is the same.
STRATEGIES = {"big_reducer": "percentile", "streaming": "histogram"}
#: Node numbers double with depth; this many levels fit in 63 bits.
MAX_DEPTH = 60
#: Nodes of up to this many values are grown to their leaves in one task, which holds them as doubles (32 MB).
SUBTREE_VALUES = 1 << 22


def subspace_size(features: int) -> int:
    return round(math.log(features) + 1)


def bootstrap(ids: DataFrame, trees: int, seed: str = "0") -> DataFrame:
    """(tree, id, n): for each tree as many draws with replacement as there are samples."""
    # numbered in order of the id: within ranges, then over the ranges' sizes
    ranged = cut(ids.select("id").repartitionByRange("id").withColumn("range", F.spark_partition_id()))
    sizes = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("size"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0))).drop("size")
    place = F.row_number().over(Window.partitionBy("range").orderBy("id")) - 1
    numbered = ranged.withColumn("place", place).join(F.broadcast(sizes), "range").select("id", (F.col("before") + F.col("place")).cast("long").alias("at"))
    count = ranged.count()
    draws = ids.sparkSession.range(count).crossJoin(F.broadcast(ids.sparkSession.range(trees).select(F.col("id").alias("tree"))))
    draws = draws.select(F.col("tree").cast("int").alias("tree"), F.floor(uniform(seed, F.col("tree"), F.col("id")) * count).cast("long").alias("at"))
    return draws.groupBy("tree", "at").agg(F.count(F.lit(1)).alias("n")).join(numbered, "at").select("tree", "id", "n")


def subspace(nodes: DataFrame, features: int, size: int, seed: str = "0") -> DataFrame:
    """Adds ``dims``: ``size`` of the features that the node's path has not used (``used``), by a hash order; fewer if they run out."""
    every = F.array_except(F.sequence(F.lit(0), F.lit(features - 1)), F.col("used"))
    ordered = F.array_sort(F.transform(every, lambda d: F.struct(F.md5(F.concat_ws(":", F.lit(seed), "tree", "node", d.cast("string"))).alias("h"), d.alias("d"))))
    return nodes.withColumn("dims", F.transform(F.slice(ordered, 1, size), lambda x: x["d"]))


def flat(members: DataFrame, samples: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(tree, node, feature, value, label, n): members' values of their nodes' features."""
    rows = members.join(samples, "id")
    if nodes is not None:
        rows = rows.join(small(nodes.select("tree", "node", "dims")), ["tree", "node"])
        return rows.select("tree", "node", "label", "n", "features", F.explode("dims").alias("feature")).select("tree", "node", "feature", F.expr("features[feature]").alias("value"), "label", "n")
    return rows.select("tree", "node", "label", "n", F.posexplode("features").alias("feature", "value"))


def candidates(rows: DataFrame, bins: int = BINS, how: str = "percentile") -> DataFrame:
    """(tree, node, feature, splits): boundaries of equally full bins, a row counting ``n`` times; distinct and sorted.

    ``percentile`` is exact; ``histogram`` takes them of a streaming histogram, which no task needs all values of a node for.
    """
    by = ["tree", "node", "feature"]
    if how == "histogram":
        cuts = F.udf(lambda centres, counts: _boundaries(centres, counts, bins), "array<double>")
        out = histograms(rows, by, weight="n", size=4 * bins).select(*by, cuts("centres", "counts").alias("splits"), F.col("high").alias("top"))
        # a split at the largest value leaves the right side empty
        return out.select(*by, F.array_sort(F.array_distinct(F.filter("splits", lambda s: s < F.col("top")))).alias("splits"))
    counts = rows.groupBy(*by, "value").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by)
    upto = F.sum("n").over(group.orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = counts.withColumn("upto", upto).withColumn("total", F.sum("n").over(group)).withColumn("top", F.max("value").over(group))
    place = lambda k: F.ceil(F.col("total") * (k / bins))
    crossed = F.lit(False)
    for k in range(1, bins):
        crossed = crossed | ((F.col("upto") >= place(k)) & (F.col("upto") - F.col("n") < place(k)))
    return ranked.where(crossed & (F.col("value") < F.col("top"))).groupBy(*by).agg(F.array_sort(F.collect_list("value")).alias("splits"))


def _boundaries(centres: list[float], counts: list[int], bins: int) -> list[float]:
    held = Histogram(max(len(centres), 1))
    held.centres, held.counts = list(centres), list(counts)
    return held.uniform(bins) or held.centres


def label_counts(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """(tree, node, feature, split, label, n_left, n_right)."""
    by = ["tree", "node", "feature"]
    binned = rows.join(small(splits), by).withColumn("bin", F.size(F.filter("splits", lambda s: s < F.col("value"))))
    counts = binned.groupBy(*by, "label", "bin").agg(F.sum("n").alias("n"))
    # for each label the counts by bin as a map, then one row per split
    held = counts.groupBy(*by, "label").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"), F.sum("n").alias("total")).join(splits, by)
    split = held.select(*by, "label", "m", "total", F.posexplode("splits").alias("k", "split"))
    left = F.aggregate(F.map_entries(F.map_filter("m", lambda b, _: b <= F.col("k"))), F.lit(0).cast("long"), lambda acc, e: acc + e["value"])
    return split.select(*by, "split", "label", left.alias("n_left"), (F.col("total") - left).alias("n_right"))


def _gini_sum(counts: Column, total: Column) -> Column:
    """1 - sum of squared shares, from the sum of squared counts."""
    return 1.0 - counts / F.nullif(total * total, F.lit(0))


def qualities(counts: DataFrame, mode: str = "paper") -> DataFrame:
    """(tree, node, feature, split, n_left, n_right, quality): decrease of gini impurity, or the formula as coded."""
    by = ["tree", "node", "feature", "split"]
    sq = lambda c: F.sum((c * c).cast("double"))
    both = F.col("n_left") + F.col("n_right")
    sums = counts.groupBy(*by).agg(
        F.sum("n_left").alias("l"), F.sum("n_right").alias("r"), sq(F.col("n_left")).alias("l2"), sq(F.col("n_right")).alias("r2"), sq(both).alias("q2")
    )
    n = F.col("l") + F.col("r")
    if mode == "paper":
        zero = F.lit(0.0)
        quality = _gini_sum(F.col("q2"), n) - F.coalesce(F.col("l") / n * _gini_sum(F.col("l2"), F.col("l")), zero) - F.coalesce(F.col("r") / n * _gini_sum(F.col("r2"), F.col("r")), zero)
    else:
        left, right = _gini_sum(F.col("l2"), n), _gini_sum(F.col("r2"), n)
        quality = left - 0.5 * left - 0.5 * right
    return sums.select(*by, F.col("l").alias("n_left"), F.col("r").alias("n_right"), quality.alias("quality"))


def best_splits(found: DataFrame) -> DataFrame:
    """The best split of each node; ties to the smaller feature, then split."""
    order = F.struct((-F.round("quality", 12)).alias("q"), "feature", "split", "n_left", "n_right", "quality")
    top = found.groupBy("tree", "node").agg(F.min(order).alias("b"))
    return top.select("tree", "node", "b.feature", "b.split", "b.n_left", "b.n_right", "b.quality")


def majority(members: DataFrame, samples: DataFrame) -> DataFrame:
    """(tree, node, label, n): the most frequent label of each node, ties to the smaller."""
    return _most(members.join(samples.select("id", "label"), "id").groupBy("tree", "node", "label").agg(F.sum("n").alias("n")))


def _most(counts: DataFrame) -> DataFrame:
    return counts.groupBy("tree", "node").agg(F.min(F.struct((-F.col("n")).alias("least"), "label")).alias("b"), F.sum("n").alias("n")).select("tree", "node", "b.label", "n")


def grow_level(samples: DataFrame, members: DataFrame, nodes: DataFrame, *, min_items: int = MIN_ITEMS, bins: int = BINS, mode: str = "paper", how: str = "percentile") -> tuple[DataFrame, DataFrame]:
    """One level: what becomes of each node (tree, node, feature, split, label), and the members of the children.

    A node whose best split leaves fewer than ``min_items`` on a side, or gains nothing, is a leaf.
    """
    rows = flat(members, samples, nodes)
    best = best_splits(qualities(label_counts(rows, candidates(rows, bins, how)), mode))
    least = max(1, min_items)
    good = best.where((F.col("n_left") >= least) & (F.col("n_right") >= least) & (F.col("quality") > 1e-12))
    done = majority(members, samples).join(good.select("tree", "node", "feature", "split"), ["tree", "node"], "left")
    done = done.join(nodes.select("tree", "node", "used"), ["tree", "node"])
    done = cut(done.select("tree", "node", "feature", "split", F.when(F.col("feature").isNull(), F.col("label")).alias("label"), "used"))
    inner = done.where("feature is not null").select("tree", "node", "feature", "split")
    moved = members.join(small(inner), ["tree", "node"]).join(samples.select("id", "features"), "id")
    child = 2 * (F.col("node") + 1) - F.when(F.expr("features[feature] <= split"), 1).otherwise(0)
    return done, cut(moved.select("tree", child.alias("node"), "id", "n"))


def build(samples: DataFrame, features: int, *, trees: int = 1, min_items: int = MIN_ITEMS, bins: int = BINS, max_depth: int = 20, seed: str = "0", mode: str = "paper", how: str = "percentile", strategy: str | None = None, reuse_features: bool = False, subtree_values: int = SUBTREE_VALUES) -> DataFrame:
    """A forest (tree, node, feature, split, label); inner nodes have a split, leaves a label.

    ``strategy`` chooses ``how`` by a builder's name (``STRATEGIES``). A node of at most ``subtree_values`` values (drawn
    rows times features) is grown to its leaves in one task; larger ones go level by level, in two jobs each, over samples
    that walk the splits found so far. Either way the forest is that of ``grow_level``. The driver holds the larger
    nodes only.
    """
    if strategy is not None:
        how = STRATEGIES[strategy]
    if max_depth > MAX_DEPTH:
        raise ValueError(f"max_depth is at most {MAX_DEPTH}")
    rules = nodes.Rules(features, subspace_size(features), min_items, bins, max_depth, seed, mode, how, reuse_features)
    held = _drawn_samples(samples, features, trees, seed)
    totals = held.select(F.explode("drawn").alias("d")).groupBy("d.tree").agg(F.sum("d.n").alias("n")).collect()
    # open nodes: the features on the path, the number of drawn rows
    level = {(r["tree"], 0): ((), r["n"]) for r in totals}
    inner, leaves, subtrees = {}, [], {}
    while level:
        subtrees |= {key: used for key, (used, n) in level.items() if n * features <= subtree_values}
        level = {key: state for key, state in level.items() if key not in subtrees}
        splittable = {key: rules.dims(key, used) for key, (used, _) in level.items() if nodes.depth(key) < max_depth}
        best = _best_of_level(held, inner, splittable, rules) if splittable else {}
        below = {}
        for key, (used, _) in level.items():
            found = best.get(key)
            if rules.splits(found, key):
                inner[key] = found[:2]
                for child, n in zip(nodes.children(key), found[2:4], strict=True):
                    below[child] = (rules.path(used, found[0]), n)
            else:
                leaves.append(key)
        level = below
    kind = samples.schema["label"].dataType.simpleString()
    schema = f"tree int, node long, feature int, split double, label {kind}"
    rows = [(*key, feature, split, None) for key, (feature, split) in inner.items()]
    rows += [(*key, None, None, label) for key, label in _majorities(held, inner, leaves, rules).items()]
    grown = _subtrees(held, inner, subtrees, rules, schema)
    return cut(grown.unionByName(samples.sparkSession.createDataFrame(rows, schema)) if rows else grown)


def _drawn_samples(samples: DataFrame, features: int, trees: int, seed: str) -> DataFrame:
    """(label, features, drawn): each sample that a bootstrap drew, with an array of (tree, n)."""
    if not samples._jdf.queryExecution().analyzed().deterministic():
        samples = store(samples.select("id", "label", "features"))  # they are read more than once
    drawn = bootstrap(samples, trees, seed).groupBy("id").agg(F.collect_list(F.struct("tree", "n")).alias("drawn"))
    missing = F.array_repeat(F.lit(None).cast("double"), features)
    rows = samples.select("id", "label", F.coalesce(F.col("features").cast("array<double>"), missing).alias("features"))
    return store(rows.join(drawn, "id").select("label", "features", "drawn"))


def _walk(held: DataFrame, inner: dict, targets: list, rules: nodes.Rules):
    return held.sparkSession.sparkContext.broadcast(nodes.Walk(inner, targets, rules.features))


def _best_of_level(held: DataFrame, inner: dict, open_nodes: dict, rules: nodes.Rules) -> dict:
    """The best split (feature, split, n_left, n_right, quality) of each open node that has one."""
    keys, most = list(open_nodes), max(map(len, open_nodes.values()))
    if not most:
        return {}
    walk = _walk(held, inner, keys, rules)
    dims = np.array([[*open_nodes[key], *[-1] * (most - len(open_nodes[key]))] for key in keys])
    value_schema = pa.schema([("tree", pa.int32()), ("node", pa.int64()), ("feature", pa.int32()), ("value", pa.float64()), ("n", pa.int64())])

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, row, target, n = walk.value.members(batch)
            feature = dims[target].ravel()
            row, target, n = (np.repeat(a, most)[feature >= 0] for a in (row, target, n))
            feature = feature[feature >= 0]
            if not len(target):
                continue
            # equal values of a batch travel as one
            value = x[row, feature]
            order = np.lexsort((value, feature, target))
            target, feature, value = target[order], feature[order], value[order]
            head = np.flatnonzero(np.r_[True, (np.diff(target) != 0) | (np.diff(feature) != 0) | (value[1:] != value[:-1])])
            n = np.add.reduceat(n[order], head)
            yield walk.value.batch(target[head], value_schema, pa.array(feature[head].astype(np.int32)), pa.array(value[head]), pa.array(n))

    rows = held.mapInArrow(values, "tree int, node long, feature int, value double, n long")
    if rules.how == "percentile":
        # the values of a node's feature meet in the window of candidates; to go there at once saves a shuffle
        rows = rows.repartition("tree", "node", "feature")
    splits = {}
    for r in candidates(rows, rules.bins, rules.how).collect():
        splits.setdefault((r["tree"], r["node"]), {})[r["feature"]] = np.array(r["splits"], float)
    points = held.sparkSession.sparkContext.broadcast(splits)
    label = held.schema["label"].dataType.simpleString()

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, row, target, n = walk.value.members(batch)
            codes, labels = nodes.coded(batch.column("label"))
            schema = pa.schema([("tree", pa.int32()), ("node", pa.int64()), ("feature", pa.int32()), ("bin", pa.int32()), ("label", batch.schema.field("label").type), ("n", pa.int64())])
            starts = np.flatnonzero(np.diff(target, prepend=-1))
            for start, end in zip(starts, [*starts[1:], len(target)], strict=True):
                at, rows = target[start], row[start:end]
                for feature, cuts in points.value.get(keys[at], {}).items():
                    bin_ = np.searchsorted(cuts, x[rows, feature], side="left")
                    bin_, code, sums = nodes.summed(n[start:end], (bin_, len(cuts) + 1), (codes[rows], len(labels)))
                    fixed = pa.array(np.full(len(sums), feature, np.int32))
                    named = pa.array([labels[c] for c in code], schema.field("label").type)
                    yield walk.value.batch(np.full(len(sums), at), schema, fixed, pa.array(bin_.astype(np.int32)), named, pa.array(sums))

    def best(key: tuple, table: pa.Table) -> pa.Table:
        (tree, node), mode = (k.as_py() for k in key), rules.mode
        codes, labels = nodes.coded(table.column("label"))
        feature, bin_, n = (table.column(name).to_numpy() for name in ("feature", "bin", "n"))
        found = []
        for f, cuts in points.value[tree, node].items():
            by_bin = np.zeros((len(cuts) + 1, len(labels)), np.int64)
            here = feature == f
            by_bin[bin_[here], codes[here]] = n[here]
            found.append((f, cuts, by_bin))
        names, top = ["tree", "node", "feature", "split", "n_left", "n_right", "quality"], nodes.best_split(found, mode)
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.float64()]
        return pa.table([pa.array([] if top is None else [v], k) for v, k in zip((tree, node, *(top or [None] * 5)), kinds, strict=True)], names=names)

    sums = held.mapInArrow(counts, f"tree int, node long, feature int, bin int, label {label}, n long").groupBy("tree", "node", "feature", "bin", "label").agg(F.sum("n").alias("n"))
    tops = sums.groupBy("tree", "node").applyInArrow(best, "tree int, node long, feature int, split double, n_left long, n_right long, quality double")
    return {(r["tree"], r["node"]): tuple(r)[2:] for r in tops.collect()}


def _majorities(held: DataFrame, inner: dict, leaves: list, rules: nodes.Rules) -> dict:
    """The label of each of the leaves."""
    if not leaves:
        return {}
    walk = _walk(held, inner, leaves, rules)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, row, target, n = walk.value.members(batch)
            codes, labels = nodes.coded(batch.column("label"))
            kind = batch.schema.field("label").type
            schema = pa.schema([("tree", pa.int32()), ("node", pa.int64()), ("label", kind), ("n", pa.int64())])
            target, code, sums = nodes.summed(n, (target, len(leaves)), (codes[row], len(labels)))
            yield walk.value.batch(target, schema, pa.array([labels[c] for c in code], kind), pa.array(sums))

    label = held.schema["label"].dataType.simpleString()
    found = _most(held.mapInArrow(counts, f"tree int, node long, label {label}, n long").groupBy("tree", "node", "label").agg(F.sum("n").alias("n")))
    return {(r["tree"], r["node"]): r["label"] for r in found.collect()}


def _subtrees(held: DataFrame, inner: dict, roots: dict, rules: nodes.Rules, schema: str) -> DataFrame:
    """All nodes from ``roots`` (and the features on their paths) down, a root a task; moves each of their drawn rows once."""
    walk = _walk(held, inner, list(roots), rules)
    used = held.sparkSession.sparkContext.broadcast(roots)

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, row, target, n = walk.value.members(batch)
            label, rows = batch.column("label"), batch.column("features")
            kinds = pa.schema([("tree", pa.int32()), ("node", pa.int64()), ("label", label.type), ("features", rows.type), ("n", pa.int64())])
            yield walk.value.batch(target, kinds, label.take(pa.array(row)), rows.take(pa.array(row)), pa.array(n))

    def grow(key: tuple, table: pa.Table) -> pa.Table:
        root = tuple(k.as_py() for k in key)
        codes, labels = nodes.coded(table.column("label"))
        x, n = nodes.matrix(table.column("features"), rules.features), table.column("n").to_numpy()
        out = zip(*nodes.grow(x, codes, labels, n, root, used.value[root], rules), strict=True)
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.float64(), table.schema.field("label").type]
        return pa.table([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names=["tree", "node", "feature", "split", "label"])

    label = held.schema["label"].dataType.simpleString()
    rows = held.mapInArrow(members, f"tree int, node long, label {label}, features array<double>, n long")
    return rows.groupBy("tree", "node").applyInArrow(grow, schema)


def traverse(samples: DataFrame, forest: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(id, tree, vote): the label of the leaf that each sample reaches.

    A forest of few nodes goes to all executors, which walk its trees for whole batches of samples; a larger
    one is joined level by level.
    """
    if forest.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return _traverse_by_joins(samples, forest, max_depth)
    nodes = {(r["tree"], r["node"]): r for r in forest.select("tree", "node", "feature", "split", "label").collect()}
    trees = sorted({tree for tree, _ in nodes})
    number = {key: i for i, key in enumerate(nodes)}
    child = lambda key, k: number.get((key[0], 2 * key[1] + k), -1) if nodes[key]["label"] is None else -1
    column = lambda name, kind: np.array([0 if r[name] is None else r[name] for r in nodes.values()], kind)
    feature, split, label = column("feature", np.int64), column("split", float), column("label", np.int64)
    left, right = (np.array([child(key, k) for key in nodes], np.int64) for k in (1, 2))
    leaf = np.array([r["label"] is not None for r in nodes.values()], bool)
    held = samples.sparkSession.sparkContext.broadcast((trees, [number[tree, 0] for tree in trees if (tree, 0) in number], feature, split, label, left, right, leaf))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, roots, feature, split, label, left, right, leaf = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column("features")
            x = values.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            for tree, root in zip(trees, roots, strict=True):
                at, rows = np.full(batch.num_rows, root), np.arange(batch.num_rows)
                for _ in range(max_depth + 1):
                    inner = rows[(at[rows] >= 0) & ~leaf[np.maximum(at[rows], 0)]]
                    if not len(inner):
                        break
                    now = at[inner]
                    at[inner] = np.where(x[inner, feature[now]] <= split[now], left[now], right[now])
                    rows = inner
                done = np.flatnonzero((at >= 0) & leaf[np.maximum(at, 0)])
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(done)), pa.array(np.full(len(done), tree, np.int32)), pa.array(label[at[done]].astype(np.int32))], ["id", "tree", "vote"])

    kind = samples.schema["id"].dataType.simpleString()
    return samples.select("id", F.col("features").cast("array<double>").alias("features")).mapInArrow(walk, f"id {kind}, tree int, vote int")


def _traverse_by_joins(samples: DataFrame, forest: DataFrame, max_depth: int) -> DataFrame:
    trees = forest.select("tree").distinct()
    at = samples.select("id", "features").crossJoin(F.broadcast(trees)).withColumn("node", F.lit(0).cast("long"))
    votes = None
    for _ in range(max_depth + 1):
        met = cut(at.join(forest, ["tree", "node"]))
        here = met.where("label is not null").select("id", "tree", F.col("label").alias("vote"))
        votes = here if votes is None else votes.unionByName(here)
        rest = met.where("label is null")
        if rest.isEmpty():
            break
        at = rest.select("id", "features", "tree", (2 * (F.col("node") + 1) - F.when(F.expr("features[feature] <= split"), 1).otherwise(0)).alias("node"))
    return votes


def majority_vote(votes: DataFrame) -> DataFrame:
    """(id, predicted): the mode of the votes, ties to the smaller label."""
    counts = votes.where("vote > -1").groupBy("id", "vote").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), "vote")).alias("b")).select("id", F.col("b.vote").alias("predicted"))


def accuracy(samples: DataFrame, forest: DataFrame) -> DataFrame:
    """(total, correct, accuracy) of a forest's majority votes on labelled samples."""
    return stats.accuracy(samples.select("id", "label").join(majority_vote(traverse(samples, forest)), "id"))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Streaming histogram of a column: rows (p, m) of centres and counts."""
    return df.agg(F.histogram_numeric(column, F.lit(bins)).alias("h")).select(F.inline("h")).select(F.col("x").cast("double").alias("p"), F.col("y").cast("double").alias("m"))


def histogram_sum(bars: Column, b: float) -> Column:
    """Estimated number of values up to ``b`` of an array of (p, m), by trapezoids."""
    n = F.size(bars)

    def piece(i: Column) -> Column:
        low, high = F.get(bars, i), F.get(bars, i + 1)
        share = (F.lit(b) - low["p"]) / F.nullif(high["p"] - low["p"], F.lit(0.0))
        middle = low["m"] + (high["m"] - low["m"]) * share
        before = F.aggregate(F.slice(bars, F.lit(1), i), F.lit(0.0), lambda acc, x: acc + x["m"])
        return before + low["m"] / 2 + (low["m"] + middle) / 2 * share

    inside = F.filter(F.sequence(F.lit(0), n - 2), lambda i: (F.get(bars, i)["p"] <= b) & (F.get(bars, i + 1)["p"] > b))
    total = F.aggregate(bars, F.lit(0.0), lambda acc, x: acc + x["m"])
    return F.when(F.get(bars, F.lit(0))["p"] > b, 0.0).when(F.get(bars, n - 1)["p"] <= b, total).otherwise(F.transform(inside, piece)[0])
