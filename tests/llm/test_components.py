"""The reduction of edges to stars, against brute force."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest

from lumenframe.llm import bagminhash


def least_reachable(edges, n):
    label = {x: x for x in range(-n, n + 1)}
    for _ in range(2 * n + 1):
        for u, v in edges:
            label[u] = label[v] = min(label[u], label[v])
    return label


@pytest.mark.parametrize("held", [1, 5, 1 << 20])
def test_stars_keep_components(monkeypatch, held):
    monkeypatch.setattr(bagminhash, "_HELD", held)
    draw = random.Random(1)
    for _ in range(60):
        n = draw.randint(1, 30)
        edges = [(draw.randint(-n, n), draw.randint(-n, n)) for _ in range(draw.randint(0, 60))]
        parts = [edges[i : i + 7] for i in range(0, len(edges), 7)]
        batches = (pa.RecordBatch.from_arrays([pa.array(side, pa.int64()) for side in zip(*part, strict=True)], ["a", "b"]) for part in parts)
        stars = [tuple(row.values()) for out in bagminhash._stars(batches) for row in out.to_pylist()]
        assert all(u > v for u, v in stars)
        assert least_reachable(stars, n) == least_reachable(edges, n)


def test_few_rows_meet_by_node(spark, monkeypatch):
    """Many tasks hold the same nodes; their rows are reduced before they are joined."""
    draw, n = random.Random(2), 300
    edges = [(draw.randint(0, n - 1), draw.randint(0, n - 1)) for _ in range(6000)]
    tables, stash = [], bagminhash.stash
    monkeypatch.setattr(bagminhash, "stash", lambda df, name: tables.append(stash(df, name)) or tables[-1])
    rows = spark.createDataFrame(edges, "a long, b long").repartition(24)
    got = {r.node: r.label for r in bagminhash.components(bagminhash.star_rows(rows)).collect()}
    assert got == {x: y for x, y in least_reachable(edges, n).items() if x != y}
    joined = next(i for i, t in enumerate(tables) if "root" in t.columns) - 1
    assert tables[joined].count() <= 4 * n
