"""Item pairs are summed block by block and never shuffled."""

import collections
import itertools
import random
import re

import pytest

from lumenframe.operators import similarity
from lumenframe.plans import catalog


@pytest.mark.parametrize(("block", "entries", "heavy"), [(1 << 22, 1 << 22, 2_000), (50, 1 << 22, 7), (50, 10, 2_000), (1 << 22, 30, 3)])
def test_blocks_find_all_pairs(spark, monkeypatch, block, entries, heavy):
    draw = random.Random(5)
    rows = [(u, i * 1_000_003 - 7, float(draw.randint(1, 9))) for u in range(25) for i in draw.sample(range(60), draw.randint(1, 40))]
    rows += [(3, rows[0][1], 2.0), (3, rows[0][1], 4.0), (None, 5, 1.0), (None, 6, 1.0), (4, None, 1.0)]
    want = collections.defaultdict(lambda: [0.0, 0])
    for a, b in itertools.permutations(rows, 2):
        if None not in a + b and a[0] == b[0] and a[1] < b[1]:
            want[a[1], b[1]][0] += a[2] * b[2]
            want[a[1], b[1]][1] += 1
    monkeypatch.setattr(similarity, "BLOCK", block)
    monkeypatch.setattr(similarity, "_ENTRIES", entries)
    monkeypatch.setattr(similarity, "HEAVY", heavy)
    monkeypatch.setattr(similarity, "_PAIRS", 40)
    got = similarity.cooccurrence(spark.createDataFrame(rows, "user long, item long, rating double")).collect()
    assert len(got) == len(want) and {(r.i, r.j): [r.dot, r.n_both] for r in got} == want


@pytest.mark.parametrize("name", ["similarity_topk", "similarity_totals"])
def test_pairs_are_not_shuffled(spark, name):
    plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
    # no join makes pairs, and none of their exchanges is by both items
    assert "MapInArrow" in plan and not [k for k in dealt if re.search(r"\bj#", k)]
    assert not re.search(r"Join \[user#", plan)


def test_totals_need_the_same_ratings(spark):
    with pytest.raises(ValueError, match="same ratings"):
        similarity.totals(spark.createDataFrame([(1, 1, 1.0)], "user long, item long, rating double"), ["cosine"])
