"""Suffixes that share a prefix lie together whatever the length of the prefix, odd or even."""

import itertools
import re

import numpy as np
import pytest

from lumenframe.llm import substrings


@pytest.mark.parametrize("width", [4, 5])
def test_prefixes_of_any_length_are_nodes(width):
    rng = np.random.default_rng(width)
    words = rng.integers(1, 4, (60, width)).astype(np.uint32)
    group = np.sort(rng.integers(0, 3, 60))
    order, common = substrings.suffix_array(group, words, np.full(60, width))
    for depth in range(1, width + 1):
        node = substrings._nodes(order, common, depth)
        for a, b in itertools.combinations(range(60), 2):
            assert (node[a] == node[b]) == (group[a] == group[b] and (words[a, :depth] == words[b, :depth]).all())


def test_repeats_that_branch_at_every_word(spark):
    rng = np.random.default_rng(5)
    passage = [f"p{i}" for i in range(90)]
    rows = [(0, " ".join(passage))]
    for i in range(1, 120):
        # parts of one passage, with other words before and behind
        a = int(rng.integers(0, 40))
        b = a + int(rng.integers(48, 56))
        rows.append((i, " ".join([*(f"a{x}" for x in rng.integers(0, 9, 5)), *passage[a:b], *(f"b{x}" for x in rng.integers(0, 9, 5))])))
    docs = [(d, re.findall(r"[^\x20\x09-\x0D]+", t)) for d, t in rows]
    least = {}
    for d, w in docs:
        for k in range(len(w) - 49):
            least.setdefault(tuple(w[k : k + 50]), d)
    want = {d: len({p for k in range(len(w) - 49) if least[tuple(w[k : k + 50])] < d for p in range(k, k + 50)}) for d, w in docs}
    got = substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_removed for r in got} == want
