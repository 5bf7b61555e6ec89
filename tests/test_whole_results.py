"""Registered queries return whole results: against SQL without the cuts, and brute force."""

from __future__ import annotations

import collections
import math
import random

import duckdb
import pytest

from lumenframe.operators import similarity
from lumenframe.plans import catalog
from lumenframe.plans import datasets as data
from lumenframe.plans import sql as S

SF = "/root/testdata/sf0.001"


def from_sql(text):
    con = duckdb.connect()
    for t in ("lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con.execute(text).fetchall()


def test_cooccurrence_has_all_pairs(spark):
    want = from_sql(f"WITH {S.similarity('cooccurrence', 1)} SELECT i, j, dot, both_ FROM pairs")
    got = catalog.queries()["cooccurrence"](spark, SF).select("i", "j", "dot", "n_both").collect()
    assert any(r.n_both == 1 for r in got) and sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("measure", list(similarity.MEASURES))
def test_similarities_have_all_pairs(spark, measure):
    want = from_sql(f"WITH {S.similarity(measure, 1)} SELECT i, j, s FROM sims")
    got = {(r.i, r.j): r.similarity for r in catalog.queries()[f"sim_{measure}"](spark, SF).collect()}
    rest = {(i, j): s for i, j, s in want}
    # a similarity of zero but for the order of a sum may fall on either side
    assert all(abs(s) < 1e-9 for pair, s in rest.items() if pair not in got)
    assert all(abs(s - rest.get(pair, 0.0)) < 2e-6 for pair, s in got.items())


@pytest.fixture(scope="module")
def words_dir(spark, tmp_path_factory):
    """30 labelled documents of few words, repeated up to nine times, and one unlabelled."""
    draw = random.Random(3)
    docs = [(i, " ".join(w for w in sorted({f"w{draw.randint(0, 40):02}" for _ in range(6)}) for _ in range(draw.randint(1, 9)))) for i in range(30)]
    folder = tmp_path_factory.mktemp("words")
    spark.createDataFrame([*docs, (99, "unlabelled")], "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, i * 7 % 3 % 2) for i, _ in docs] + [(99, None)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), docs


def test_sfo_takes_all_words_and_counts(spark, words_dir):
    folder, docs = words_dir
    counts = {i: collections.Counter(t.split()) for i, t in docs}
    dims = {w: d for d, w in enumerate(sorted({w for c in counts.values() for w in c}))}
    want = sorted((i, i * 7 % 3 % 2, dims[w], n / 5) for i, c in counts.items() for w, n in c.items())
    assert max(x[3] for x in want) > 1
    assert sorted(map(tuple, data.token_rows(spark, folder).collect())) == want

    weights = {3: 0.5, 7: -0.25}
    z = collections.Counter()
    for i, _, d, x in want:
        z[i] += x * weights.get(d, 0)
    sigma = lambda t: 1 / (1 + math.exp(-t))
    found = {}
    for dim in sorted({x[2] for x in want} - set(weights)):
        rows = [(y, x, z[i]) for i, y, d, x in want if d == dim]
        beta, done = 0.0, False
        for _ in range(3):
            p = [sigma(b + x * beta) for _, x, b in rows]
            g = sum((q - y) * x for q, (y, x, _) in zip(p, rows, strict=True))
            h = sum(x * x * q * (1 - q) for q, (_, x, _) in zip(p, rows, strict=True))
            step = 0.0 if done or h == 0 else g / h
            beta, done = beta - step, abs(step) < 1e-6
        found[dim] = beta
    assert {r.dim: r.n for r in catalog.queries()["sfo_train_records"](spark, folder).collect()} == {d: sum(x[2] == d for x in want) for d in found}
    got = {r.dim: r.coefficient for r in catalog.queries()["sfo_coefficients"](spark, folder).collect()}
    assert got == {d: pytest.approx(b, abs=1e-4) for d, b in found.items()}
    assert {r.dim for r in catalog.queries()["sfo_gains"](spark, folder).collect()} == {d for d, b in found.items() if b != 0}


def test_rf_build_takes_embeddings_to_full_depth(spark):
    trees = catalog.queries()["rf_build"](spark, "/root/testdata/sf0.01").collect()
    assert any((r.feature or 0) > 3 for r in trees)
    inner = {(r.tree, r.node) for r in trees if r.label is None}
    # a node is a leaf or has both children
    assert inner and {(r.tree, r.node) for r in trees} == {(t, 0) for t in (0, 1)} | {(t, 2 * n + k) for t, n in inner for k in (1, 2)}
