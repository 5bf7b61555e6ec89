"""``cooccurrence``, ``sim_*`` and ``sfo_*`` against their SQL as it is given, on tables of which its cuts remove nothing."""

from __future__ import annotations

import random

import duckdb
import pytest

from lumenframe.plans import catalog

#: How far a value on a rounding tie may move, by the digits that the query gives.
CLOSE = {"sim": 2e-6, "coo": 0.0, "sfo": 2e-4}


def check(spark, name, folder, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    found = con.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    want = sorted(found.fetchall())
    got = sorted(tuple(r[c] for c in columns) for r in catalog.queries()[name](spark, str(folder)).collect())
    keys = 2 if columns[:2] == ["i", "j"] else 1
    assert want and [r[:keys] for r in got] == [r[:keys] for r in want]
    assert all(a == pytest.approx(b, abs=CLOSE[name[:3]]) for r, w in zip(got, want, strict=True) for a, b in zip(r[keys:], w[keys:], strict=True))


@pytest.fixture(scope="module")
def words_dir(spark, tmp_path_factory):
    """60 labelled documents of 14 words, each in over 20 of them and at most five times in one; odd white space, null and empty texts."""
    draw = random.Random(5)
    vocabulary = [*(f"w{k:02}" for k in range(12)), "v\x0bt", "n b"]
    spaces = [" ", "  ", "\t", "\n", "\x0c", "\r\n"]
    docs = []
    for i in range(60):
        tokens = [w for w in vocabulary if draw.random() < 0.6 for _ in range(draw.randint(1, 5))]
        draw.shuffle(tokens)
        docs.append((i, "".join(t + draw.choice(spaces) for t in tokens)))
    folder = tmp_path_factory.mktemp("uncut_words")
    odd = [(100, None), (101, ""), (102, " \n"), (103, "unlabelled"), (104, "null")]
    spark.createDataFrame(docs + odd, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    labels = [(i, draw.randint(0, 1)) for i, _ in docs] + [(100, 1), (101, 0), (102, 1), (104, None)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    return folder


@pytest.mark.parametrize("name", [n for n in catalog.queries() if n.startswith("sfo_")])
def test_sfo_equals_its_sql(spark, words_dir, name):
    check(spark, name, words_dir, ("documents", "labels"))


@pytest.fixture(scope="module")
def ratings_dir(spark, tmp_path_factory):
    """30 users and 12 items, any two of which share three users or more; some are rated twice by a user."""
    draw = random.Random(6)
    rated = [(u, i) for u in range(30) for i in range(12) if u < 3 or draw.random() < 0.5]
    rated += rated[::7]
    lines = [(u, i, float(draw.randint(1, 50)), n) for n, (u, i) in enumerate(rated)]
    folder = tmp_path_factory.mktemp("uncut_ratings")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_quantity double, l_linenumber int").write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(u, u * 10) for u in range(30)], "o_orderkey long, o_custkey long").write.parquet(f"{folder}/orders.parquet")
    return folder


@pytest.mark.parametrize("name", [n for n in catalog.queries() if n.startswith(("cooccurrence", "sim_"))])
def test_pairs_equal_their_sql(spark, ratings_dir, name):
    check(spark, name, ratings_dir, ("lineitem", "orders"))


def test_top_features_are_ordered_as_returned(spark, monkeypatch):
    """Gains that agree to the digits that are returned are a tie, which goes to the smaller dim."""
    found = [(d, 3.0 + (1e-5 if d % 2 else 0.0) + d // 4, 0.1) for d in range(15)]
    monkeypatch.setattr(catalog, "_records", lambda *_: None)
    monkeypatch.setattr(catalog.sfo, "coefficients", lambda *_, **__: None)
    monkeypatch.setattr(catalog.sfo, "gains", lambda *_, **__: spark.createDataFrame(found, "dim int, gain double, coefficient double"))
    got = [(r.dim, r.gain) for r in catalog.queries()["sfo_top_features"](spark, "").collect()]
    text = catalog.oracle_sql()["sfo_top_features"]
    gain0 = f"WITH gain0 AS (SELECT * FROM (VALUES {', '.join(f'({d}, CAST({g} AS DOUBLE))' for d, g, _ in found)}) t(dim, gain)) "
    assert got == duckdb.connect().execute(gain0 + text[text.rindex("SELECT dim, round(") :]).fetchall()
