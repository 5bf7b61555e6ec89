"""Queries whose SQL still cuts, against that SQL without its cuts: nothing else may part them."""

from __future__ import annotations

import duckdb
import pytest

from lumenframe.plans import catalog

SF = "/root/testdata/sf0.001"
#: What ``REPLY_r01.md`` asks the SQL's owner to change.
EDITS = [("WHERE both_ >= 3", "WHERE both_ >= 1"), (" HAVING count(*) >= 20", ""), ("least(n, 5) / CAST(5 AS DOUBLE)", "n / CAST(5 AS DOUBLE)")]
CUT = [n for n, text in catalog.oracle_sql().items() if n.startswith(("cooccurrence", "sim_", "sfo_")) and any(old in text for old, _ in EDITS)]
#: How far a value on a rounding tie may move, by the digits that the query gives.
CLOSE = {"sim": 2e-6, "coo": 0.0, "sfo": 2e-4}


def test_queries_with_cut_sql():
    sims = {"euclidean", "cosine", "pearson", "tanimoto", "cityblock", "cooccurrence", "loglikelihood"}
    sfos = {"train_records", "coefficients", "gains", "top_features", "forward_2"}
    assert set(CUT) == {"cooccurrence"} | {f"sim_{m}" for m in sims} | {f"sfo_{m}" for m in sfos}


@pytest.mark.parametrize("name", CUT)
def test_query_matches_uncut_sql(spark, name):
    text = catalog.oracle_sql()[name]
    for old, new in EDITS:
        text = text.replace(old, new)
    con = duckdb.connect()
    for t in ("lineitem", "orders", "documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(text)
    columns = [c[0] for c in found.description]
    keys = 2 if columns[:2] == ["i", "j"] else 1
    want = {r[:keys]: r[keys:] for r in found.fetchall()}
    got = {r[:keys]: r[keys:] for r in (tuple(x[c] for c in columns) for x in catalog.queries()[name](spark, SF).collect())}
    close = CLOSE[name[:3]]
    # a row whose values are all zero, but for the order of a sum, may be on one side alone
    assert all(all(abs(v) <= close for v in (got.get(k) or want.get(k))) for k in got.keys() ^ want.keys())
    assert all(a == pytest.approx(b, abs=close) for k, v in want.items() if k in got for a, b in zip(got[k], v, strict=True))
