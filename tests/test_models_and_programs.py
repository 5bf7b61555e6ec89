import json
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import clustering, forest, logistic, models, similarity, stats
from lumenframe.plans import catalog, programs
from lumenframe.sources import sinks
from tests.test_entry import SF, plain


@pytest.mark.parametrize("name", ["kmeans_assign_many", "logreg_gradient_wide", "logreg_hessian_wide", "model_protocol", "auc"])
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = catalog.queries()[name](spark, SF)
    want = con.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    assert got == sorted((tuple(map(plain, r)) for r in want.fetchall()), key=str)


def test_heavy_users_are_dealt_over_blocks(spark, monkeypatch):
    draw = random.Random(3)
    rows = sorted({(u, draw.randrange(60)) for u in range(12) for _ in range(50 if u < 2 else 4)})
    ratings = spark.createDataFrame([(u, i, float(u + i % 5 + 1)) for u, i in rows], "user long, item long, rating double")
    found = lambda: sorted(map(tuple, similarity.cooccurrence(ratings).collect()))
    whole = found()
    monkeypatch.setattr(similarity, "HEAVY", 5)
    assert found() == whole
    assert len(whole) > 500


def test_many_centres_as_few(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 3)) * 1e3 + 1e6
    rows = [(i, v.tolist(), "kept") for i, v in enumerate(x)] + [(60, None, None), (61, x[5].tolist(), "tie")]
    points = spark.createDataFrame(rows, "id long, point array<double>, cid string")
    centres = [(i, x[i].tolist()) for i in range(20)] + [(30, x[5].tolist())]
    expect = {i: min((float(((np.array(p) - c) ** 2).sum()), cid) for cid, c in centres) for i, p, _ in rows if p}
    for many in (100, 5):
        monkeypatch.setattr(clustering, "MANY", many)
        for metric in ("squared_euclidean", "euclidean"):
            got = {r.id: (r.dist, r.cid) for r in clustering.assign(points, centres, metric).where("id <> 60").collect()}
            assert {i: c for i, (_, c) in got.items()} == {i: c for i, (_, c) in expect.items()}
            assert all(abs((d if metric == "squared_euclidean" else d * d) - expect[i][0]) < 1e-6 * (1 + expect[i][0]) for i, (d, _) in got.items())
    with pytest.raises(ValueError, match="searcher"):
        clustering.assign(points, centres, searcher="tree")
    assert clustering.assign(points.where("id < 3"), centres, searcher=2).count() == 3


def test_wide_sums_as_expressions(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(int(rng.integers(2)), rng.normal(size=6).tolist()) for _ in range(40)] + [(None, [1.0] * 6), (1, None)]
    df = spark.createDataFrame(rows, "label int, features array<double>")
    w = rng.normal(size=6).tolist()
    narrow = [sorted(map(tuple, f.collect())) for f in (logistic.gradient(df, w), logistic.hessian(df, w))]
    monkeypatch.setattr(logistic, "WIDE", 2)
    wide = [sorted(map(tuple, f.collect())) for f in (logistic.gradient(df, w), logistic.hessian(df, w))]
    for a, b in zip(narrow, wide, strict=True):
        np.testing.assert_allclose(np.array(a, float), np.array(b, float), rtol=1e-9, atol=1e-12)


def test_auc_of_bunched_and_tied_scores(spark):
    draw = random.Random(5)
    rows = [(int(draw.random() < 0.4), 0.5 + draw.randrange(30) * 1e-9) for _ in range(300)] + [(1, 0.9), (0, 0.1)]
    df = spark.createDataFrame(rows, "label int, p double")
    pairs = [(a > b) + (a == b) / 2 for y, a in rows if y for z, b in rows if not z]
    assert abs(stats.auc(df).first().auc - sum(pairs) / len(pairs)) < 1e-12


def test_held_out_points_judge_and_weigh(spark):
    rng = np.random.default_rng(2)
    rows = [(0, 1.0, (rng.normal(size=2) * 0.1 + 5 * (i % 3)).tolist()) for i in range(60)]
    sketch = spark.createDataFrame(rows, "part int, weight double, point array<double>")
    total = lambda **o: clustering.ball_kmeans(sketch, 3, plus_plus=True, **o).agg(F.sum("weight")).first()[0]
    assert total() == 60
    assert total(test_share=0.25) == 60
    assert total(test_share=0.25, correct_weights=False) == 45
    with pytest.raises(ValueError, match="share"):
        clustering.ball_kmeans(sketch, 3, test_share=1.0)


def test_models_keep_the_protocol(spark):
    line, curve = models.Linear([1.0, 2.0]), models.Logistic([0.0, 1.0])
    for m in (line, curve, models.Ensemble([curve])):
        assert isinstance(m, models.Regression)
        assert isinstance(m, models.Classification)
    x = F.array(F.lit(1.0), F.lit(0.75))
    got = spark.range(1).select(line.predict(x, 1.0), line.classify(x), curve.predict(x), curve.classify(x)).first()
    assert got[:2] == (3.5, 3)
    assert abs(got[2] - 1 / (1 + np.exp(-0.75))) < 1e-12
    assert got[3] == 1


def test_forests_and_models_are_read_back(spark, tmp_path):
    trees = spark.createDataFrame([(0, 0, 1, 0.5, None), (0, 1, None, None, 0), (0, 2, None, None, 1)], "tree int, node long, feature int, split double, label int")
    sinks.forest_text(trees).write.text(str(tmp_path / "forest"))
    assert sorted(sinks.read_forest(spark, str(tmp_path / "forest")).collect()) == sorted(trees.collect())
    model = spark.createDataFrame([(0, 0.1), (7, -1e-300)], "dim int, weight double")
    sinks.model_text(model).write.text(str(tmp_path / "model"))
    assert sorted(sinks.read_model(spark, str(tmp_path / "model")).collect()) == sorted(model.collect())
    with pytest.raises(KeyError):
        forest.build(trees, 2, strategy="other")


def test_programs_read_run_and_write(spark, tmp_path):
    (tmp_path / "r.csv").write_text("1,10,2\n1,11,3\n2,10\n2,11,1\n2,12,4\n")
    (tmp_path / "l.txt").write_text("1 0:1 1:2\n0 0:1 1:-2\n1 0:1 1:1\n")
    (tmp_path / "s.txt").write_text("".join(f"{i} {i % 2} {i % 2}.5 {i}\n" for i in range(40)))
    (tmp_path / "p.txt").write_text("".join(f"{i}|{i % 2 * 9}|{i % 2 * 9 + i * 0.001}|\n" for i in range(40)))
    path = lambda n: str(tmp_path / n)
    report = programs.run(spark, "item_similarity", path("o1"), ratings=path("r.csv"), measure="tanimoto", k="1")
    assert report["seconds"] >= report["seconds_planning"]
    assert "Physical Plan" in report["plan"]
    assert sorted(r.value for r in spark.read.text(path("o1"), wholetext=True).collect() if r.value)[0].startswith("10\n11:1.000000")
    programs.run(spark, "batch_descent", path("o2"), train=path("l.txt"), iterations="3", rate="0.5")
    assert dict(map(tuple, sinks.read_model(spark, path("o2")).collect()))[1] > 0
    programs.run(spark, "feature_gains", path("o3"), train=path("l.txt"), test=path("l.txt"), iterations=2, penalty=0.1)
    assert sinks.read_gains(spark, path("o3")).first().dim == 1
    programs.run(spark, "random_forest", path("o4"), train=path("s.txt"), features="2", min_items="5", strategy="streaming")
    assert sinks.read_forest(spark, path("o4")).where("node = 0").first().feature is not None
    programs.run(spark, "one_pass_kmeans", path("o5"), points=path("p.txt"), k="2")
    assert spark.read.text(path("o5")).count() == 2
    with pytest.raises(ValueError, match="usage: batch_descent train=..."):
        programs.run(spark, "batch_descent", path("o6"), iterations=1)
    assert programs.main(["nothing"]) == 2
    json.dumps(report)
