"""Importance resampling against plain Python, and the draw against its probabilities."""

from __future__ import annotations

import collections
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import _text as tx
from lumenframe.llm import quality

TOKEN = re.compile(r"[a-z0-9_\x80-￿]+|[^\sa-z0-9_\x80-￿]+")


def test_draw_follows_the_weights(spark):
    n, k = 20_000, 5_000
    rows = spark.range(2 * n).select("id", F.when(F.col("id") < n, F.lit(0.0)).otherwise(F.lit(math.log(3))).alias("log_weight"))
    got = quality.gumbel_top_k(rows, k, "id", seed=3).where("kept").select("id").toPandas()["id"].to_numpy()
    # a draw without replacement of many: a row of weight w is in it with probability 1 - exp(-w t)
    low, high = 0.0, 5.0
    for _ in range(60):
        t = (low + high) / 2
        low, high = (t, high) if n * (2 - math.exp(-t) - math.exp(-3 * t)) < k else (low, t)
    want = n * (1 - math.exp(-3 * t))
    assert len(got) == k and abs((got >= n).sum() - want) < 4 * math.sqrt(want * math.exp(-3 * t))
    other = quality.gumbel_top_k(rows, k, "id", seed=4).where("kept").select("id").toPandas()["id"].to_numpy()
    assert len(np.intersect1d(got, other)) < 0.5 * k


@pytest.mark.parametrize("k", [0, 1, 7, 10, 99])
def test_kth_largest_and_ties(spark, k):
    rows = spark.createDataFrame([(i, float(i // 2)) for i in range(10)] + [(10, None)], "id long, log_weight double")
    assert quality.gumbel_top_k(rows, k, "id").where("kept").count() == min(k, 10)
    twice = spark.createDataFrame([(1, 5.0), (1, 5.0), (2, -50.0)], "id long, log_weight double")
    assert [r.id for r in quality.gumbel_top_k(twice, 1, "id").where("kept").collect()] == [1, 1]


def test_weights_equal_plain_python(spark):
    texts = {1: "good words here and more good words", 2: "bad *** bad *** BAD", 3: "Ünïcode good words", 4: None, 5: "", 6: "good " * 200, 7: "good words here and more good words"}
    docs = spark.createDataFrame([(i, t, 1.0, "x") for i, t in texts.items()], "doc_id long, text string, log_weight double, kept string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (6, 1), (7, 1), (99, 1), (None, 1), (2, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.resample_quality(docs, labels, k=3).collect()}

    def grams(text):
        tokens = TOKEN.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
        return tokens + [("same",) if a == b else (a, b) for a, b in zip(tokens, tokens[1:])]

    # few enough n-grams for none to share a bucket
    everything = [g for t in texts.values() for g in grams(t)]
    hashed = {int(x) for t in texts.values() if t for x in quality._ngrams(tx.Column(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())])), 0, 1)[1]}
    assert len(hashed) == len(set(everything))
    learn = [i for i in (1, 2, 3, 6, 7) if zlib.crc32(str(i).encode()) % 3 != 1]
    raw, size = collections.Counter(everything), 1 << quality.BUCKETS_LOG2
    target = collections.Counter(g for i in learn if i != 2 for g in grams(texts[i]))
    back = 0.1 * target.total() + 1.0
    for i, t in texts.items():
        total = 0.0
        for g in grams(t):
            p = (raw[g] + 0.5) / (raw.total() + 0.5 * size)
            total += math.log((target[g] + back * p) / (target.total() + back)) - math.log(p)
        n = len(grams(t))
        if not n:
            assert got[i].log_weight is None and got[i].log_ratio is None and not got[i].kept
        else:
            assert got[i].log_ratio == pytest.approx(total / n, rel=1e-4, abs=1e-5)
            assert got[i].log_weight == pytest.approx(total * min(1, quality.LENGTH / n), rel=1e-4, abs=1e-5)
    assert sum(r.kept for r in got.values()) == 3
    half = quality.keep_drawn(docs, labels, fraction=0.4)
    assert half.count() == 2 and half.columns == docs.columns


def test_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "some words"), (None, "some words"), (1, "some words"), (1, "other words")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.kept for r in quality.resample_quality(docs, labels).collect()] == [True] * 4
    assert quality.resample_quality(docs, labels, k=0).where("kept").count() == 0
