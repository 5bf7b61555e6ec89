"""Operators do their whole job on inputs beyond the ordinary."""

from __future__ import annotations

import random
import string
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

import corpus_pipeline
from lumenframe.llm import _text as tx
from lumenframe.llm import bagminhash, mixing, pii, toxicity


def test_long_secrets_are_replaced_whole(spark):
    draw = random.Random(2)
    long, key = ("".join(draw.choices(string.ascii_letters + string.digits, k=n)) for n in (300, 100))
    rows = [(0, f"token={long} end"), (1, f"use sk-{key}, please"), (2, f"token={long}x"), (3, "token=" + "a1" * 5000)]
    out = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[i].n_found == 1 and len(out[i].text) == len(rows[i][1]) for i in out)
    for i, was in ((0, long), (1, key)):
        assert not any(was[k : k + 12] in out[i].text for k in range(len(was) - 11))
    assert out[0].text.startswith("token=") and out[0].text.endswith(" end") and out[1].text.startswith("use sk-")
    assert out[0].text[6:306] != out[2].text[6:306]


def test_toxicity_learns_ngrams_of_a_single_text(spark, monkeypatch):
    learned = []
    real = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda gram, counts: learned.append(counts) or real(gram, counts))
    docs = spark.createDataFrame([(i, f"common words {chr(97 + i) * 3}rare{chr(122 - i)}") for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i // 2 % 2) for i in range(20)], "doc_id long, toxic int")
    assert toxicity.score_toxicity(docs, labels).count() == 20
    assert (learned[-1].sum(1) == 1).any()


def test_pipeline_leaves_out_what_the_mixture_does_not_take(spark):
    docs = spark.createDataFrame([(i, "some words of text", "a" if i < 90 else "b") for i in range(100)], "doc_id long, text string, source string")
    want = {(r.doc_id, r.taken) for r in mixing.mix_sources(docs).where("taken > 0").collect()}
    got = {(r.doc_id, r.taken) for r in corpus_pipeline.mix(spark, docs, "").collect()}
    assert got == want and 0 < len(got) < 100


def test_near_duplicates_are_verified_on_whole_hashes():
    a, b = (np.array(x, np.uint64) for x in ([5, 5, 9], [5 | 1 << 40, 5, 9]))
    assert bagminhash.similarity(a, b) == 0.5 and bagminhash.similarity(a, a) == 1
    text = "one two three four five six one two three four five six"
    batch = pa.RecordBatch.from_arrays([pa.array([text]), pa.array([7], pa.int64())], ["__text", "__node"])
    full = SimpleNamespace(value=b"\xff" * (1 << bagminhash._FILTER_LOG2 - 3))
    (out,) = bagminhash._multisets(full, 5)([batch])
    want = np.sort(bagminhash.shingles(tx.column(batch.column("__text")), 0, 1, 5)[1])
    assert np.array_equal(np.frombuffer(out.column("bag")[0].as_py(), np.uint64), want)
