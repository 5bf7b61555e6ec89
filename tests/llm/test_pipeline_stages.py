"""Each stage of the pipeline on awkward tables: nulls, empty and long texts, repeated rows, ties, extra columns, nothing at all."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

import corpus_pipeline
from lumenframe.llm import _store, bagminhash, topk

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept int, size int, n_found string, label long"

#: Bad texts; of these ids only the last is held out from learning.
JUNK = [*(i for i in range(200, 230) if zlib.crc32(str(i).encode()) % 3 != 1), next(i for i in range(230, 260) if zlib.crc32(str(i).encode()) % 3 == 1)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(9)
    prose = lambda n: " ".join(f"w{int(i)}" for i in rng.integers(0, 300, n))
    passage, copy, long = prose(40), prose(120), prose(20_000)
    texts = [(i, prose(60)) for i in range(30)]
    texts += [(100, copy), (101, copy), (102, copy + " end"), (102, copy + " end"), (103, f"{prose(20)} {passage} {prose(20)}"), (104, long), (105, None), (106, ""), (107, " \n"), (None, prose(50)), (None, copy), (107, " \n"), (108, "mail a@b.co now"), *((j, f"*** $$$ %%% {j} " * 40) for j in JUNK)]
    where = tmp_path_factory.mktemp("stages")
    rows = [(i, t, "en", "s" if (i or 0) % 3 else None, None if t is None else len(t), 1, 2, "3", 4) for i, t in texts]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, int(i not in JUNK)) for i, _ in texts if i is not None] + [(999, 1), (None, 1), (3, None)], "doc_id long, quality int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(1, passage), (1, passage), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return str(where)


def test_stages_chain(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == [c.split()[0] for c in DOCS.split(", ")]
        docs = _store.stash(docs, name)
        left[name] = [r.doc_id for r in docs.collect()]
    # copies: the least id of a class stays, once (null comes first); texts without words are no copies
    assert not set(JUNK) & set(left["quality"]) and left["near_duplicates"].count(102) == 0
    assert sum(i in (100, 101, 102) for i in left["near_duplicates"]) == 0 and left["near_duplicates"].count(None) == 2
    assert 103 in left["near_duplicates"] and 103 not in left["decontamination"] and set(range(30)) <= set(left["pii"])
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    rows = mixed.collect()
    assert {"taken", "target", "text", "doc_size", "n_found"} <= set(mixed.columns) and all(r.taken > 0 for r in rows)


def test_stages_of_nothing(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_one_of_each_class_stays(spark):
    rng = np.random.default_rng(3)
    base = [f"w{int(i)}" for i in rng.integers(0, 99, 100)]
    rows = []
    for i in range(12):
        w = list(base)
        w[i * 5] = f"x{i}"
        rows.append((50 - i, " ".join(w)))
    rows += [(7, "alone"), (7, "alone"), (8, "alone"), (9, ""), (9, ""), (10, None)]
    kept = bagminhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text or "") for r in kept) == sorted([(39, rows[11][1]), (7, "alone"), (9, ""), (9, ""), (10, "")])


def test_shared_folder_is_never_the_drivers_own_on_a_cluster():
    class Unset:
        master = "spark://host:7077"
        sparkContext = property(lambda self: self)  # noqa: N815
        conf = property(lambda self: self)

        def get(self, *_):
            return None

    with pytest.raises(ValueError, match="checkpoint"):
        _store.shared_folder(Unset())


def test_scores_beyond_64_bits_are_an_error(spark):
    rows = [(0, [1e18, 1.0]), (1, [1e18, 1.0]), (2, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond 64 bits"):
        topk.topk(df, df.where("vec_id = 0")).collect()
