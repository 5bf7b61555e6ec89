"""Runnable programs: files in, files out, parameters by name, and a report of the run.

``python -m lumenframe.plans.programs item_similarity ratings=in.csv out=dir measure=tanimoto k=10``
"""

from __future__ import annotations

import inspect
import json
import sys
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.operators import clustering, forest, logistic, sfo, similarity
from lumenframe.session import build_session, cut
from lumenframe.sources import sinks, text

PROGRAMS: dict[str, Program] = {}


@dataclass(frozen=True)
class Program:
    """A plan by name; ``make`` takes a session and the parameters and returns what is written."""

    name: str
    make: Callable[..., DataFrame]

    def parameters(self) -> dict[str, inspect.Parameter]:
        return dict(list(inspect.signature(self.make).parameters.items())[1:])

    def usage(self) -> str:
        empty = inspect.Parameter.empty
        words = [f"{p.name}=..." if p.default is empty else f"[{p.name}={p.default}]" for p in self.parameters().values()]
        return " ".join([self.name, *words, "out=..."])

    def plan(self, spark: SparkSession, **given: str | float | int | None) -> DataFrame:
        """The result, with values given as text read as their parameters' defaults are; an unknown or missing one is an error."""
        known = self.parameters()
        wrong = set(given) - set(known) | {n for n, p in known.items() if p.default is inspect.Parameter.empty and n not in given}
        if wrong:
            raise ValueError(f"{', '.join(sorted(wrong))}: usage: {self.usage()}")
        return self.make(spark, **{n: _as(known[n].default, v) for n, v in given.items()})


def _as(default, value):
    if not isinstance(value, str) or isinstance(default, str) or default is inspect.Parameter.empty:
        return value
    return json.loads(value)


def program(make: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    PROGRAMS[make.__name__] = Program(make.__name__, make)
    return make


@program
def item_similarity(spark: SparkSession, ratings: str, measure: str = "euclidean", threshold: float | None = None, k: int = 0) -> DataFrame:
    """Lines of each item and its similar ones; ``k`` keeps the most similar, 0 all."""
    rows = similarity.dedupe(text.parse_ratings(text.read_lines(spark, ratings)))
    found = similarity.similarities(rows, measure, threshold=threshold, most=k or None)
    return sinks.similarity_text(similarity.top_k(found, k) if k else found)


@program
def batch_descent(spark: SparkSession, train: str, positive: int = 1, iterations: int = 5, rate: float = 0.05) -> DataFrame:
    """The weights of a logistic regression on libsvm lines, as ``dim weight`` lines."""
    return sinks.model_text(logistic.sparse_descent(_libsvm(spark, train, positive), iterations=iterations, rate=rate))


@program
def feature_gains(spark: SparkSession, train: str, test: str, positive: int = 1, iterations: int = 5, penalty: float = 0.0) -> DataFrame:
    """Gains of single features over an empty model, as ``dim gain coefficient`` lines."""
    rows = [sfo.records(_libsvm(spark, path, positive), text.empty_model(spark)) for path in (train, test)]
    return sinks.gains_text(sfo.gains(rows[1], sfo.coefficients(rows[0], iterations=iterations, penalty=penalty)))


@program
def random_forest(spark: SparkSession, train: str, features: int, trees: int = 1, min_items: int = forest.MIN_ITEMS, strategy: str = "big_reducer") -> DataFrame:
    """A forest on ``id label f1 f2 ...`` lines, as lines of its nodes."""
    samples = text.parse_samples(text.read_lines(spark, train))
    return sinks.forest_text(forest.build(samples, int(features), trees=trees, min_items=min_items, strategy=strategy))


@program
def one_pass_kmeans(spark: SparkSession, points: str, k: int = 5, kappa: int = 50, runs: int = 10, test_share: float = 0.0) -> DataFrame:
    """Centres of ``id|x1|x2|...|`` lines, in their form."""
    rows = text.parse_points(text.read_lines(spark, points), sep="|")
    found = clustering.ball_kmeans(clustering.one_pass(rows, kappa=kappa), k, runs=runs, test_share=test_share)
    return found.select(F.concat(F.concat_ws("|", F.col("cid").cast("string"), F.col("point").cast("array<string>")), F.lit("|")).alias("value"))


def _libsvm(spark: SparkSession, path: str, positive: int) -> DataFrame:
    lines = text.read_lines(spark, path)
    # numbers of lines hold for one reading only, so the rows are kept
    keyed = lines.withColumn("key", F.monotonically_increasing_id())
    return cut(text.parse_libsvm(keyed, id_col="key", multi_label=True, positive_class=positive))


def run(spark: SparkSession, name: str, out: str, **given) -> dict:
    """Runs a program into a text directory; (seconds of planning and of the whole job, the plan) as a report."""
    start = time.time()
    result = PROGRAMS[name].plan(spark, **given)
    planned = time.time() - start
    result.write.text(out)
    plan = result._jdf.queryExecution().toString()
    return {"program": name, "out": out, "seconds_planning": round(planned, 3), "seconds": round(time.time() - start, 3), "plan": plan}


def main(args: list[str]) -> int:
    if not args or args[0] not in PROGRAMS or any("=" not in a for a in args[1:]):
        print("\n".join(p.usage() for p in PROGRAMS.values()), file=sys.stderr)
        return 2
    given = dict(a.split("=", 1) for a in args[1:])
    spark = build_session(args[0], given.pop("master", None))
    report = run(spark, args[0], given.pop("out"), **given)
    print(json.dumps({k: v for k, v in report.items() if k != "plan"}))
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
