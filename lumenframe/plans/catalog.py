"""Registry of the library's named queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import numeric, strings
from lumenframe.operators import clustering, forest, logistic, sfo, similarity, stats
from lumenframe.plans import datasets as data
from lumenframe.plans import sql as S
from lumenframe.session import store, table
from lumenframe.sources import text as sources

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if oracle is not None:
            _SQL[name] = oracle
        return f

    return add


def queries() -> dict[str, Query]:
    from lumenframe.plans import catalog_more  # noqa: F401  (registers its own)

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(c if isinstance(c, Column) else F.col(c), digits) + F.lit(0.0)


# ratings and similarity


@query(
    "ratings_parse",
    f"""WITH {S.LINES} SELECT "user", item, CASE WHEN line = 1 THEN 1.0 ELSE rating END AS rating FROM rating_rows""",
)
def ratings_parse(spark, sf_dir):
    rows = data.rating_rows(spark, sf_dir)
    lines = rows.select(F.concat_ws(",", F.col("user").cast("string"), F.col("item").cast("string"), F.when(F.col("line") != 1, F.col("rating").cast("string"))).alias("value"))
    return sources.parse_ratings(lines)


@query("ratings_dedupe", f"""WITH {S.RATINGS} SELECT "user", item, rating FROM ratings""")
def ratings_dedupe(spark, sf_dir):
    return data.ratings(spark, sf_dir)


@query("item_stats", f"WITH {S.STATS} SELECT item, nnz, largest, l1, l2sq FROM stats")
def item_stats(spark, sf_dir):
    return similarity.item_stats(data.ratings(spark, sf_dir))


@query("user_count", f"""WITH {S.RATINGS} SELECT count(DISTINCT "user") AS n_users FROM ratings""")
def user_count(spark, sf_dir):
    return similarity.user_count(data.ratings(spark, sf_dir))


@query(
    "ratings_sampled",
    f"""WITH {S.RATINGS} SELECT "user", item, rating FROM (SELECT *, count(*) OVER (PARTITION BY item) AS n FROM ratings)
    WHERE CAST(('0x' || substr(md5('0:' || "user" || ':' || item), 1, 13)) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) < least(20, n) / CAST(n AS DOUBLE)""",
)
def ratings_sampled(spark, sf_dir):
    return similarity.sample_down(data.ratings(spark, sf_dir), 20)


@query("cooccurrence", f"WITH {S.similarity('cooccurrence')}, big AS (SELECT * FROM pairs WHERE both_ >= 3) SELECT i, j, dot, both_ AS n_both FROM big")
def cooccurrence(spark, sf_dir):
    return similarity.cooccurrence(data.ratings(spark, sf_dir))


def _similar(measure, spark, sf_dir):
    found = similarity.similarities(data.ratings(spark, sf_dir), measure)
    return found.select("i", "j", rounded("similarity").alias("similarity"))


for _m in similarity.MEASURES:
    query(f"sim_{_m}", f"WITH {S.similarity(_m)} SELECT i, j, {S.r('s')} AS similarity FROM sims")(partial(_similar, _m))


@query("sim_threshold", f"WITH {S.similarity('tanimoto', 1, 's >= 0.06')} SELECT i, j, {S.r('s')} AS similarity FROM sims")
def sim_threshold(spark, sf_dir):
    found = similarity.similarities(data.ratings(spark, sf_dir), "tanimoto", threshold=0.06)
    return found.select("i", "j", rounded("similarity").alias("similarity"))


@query(
    "similarity_topk",
    f"""WITH {S.similarity('tanimoto', 1)} SELECT i, j, CAST(rank AS INTEGER) AS rank, {S.r('s')} AS similarity FROM
    (SELECT *, row_number() OVER (PARTITION BY i ORDER BY s DESC, j) AS rank FROM sims) WHERE rank <= 10""",
)
def similarity_topk(spark, sf_dir):
    top = similarity.top_k(similarity.similarities(data.ratings(spark, sf_dir), "tanimoto", most=10), 10)
    return top.select("i", "j", "rank", rounded("similarity").alias("similarity"))


# sources


def _supplier_lines(spark, sf_dir, multi):
    rows = table(spark, sf_dir, "supplier")
    if multi:
        label = F.concat_ws(",", (F.col("s_nationkey") % 5).cast("string"), F.lit("7"))
    else:
        label = F.when(F.col("s_acctbal") > 0, "+1").otherwise("-1")
    line = F.concat(label, F.lit("  3:"), F.col("s_nationkey").cast("string"), F.lit(" 20:"), F.col("s_acctbal").cast("string"), F.lit(" 21:0"))
    return rows.select(F.col("s_suppkey").alias("key"), line.alias("value"))


_SUPPLIER = "SELECT s_suppkey AS id, CASE WHEN {0} THEN 1 ELSE 0 END AS label, dim, value FROM (SELECT *, unnest([3, 20]) AS dim, unnest([CAST(s_nationkey AS DOUBLE), s_acctbal]) AS value FROM supplier) WHERE value <> 0"


@query("libsvm_parse_single", _SUPPLIER.format("s_acctbal > 0"))
def libsvm_parse_single(spark, sf_dir):
    return sources.parse_libsvm(_supplier_lines(spark, sf_dir, False), id_col="key", multi_label=False, num_features=22)


@query("libsvm_parse_multi", _SUPPLIER.format("s_nationkey % 5 = 2"))
def libsvm_parse_multi(spark, sf_dir):
    return sources.parse_libsvm(_supplier_lines(spark, sf_dir, True), id_col="key", positive_class=2, num_features=22)


@query("csv_select_bias", "SELECT CAST(1 AS DOUBLE) AS bias, p_retailprice, CAST(p_size AS DOUBLE) AS p_size, CAST(p_partkey AS DOUBLE) AS target FROM part")
def csv_select_bias(spark, sf_dir):
    return sources.select_matrix(table(spark, sf_dir, "part"), ["p_retailprice", "p_size"], "p_partkey", bias=True)


@query(
    "flatten_to_vector",
    "SELECT s_suppkey AS id, 5 AS size, CAST(s_nationkey AS DOUBLE) AS third, s_acctbal AS fourth FROM supplier",
)
def flatten_to_vector(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.explode(F.create_map(F.lit(2), F.col("s_nationkey").cast("double"), F.lit(3), F.col("s_acctbal"))).alias("dim", "value"))
    v = F.col("vector")
    return sources.flatten(rows, 5).select("id", F.size(v).alias("size"), v[2].alias("third"), v[3].alias("fourth"))


# statistics

_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "column_stats",
    " UNION ALL ".join(f"SELECT '{c}' AS name, {S.r(f'avg({c})')} AS mean, {S.r(f'min({c} + 0.0)')} AS low, {S.r(f'max({c} + 0.0)')} AS high, {S.r(f'max({c} + 0.0) - min({c} + 0.0)')} AS span FROM lineitem" for c in _COLUMNS),
)
def column_stats(spark, sf_dir):
    found = stats.column_stats(table(spark, sf_dir, "lineitem"), _COLUMNS)
    return found.select("name", *[rounded(c).alias(c) for c in ("mean", "low", "high", "span")])


@query(
    "range_normalize",
    "SELECT l_orderkey, l_linenumber, "
    + ", ".join(S.r(f"({c} - (SELECT avg({c}) FROM lineitem)) / (SELECT max({c} + 0.0) - min({c} + 0.0) FROM lineitem)") + f" AS {c}" for c in _COLUMNS)
    + " FROM lineitem",
)
def range_normalize(spark, sf_dir):
    rows = stats.range_normalise(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *_COLUMNS), _COLUMNS)
    return rows.select("l_orderkey", "l_linenumber", *[rounded(c).alias(c) for c in _COLUMNS])


@query("label_map", "SELECT CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS label, count(*) AS n FROM lineitem GROUP BY 1")
def label_map(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(stats.map_label(F.col("l_returnflag"), "A").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


# logistic and linear regression


def _scored(spark, sf_dir, threshold=0.5):
    return logistic.predict(data.tabular(spark, sf_dir), data.WEIGHTS, threshold=threshold)


@query("logreg_predict", f"WITH {S.SCORED} SELECT l_orderkey, l_linenumber, {S.r('p')} AS p FROM scored")
def logreg_predict(spark, sf_dir):
    return _scored(spark, sf_dir).select("l_orderkey", "l_linenumber", rounded("p").alias("p"))


@query(
    "logreg_classify_threshold",
    f"WITH {S.SCORED} SELECT label, CAST(floor(p + 0.55) AS INTEGER) AS predicted, count(*) AS n FROM scored GROUP BY 1, 2",
)
def logreg_classify_threshold(spark, sf_dir):
    return _scored(spark, sf_dir, 0.55).groupBy("label", "predicted").agg(F.count(F.lit(1)).alias("n"))


@query(
    "logreg_gradient",
    f"WITH {S.SCORED} " + " UNION ALL ".join(f"SELECT {d} AS dim, {S.r(f'sum((p - label) * x{d})', 4)} AS gradient, count(*) AS n FROM scored" for d in range(5)),
)
def logreg_gradient(spark, sf_dir):
    return logistic.gradient(data.tabular(spark, sf_dir), data.WEIGHTS).select("dim", rounded("gradient", 4).alias("gradient"), "n")


def _weights(spark, w):
    return spark.createDataFrame([(d, float(x)) for d, x in enumerate(w)], "dim int, weight double").select("dim", rounded("weight").alias("weight"))


@query("logreg_gd_5", S.descent(5, 1.0, True))
def logreg_gd_5(spark, sf_dir):
    return _weights(spark, logistic.gradient_descent(data.tabular(spark, sf_dir), 5, iterations=5, rate=1.0, mean=True))


@query("logreg_gd_5_sum", S.descent(5, 1e-6, False))
def logreg_gd_5_sum(spark, sf_dir):
    return _weights(spark, logistic.gradient_descent(data.tabular(spark, sf_dir), 5, iterations=5, rate=1e-6))


@query(
    "logreg_hessian",
    f"WITH {S.SCORED} " + " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, {S.r(f'sum(x{i} * x{j} * p * (1 - p))', 4)} AS value FROM scored" for i in range(5) for j in range(i, 5)),
)
def logreg_hessian(spark, sf_dir):
    return logistic.hessian(data.tabular(spark, sf_dir), data.WEIGHTS).select("i", "j", rounded("value", 4).alias("value"))


@query("logreg_newton")
def logreg_newton(spark, sf_dir):
    return _weights(spark, logistic.newton(data.tabular(spark, sf_dir), 5, iterations=4, penalty=1.0))


@query("logreg_lbfgs")
def logreg_lbfgs(spark, sf_dir):
    return _weights(spark, logistic.lbfgs(data.tabular(spark, sf_dir)))


@query(
    "loglik",
    f"WITH {S.SCORED} SELECT {S.r('sum(label * ln(p) + (1 - label) * ln(1 - p))', 3)} AS loglik, {S.r('avg((p - label) * (p - label))')} AS mean_squared_error FROM scored",
)
def loglik(spark, sf_dir):
    rows = _scored(spark, sf_dir)
    y, p = F.col("label"), F.col("p")
    return rows.agg(rounded(F.sum(numeric.log_likelihood(y, p)), 3).alias("loglik"), rounded(F.avg(numeric.squared_error(y, p))).alias("mean_squared_error"))


_PREDICTED = S.SCORED + ", predicted AS (SELECT *, CAST(floor(p + 0.5) AS INTEGER) AS predicted FROM scored)"


@query(
    "confusion",
    f"WITH {_PREDICTED} SELECT count(*) FILTER (label = 1 AND predicted = 1) AS tp, count(*) FILTER (label = 0 AND predicted = 0) AS tn, count(*) FILTER (label = 0 AND predicted = 1) AS fp, count(*) FILTER (label = 1 AND predicted = 0) AS fn FROM predicted",
)
def confusion(spark, sf_dir):
    return stats.confusion(_scored(spark, sf_dir))


@query(
    "accuracy",
    f"WITH {_PREDICTED} SELECT count(*) AS total, count(*) FILTER (label = predicted) AS correct, {S.r('avg(CASE WHEN label = predicted THEN 1.0 ELSE 0 END)')} AS accuracy FROM predicted",
)
def accuracy(spark, sf_dir):
    return stats.accuracy(_scored(spark, sf_dir)).withColumn("accuracy", rounded("accuracy"))


@query("mean_deviation", f"WITH {S.SCORED} SELECT {S.r('avg(abs(label - p))')} AS mean_deviation FROM scored")
def mean_deviation(spark, sf_dir):
    return stats.mean_deviation(_scored(spark, sf_dir)).select(rounded("mean_deviation").alias("mean_deviation"))


@query(
    "auc",
    f"""WITH {S.SCORED}, by_p AS (SELECT p, sum(label) AS pos, count(*) - sum(label) AS neg FROM scored GROUP BY p),
    ranked AS (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM by_p)
    SELECT {S.r('CAST(sum(pos * (below + neg / 2.0)) AS DOUBLE) / (CAST(sum(pos) AS DOUBLE) * sum(neg))')} AS auc FROM ranked""",
)
def auc(spark, sf_dir):
    return stats.auc(_scored(spark, sf_dir)).select(rounded("auc").alias("auc"))


@query(
    "linreg_normal_equations",
    "WITH x AS (SELECT CAST(1 AS DOUBLE) AS x0, CAST(p_size AS DOUBLE) / 50 AS x1, (p_partkey % 100) / CAST(100 AS DOUBLE) AS x2, p_retailprice / 1000 AS x3 FROM part) "
    + " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, {S.r(f'sum(x{i} * x{j})', 4)} AS value FROM x" for i in range(4) for j in range(i, 4)),
)
def linreg_normal_equations(spark, sf_dir):
    return logistic.gram(_part(spark, sf_dir), ["size", "key"], "price").select("i", "j", rounded("value", 4).alias("value"))


def _part(spark, sf_dir):
    return table(spark, sf_dir, "part").select((F.col("p_size") / 50).alias("size"), (F.col("p_partkey") % 100 / 100).alias("key"), (F.col("p_retailprice") / 1000).alias("price"))


@query(
    "linreg_fit",
    f"""WITH x AS (SELECT CAST(p_size AS DOUBLE) / 50 AS s, p_retailprice / 1000 AS p FROM part)
    SELECT 0 AS dim, {S.r('regr_intercept(p, s)')} AS weight FROM x UNION ALL SELECT 1, {S.r('regr_slope(p, s)')} FROM x""",
)
def linreg_fit(spark, sf_dir):
    return _weights(spark, logistic.linear_regression(_part(spark, sf_dir), ["size"], "price"))


# single-feature optimisation

_ROUNDS = 3


def _sfo(spark, sf_dir):
    return store(data.token_rows(spark, sf_dir)), data.base_model(spark)


def _records(spark, sf_dir):
    return store(sfo.records(*_sfo(spark, sf_dir)))


@query("sfo_train_records", f"WITH {S.TOKENS}, {S.sfo_step(0, 1)} SELECT dim, count(*) AS n, sum(y) AS positives, {S.r('sum(x)', 4)} AS x, {S.r('sum(z)', 4)} AS z FROM rec0 GROUP BY dim")
def sfo_train_records(spark, sf_dir):
    rows = _records(spark, sf_dir)
    return rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("positives"), rounded(F.sum("x"), 4).alias("x"), rounded(F.sum("z"), 4).alias("z"))


@query("sfo_coefficients", f"WITH {S.TOKENS}, {S.sfo_step(0, _ROUNDS)} SELECT dim, {S.r('beta', 4)} AS coefficient FROM b0_{_ROUNDS}")
def sfo_coefficients(spark, sf_dir):
    found = sfo.coefficients(_records(spark, sf_dir), iterations=_ROUNDS)
    return found.select("dim", rounded("coefficient", 4).alias("coefficient"))


@query("sfo_gains", f"WITH {S.TOKENS}, {S.sfo_step(0, _ROUNDS)} SELECT dim, {S.r('gain', 4)} AS gain, {S.r('coefficient', 4)} AS coefficient FROM gain0")
def sfo_gains(spark, sf_dir):
    rows = _records(spark, sf_dir)
    found = sfo.gains(rows, sfo.coefficients(rows, iterations=_ROUNDS))
    return found.select("dim", rounded("gain", 4).alias("gain"), rounded("coefficient", 4).alias("coefficient"))


@query("sfo_top_features", f"WITH {S.TOKENS}, {S.sfo_step(0, _ROUNDS)} SELECT dim, {S.r('gain', 4)} AS gain FROM gain0 ORDER BY gain DESC, dim LIMIT 10")
def sfo_top_features(spark, sf_dir):
    rows = _records(spark, sf_dir)
    found = sfo.gains(rows, sfo.coefficients(rows, iterations=_ROUNDS))
    # the SQL orders by the gain as it is returned, so ties are those of the rounded gains
    return sfo.best(found.select("dim", rounded("gain", 4).alias("gain")), 10)


_NEXT = "m{1} AS (SELECT * FROM m{0} UNION ALL (SELECT dim, coefficient AS weight, {1} AS step FROM gain{0} ORDER BY gain DESC, dim LIMIT 1))"


@query("sfo_forward_2", f"WITH {S.TOKENS}, {S.sfo_step(0, _ROUNDS)}, {_NEXT.format(0, 1)}, {S.sfo_step(1, _ROUNDS)}, {_NEXT.format(1, 2)} SELECT dim, {S.r('weight', 4)} AS weight, step FROM m2")
def sfo_forward_2(spark, sf_dir):
    rows, model = _sfo(spark, sf_dir)
    return sfo.forward_selection(rows, rows, model, steps=2, iterations=_ROUNDS).select("dim", rounded("weight", 4).alias("weight"), "step")


# ensembles


@query("ensemble_partition", "SELECT CAST(vec_id % 4 AS INTEGER) AS part, count(*) AS n FROM embeddings GROUP BY 1")
def ensemble_partition(spark, sf_dir):
    return logistic.random_partition(data.vectors(spark, sf_dir), 4, how="modulo").groupBy("part").agg(F.count(F.lit(1)).alias("n"))


def _trained(spark, sf_dir):
    rows = logistic.random_partition(data.vectors(spark, sf_dir).withColumnRenamed("point", "features"), 4)
    return logistic.train_ensemble(rows)


@query("ensemble_train")
def ensemble_train(spark, sf_dir):
    return _trained(spark, sf_dir).select("model", "dim", "weight")


@query("online_accuracy")
def online_accuracy(spark, sf_dir):
    return _trained(spark, sf_dir).groupBy("model").agg(F.first("online_accuracy").alias("online_accuracy"))


def _votes(spark, sf_dir):
    rows = data.vectors(spark, sf_dir).withColumnRenamed("point", "features")
    return logistic.ensemble_predict(rows, data.models())


_NO = " + ".join(f"CASE WHEN p{m} < 0.5 THEN p{m} ELSE 0 END" for m in data.models())
_YES = " + ".join(f"CASE WHEN p{m} >= 0.5 THEN p{m} ELSE 0 END" for m in data.models())


@query(
    "ensemble_vote",
    f"WITH {S.ENSEMBLE} SELECT id, label, CASE WHEN {_YES} > {_NO} THEN 1 ELSE 0 END AS as_coded, CASE WHEN {' + '.join(f'CAST(p{m} >= 0.5 AS INTEGER)' for m in data.models())} >= 2 THEN 1 ELSE 0 END AS majority FROM ps",
)
def ensemble_vote(spark, sf_dir):
    rows = _votes(spark, sf_dir)
    return rows.select("id", "label", logistic.vote(F.col("ps")).alias("as_coded"), logistic.vote(F.col("ps"), "majority").alias("majority"))


@query(
    "ensemble_eval",
    f"WITH {S.ENSEMBLE} " + " UNION ALL ".join(f"SELECT {m} AS model, count(*) AS total, count(*) FILTER ((p{m} >= 0.5) = (label = 1)) AS correct FROM ps" for m in data.models()),
)
def ensemble_eval(spark, sf_dir):
    return logistic.evaluate(_votes(spark, sf_dir))


@query(
    "ensemble_merged",
    f"WITH pts AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings) SELECT id, {S.r('1.0 / (1.0 + exp(-list_dot_product(x, ' + str(logistic.merged(data.models())) + '::DOUBLE[])))')} AS p FROM pts",
)
def ensemble_merged(spark, sf_dir):
    rows = data.vectors(spark, sf_dir)
    return logistic.predict(rows, logistic.merged(data.models()), features="point").select("id", rounded("p").alias("p"))


# random forests


def _root(spark, sf_dir):
    samples = data.order_samples(spark, sf_dir)
    members = samples.select(F.lit(0).alias("tree"), F.lit(0).cast("long").alias("node"), "id", F.lit(1).cast("long").alias("n"))
    return samples, members, forest.flat(members, samples)


@query(
    "rf_bootstrap",
    """WITH s AS (SELECT l_orderkey AS id, row_number() OVER (ORDER BY l_orderkey) - 1 AS place FROM lineitem GROUP BY 1), n AS (SELECT count(*) AS n FROM s),
    d AS (SELECT tree, CAST(floor(CAST(('0x' || substr(md5('0:' || tree || ':' || k), 1, 13)) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) * n) AS BIGINT) AS place FROM n, (SELECT unnest(range(0, 2)) AS tree), (SELECT unnest(range(0, (SELECT n FROM n))) AS k))
    SELECT CAST(tree AS INTEGER) AS tree, id, count(*) AS n FROM d JOIN s USING (place) GROUP BY 1, 2""",
)
def rf_bootstrap(spark, sf_dir):
    return forest.bootstrap(data.order_samples(spark, sf_dir), 2)


@query("rf_histogram")
def rf_histogram(spark, sf_dir):
    return forest.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice", 10)


@query("rf_split_candidates", f"WITH {S.SAMPLES} SELECT feature, split FROM cuts")
def rf_split_candidates(spark, sf_dir):
    rows = _root(spark, sf_dir)[2]
    return forest.candidates(rows).select("feature", F.explode("splits").alias("split"))


def _counts(spark, sf_dir):
    rows = _root(spark, sf_dir)[2]
    return forest.label_counts(rows, forest.candidates(rows))


@query("rf_label_distribution", f"WITH {S.SAMPLES} SELECT feature, split, label, n_left, n_right FROM dist")
def rf_label_distribution(spark, sf_dir):
    return _counts(spark, sf_dir).select("feature", "split", "label", "n_left", "n_right")


@query("rf_split_quality", f"WITH {S.SAMPLES} SELECT feature, split, CAST(l AS BIGINT) AS n_left, CAST(r AS BIGINT) AS n_right, {S.r('quality', 8)} AS quality FROM quality")
def rf_split_quality(spark, sf_dir):
    return forest.qualities(_counts(spark, sf_dir)).select("feature", "split", "n_left", "n_right", rounded("quality", 8).alias("quality"))


@query("rf_split_quality_as_coded", f"WITH {S.SAMPLES} SELECT feature, split, {S.r('ql - 0.5 * ql - 0.5 * qr', 8)} AS quality FROM quality")
def rf_split_quality_as_coded(spark, sf_dir):
    return forest.qualities(_counts(spark, sf_dir), "as_coded").select("feature", "split", rounded("quality", 8).alias("quality"))


@query("rf_best_split", f"WITH {S.SAMPLES} SELECT feature, split, CAST(l AS BIGINT) AS n_left, CAST(r AS BIGINT) AS n_right, {S.r('quality', 8)} AS quality FROM best")
def rf_best_split(spark, sf_dir):
    best = forest.best_splits(forest.qualities(_counts(spark, sf_dir)))
    return best.select("feature", "split", "n_left", "n_right", rounded("quality", 8).alias("quality"))


def _level(spark, sf_dir):
    samples, members, _ = _root(spark, sf_dir)
    nodes = spark.createDataFrame([(0, 0, [], [0, 1, 2, 3])], "tree int, node long, used array<int>, dims array<int>")
    return forest.grow_level(samples, members, nodes, min_items=1)


@query("rf_level", f"WITH {S.SAMPLES} SELECT 0 AS tree, CAST(0 AS BIGINT) AS node, feature, split, CAST(NULL AS INTEGER) AS label FROM best")
def rf_level(spark, sf_dir):
    return _level(spark, sf_dir)[0].select("tree", "node", "feature", "split", "label")


@query(
    "rf_partition",
    f"WITH {S.SAMPLES} SELECT CASE WHEN value <= split THEN 1 ELSE 2 END AS node, count(*) AS n FROM flat JOIN best USING (feature) GROUP BY 1",
)
def rf_partition(spark, sf_dir):
    return _level(spark, sf_dir)[1].groupBy(F.col("node").cast("int").alias("node")).agg(F.count(F.lit(1)).alias("n"))


@query("rf_build")
def rf_build(spark, sf_dir):
    points = data.vectors(spark, sf_dir).select("id", F.col("cls").cast("int").alias("label"), F.col("point").alias("features"))
    return forest.build(points, 64, trees=2)


_TREES = [(0, 0, 1, 100.0, None), (0, 1, None, None, 0), (0, 2, 0, 4.0, None), (0, 5, None, None, 1), (0, 6, None, None, 0), (1, 0, 2, 0.02, None), (1, 1, None, None, 1), (1, 2, None, None, 0), (2, 0, None, None, 1)]


@query(
    "rf_eval",
    f"""WITH {S.SAMPLES}, votes AS (SELECT id, label, CASE WHEN f1 <= 100 THEN 0 WHEN f0 <= 4 THEN 1 ELSE 0 END AS v0, CASE WHEN f2 <= 0.02 THEN 1 ELSE 0 END AS v1, 1 AS v2 FROM samples)
    SELECT id, CASE WHEN v0 + v1 + v2 >= 2 THEN 1 ELSE 0 END AS predicted FROM votes""",
)
def rf_eval(spark, sf_dir):
    trees = spark.createDataFrame(_TREES, "tree int, node long, feature int, split double, label int")
    return forest.majority_vote(forest.traverse(data.order_samples(spark, sf_dir), trees))


# clustering


def _clusters(spark, sf_dir):
    points = data.vectors(spark, sf_dir)
    return points, clustering.collect_centres(data.first_centres(points))


def _nearest(metric, spark, sf_dir):
    points, centres = _clusters(spark, sf_dir)
    return clustering.assign(points, centres, metric).select("id", "cid", rounded("dist").alias("dist"))


for _m in S.DISTANCES:
    query(f"kmeans_assign_{_m}", f"WITH {S.POINTS}, {S.assigned(_m)} SELECT id, cid, {S.r('dist')} AS dist FROM near")(partial(_nearest, _m))


def _long(spark, centres):
    rows = [(int(c), d, float(x)) for c, v in centres for d, x in enumerate(v)]
    return spark.createDataFrame(rows, "cid int, dim int, value double").select("cid", "dim", rounded("value").alias("value"))


@query("kmeans_update", f"WITH {S.POINTS}, {S.assigned('squared_euclidean')}, {S.moved('c1', 'near', 'c0')} {S.long_centres('c1')}")
def kmeans_update(spark, sf_dir):
    return _long(spark, clustering.lloyd(*_clusters(spark, sf_dir), 1))


@query(
    "kmeans_lloyd_2",
    f"WITH {S.POINTS}, {S.assigned('squared_euclidean')}, {S.moved('c1', 'near', 'c0')}, {S.assigned('squared_euclidean', 'c1', 'near1')}, {S.moved('c2', 'near1', 'c1')} {S.long_centres('c2')}",
)
def kmeans_lloyd_2(spark, sf_dir):
    return _long(spark, clustering.lloyd(*_clusters(spark, sf_dir), 2))


@query(
    "ball_kmeans_step",
    f"""WITH {S.POINTS}, {S.assigned('euclidean')}, gap AS (SELECT a.cid, min(sqrt(list_sum(list_transform(range(1, 65), lambda i: (a.c[i] - b.c[i]) * (a.c[i] - b.c[i]))))) AS gap FROM c0 a JOIN c0 b ON a.cid <> b.cid GROUP BY a.cid),
    held AS (SELECT near.* FROM near JOIN gap USING (cid) WHERE dist < 0.9 * gap), {S.moved('c1', 'held', 'c0')} {S.long_centres('c1')}""",
)
def ball_kmeans_step(spark, sf_dir):
    points, centres = _clusters(spark, sf_dir)
    new = clustering.collect_centres(clustering.ball_step(points, centres, 0.9))
    return _long(spark, sorted((dict(centres) | dict(new)).items()))


@query("cluster_weights", f"WITH {S.POINTS}, {S.assigned('squared_euclidean')} SELECT cid, CAST(count(*) AS DOUBLE) AS weight FROM near GROUP BY cid")
def cluster_weights(spark, sf_dir):
    return clustering.cluster_weights(*_clusters(spark, sf_dir))


@query("cluster_cost", f"WITH {S.POINTS}, {S.assigned('euclidean')} SELECT {S.r('sum(dist)', 4)} AS cost FROM near")
def cluster_cost(spark, sf_dir):
    return clustering.total_cost(*_clusters(spark, sf_dir)).select(rounded("cost", 4).alias("cost"))


@query("kmeans_onepass")
def kmeans_onepass(spark, sf_dir):
    return clustering.one_pass(data.vectors(spark, sf_dir))


@query("kmeans_ball_full")
def kmeans_ball_full(spark, sf_dir):
    return clustering.ball_kmeans(clustering.one_pass(data.vectors(spark, sf_dir), kappa=50), k=5)


# text

_TOKENS_SQL = "list_filter(string_split_regex(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^A-Za-z0-9_]', ' ', 'g'), '\\s+'), lambda t: t <> '')"


def _words(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rows.select("doc_id", strings.tokens(strings.replace_non_word(strings.lower_ascii(F.col("text")), ascii_only=True)).alias("w"))


@query("text_lower_nonword_tokens", f"SELECT doc_id, CAST(len(w) AS BIGINT) AS n, md5(array_to_string(w, ' ')) AS digest FROM (SELECT doc_id, {_TOKENS_SQL} AS w FROM documents)")
def text_lower_nonword_tokens(spark, sf_dir):
    return _words(spark, sf_dir).select("doc_id", F.size("w").cast("long").alias("n"), F.md5(F.array_join("w", " ")).alias("digest"))


@query(
    "stopword_filter",
    f"SELECT doc_id, CAST(len(w) AS BIGINT) AS n, md5(array_to_string(w, ' ')) AS digest FROM (SELECT doc_id, list_filter({_TOKENS_SQL}, lambda t: t NOT IN ({S.STOP_LIST})) AS w FROM documents)",
)
def stopword_filter(spark, sf_dir):
    rows = _words(spark, sf_dir).select("doc_id", strings.without_stop_words(F.col("w")).alias("w"))
    return rows.select("doc_id", F.size("w").cast("long").alias("n"), F.md5(F.array_join("w", " ")).alias("digest"))
