"""More named queries: sparse learning, second levels and weights of forests, sources, sinks, and invariants of what SQL can't compute."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.functions import numeric
from lumenframe.operators import clustering, forest, logistic, models, sfo, similarity, stats
from lumenframe.operators.histograms import histograms
from lumenframe.plans import catalog as base
from lumenframe.plans import datasets as data
from lumenframe.plans import sql as S
from lumenframe.plans.catalog import query, rounded
from lumenframe.session import table
from lumenframe.sources import sinks
from lumenframe.sources import text as sources

# ratings


@query("ratings_last", f"""WITH {S.LINES} SELECT "user", item, arg_max(rating, line * 1000 + rating) AS rating FROM rating_rows GROUP BY 1, 2""")
def ratings_last(spark, sf_dir):
    rows = data.rating_rows(spark, sf_dir).withColumn("at", F.col("line") * 1000 + F.col("rating"))
    return similarity.dedupe(rows, "last", "at")


_TOTALS = " UNION ALL ".join(
    f"(WITH {S.similarity(m, 1)} SELECT '{m}' AS measure, i, {S.r('sum(s)', 5)} AS total, CAST(sum(both_) AS BIGINT) AS n_both FROM sims GROUP BY i)" for m in ("euclidean", "tanimoto", "cityblock", "cooccurrence", "loglikelihood")
)


@query("similarity_totals", _TOTALS)
def similarity_totals(spark, sf_dir):
    """Of all pairs with a common user: each item's similarity to larger items in all."""
    found = similarity.totals(data.ratings(spark, sf_dir), ["euclidean", "tanimoto", "cityblock", "cooccurrence", "loglikelihood"])
    return found.select("measure", "i", rounded("total", 5).alias("total"), "n_both")


@query(
    "similarity_lines",
    f"""WITH {S.similarity('tanimoto', 1, 's >= 0.06')} SELECT concat(i, chr(10), string_agg(concat(j, ':', printf('%.6f', s)), chr(10) ORDER BY j)) AS value FROM sims GROUP BY i""",
)
def similarity_lines(spark, sf_dir):
    return sinks.similarity_text(similarity.similarities(data.ratings(spark, sf_dir), "tanimoto", threshold=0.06))


# sources


@query("rcv1_vectors", "SELECT s_suppkey AS id, dim, value FROM (SELECT *, unnest([3, 20]) AS dim, unnest([CAST(s_nationkey AS DOUBLE), s_acctbal]) AS value FROM supplier) WHERE value <> 0")
def rcv1_vectors(spark, sf_dir):
    lines = table(spark, sf_dir, "supplier").select(F.concat(F.col("s_suppkey").cast("string"), F.lit("  3:"), F.col("s_nationkey").cast("string"), F.lit(" 20:"), F.col("s_acctbal").cast("string"), F.lit(" 21:0")).alias("value"))
    return sources.parse_rcv1_vectors(lines)


@query("rcv1_labels", "SELECT s_suppkey AS id, CAST(max(CASE WHEN s_nationkey % 3 = 1 THEN 1 ELSE 0 END) AS INTEGER) AS label FROM supplier GROUP BY 1")
def rcv1_labels(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier")
    lines = rows.select(F.concat(F.lit("c"), (F.col("s_nationkey") % 3).cast("string"), F.lit(" "), F.col("s_suppkey").cast("string"), F.lit(" 1")).alias("value"))
    return sources.label_by_id(rows.select(F.col("s_suppkey").alias("id")), sources.parse_rcv1_labels(lines, "C1")).select("id", "label")


@query("samples_parse", "SELECT p_partkey AS id, p_size AS label, 2 AS size, p_retailprice AS first, CAST(p_size AS DOUBLE) / 255 AS second FROM part")
def samples_parse(spark, sf_dir):
    lines = table(spark, sf_dir, "part").select(F.concat_ws(" ", F.col("p_partkey").cast("string"), F.col("p_size").cast("string"), (F.col("p_retailprice") * 255).cast("string"), F.col("p_size").cast("string")).alias("value"))
    rows = sources.scale_labelled(sources.parse_samples(lines), 255)
    return rows.select("id", "label", F.size("features").alias("size"), F.round(F.col("features")[0], 2).alias("first"), F.col("features")[1].alias("second"))


@query("points_parse", "SELECT c_custkey AS id, c_acctbal AS x, CAST(c_nationkey AS DOUBLE) AS y FROM customer")
def points_parse(spark, sf_dir):
    lines = table(spark, sf_dir, "customer").select(F.concat(F.concat_ws("|", F.col("c_custkey").cast("string"), F.col("c_acctbal").cast("string"), F.col("c_nationkey").cast("string")), F.lit("|")).alias("value"))
    return sources.parse_points(lines, sep="|").select("id", F.col("point")[0].alias("x"), F.col("point")[1].alias("y"))


@query("weight_vector", "SELECT CAST(d AS INTEGER) AS dim, CAST(0.5 AS DOUBLE) AS weight FROM (SELECT unnest(range(0, 100)) AS d)")
def weight_vector(spark, sf_dir):
    return sources.weight_vector(spark, 100, 0.5).unionByName(sources.empty_model(spark))


@query("model_codec", "SELECT n_nationkey AS dim, CAST(n_regionkey AS DOUBLE) / 3 AS weight, n_name AS name FROM nation")
def model_codec(spark, sf_dir):
    model = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("dim"), (F.col("n_regionkey").cast("double") / 3).alias("weight"), F.col("n_name").alias("name"))
    return sinks.decode_model(spark, sinks.encode_model(model))


# functions


@query(
    "scalar_functions",
    f"""WITH x AS (SELECT p_partkey AS id, p_size / CAST(50 AS DOUBLE) AS q FROM part)
    SELECT id, {S.r('CASE WHEN q = 1 THEN NULL ELSE ln(q / (1 - q)) END')} AS logit, q <> 1 AND q <> 0 AS regular,
    {S.r('CASE WHEN q = 1 THEN 0 ELSE -(q * ln(q) + (1 - q) * ln(1 - q)) END')} AS entropy, {S.r('1 - q * q - (1 - q) * (1 - q)')} AS gini, {S.r('q + 1')} AS first, {S.r('CAST(2 AS DOUBLE)')} AS second FROM x""",
)
def scalar_functions(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") / 50).alias("q"))
    shares = F.array(F.col("q"), 1 - F.col("q"))
    added = numeric.add_padded(F.array(F.col("q")), F.array(F.lit(1.0), F.lit(2.0)))
    regular = numeric.is_regular(F.col("q")) & numeric.is_regular(1 - F.col("q"))
    return rows.select(
        "id",
        rounded(numeric.logit(F.col("q"))).alias("logit"),
        regular.alias("regular"),
        rounded(numeric.entropy(shares)).alias("entropy"),
        rounded(numeric.gini(shares)).alias("gini"),
        rounded(added[0]).alias("first"),
        rounded(added[1]).alias("second"),
    )


_D = "list_transform(range(1, 65), lambda i: x[i] - c[i])"


@query(
    "distances_more",
    f"""WITH {S.POINTS}, o AS (SELECT c FROM c0 WHERE cid = 0) SELECT id,
    {S.r(f'pow(list_sum(list_transform({_D}, lambda d: pow(abs(d), 3))), 1.0 / 3)')} AS minkowski,
    {S.r(f'sqrt(list_sum(list_transform({_D}, lambda d: 2 * d * d)))')} AS mahalanobis,
    {S.r(f'sqrt(list_sum(list_transform({_D}, lambda d: 0.5 * d * d)))')} AS weighted_euclidean,
    {S.r(f'list_sum(list_transform({_D}, lambda d: 0.5 * abs(d)))')} AS weighted_manhattan FROM points, o""",
)
def distances_more(spark, sf_dir):
    points, centres = base._clusters(spark, sf_dir)
    c = F.array(*[F.lit(float(v)) for v in dict(centres)[0]])
    half = F.array(*[F.lit(0.5)] * 64)
    inverse = [[2.0 * (i == j) for j in range(64)] for i in range(64)]
    of = lambda name, **o: rounded(numeric.distance(name, F.col("point"), c, **o)).alias(name)
    return points.select("id", of("minkowski", p=3.0), of("mahalanobis", inverse=inverse), of("weighted_euclidean", weights=half), of("weighted_manhattan", weights=half))


# sparse logistic regression

_SPARSE = """WITH tab AS (SELECT CASE WHEN s_acctbal > 0 THEN 1 ELSE 0 END AS label, CAST(s_nationkey AS DOUBLE) / 25 AS x3, s_acctbal / 10000 AS x20 FROM supplier), w0 AS (SELECT CAST(0 AS DOUBLE) AS a3, CAST(0 AS DOUBLE) AS a20)"""


def _sparse_descent(steps: int) -> str:
    parts = [_SPARSE]
    for k in range(steps):
        parts.append(f"e{k} AS (SELECT tab.*, {S._sigma('x3 * a3 + x20 * a20')} - label AS e, w.* FROM tab, w{k} w)")
        parts.append(f"w{k + 1} AS (SELECT max(a3) - 2.0 * sum(e * x3) / count(*) AS a3, max(a20) - 2.0 * sum(e * x20) / count(*) AS a20 FROM e{k})")
    return ", ".join(parts)


def _sparse_rows(spark, sf_dir):
    rows = base.libsvm_parse_single(spark, sf_dir)
    return rows.withColumn("value", F.col("value") / F.when(F.col("dim") == 3, 25.0).otherwise(10000.0)), table(spark, sf_dir, "supplier").count()


@query("logreg_gd_sparse", _sparse_descent(5) + f" SELECT 3 AS dim, {S.r('a3')} AS weight FROM w5 UNION ALL SELECT 20, {S.r('a20')} FROM w5")
def logreg_gd_sparse(spark, sf_dir):
    rows, n = _sparse_rows(spark, sf_dir)
    return logistic.sparse_descent(rows, iterations=5, rate=2.0, mean=True, n=n).select("dim", rounded("weight").alias("weight"))


@query(
    "logreg_gradient_sparse",
    _SPARSE + f", e AS (SELECT *, {S._sigma('x3 * 0.5 - x20')} - label AS e FROM tab) SELECT 3 AS dim, {S.r('sum(e * x3)', 5)} AS gradient FROM e UNION ALL SELECT 20, {S.r('sum(e * x20)', 5)} FROM e",
)
def logreg_gradient_sparse(spark, sf_dir):
    model = spark.createDataFrame([(3, 0.5), (20, -1.0), (21, 9.0)], "dim int, weight double")
    return logistic.sparse_gradient(_sparse_rows(spark, sf_dir)[0], model).select("dim", rounded("gradient", 5).alias("gradient"))


@query(
    "logreg_predict_sparse",
    _SPARSE.replace("SELECT CASE", "SELECT s_suppkey AS id, CASE").replace("FROM supplier)", "FROM supplier WHERE s_nationkey <> 0 OR s_acctbal <> 0)")
    + f", s AS (SELECT id, label, {S._sigma('x3 * 0.5 - x20')} AS p FROM tab) SELECT id, label, {S.r('p')} AS p, CAST(floor(p + 0.5) AS INTEGER) AS predicted FROM s",
)
def logreg_predict_sparse(spark, sf_dir):
    model = spark.createDataFrame([(3, 0.5), (20, -1.0)], "dim int, weight double")
    return logistic.sparse_predict(_sparse_rows(spark, sf_dir)[0], model).withColumn("p", rounded("p"))


@query("linreg_classify", "WITH x AS (SELECT CAST(p_size AS DOUBLE) / 50 AS s FROM part) SELECT CAST(floor(0.25 + 1.5 * s + 0.5) AS INTEGER) AS cls, count(*) AS n FROM x GROUP BY 1")
def linreg_classify(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.array(F.lit(1.0), F.col("p_size") / 50).alias("x"))
    return rows.select(logistic.round_class(logistic.linear(F.col("x"), [0.25, 1.5])).alias("cls")).groupBy("cls").agg(F.count(F.lit(1)).alias("n"))


# single-feature optimisation, over all words and whole counts

_ALL_TOKENS = """words AS (SELECT doc_id AS id, quality AS label, unnest(string_split_regex(text, '\\s+')) AS token FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL),
counts AS (SELECT id, label, token, count(*) AS n FROM words WHERE token <> '' GROUP BY 1, 2, 3),
dims AS (SELECT token, CAST(dense_rank() OVER (ORDER BY token) - 1 AS INTEGER) AS dim FROM (SELECT DISTINCT token FROM counts)),
vec AS (SELECT id, label, dim, n / CAST(5 AS DOUBLE) AS value FROM counts JOIN dims USING (token)),
m0 AS (SELECT * FROM (VALUES (3, CAST(0.5 AS DOUBLE), 0), (7, CAST(-0.25 AS DOUBLE), 0)) t(dim, weight, step))"""


@query("sfo_gain_join", f"WITH {_ALL_TOKENS}, {S.sfo_step(0, 1)} SELECT dim, {S.r('gain', 3)} AS gain, {S.r('coefficient', 3)} AS coefficient FROM gain0")
def sfo_gain_join(spark, sf_dir):
    rows = base._records(spark, sf_dir)
    return sfo.gains(rows, sfo.coefficients(rows, iterations=1)).select("dim", rounded("gain", 3).alias("gain"), rounded("coefficient", 3).alias("coefficient"))


_DROP = f"abs(y - {S._sigma('z + 1.0')}) - abs(y - {S._sigma('z + x * beta + 1.0')})"


@query(
    "sfo_mean_deviation",
    f"WITH {_ALL_TOKENS}, {S.sfo_step(0, 1)} SELECT dim, {S.r(f'sum({_DROP}) / (SELECT count(DISTINCT id) FROM vec)', 6)} AS gain FROM rec0 JOIN b0_1 USING (dim) WHERE beta <> 0 GROUP BY dim",
)
def sfo_mean_deviation(spark, sf_dir):
    vectors, model = base._sfo(spark, sf_dir)
    rows = base.store(sfo.records(vectors, model))
    n = vectors.select("id").distinct().count()
    return sfo.gains(rows, sfo.coefficients(rows, iterations=1), "mean_deviation", n).select("dim", rounded("gain").alias("gain"))


_P = S._sigma("z")


@query(
    "sfo_penalty",
    f"""WITH {_ALL_TOKENS}, {S.sfo_step(0, 1)} SELECT dim, {S.r('beta', 3)} AS coefficient FROM
    (SELECT dim, count(*) AS n, -sum(({_P} - y) * x) / (sum(x * x * {_P} * (1 - {_P})) + 0.2) AS beta FROM rec0 GROUP BY dim) WHERE n >= 5""",
)
def sfo_penalty(spark, sf_dir):
    found = sfo.coefficients(base._records(spark, sf_dir), iterations=1, penalty=0.1, min_records=5)
    return found.select("dim", rounded("coefficient", 3).alias("coefficient"))


# forests

_WEIGHED = (
    S.SAMPLES.split("flat AS")[0]
    + """wf AS (SELECT 0 AS feature, f0 AS value, id % 3 + 1 AS n FROM samples UNION ALL SELECT 1, f1, id % 3 + 1 FROM samples UNION ALL SELECT 2, f2, id % 3 + 1 FROM samples UNION ALL SELECT 3, f3, id % 3 + 1 FROM samples),
wv AS (SELECT feature, value, sum(n) AS n FROM wf GROUP BY 1, 2),
wo AS (SELECT feature, value, n, sum(n) OVER (PARTITION BY feature ORDER BY value) AS upto, sum(n) OVER (PARTITION BY feature) AS total, max(value) OVER (PARTITION BY feature) AS top FROM wv)
SELECT DISTINCT feature, value AS split FROM wo, (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[]) AS q) WHERE upto >= ceil(CAST(total AS DOUBLE) * q) AND upto - n < ceil(CAST(total AS DOUBLE) * q) AND value < top"""
)


@query("rf_candidates_weighted", f"WITH {_WEIGHED}")
def rf_candidates_weighted(spark, sf_dir):
    samples, members, _ = base._root(spark, sf_dir)
    rows = forest.flat(members.withColumn("n", F.pmod("id", F.lit(3)) + 1), samples)
    return forest.candidates(rows).select("feature", F.explode("splits").alias("split"))


_SECOND = (
    S.SAMPLES
    + """, placed AS (SELECT id, CASE WHEN value <= split THEN 1 ELSE 2 END AS node FROM flat JOIN best USING (feature)),
flat2 AS (SELECT node, flat.* FROM flat JOIN placed USING (id)),
ordered2 AS (SELECT node, feature, value, row_number() OVER (PARTITION BY node, feature ORDER BY value) AS rn, count(*) OVER (PARTITION BY node, feature) AS n, max(value) OVER (PARTITION BY node, feature) AS top FROM flat2),
cuts2 AS (SELECT DISTINCT node, feature, value AS split FROM ordered2, (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[]) AS q) WHERE rn = ceil(n * q) AND value < top),
dist2 AS (SELECT node, feature, split, label, count(*) FILTER (value <= split) AS n_left, count(*) FILTER (value > split) AS n_right FROM flat2 JOIN cuts2 USING (node, feature) GROUP BY ALL),
sums2 AS (SELECT node, feature, split, CAST(sum(n_left) AS DOUBLE) AS l, CAST(sum(n_right) AS DOUBLE) AS r, sum(CAST(n_left AS DOUBLE) * n_left) AS l2, sum(CAST(n_right AS DOUBLE) * n_right) AS r2, sum(CAST(n_left + n_right AS DOUBLE) * (n_left + n_right)) AS q2 FROM dist2 GROUP BY ALL),
quality2 AS (SELECT *, (1 - q2 / ((l + r) * (l + r))) - coalesce(l / (l + r) * (1 - l2 / nullif(l * l, 0)), 0) - coalesce(r / (l + r) * (1 - r2 / nullif(r * r, 0)), 0) AS quality FROM sums2),
best2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY round(quality, 12) DESC, feature, split) AS k FROM quality2) WHERE k = 1 AND l >= 70 AND r >= 70 AND quality > 1e-12),
label2 AS (SELECT node, arg_min(label, -n * 10 + label) AS label FROM (SELECT node, label, count(*) AS n FROM placed JOIN samples USING (id) GROUP BY ALL) GROUP BY node)
SELECT CAST(node AS BIGINT) AS node, feature, split, CASE WHEN feature IS NULL THEN label END AS label FROM label2 LEFT JOIN best2 USING (node)"""
)


@query("rf_level_2", f"WITH {_SECOND}")
def rf_level_2(spark, sf_dir):
    samples = data.order_samples(spark, sf_dir)
    _, members = base._level(spark, sf_dir)
    nodes = spark.createDataFrame([(0, n, [], [0, 1, 2, 3]) for n in (1, 2)], "tree int, node long, used array<int>, dims array<int>")
    return forest.grow_level(samples, members, nodes)[0].select("node", "feature", "split", "label")


@query(
    "rf_accuracy",
    f"""WITH {S.SAMPLES}, votes AS (SELECT id, label, CASE WHEN f1 <= 100 THEN 0 WHEN f0 <= 4 THEN 1 ELSE 0 END AS v0, CASE WHEN f2 <= 0.02 THEN 1 ELSE 0 END AS v1, 1 AS v2 FROM samples),
    p AS (SELECT label, CASE WHEN v0 + v1 + v2 >= 2 THEN 1 ELSE 0 END AS predicted FROM votes)
    SELECT count(*) AS total, count(*) FILTER (label = predicted) AS correct, {S.r('avg(CASE WHEN label = predicted THEN 1.0 ELSE 0 END)')} AS accuracy FROM p""",
)
def rf_accuracy(spark, sf_dir):
    trees = spark.createDataFrame(base._TREES, "tree int, node long, feature int, split double, label int")
    return forest.accuracy(data.order_samples(spark, sf_dir), trees).withColumn("accuracy", rounded("accuracy"))


@query("rf_build_reaches", "SELECT CAST(t AS INTEGER) AS tree, n FROM (SELECT count(*) AS n FROM embeddings), (SELECT unnest([0, 1]) AS t)")
def rf_build_reaches(spark, sf_dir):
    """Every sample reaches one leaf of each tree that was built."""
    points = data.vectors(spark, sf_dir).select("id", F.col("cls").cast("int").alias("label"), F.col("point").alias("features"))
    return forest.traverse(points, forest.build(points, 64, trees=2)).groupBy("tree").agg(F.count(F.lit(1)).alias("n"))


@query("histogram_mass", "SELECT l_returnflag AS flag, CAST(sum(l_linenumber) AS BIGINT) AS mass, min(l_extendedprice) AS low, max(l_extendedprice) AS high, TRUE AS ordered FROM lineitem GROUP BY 1")
def histogram_mass(spark, sf_dir):
    """A weighted histogram holds all counts between the least and the largest value, its centres in order."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").alias("value"), F.col("l_linenumber").alias("n"))
    found = histograms(rows, ["flag"], weight="n", size=20)
    mass = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    fine = (F.array_sort("centres") == F.col("centres")) & (F.size("centres") == 20) & (F.array_min("centres") >= F.col("low")) & (F.array_max("centres") <= F.col("high"))
    return found.select("flag", mass.alias("mass"), "low", "high", fine.alias("ordered"))


# invariants of learners whose result SQL can't compute


@query("kmeans_sketch_mass", "SELECT CAST(count(*) AS DOUBLE) AS weight, " + ", ".join(S.r(f"avg(CAST(embedding[{d + 1}] AS DOUBLE))") + f" AS mean_{d}" for d in range(4)) + " FROM embeddings")
def kmeans_sketch_mass(spark, sf_dir):
    """A sketch keeps the points' number and mean."""
    found = clustering.one_pass(data.vectors(spark, sf_dir))
    return found.agg(F.sum("weight").alias("weight"), *[rounded(F.sum(F.col("point")[d] * F.col("weight")) / F.sum("weight")).alias(f"mean_{d}") for d in range(4)])


@query("kmeans_ball_mass", "SELECT 5 AS n, CAST(count(*) AS DOUBLE) AS weight FROM embeddings")
def kmeans_ball_mass(spark, sf_dir):
    found = clustering.ball_kmeans(clustering.one_pass(data.vectors(spark, sf_dir), kappa=50), k=5)
    return found.agg(F.count(F.lit(1)).cast("int").alias("n"), F.sum("weight").alias("weight"))


@query("logreg_newton_stationary", "SELECT CAST(d AS INTEGER) AS dim, TRUE AS stationary FROM (SELECT unnest(range(0, 5)) AS d)")
def logreg_newton_stationary(spark, sf_dir):
    """At the optimum the penalised gradient vanishes."""
    rows = data.tabular(spark, sf_dir)
    w = logistic.newton(rows, 5, iterations=8, penalty=1.0)
    weights = F.array(*[F.lit(0.0), *[F.lit(float(x)) for x in w[1:]]])
    left = F.abs(F.col("gradient") + F.get(weights, F.col("dim"))) / F.col("n")
    return logistic.gradient(rows, w).select("dim", (left < 1e-9).alias("stationary"))


@query("ensemble_train_repeats", "SELECT CAST(m AS INTEGER) AS model, 64 AS dims, TRUE AS same, TRUE AS share FROM (SELECT unnest(range(0, 4)) AS m)")
def ensemble_train_repeats(spark, sf_dir):
    """Two trainings agree whatever the order of the rows, and the online accuracy is a share."""
    rows = logistic.random_partition(data.vectors(spark, sf_dir).withColumnRenamed("point", "features"), 4)
    one = logistic.train_ensemble(rows)
    other = logistic.train_ensemble(rows.orderBy(F.desc("id"))).select("model", "dim", F.col("weight").alias("again"))
    by = one.join(other, ["model", "dim"]).groupBy("model")
    return by.agg(F.count(F.lit(1)).cast("int").alias("dims"), F.bool_and(F.col("weight") == F.col("again")).alias("same"), F.bool_and(F.col("online_accuracy").between(0.0, 1.0)).alias("share"))


@query("confusion_total", "SELECT count(*) AS n FROM lineitem")
def confusion_total(spark, sf_dir):
    return stats.confusion(base._scored(spark, sf_dir)).select((F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")).alias("n"))


# many centres, many features

_MANY = "c0 AS (SELECT CAST(vec_id AS INTEGER) AS cid, CAST(embedding AS DOUBLE[]) AS c FROM embeddings ORDER BY vec_id LIMIT 40)"


def _many(spark, sf_dir):
    points = data.vectors(spark, sf_dir)
    return points, clustering.collect_centres(points.orderBy("id").limit(40), "id")


@query(
    "kmeans_assign_many",
    f"""WITH points AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), {_MANY},
    near AS (SELECT id, cid, {_D.replace('x[i] - c[i]', '(x[i] - c[i]) * (x[i] - c[i])')} AS l FROM points, c0),
    best AS (SELECT id, min(struct_pack(d := list_sum(l), c := cid)) AS b FROM near GROUP BY id) SELECT id, b.c AS cid, {S.r('b.d')} AS dist FROM best""",
)
def kmeans_assign_many(spark, sf_dir):
    return clustering.assign(*_many(spark, sf_dir)).select("id", "cid", rounded("dist").alias("dist"))


_WIDE_W = "list_transform(range(1, 65), lambda d: ((d - 1) * 7 % 11 - 5) / CAST(10 AS DOUBLE))"
_WIDE_P = f"""WITH pts AS (SELECT CASE WHEN label = 1 THEN 1 ELSE 0 END AS y, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
ps AS (SELECT *, 1.0 / (1.0 + exp(-list_dot_product(x, {_WIDE_W}))) AS p FROM pts)"""


def _wide(spark, sf_dir):
    return data.vectors(spark, sf_dir).withColumnRenamed("point", "features"), data.models()[0]


@query("logreg_gradient_wide", f"{_WIDE_P}, e AS (SELECT p - y AS e, unnest(x) AS v, unnest(range(0, 64)) AS dim FROM ps) SELECT CAST(dim AS INTEGER) AS dim, {S.r('sum(e * v)', 5)} AS gradient, count(*) AS n FROM e GROUP BY dim")
def logreg_gradient_wide(spark, sf_dir):
    return logistic.gradient(*_wide(spark, sf_dir)).select("dim", rounded("gradient", 5).alias("gradient"), "n")


@query(
    "logreg_hessian_wide",
    f"{_WIDE_P}, a AS (SELECT x, p * (1 - p) AS v, unnest(x) AS xi, unnest(range(0, 64)) AS i FROM ps), b AS (SELECT i, v * xi AS vi, unnest(x) AS xj, unnest(range(0, 64)) AS j FROM a) SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, {S.r('sum(vi * xj)', 5)} AS value FROM b WHERE i <= j GROUP BY ALL",
)
def logreg_hessian_wide(spark, sf_dir):
    return logistic.hessian(*_wide(spark, sf_dir)).select("i", "j", rounded("value", 5).alias("value"))


@query(
    "model_protocol",
    f"""WITH {S.ENSEMBLE} SELECT id, {S.r('(' + ' + '.join(f'p{m}' for m in data.models()) + ') / 3')} AS mean, CAST(floor(p0 + 0.7) AS INTEGER) AS one,
    CASE WHEN {' + '.join(f'CAST(p{m} >= 0.5 AS INTEGER)' for m in data.models())} >= 2 THEN 1 ELSE 0 END AS voted FROM ps""",
)
def model_protocol(spark, sf_dir):
    single = [models.Logistic(w, 0.7) for w in data.models().values()]
    both, x = models.Ensemble(single), F.col("point")
    return data.vectors(spark, sf_dir).select("id", rounded(both.predict(x)).alias("mean"), single[0].classify(x).alias("one"), both.classify(x).alias("voted"))
