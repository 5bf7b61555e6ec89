"""SQL (DuckDB) that the queries are held against."""

from __future__ import annotations

from lumenframe.functions.strings import STOP_WORDS
from lumenframe.plans.datasets import WEIGHTS, models

LINES = """rating_rows AS (SELECT o_custkey AS "user", l_partkey AS item, l_quantity AS rating, l_linenumber AS line FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
RATINGS = LINES + """, ratings AS (SELECT "user", item, sum(rating) AS rating FROM rating_rows GROUP BY 1, 2)"""
STATS = RATINGS + """, stats AS (SELECT item, count(*) AS nnz, max(rating) AS largest, sum(abs(rating)) AS l1, sum(rating * rating) AS l2sq FROM ratings GROUP BY item)"""
TABULAR = """tab AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
  CAST(1.0 AS DOUBLE) AS x0, l_quantity / 50 AS x1, l_extendedprice / 1e5 AS x2, l_discount * 10 AS x3, l_tax * 10 AS x4 FROM lineitem)"""


def _sigma(z: str) -> str:
    return f"(1.0 / (1.0 + exp(-({z}))))"


def _z(weights) -> str:
    return " + ".join(f"x{d} * CAST({w} AS DOUBLE)" for d, w in enumerate(weights))


SCORED = TABULAR + f", scored AS (SELECT *, CAST({_sigma(_z(WEIGHTS))} AS DOUBLE) AS p FROM tab)"


def r(x: str, digits: int = 6) -> str:
    return f"round(CAST({x} AS DOUBLE), {digits}) + 0.0"


def _xlogx(x: str) -> str:
    return f"(CASE WHEN {x} > 0 THEN {x} * ln({x}) ELSE 0 END)"


def _entropy(*parts: str) -> str:
    total = "(" + " + ".join(parts) + ")"
    return f"({_xlogx(total)} - " + " - ".join(_xlogx(p) for p in parts) + ")"


def similarity(measure: str, min_both: int = 3, keep: str = "s > 0") -> str:
    scaled = "SELECT \"user\", item, rating FROM ratings"
    if measure in ("cosine", "pearson"):
        mean = "avg(rating)" if measure == "pearson" else "0.0"
        scaled = f"""SELECT "user", item, CASE WHEN len > 1e-9 THEN (rating - mean) / len ELSE 0 END AS rating FROM ratings JOIN
          (SELECT item, mean, sqrt(greatest(sq - n * mean * mean, 0)) AS len FROM (SELECT item, CAST({mean} AS DOUBLE) AS mean, sum(rating * rating) AS sq, count(*) AS n FROM ratings GROUP BY item)) USING (item)"""
    k11, k12, k21 = "both_", "(b.nnz - both_)", "(a.nnz - both_)"
    k22 = "((SELECT count(DISTINCT \"user\") FROM ratings) - a.nnz - b.nnz + both_)"
    formula = {
        "euclidean": "1.0 / (1.0 + sqrt(greatest(a.l2sq - 2 * dot + b.l2sq, 0.0)))",
        "cosine": "dot",
        "pearson": "dot",
        "tanimoto": "CAST(both_ AS DOUBLE) / (a.nnz + b.nnz - both_)",
        "cityblock": "CAST(1.0 AS DOUBLE) / (1 + a.nnz + b.nnz - 2 * both_)",
        "cooccurrence": "CAST(both_ AS DOUBLE)",
        "loglikelihood": f"1.0 - 1.0 / (1.0 + greatest(2.0 * ({_entropy(f'({k11} + {k12})', f'({k21} + {k22})')} + {_entropy(f'({k11} + {k21})', f'({k12} + {k22})')} - {_entropy(k11, k12, k21, k22)}), 0))",
    }[measure]
    return f"""{STATS}, scaled AS ({scaled}),
      pairs AS (SELECT x.item AS i, y.item AS j, sum(x.rating * y.rating) AS dot, count(*) AS both_ FROM scaled x JOIN scaled y ON x."user" = y."user" AND x.item < y.item GROUP BY 1, 2),
      sims AS (SELECT * FROM (SELECT i, j, both_, CAST({formula} AS DOUBLE) AS s FROM pairs JOIN stats a ON a.item = i JOIN stats b ON b.item = j WHERE both_ >= {min_both}) WHERE {keep})"""


def descent(steps: int, rate: float, mean: bool) -> str:
    parts = [TABULAR, "w0 AS (SELECT " + ", ".join(f"CAST(0 AS DOUBLE) AS a{d}" for d in range(5)) + ")"]
    for k in range(steps):
        z = " + ".join(f"x{d} * a{d}" for d in range(5))
        scale = f"{rate} / count(*)" if mean else f"{rate}"
        parts.append(f"e{k} AS (SELECT tab.*, {_sigma(z)} - label AS e, w.* FROM tab, w{k} w)")
        parts.append(f"w{k + 1} AS (SELECT " + ", ".join(f"max(a{d}) - {scale} * sum(e * x{d}) AS a{d}" for d in range(5)) + f" FROM e{k})")
    return "WITH " + ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT {d} AS dim, {r(f'a{d}')} AS weight FROM w{steps}" for d in range(5))


TOKENS = """words AS (SELECT doc_id AS id, quality AS label, unnest(string_split_regex(text, '\\s+')) AS token FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL),
counts AS (SELECT id, label, token, count(*) AS n FROM words WHERE token <> '' GROUP BY 1, 2, 3),
dims AS (SELECT token, CAST(dense_rank() OVER (ORDER BY token) - 1 AS INTEGER) AS dim FROM (SELECT token FROM counts GROUP BY token HAVING count(*) >= 20)),
vec AS (SELECT id, label, dim, least(n, 5) / CAST(5 AS DOUBLE) AS value FROM counts JOIN dims USING (token)),
m0 AS (SELECT * FROM (VALUES (3, CAST(0.5 AS DOUBLE), 0), (7, CAST(-0.25 AS DOUBLE), 0)) t(dim, weight, step))"""


def sfo_step(k: int, rounds: int) -> str:
    """Records, coefficients and gains for base model ``m{k}``."""
    parts = [
        f"z{k} AS (SELECT id, sum(value * coalesce(weight, 0)) AS z FROM vec LEFT JOIN m{k} USING (dim) GROUP BY id)",
        f"rec{k} AS (SELECT id, dim, label AS y, value AS x, z FROM vec JOIN z{k} USING (id) ANTI JOIN m{k} USING (dim))",
        f"b{k}_0 AS (SELECT dim, CAST(0 AS DOUBLE) AS beta, FALSE AS done FROM rec{k} GROUP BY dim)",
    ]
    for i in range(rounds):
        p = _sigma("z + x * beta")
        parts.append(
            f"b{k}_{i + 1} AS (SELECT dim, beta - step AS beta, abs(step) < 1e-6 AS done FROM (SELECT dim, beta, CASE WHEN done OR h = 0 THEN 0 ELSE g / nullif(h, 0) END AS step FROM "
            f"(SELECT dim, beta, done, sum(({p} - y) * x) AS g, sum(x * x * {p} * (1 - {p})) AS h FROM rec{k} JOIN b{k}_{i} USING (dim) GROUP BY dim, beta, done)))"
        )
    clamp = lambda q: f"(CASE WHEN {q} = 0 THEN 4.9e-324 WHEN {q} = 1 THEN 0.9999999 ELSE {q} END)"
    ll = lambda q: f"(y * ln({clamp(q)}) + (1 - y) * ln(1 - {clamp(q)}))"
    parts.append(
        f"gain{k} AS (SELECT dim, sum({ll(_sigma('z + x * beta + 1.0'))} - {ll(_sigma('z + 1.0'))}) AS gain, max(beta) AS coefficient FROM rec{k} JOIN b{k}_{rounds} USING (dim) WHERE beta <> 0 GROUP BY dim)"
    )
    return ", ".join(parts)


SAMPLES = """samples AS (SELECT l_orderkey AS id, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS label, CAST(count(*) AS DOUBLE) AS f0, sum(l_quantity) AS f1, min(l_discount + 0.0) AS f2, max(l_tax + 0.0) AS f3 FROM lineitem GROUP BY 1),
flat AS (SELECT id, label, 0 AS feature, f0 AS value FROM samples UNION ALL SELECT id, label, 1, f1 FROM samples UNION ALL SELECT id, label, 2, f2 FROM samples UNION ALL SELECT id, label, 3, f3 FROM samples),
ordered AS (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value) AS rn, count(*) OVER (PARTITION BY feature) AS n, max(value) OVER (PARTITION BY feature) AS top FROM flat),
cuts AS (SELECT DISTINCT feature, value AS split FROM ordered, (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[]) AS q) WHERE rn = ceil(n * q) AND value < top),
dist AS (SELECT feature, split, label, count(*) FILTER (value <= split) AS n_left, count(*) FILTER (value > split) AS n_right FROM flat JOIN cuts USING (feature) GROUP BY 1, 2, 3),
sums AS (SELECT feature, split, CAST(sum(n_left) AS DOUBLE) AS l, CAST(sum(n_right) AS DOUBLE) AS r, sum(CAST(n_left AS DOUBLE) * n_left) AS l2, sum(CAST(n_right AS DOUBLE) * n_right) AS r2,
  sum(CAST(n_left + n_right AS DOUBLE) * (n_left + n_right)) AS q2 FROM dist GROUP BY 1, 2),
quality AS (SELECT feature, split, l, r, (1 - q2 / ((l + r) * (l + r))) - coalesce(l / (l + r) * (1 - l2 / nullif(l * l, 0)), 0) - coalesce(r / (l + r) * (1 - r2 / nullif(r * r, 0)), 0) AS quality,
  (1 - l2 / ((l + r) * (l + r))) AS ql, (1 - r2 / ((l + r) * (l + r))) AS qr FROM sums),
best AS (SELECT * FROM quality ORDER BY round(quality, 12) DESC, feature, split LIMIT 1)"""

POINTS = """points AS (SELECT vec_id AS id, label AS cls, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
c0 AS (SELECT cls AS cid, arg_min(x, id) AS c FROM points GROUP BY cls)"""
DISTANCES = {
    "squared_euclidean": "list_sum(list_transform(range(1, 65), lambda i: (x[i] - c[i]) * (x[i] - c[i])))",
    "cosine": "1.0 - list_dot_product(x, c) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(c, c)))",
    "chebyshev": "list_max(list_transform(range(1, 65), lambda i: abs(x[i] - c[i])))",
    "euclidean": "sqrt(list_sum(list_transform(range(1, 65), lambda i: (x[i] - c[i]) * (x[i] - c[i]))))",
    "manhattan": "list_sum(list_transform(range(1, 65), lambda i: abs(x[i] - c[i])))",
    "tanimoto": "1.0 - list_dot_product(x, c) / (list_dot_product(x, x) + list_dot_product(c, c) - list_dot_product(x, c))",
}


def assigned(metric: str, centres: str = "c0", name: str = "near") -> str:
    return (
        f"{name} AS (SELECT id, x, cid, dist FROM (SELECT id, x, cid, dist, row_number() OVER (PARTITION BY id ORDER BY dist, cid) AS rn FROM "
        f"(SELECT id, x, cid, {DISTANCES[metric]} AS dist FROM points, {centres})) WHERE rn = 1)"
    )


def moved(name: str, of: str, old: str) -> str:
    """New centres as lists; a centre without points stays."""
    long = f"(SELECT cid, list(m ORDER BY d) AS c FROM (SELECT cid, d, avg(x[d]) AS m FROM {of}, (SELECT unnest(range(1, 65)) AS d) GROUP BY cid, d) GROUP BY cid)"
    return f"{name} AS (SELECT o.cid, coalesce(n.c, o.c) AS c FROM {old} o LEFT JOIN {long} n USING (cid))"


def long_centres(name: str) -> str:
    return f"SELECT cid, CAST(d - 1 AS INTEGER) AS dim, {r('c[d]')} AS value FROM {name}, (SELECT unnest(range(1, 65)) AS d)"


MODELS = ", ".join(f"[{', '.join(map(str, w))}]::DOUBLE[] AS w{m}" for m, w in models().items())
ENSEMBLE = f"""pts AS (SELECT vec_id AS id, CASE WHEN label = 1 THEN 1 ELSE 0 END AS label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), mdl AS (SELECT {MODELS}),
ps AS (SELECT id, label, {', '.join(f'1.0 / (1.0 + exp(-list_dot_product(x, w{m}))) AS p{m}' for m in models())} FROM pts, mdl)"""

STOP_LIST = ", ".join(f"'{w}'" for w in STOP_WORDS)
