"""Registered queries: PCA, stepwise selection, ranked selection, collinearity."""

from __future__ import annotations

from itertools import combinations

from curata.operators import reduce as red
from curata.plans.catalog import query, rnd
from curata.plans.inputs import table

LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
STEP_COLUMNS = ["l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_partkey"]  # target first


@query("r1_pca")
def r1_pca(spark, sf_dir):
    """PCA to 90 % variance over all numeric lineitem columns, non-numeric kept."""
    return rnd(red.pca_reduce(table(spark, sf_dir, "lineitem"), 0.9))


@query(
    "r1_pca_two_columns",
    """WITH z AS (SELECT p_partkey, (p_size - (SELECT avg(p_size) FROM part)) / (SELECT stddev_samp(p_size) FROM part) AS a,
       (p_retailprice - (SELECT avg(p_retailprice) FROM part)) / (SELECT stddev_samp(p_retailprice) FROM part) AS b FROM part),
r AS (SELECT CASE WHEN corr(p_size, p_retailprice) >= 0 THEN 1 ELSE -1 END AS s FROM part)
SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, round((a + s * b) / sqrt(2), 6) + 0.0 AS PC1, round((a - s * b) / sqrt(2), 6) + 0.0 AS PC2 FROM z, r""",
)
def r1_pca_two_columns(spark, sf_dir):
    """Two weakly correlated columns: the closed form (z1 + z2, z1 - z2) / sqrt 2, both components kept."""
    part = table(spark, sf_dir, "part")
    return rnd(red.pca_reduce(part.select(part.p_partkey.cast("string").alias("p_partkey"), part.p_size.cast("double").alias("p_size"), "p_retailprice"), 0.9))


# Three columns: the correlation matrix less its diagonal has the closed eigenvalues
# 2 sqrt(s / 3) cos(phi + 2 pi j / 3); its eigenvectors are cross products of two rows.
_PCA3_SQL = """
WITH m AS (SELECT avg(c_custkey) AS m1, avg(c_nationkey) AS m2, avg(c_acctbal) AS m3, stddev_samp(c_custkey) AS s1,
       stddev_samp(c_nationkey) AS s2, stddev_samp(c_acctbal) AS s3, corr(c_custkey, c_nationkey) AS r,
       corr(c_custkey, c_acctbal) AS q, corr(c_nationkey, c_acctbal) AS t FROM customer),
o AS (SELECT *, (r * r + q * q + t * t) / 3 AS w FROM m),
e AS (SELECT o.*, j, 2 * sqrt(w) * cos(acos(greatest(-1, least(1, r * q * t / (w * sqrt(w))))) / 3 - 2 * pi() * j / 3) AS l
      FROM o, (VALUES (0), (1), (2)) k(j)),
v AS (SELECT *, r * t + q * l AS a, q * r + l * t AS b, l * l - r * r AS c, row_number() OVER (ORDER BY l DESC) AS pc FROM e),
u AS (SELECT *, sqrt(a * a + b * b + c * c) * sign(CASE WHEN abs(a) >= abs(b) AND abs(a) >= abs(c) THEN a WHEN abs(b) >= abs(c) THEN b ELSE c END) AS d FROM v),
z AS (SELECT c_mktsegment, c_name, pc, (a * (c_custkey - m1) / s1 + b * (c_nationkey - m2) / s2 + c * (c_acctbal - m3) / s3) / d AS score
      FROM customer, u)
SELECT c_mktsegment, c_name, round(max(score) FILTER (pc = 1), 6) + 0.0 AS PC1, round(max(score) FILTER (pc = 2), 6) + 0.0 AS PC2,
       round(max(score) FILTER (pc = 3), 6) + 0.0 AS PC3 FROM z GROUP BY c_mktsegment, c_name"""


@query("r1_pca_three_columns", _PCA3_SQL)
def r1_pca_three_columns(spark, sf_dir):
    """All three components of the numeric columns of customer, against their closed form."""
    return rnd(red.pca_reduce(table(spark, sf_dir, "customer").select("c_mktsegment", "c_name", "c_custkey", "c_nationkey", "c_acctbal"), 0.999))


for _dir in ("forward", "backward", "both"):

    def _fn(spark, sf_dir, _dir=_dir):
        li = table(spark, sf_dir, "lineitem").select(*LI_NUM)
        return red.stepwise(li, "l_extendedprice", _dir)

    query(f"r2_stepwise_{_dir}" if _dir == "forward" else (f"r3_stepwise_{_dir}" if _dir == "backward" else "r4_stepwise_both"))(_fn)


def _determinant(names: list[str]) -> str:
    """Determinant of the centred cross products of columns, expanded along the first row."""
    cell = lambda a, b: f"s_{min(a, b)}_{max(a, b)}"

    def minor(rows: list[str], cols: list[str]) -> str:
        if not rows:
            return "1.0"
        parts = [f"{'-' if k % 2 else '+'} {cell(rows[0], c)} * ({minor(rows[1:], cols[:k] + cols[k + 1 :])})" for k, c in enumerate(cols)]
        return " ".join(parts).removeprefix("+ ")

    return minor(names, names)


def _stepwise_sql(target: str, feats: list[str], direction: str) -> str:
    """Every subset's AIC from determinants (RSS = |S with y| / |S|), then the greedy path over the subsets."""
    names = [target, *feats]
    mean = ", ".join(f"avg(CAST({c} AS DOUBLE)) AS m_{c}" for c in names)
    sums = ", ".join(f"sum((CAST({a} AS DOUBLE) - m_{a}) * (CAST({b} AS DOUBLE) - m_{b})) / 1e6 AS s_{min(a, b)}_{max(a, b)}" for i, a in enumerate(names) for b in names[i:])
    models = []
    for mask in range(1 << len(feats)):
        own = [f for i, f in enumerate(feats) if mask >> i & 1]
        models.append(f"SELECT {mask} AS mask, n * ln(({_determinant([target, *own])}) / ({_determinant(own)}) * 1e6 / n) + 2 * {len(own) + 1} AS aic FROM g")
    full = (1 << len(feats)) - 1
    step = {"forward": "b.mask & p.mask = p.mask", "backward": "b.mask & p.mask = b.mask", "both": "true"}[direction]
    body = " UNION ALL ".join(f"SELECT '{f}' AS feature, (mask >> {i}) & 1 = 1 AS chosen FROM last" for i, f in enumerate(feats))
    return f"""WITH RECURSIVE a AS (SELECT {mean} FROM lineitem),
g AS MATERIALIZED (SELECT count(*) AS n, {sums} FROM lineitem, a),
models AS MATERIALIZED ({' UNION ALL '.join(models)}),
-- from each subset to its best neighbour of one feature more or less, if that is better
moves AS MATERIALIZED (SELECT p.mask, arg_min(b.mask, b.aic) AS best, min(b.aic) AS best_aic, any_value(p.aic) AS aic
  FROM models p JOIN models b ON bit_count(xor(b.mask, p.mask)) = 1 AND {step} GROUP BY p.mask),
path AS (SELECT {0 if direction == "forward" else full} AS mask, 0 AS steps UNION ALL
  SELECT best, steps + 1 FROM path JOIN moves USING (mask) WHERE best_aic < aic - 1e-7),
last AS (SELECT arg_max(mask, steps) AS mask FROM path)
{body}"""


def _chosen(spark, kept: list[str], feats: list[str]):
    return spark.createDataFrame([(f, f in kept) for f in feats], "feature string, chosen boolean")


for _dir, _name in (("forward", "r2_stepwise_forward_choice"), ("backward", "r3_stepwise_backward_choice"), ("both", "r4_stepwise_both_choice")):

    def _fn(spark, sf_dir, _dir=_dir):
        """Which features the stepwise search keeps, against the AIC of every subset."""
        li = table(spark, sf_dir, "lineitem").select(*STEP_COLUMNS)
        return _chosen(spark, red.stepwise(li, STEP_COLUMNS[0], _dir).columns, STEP_COLUMNS[1:])

    query(_name, _stepwise_sql(STEP_COLUMNS[0], STEP_COLUMNS[1:], _dir))(_fn)


@query("r4_stepwise_both_text_predictors")
def r4_stepwise_both_text_predictors(spark, sf_dir):
    """Stepwise (both directions) with the text columns l_returnflag and
    l_linestatus as dummy groups beside the numeric columns."""
    li = table(spark, sf_dir, "lineitem").select(*LI_NUM, "l_returnflag", "l_linestatus")
    return red.stepwise(li, "l_extendedprice", "both")


def _scores_sql(target: str, feats: list[str], k: int) -> str:
    parts = [f"SELECT '{f}' AS feature, {i} AS pos, abs(corr(CAST({f} AS DOUBLE), {target})) AS score FROM lineitem" for i, f in enumerate(feats)]
    body = "\nUNION ALL\n".join(parts)
    return f"""
WITH s AS ({body}),
r AS (SELECT feature, score, row_number() OVER (ORDER BY score DESC NULLS LAST, pos) AS rank FROM s)
SELECT feature, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank, rank <= {k} AS kept_forward,
       rank <= {len(feats)} - least({k}, {len(feats) - 1}) AS kept_backward FROM r"""


_R5_FEATS = [c for c in LI_NUM if c != "l_extendedprice"]


@query("r5_rank_select_scores", _scores_sql("l_extendedprice", _R5_FEATS, 3))
def r5_rank_select_scores(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(*LI_NUM)
    scores = red.feature_scores(li, "l_extendedprice")
    p = len(scores)
    rows = [
        (f, None if s is None else round(s, 6), i + 1, i + 1 <= 3, i + 1 <= p - min(3, p - 1))
        for i, (f, s) in enumerate(scores)
    ]
    return spark.createDataFrame(rows, "feature string, score double, rank int, kept_forward boolean, kept_backward boolean")


@query("r5_rank_select_forward")
def r5_rank_select_forward(spark, sf_dir):
    return red.rank_select(table(spark, sf_dir, "lineitem").select(*LI_NUM), "l_extendedprice", 3, "forward")


def _collinear_sql(src: str, cols: list[str], threshold: float, prefer: str, corr_expr) -> str:
    parts = []
    for i, j in combinations(range(len(cols)), 2):
        a, b = cols[i], cols[j]
        drop = a if prefer == "first" else b
        parts.append(f"SELECT '{drop}' AS column_name, COALESCE({corr_expr(a, b)}, 0) AS r FROM {src}")
    body = "\nUNION ALL\n".join(parts)
    return f"SELECT DISTINCT column_name FROM ({body}) WHERE abs(r) > {threshold}"


PART_NUM = ["p_partkey", "p_size", "p_retailprice"]


def _pearson_pair(a: str, b: str) -> str:
    return f"corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))"


@query("m1_collinear_pearson_first", _collinear_sql("part", PART_NUM, 0.3, "first", _pearson_pair))
def m1_collinear_pearson_first(spark, sf_dir):
    names = red.collinear_columns(table(spark, sf_dir, "part").select(*PART_NUM), 0.3, "pearson", "first")
    return spark.createDataFrame([(n,) for n in names], "column_name string")


@query("m1_collinear_pearson_last", _collinear_sql("part", PART_NUM, 0.3, "last", _pearson_pair))
def m1_collinear_pearson_last(spark, sf_dir):
    names = red.collinear_columns(table(spark, sf_dir, "part").select(*PART_NUM), 0.3, "pearson", "last")
    return spark.createDataFrame([(n,) for n in names], "column_name string")


@query("m1_drop_collinear_table")
def m1_drop_collinear_table(spark, sf_dir):
    """The reduced table itself (Pearson, |r| > 0.3, the later column of a pair
    goes); rows-only -- the drop decision is oracle-checked by
    ``m1_collinear_pearson_last``."""
    return red.drop_collinear(table(spark, sf_dir, "part").select(*PART_NUM), 0.3, "pearson", "last")


def _spearman_pair(a: str, b: str) -> str:
    return (
        f"(SELECT corr(ra, rb) FROM (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS ra, "
        f"rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS rb FROM "
        f"(SELECT CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y FROM part WHERE {a} IS NOT NULL AND {b} IS NOT NULL)))"
    )


@query("m1_collinear_spearman", _collinear_sql("(SELECT 1)", PART_NUM, 0.3, "first", _spearman_pair))
def m1_collinear_spearman(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(*PART_NUM)
    names = red.collinear_columns(part, 0.3, "spearman", "first")
    return spark.createDataFrame([(n,) for n in names], "column_name string")


def _kendall_pair(a: str, b: str) -> str:
    return f"""(WITH s AS (SELECT row_number() OVER () AS i, CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y FROM part),
  p AS (SELECT sign(s1.x - s2.x) * sign(s1.y - s2.y) AS sg, s1.x <> s2.x AS nx, s1.y <> s2.y AS ny FROM s s1 JOIN s s2 ON s1.i < s2.i)
  SELECT (count(*) FILTER (WHERE sg > 0) - count(*) FILTER (WHERE sg < 0))
         / sqrt(CAST(count(*) FILTER (WHERE nx) AS DOUBLE) * count(*) FILTER (WHERE ny)) FROM p)"""


@query("m1_collinear_kendall", _collinear_sql("(SELECT 1)", PART_NUM, 0.3, "last", _kendall_pair))
def m1_collinear_kendall(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(*PART_NUM)
    names = red.collinear_columns(part, 0.3, "kendall", "last")
    return spark.createDataFrame([(n,) for n in names], "column_name string")
