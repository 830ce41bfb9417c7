"""Registered queries: typing, missing values, smoothing, outliers, consistency."""

from __future__ import annotations

from pyspark.sql import functions as F

from curata.operators import consistency, missing, outliers, schema, smoothing
from curata.plans.catalog import query, rnd
from curata.plans.inputs import derived, orders_date_text, orders_date_text_sql, table, with_derived

OG = "o_orderkey, o_custkey, o_orderstatus, {tp}, o_orderpriority"


def _og(tp: str) -> str:
    return OG.format(tp=tp)


# --- T2, T4, T6, T7, F1 -------------------------------------------------------------------------


@query(
    "t2_coerce_numeric",
    with_derived(
        "orders_number_text",
        "SELECT o_orderkey, CASE WHEN isnan(v) OR isinf(v) THEN NULL ELSE v END AS raw "
        "FROM (SELECT o_orderkey, TRY_CAST(trim(raw) AS DOUBLE) AS v FROM src)",
    ),
)
def t2_coerce_numeric(spark, sf_dir):
    df = derived(spark, sf_dir, "orders_number_text")
    return schema.prepare(df, qualitative=[], quantitative=["o_orderkey", "raw"]).withColumn(
        "o_orderkey", F.col("o_orderkey").cast("long")
    )


@query(
    "t4_null_tokens",
    with_derived(
        "orders_number_text",
        "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, "
        "CASE WHEN lower(raw) IN ('null', 'nan', 'inf', '-inf') THEN NULL ELSE raw END AS raw FROM src",
    ),
)
def t4_null_tokens(spark, sf_dir):
    df = derived(spark, sf_dir, "orders_number_text")
    return schema.prepare(df, qualitative=["o_orderkey", "raw"])


@query(
    "t5_select_by_role",
    "SELECT o_orderpriority, CAST(o_custkey AS VARCHAR) AS o_custkey, CAST(o_totalprice AS DOUBLE) AS o_totalprice, CAST(o_orderkey AS DOUBLE) AS o_orderkey FROM orders",
)
def t5_select_by_role(spark, sf_dir):
    """Both role lists at once: qualitative columns first, then quantitative ones."""
    out = schema.prepare(table(spark, sf_dir, "orders"), ["o_orderpriority", "o_custkey"], ["o_totalprice", "o_orderkey"])
    if out.columns != ["o_orderpriority", "o_custkey", "o_totalprice", "o_orderkey"]:
        raise AssertionError(out.columns)
    return out


@query("t6_drop_columns", "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def t6_drop_columns(spark, sf_dir):
    return schema.drop_columns(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderdate", "no_such_column"])


@query(
    "t7_typecast_integer",
    with_derived(
        "orders_number_text",
        "SELECT o_orderkey, CASE WHEN v = floor(v) THEN CAST(v AS BIGINT) END AS raw FROM "
        "(SELECT o_orderkey, CASE WHEN isnan(d) OR isinf(d) THEN NULL ELSE d END AS v FROM "
        "(SELECT o_orderkey, TRY_CAST(trim(raw) AS DOUBLE) AS d FROM src))",
    ),
)
def t7_typecast_integer(spark, sf_dir):
    return schema.typecast(derived(spark, sf_dir, "orders_number_text"), "raw", "integer")


@query(
    "t7_typecast_numeric",
    with_derived(
        "orders_number_text",
        "SELECT o_orderkey, CASE WHEN isnan(v) OR isinf(v) THEN NULL ELSE v END AS raw "
        "FROM (SELECT o_orderkey, TRY_CAST(trim(raw) AS DOUBLE) AS v FROM src)",
    ),
)
def t7_typecast_numeric(spark, sf_dir):
    return schema.typecast(derived(spark, sf_dir, "orders_number_text"), "raw", "numeric")


@query("t7_typecast_factor", "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey FROM orders")
def t7_typecast_factor(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return schema.typecast(o, "o_custkey", "factor")


@query("t7_typecast_logical", "SELECT l_orderkey, l_linenumber, l_discount <> 0 AS l_discount FROM lineitem")
def t7_typecast_logical(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount")
    return schema.typecast(li, "l_discount", "logical")


@query("t7_typecast_string", "SELECT o_orderkey, CAST(o_totalprice AS VARCHAR) AS o_totalprice FROM orders")
def t7_typecast_string(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return schema.typecast(o, "o_totalprice", "string")


_T7F_SQL = f"""
WITH src AS ({orders_date_text_sql()})
SELECT o_orderkey, strftime(COALESCE(
    try_strptime(trim(date_text), '%Y-%m-%d %H:%M:%S'),
    try_strptime(trim(date_text), '%Y-%m-%dT%H:%M:%S'),
    CASE WHEN regexp_full_match(trim(date_text), '\\d{{4,}}-\\d{{1,2}}-\\d{{1,2}}') THEN try_strptime(trim(date_text), '%Y-%m-%d') END,
    CASE WHEN regexp_full_match(trim(date_text), '\\d{{4,}}/\\d{{1,2}}/\\d{{1,2}}') THEN try_strptime(trim(date_text), '%Y/%m/%d') END,
    CASE WHEN regexp_full_match(trim(date_text), '\\d{{1,2}}/\\d{{1,2}}/\\d{{4,}}') THEN try_strptime(trim(date_text), '%m/%d/%Y') END,
    CASE WHEN regexp_full_match(trim(date_text), '\\d{{1,2}}/\\d{{1,2}}/\\d{{4,}}') THEN try_strptime(trim(date_text), '%d/%m/%Y') END
  ), '%Y-%m-%d %H:%M:%S') AS date_text
FROM src"""


@query("t7_typecast_date", _T7F_SQL)
def t7_typecast_date(spark, sf_dir):
    df = schema.typecast(orders_date_text(spark, sf_dir), "date_text", "date")
    return df.withColumn("date_text", F.col("date_text").cast("string"))  # wall clock, no zone


@query("f1_drop_null_rows", with_derived("orders_gaps", f"SELECT {_og('o_totalprice')} FROM src WHERE o_totalprice IS NOT NULL"))
def f1_drop_null_rows(spark, sf_dir):
    return schema.drop_null_rows(derived(spark, sf_dir, "orders_gaps"), "o_totalprice")


# --- C1-C9b ---------------------------------------------------------------------------------------


def _impute_sql(fill: str, digits: int = 4) -> str:
    return with_derived(
        "orders_gaps", f"SELECT {_og(f'round(COALESCE(o_totalprice, ({fill})), {digits}) AS o_totalprice')} FROM src"
    )


def _impute(method: str, digits: int = 4, **kw):
    def fn(spark, sf_dir):
        df = derived(spark, sf_dir, "orders_gaps")
        return rnd(missing.handle_missing(df, "o_totalprice", method, **kw), digits)

    return fn


query("c1_impute_mean", _impute_sql("SELECT avg(o_totalprice) FROM src"))(_impute("mean"))
query("c2_impute_median", _impute_sql("SELECT quantile_cont(o_totalprice, 0.5) FROM src"))(_impute("median"))
query("c4_impute_constant", _impute_sql("SELECT 0.0"))(_impute("constant", constant=0.0))
query(
    "c3_impute_mode_numeric",
    _impute_sql("SELECT o_totalprice FROM src WHERE o_totalprice IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1"),
)(_impute("mode"))


@query(
    "c3_impute_mode_text",
    with_derived(
        "orders_text_gaps",
        "SELECT o_orderkey, o_totalprice, COALESCE(o_orderpriority, (SELECT o_orderpriority FROM src "
        "WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS o_orderpriority FROM src",
    ),
)
def c3_impute_mode_text(spark, sf_dir):
    return missing.handle_missing(derived(spark, sf_dir, "orders_text_gaps"), "o_orderpriority", "mode")


query("c5_remove_rows", with_derived("orders_gaps", f"SELECT {_og('o_totalprice')} FROM src WHERE o_totalprice IS NOT NULL"))(
    _impute("remove_row")
)
query("c6_remove_column", with_derived("orders_gaps", "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM src"))(
    _impute("remove_col")
)


@query(
    "c7_regression_impute",
    with_derived(
        "lineitem_gaps",
        "SELECT l_orderkey, l_linenumber, l_quantity, l_discount, "
        "round(COALESCE(l_extendedprice, CASE WHEN l_quantity IS NOT NULL THEN a + b * l_quantity END), 4) AS l_extendedprice "
        "FROM src, (SELECT regr_intercept(l_extendedprice, l_quantity) AS a, regr_slope(l_extendedprice, l_quantity) AS b FROM src) fit",
    ),
)
def c7_regression_impute(spark, sf_dir):
    df = derived(spark, sf_dir, "lineitem_gaps")
    return rnd(missing.handle_missing(df, "l_extendedprice", "regression", features=["l_quantity"]), 4)


def _ols_sql(src: str, keys: list[str], feats: list[str], target: str, digits: int) -> str:
    """Least squares on all features at once: each centred feature less its projections on those before it."""
    ctes = [f"t0 AS (SELECT * FROM src WHERE {target} IS NOT NULL AND " + " AND ".join(f"{f} IS NOT NULL" for f in feats) + ")"]
    means = ", ".join(f"avg(CAST({f} AS DOUBLE)) AS m{i}" for i, f in enumerate(feats))
    ctes.append(f"mean AS (SELECT {means}, avg({target}) AS my FROM t0)")
    # e{i} holds feature i made orthogonal to features 0..i-1, on all rows; q{i} its coefficients
    centred = ", ".join(f"CAST({f} AS DOUBLE) - m{i} AS e{i}" for i, f in enumerate(feats))
    ctes.append(f"w0 AS (SELECT src.*, {centred}, {target} IS NOT NULL AND " + " AND ".join(f"{f} IS NOT NULL" for f in feats) + " AS fit FROM src, mean)")
    for i in range(1, len(feats)):
        coef = ", ".join(f"sum(e{i} * e{j}) / sum(e{j} * e{j}) AS b{i}_{j}" for j in range(i))
        ctes.append(f"q{i} AS (SELECT {coef} FROM w{i - 1} WHERE fit)")
        less = " - ".join([f"e{i}", *(f"b{i}_{j} * e{j}" for j in range(i))])
        ctes.append(f"w{i} AS (SELECT * REPLACE ({less} AS e{i}) FROM w{i - 1}, q{i})")
    last = len(feats) - 1
    ctes.append("g AS (SELECT " + ", ".join(f"sum(({target} - my) * e{i}) / sum(e{i} * e{i}) AS g{i}" for i in range(len(feats))) + f" FROM w{last}, mean WHERE fit)")
    pred = "my + " + " + ".join(f"g{i} * e{i}" for i in range(len(feats)))
    return ",\n".join(ctes) + f"\nSELECT {', '.join(keys)}, round(COALESCE({target}, {pred}), {digits}) AS {target} FROM w{last}, mean, g"


@query(
    "c7_regression_impute_all_features",
    with_derived("lineitem_gaps", "").rstrip()
    + ",\n"
    + _ols_sql("lineitem_gaps", ["l_orderkey", "l_linenumber", "l_quantity", "l_discount"], ["l_orderkey", "l_linenumber", "l_quantity", "l_discount"], "l_extendedprice", 4),
)
def c7_regression_impute_all_features(spark, sf_dir):
    """All other numeric columns as features."""
    return rnd(missing.handle_missing(derived(spark, sf_dir, "lineitem_gaps"), "l_extendedprice", "regression"), 4, ["l_extendedprice"])


@query(
    "c7_regression_impute_wide_key",
    with_derived("lineitem_wide", "").rstrip()
    + ",\n"
    + _ols_sql("lineitem_wide", ["wide_key", "l_linenumber", "l_discount"], ["wide_key", "l_linenumber", "l_discount"], "l_extendedprice", 4),
)
def c7_regression_impute_wide_key(spark, sf_dir):
    """Features whose widths differ by twelve orders of magnitude."""
    return rnd(missing.handle_missing(derived(spark, sf_dir, "lineitem_wide"), "l_extendedprice", "regression"), 4, ["l_extendedprice"])


def _nan_query(method: str, **kw):
    def fn(spark, sf_dir):
        return missing.handle_missing(derived(spark, sf_dir, "orders_nan"), "v", method, **kw)

    return fn


_GOOD = "v IS NOT NULL AND NOT isnan(v)"
query(
    "c3_impute_mode_nan",
    with_derived("orders_nan", f"SELECT o_orderkey, CASE WHEN {_GOOD} THEN v ELSE (SELECT v FROM src WHERE {_GOOD} GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) END AS v FROM src"),
)(_nan_query("mode"))
query("c4_impute_constant_nan", with_derived("orders_nan", f"SELECT o_orderkey, CASE WHEN {_GOOD} THEN v ELSE 42.5 END AS v FROM src"))(_nan_query("constant", constant=42.5))
query("c5_remove_rows_nan", with_derived("orders_nan", f"SELECT o_orderkey, v FROM src WHERE {_GOOD}"))(_nan_query("remove_row"))


@query("f1_drop_null_rows_nan", with_derived("orders_nan", f"SELECT o_orderkey, v FROM src WHERE {_GOOD}"))
def f1_drop_null_rows_nan(spark, sf_dir):
    return schema.drop_null_rows(derived(spark, sf_dir, "orders_nan"), "v")


@query("c8_boosted_tree_impute")
def c8_boosted_tree_impute(spark, sf_dir):
    return missing.handle_missing(derived(spark, sf_dir, "lineitem_gaps2"), "l_extendedprice", "decision_tree")


@query("c9_tree_impute")
def c9_tree_impute(spark, sf_dir):
    return missing.handle_missing(derived(spark, sf_dir, "lineitem_gaps2"), "l_extendedprice", "tree")


@query(
    "c9_tree_impute_bounds",
    with_derived(
        "lineitem_gaps2",
        "SELECT l_orderkey, l_linenumber, l_extendedprice AS known, l_extendedprice IS NULL AS filled, TRUE AS in_range FROM src",
    ),
)
def c9_tree_impute_bounds(spark, sf_dir):
    """What holds for any tree: known values stay, every gap is filled, within the range of the known values."""
    df = derived(spark, sf_dir, "lineitem_gaps2").withColumn("was", F.col("l_extendedprice"))
    low, high = df.agg(F.min("was"), F.max("was")).first()
    out = missing.handle_missing(df, "l_extendedprice", "tree", features=["l_orderkey", "l_linenumber", "l_quantity", "l_discount"])
    value, was = F.col("l_extendedprice"), F.col("was")
    inside = value.isNotNull() & (value >= low) & (value <= high) & (was.isNull() | (value == was))
    return out.select("l_orderkey", "l_linenumber", F.when(was.isNotNull(), value).alias("known"), was.isNull().alias("filled"), inside.alias("in_range"))


# A predictor of a few values: the leaves are its values, so a fill is the mean of the known rows that share it.
_STATUS_MEAN = (
    "SELECT o_orderkey, o_orderstatus, round(coalesce(o_totalprice, avg(o_totalprice) OVER (PARTITION BY o_orderstatus)), 4) + 0.0 AS o_totalprice FROM src"
)


@query("c8_boosted_tree_impute_values", with_derived("orders_gaps", _STATUS_MEAN))
def c8_boosted_tree_impute_values(spark, sf_dir):
    """Boosted trees on the status as a number: the fill itself, against the mean of its status."""
    df = derived(spark, sf_dir, "orders_gaps").withColumn("code", F.ascii("o_orderstatus"))
    out = missing.handle_missing(df, "o_totalprice", "decision_tree", features=["code"])
    return out.select("o_orderkey", "o_orderstatus", (F.round("o_totalprice", 4) + 0.0).alias("o_totalprice"))


@query("c9_tree_impute_values", with_derived("orders_gaps", _STATUS_MEAN))
def c9_tree_impute_values(spark, sf_dir):
    """One tree on the status as text: the fill itself, against the mean of its status."""
    out = missing.handle_missing(derived(spark, sf_dir, "orders_gaps"), "o_totalprice", "tree", features=["o_orderstatus"])
    return out.select("o_orderkey", "o_orderstatus", (F.round("o_totalprice", 4) + 0.0).alias("o_totalprice"))


_STATUS_OR_NONE = _STATUS_MEAN.replace("PARTITION BY o_orderstatus", "PARTITION BY CASE WHEN o_orderkey % 6 <> 0 THEN o_orderstatus END")


@query("c8_boosted_tree_impute_missing_side", with_derived("orders_gaps", _STATUS_OR_NONE))
def c8_boosted_tree_impute_missing_side(spark, sf_dir):
    """A predictor that every sixth order lacks: missing is a bin of its own, so those rows get their own mean.

    The second predictor says nothing but is always there (rows without any predictor are not filled).
    """
    code = F.when(F.col("o_orderkey") % 6 != 0, F.ascii("o_orderstatus"))
    df = derived(spark, sf_dir, "orders_gaps").withColumns({"code": code, "present": F.lit(1)})
    out = missing.handle_missing(df, "o_totalprice", "decision_tree", features=["code", "present"])
    return out.select("o_orderkey", "o_orderstatus", (F.round("o_totalprice", 4) + 0.0).alias("o_totalprice"))


@query("c9_tree_impute_surrogate", with_derived("orders_gaps", _STATUS_MEAN))
def c9_tree_impute_surrogate(spark, sf_dir):
    """Two predictors that say the same, each missing where the other is not: rows that lack one go by the other."""
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    df = derived(spark, sf_dir, "orders_gaps").withColumns(
        {"text": F.when(key % 6 != 0, status), "code": F.when((key % 5 != 0) | (key % 6 == 0), F.ascii(status))}
    )
    out = missing.handle_missing(df, "o_totalprice", "tree", features=["text", "code"])
    return out.select("o_orderkey", "o_orderstatus", (F.round("o_totalprice", 4) + 0.0).alias("o_totalprice"))


@query("c9_tree_impute_text")
def c9_tree_impute_text(spark, sf_dir):
    df = derived(spark, sf_dir, "orders_text_gaps")
    return missing.handle_missing(df, "o_orderpriority", "tree", features=["o_orderkey", "o_totalprice"])


@query(
    "c9b_unimputable_report",
    with_derived(
        "lineitem_gaps2",
        "SELECT l_orderkey, l_linenumber, l_discount, l_quantity, l_extendedprice, "
        "concat_ws(',', CASE WHEN l_orderkey IS NULL THEN 'l_orderkey' END, CASE WHEN l_linenumber IS NULL THEN 'l_linenumber' END, "
        "CASE WHEN l_discount IS NULL THEN 'l_discount' END, CASE WHEN l_quantity IS NULL THEN 'l_quantity' END) AS missing_predictors "
        "FROM src WHERE l_extendedprice IS NULL AND (l_orderkey IS NULL OR l_linenumber IS NULL OR l_discount IS NULL OR l_quantity IS NULL)",
    ),
)
def c9b_unimputable_report(spark, sf_dir):
    rep = missing.unimputable_report(derived(spark, sf_dir, "lineitem_gaps2"), "l_extendedprice")
    return rep.withColumn("missing_predictors", F.array_join("missing_predictors", ","))


# --- C10-C13 ----------------------------------------------------------------------------------------

_POS = "SELECT event_id, value, row_number() OVER (ORDER BY ts, event_id) - 1 AS pos FROM src"


@query(
    "c10_bin_means",
    with_derived("events_gaps", f"SELECT event_id, round(avg(value) OVER (PARTITION BY pos // 5), 6) AS value FROM ({_POS})"),
)
def c10_bin_means(spark, sf_dir):
    df = derived(spark, sf_dir, "events_gaps")
    return rnd(smoothing.bin_means(df, "value", ["ts", "event_id"], 5).select("event_id", "value"))


@query(
    "c11_linear_trend",
    with_derived(
        "events_gaps",
        f"SELECT event_id, round(a + b * pos, 6) AS value FROM ({_POS}) p, "
        f"(SELECT regr_intercept(value, pos) AS a, regr_slope(value, pos) AS b FROM ({_POS})) fit",
    ),
)
def c11_linear_trend(spark, sf_dir):
    df = derived(spark, sf_dir, "events_gaps")
    return rnd(smoothing.linear_trend(df, "value", ["ts", "event_id"]).select("event_id", "value"))


def _lowess_sql(frac: float, rounds: int, degree: int) -> str:
    """Local regression over row positions: every point against its k nearest fitted points, O(m * k)."""
    ctes = [
        "p AS (SELECT event_id, value, row_number() OVER (ORDER BY ts, event_id) - 1 AS x FROM src)",
        "f AS MATERIALIZED (SELECT event_id, CAST(x AS DOUBLE) AS x, value AS y, row_number() OVER (ORDER BY x) - 1 AS r FROM p WHERE value IS NOT NULL)",
        f"c AS MATERIALIZED (SELECT m, greatest(2, least(m, CAST(floor({frac} * m + 1e-10) AS BIGINT))) AS k, rng FROM (SELECT count(*) AS m, max(x) - min(x) AS rng FROM f))",
        "g AS MATERIALIZED (SELECT (a.x + b.x) / 2 AS g FROM f a, c, f b WHERE b.r = a.r + c.k)",
        # g does not fall with its place, so its rank among all is the number of smaller ones
        "u AS (SELECT v, sum(n) AS n FROM (SELECT g AS v, 1 AS n FROM g UNION ALL SELECT x, 0 FROM f) GROUP BY v)",
        "s AS MATERIALIZED (SELECT v, coalesce(sum(n) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM u)",
        "w AS (SELECT f.r, f.x, least(CAST(below AS BIGINT), m - k) AS l FROM f JOIN s ON s.v = f.x, c)",
        "win AS MATERIALIZED (SELECT w.r, w.x, l, greatest(w.x - a.x, b.x - w.x) AS h FROM w, c, f a, f b WHERE a.r = l AND b.r = l + k - 1)",
        "k0 AS (SELECT r, 1.0 AS rw FROM f)",
    ]
    if degree == 1:
        line = "CASE WHEN sqrt(greatest(s2 / s0 - (s1 / s0) * (s1 / s0), 0)) > 0.001 * rng THEN t0 / s0 - ((t1 / s0 - (s1 / s0) * (t0 / s0)) / (s2 / s0 - (s1 / s0) * (s1 / s0))) * (s1 / s0) ELSE t0 / s0 END"
    else:
        det = "(s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2))"
        line = f"CASE WHEN abs({det}) > 1e-12 THEN (t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2)) / {det} ELSE t0 / s0 END"
    for i in range(rounds + 1):
        tri = "CASE WHEN abs(f.x - win.x) / h <= 0.001 THEN 1.0 WHEN abs(f.x - win.x) / h > 0.999 THEN 0.0 ELSE pow(1 - pow(abs(f.x - win.x) / h, 3), 3) END"
        sums = ", ".join([f"sum(t * pow(d, {j})) AS s{j}" for j in range(5)] + [f"sum(t * pow(d, {j}) * y) AS t{j}" for j in range(3)])
        ctes.append(f"n{i} AS (SELECT win.r, f.x - win.x AS d, f.y, {tri} * rw AS t FROM win, c, f JOIN k{i} ON k{i}.r = f.r WHERE f.r BETWEEN l AND l + k - 1)")
        ctes.append(f"f{i} AS MATERIALIZED (SELECT r, {line} AS fit FROM (SELECT r, {sums} FROM n{i} GROUP BY r), c)")
        if i < rounds:
            ctes.append(f"e{i} AS MATERIALIZED (SELECT f.r, abs(y - fit) AS e FROM f JOIN f{i} ON f{i}.r = f.r)")
            q = f"(e / (SELECT 6 * quantile_cont(e, 0.5) FROM e{i}))"
            ctes.append(f"k{i + 1} AS MATERIALIZED (SELECT r, CASE WHEN {q} <= 0.001 THEN 1.0 WHEN {q} > 0.999 THEN 0.0 ELSE pow(1 - {q} * {q}, 2) END AS rw FROM e{i})")
    last = f"SELECT p.event_id, round(fit, 6) AS value FROM p LEFT JOIN f ON f.event_id = p.event_id LEFT JOIN f{rounds} ON f{rounds}.r = f.r"
    return with_derived("events_gaps", "").rstrip() + ",\n" + ",\n".join(ctes) + "\n" + last


@query("c12_lowess", _lowess_sql(0.3, 3, 1))
def c12_lowess(spark, sf_dir):
    """LOWESS (frac 0.3, 3 robust rounds) over the whole events table."""
    df = derived(spark, sf_dir, "events_gaps")
    return rnd(smoothing.lowess(df, "value", ["ts", "event_id"]).select("event_id", "value"))


@query("c13_loess_quadratic", _lowess_sql(0.75, 0, 2))
def c13_loess_quadratic(spark, sf_dir):
    """Degree-2 local regression, span 0.75, no robustness rounds."""
    df = derived(spark, sf_dir, "events_gaps")
    return rnd(smoothing.lowess(df, "value", ["ts", "event_id"], frac=0.75, iterations=0, degree=2).select("event_id", "value"))


# --- C14-C21 ----------------------------------------------------------------------------------------

_Z = "abs((value - (SELECT avg(value) FROM src)) / (SELECT stddev_pop(value) FROM src)) > 3"
_IQR = (
    "(value < (SELECT quantile_cont(value, 0.25) - 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) FROM src) "
    "OR value > (SELECT quantile_cont(value, 0.75) + 1.5 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) FROM src))"
)
_PCT = "(value < (SELECT quantile_cont(value, 0.01) FROM src) OR value > (SELECT quantile_cont(value, 0.99) FROM src))"
_MASKS = {"zscore": _Z, "iqr": _IQR, "percentile": _PCT}


def _detect(method: str):
    def fn(spark, sf_dir):
        return outliers.detect_outliers(derived(spark, sf_dir, "events_spikes"), "value", method)

    return fn


for _i, _m in (("c14", "zscore"), ("c15", "iqr"), ("c16", "percentile")):
    query(
        f"{_i}_detect_{_m}",
        with_derived("events_spikes", f"SELECT count(*) FILTER (WHERE {_MASKS[_m]}) AS outlier_count FROM src"),
    )(_detect(_m))

_REPL = {
    "mean": "(SELECT avg(value) FROM src)",
    "median": "(SELECT quantile_cont(value, 0.5) FROM src)",
    "mode": "(SELECT value FROM src WHERE value IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)",
}


def _handle(method: str, repl: str):
    def fn(spark, sf_dir):
        df = derived(spark, sf_dir, "events_spikes").select("event_id", "value")
        return rnd(outliers.handle_outliers(df, "value", method, repl))

    return fn


for _m in ("zscore", "iqr", "percentile"):
    for _r in ("mean", "median", "mode", "remove_row"):
        if _r == "remove_row":
            sql = with_derived("events_spikes", f"SELECT event_id, round(value, 6) AS value FROM src WHERE NOT COALESCE({_MASKS[_m]}, FALSE)")
        else:
            sql = with_derived(
                "events_spikes",
                f"SELECT event_id, round(CASE WHEN COALESCE({_MASKS[_m]}, FALSE) THEN {_REPL[_r]} ELSE value END, 6) AS value FROM src",
            )
        query(f"c17_{_m}_{_r}", sql)(_handle(_m, _r))


def _lib_sql(src: str, mask: str, action: str) -> str:
    if action == "remove":
        return with_derived(src, f"SELECT event_id, round(value, 6) AS value FROM src WHERE NOT COALESCE({mask}, FALSE)")
    keep = f"value IS NOT NULL AND NOT COALESCE({mask}, FALSE)"
    fill = (
        f"(SELECT CASE WHEN bool_and(value = floor(value)) THEN round_even(avg(value), 0) ELSE avg(value) END FROM src WHERE {keep})"
    )
    return with_derived(
        src, f"SELECT event_id, round(CASE WHEN COALESCE({mask}, FALSE) THEN {fill} ELSE value END, 6) AS value FROM src"
    )


_LZ = "abs((value - (SELECT avg(value) FROM src)) / (SELECT stddev_samp(value) FROM src)) > 2.5"


def _lib(fn_name: str, src: str, action: str):
    def fn(spark, sf_dir):
        df = derived(spark, sf_dir, src).select("event_id", "value")
        op = outliers.zscore_outliers if fn_name == "zscore" else outliers.iqr_outliers
        return rnd(op(df, "value", action=action))

    return fn


query("c18_zscore_remove", _lib_sql("events_spikes", _LZ, "remove"))(_lib("zscore", "events_spikes", "remove"))
query("c18_zscore_replace", _lib_sql("events_spikes", _LZ, "replace"))(_lib("zscore", "events_spikes", "replace"))
query("c18_zscore_replace_whole", _lib_sql("events_whole", _LZ, "replace"))(_lib("zscore", "events_whole", "replace"))
query("c19_iqr_remove", _lib_sql("events_spikes", _IQR, "remove"))(_lib("iqr", "events_spikes", "remove"))
query("c19_iqr_replace_whole", _lib_sql("events_whole", _IQR, "replace"))(_lib("iqr", "events_whole", "replace"))


_DBSCAN_SQL = """
WITH s AS (SELECT s_suppkey, s_nationkey, s_acctbal,
                  (s_nationkey - avg(s_nationkey) OVER ()) / stddev_samp(s_nationkey) OVER () AS z0,
                  (s_acctbal - avg(s_acctbal) OVER ()) / stddev_samp(s_acctbal) OVER () AS z1 FROM supplier),
nb AS (SELECT a.s_suppkey AS id, b.s_suppkey AS nid FROM s a JOIN s b
       ON (a.z0 - b.z0) * (a.z0 - b.z0) + (a.z1 - b.z1) * (a.z1 - b.z1) <= 0.25),
core AS (SELECT id, count(*) >= 5 AS is_core FROM nb GROUP BY id),
flag AS (SELECT nb.id, bool_or(c.is_core) AS near_core FROM nb JOIN core c ON c.id = nb.nid GROUP BY nb.id)
SELECT s.s_suppkey, s.s_nationkey, s.s_acctbal
FROM s JOIN flag ON flag.id = s.s_suppkey
WHERE flag.near_core"""


@query("c20_dbscan_remove_noise", _DBSCAN_SQL)
def c20_dbscan_remove_noise(spark, sf_dir):
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    return outliers.dbscan_outliers(sup, ["s_nationkey", "s_acctbal"], eps=0.5, min_pts=5, id_col="s_suppkey")


_DBSCAN_REPLACE_SQL = """
WITH s AS (SELECT s_suppkey, s_nationkey, s_acctbal,
                  (s_nationkey - avg(s_nationkey) OVER ()) / stddev_samp(s_nationkey) OVER () AS z0,
                  (s_acctbal - avg(s_acctbal) OVER ()) / stddev_samp(s_acctbal) OVER () AS z1 FROM supplier),
nb AS (SELECT a.s_suppkey AS id, b.s_suppkey AS nid FROM s a JOIN s b
       ON (a.z0 - b.z0) * (a.z0 - b.z0) + (a.z1 - b.z1) * (a.z1 - b.z1) <= 0.25),
core AS (SELECT id, count(*) >= 5 AS is_core FROM nb GROUP BY id),
flag AS (SELECT nb.id, NOT bool_or(c.is_core) AS noise FROM nb JOIN core c ON c.id = nb.nid GROUP BY nb.id),
t AS (SELECT s.*, flag.noise FROM s JOIN flag ON flag.id = s.s_suppkey),
m AS (SELECT round_even(avg(s_nationkey), 0) AS mn, round_even(avg(s_acctbal), 0) AS ma FROM t WHERE NOT noise)
SELECT s_suppkey,
       CAST(CASE WHEN noise AND s_nationkey > mn THEN mn ELSE s_nationkey END AS INTEGER) AS s_nationkey,
       CASE WHEN noise AND s_acctbal > ma THEN ma ELSE s_acctbal END AS s_acctbal
FROM t, m"""


@query("c20_dbscan_replace", _DBSCAN_REPLACE_SQL)
def c20_dbscan_replace(spark, sf_dir):
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    return outliers.dbscan_outliers(sup, ["s_nationkey", "s_acctbal"], action="replace", id_col="s_suppkey")


_DBSCAN_ALL_SQL = """
WITH s AS (SELECT *, (c_custkey - avg(c_custkey) OVER ()) / stddev_samp(c_custkey) OVER () AS z0,
                  (c_nationkey - avg(c_nationkey) OVER ()) / stddev_samp(c_nationkey) OVER () AS z1,
                  (c_acctbal - avg(c_acctbal) OVER ()) / stddev_samp(c_acctbal) OVER () AS z2 FROM customer),
nb AS (SELECT a.c_custkey AS id, b.c_custkey AS nid FROM s a JOIN s b
       ON (a.z0 - b.z0) * (a.z0 - b.z0) + (a.z1 - b.z1) * (a.z1 - b.z1) + (a.z2 - b.z2) * (a.z2 - b.z2) <= 0.09),
core AS (SELECT id, count(*) >= 8 AS is_core FROM nb GROUP BY id),
flag AS (SELECT nb.id, bool_or(c.is_core) AS near_core FROM nb JOIN core c ON c.id = nb.nid GROUP BY nb.id)
SELECT s.* EXCLUDE (z0, z1, z2) FROM s JOIN flag ON flag.id = s.c_custkey WHERE flag.near_core"""


@query("c20_dbscan_all_numeric", _DBSCAN_ALL_SQL)
def c20_dbscan_all_numeric(spark, sf_dir):
    """Every numeric column of customer, the key too: dozens of noise points at sf0.01."""
    return outliers.dbscan_outliers(table(spark, sf_dir, "customer"), eps=0.3, min_pts=8)


_RARE_T = 0.13
_RARE = f"lang IN (SELECT lang FROM documents WHERE lang IS NOT NULL GROUP BY 1 HAVING count(*) / (SELECT count(lang) FROM documents) < {_RARE_T})"


@query("c21_rare_remove", f"SELECT doc_id, lang FROM documents WHERE NOT COALESCE({_RARE}, FALSE)")
def c21_rare_remove(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return outliers.rare_categories(docs, "lang", _RARE_T, "proportion", "remove")


@query(
    "c21_rare_replace",
    f"SELECT doc_id, CASE WHEN {_RARE} THEN (SELECT lang FROM documents WHERE lang IS NOT NULL AND NOT {_RARE} "
    f"GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) ELSE lang END AS lang FROM documents",
)
def c21_rare_replace(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return outliers.rare_categories(docs, "lang", _RARE_T, "proportion", "replace")


_NATIONS = "SELECT c_custkey, c_nationkey || '/' || c_mktsegment AS kind FROM customer"


@query("c21_rare_count_remove", f"WITH src AS ({_NATIONS}) SELECT c_custkey, kind FROM src WHERE kind NOT IN (SELECT kind FROM src GROUP BY 1 HAVING count(*) < 12)")
def c21_rare_count_remove(spark, sf_dir):
    """Kinds of customers (nation and segment) seen under 12 times go."""
    kind = F.concat(F.col("c_nationkey").cast("string"), F.lit("/"), "c_mktsegment")
    return outliers.rare_categories(table(spark, sf_dir, "customer").select("c_custkey", kind.alias("kind")), "kind", 12, "count", "remove")


# --- C22-C25 -----------------------------------------------------------------------------------------


@query("c22_remove_duplicates", with_derived("orders_dups", "SELECT DISTINCT * FROM src"))
def c22_remove_duplicates(spark, sf_dir):
    return consistency.remove_duplicates(derived(spark, sf_dir, "orders_dups"))


_TITLE = "array_to_string(list_transform(regexp_extract_all(lower(priority_text), '(\\p{L}+|\\P{L}+)', 1), lambda x: upper(x[1]) || x[2:]), '')"
_TRIM = "regexp_replace(priority_text, '^[ \\t\\n\\r\\f\\x0B]+|[ \\t\\n\\r\\f\\x0B]+$', '', 'g')"

for _name, _case, _expr in (
    ("c23a_lowercase", "lower", "lower(priority_text)"),
    ("c23b_uppercase", "upper", "upper(priority_text)"),
    ("c23c_titlecase", "title", _TITLE),
):

    def _fn(spark, sf_dir, _case=_case):
        return consistency.text_case(derived(spark, sf_dir, "orders_messy_text"), ["priority_text"], _case)

    query(_name, with_derived("orders_messy_text", f"SELECT o_orderkey, {_expr} AS priority_text FROM src"))(_fn)


@query("c23d_trim", with_derived("orders_messy_text", f"SELECT o_orderkey, {_TRIM} AS priority_text FROM src"))
def c23d_trim(spark, sf_dir):
    return consistency.trim(derived(spark, sf_dir, "orders_messy_text"), ["priority_text"])


_C24_SQL = _T7F_SQL.replace("'%Y-%m-%d %H:%M:%S') AS date_text", "'%d.%m.%Y') AS date_text")


@query("c24_change_date_format", _C24_SQL)
def c24_change_date_format(spark, sf_dir):
    return consistency.change_date_format(orders_date_text(spark, sf_dir), "date_text", "%d.%m.%Y")


def _c25_sql() -> str:
    s2 = "regexp_replace(trim(date_text), '[^0-9A-Za-z]+', '-', 'g')"
    four_ymd = "'\\d{4,}-\\d{1,2}-\\d{1,2}'"
    four_end = "'\\d{1,2}-\\d{1,2}-\\d{4,}'"
    two_ymd = "'\\d{2}-\\d{1,2}-\\d{1,2}'"
    two_end = "'\\d{1,2}-\\d{1,2}-\\d{2}'"

    def p(pat, fmt):
        return f"CASE WHEN regexp_full_match(s2, {pat}) THEN CAST(try_strptime(s2, '{fmt}') AS DATE) END"

    def pivot(e):
        return f"(CASE WHEN year({e}) >= 2069 THEN {e} - INTERVAL 100 YEAR ELSE {e} END)"

    def two(pat, fmt):
        return pivot(f"CAST((CASE WHEN regexp_full_match(s2, {pat}) THEN try_strptime(s2, '{fmt}') END) AS DATE)")

    return f"""
WITH src AS ({orders_date_text_sql()}), t AS (SELECT o_orderkey, {s2} AS s2 FROM src)
SELECT o_orderkey, strftime(COALESCE({p(four_ymd, '%Y-%m-%d')}, {p(four_end, '%d-%m-%Y')}, {p(four_end, '%m-%d-%Y')},
  {two(two_ymd, '%y-%m-%d')}, {two(two_end, '%d-%m-%y')}, {two(two_end, '%m-%d-%y')}), '%Y-%m-%d') AS date_text FROM t"""


@query("c25_standardize_dates", _c25_sql())
def c25_standardize_dates(spark, sf_dir):
    return consistency.standardize_dates(orders_date_text(spark, sf_dir), "date_text", "%Y-%m-%d")
