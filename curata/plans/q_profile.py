"""Registered queries: column roles, profile, correlations, aggregation."""

from __future__ import annotations

from pyspark.sql import functions as F

from curata.operators import aggregate as agg_ops
from curata.operators import correlation, profile, schema
from curata.plans.catalog import query, rnd
from curata.plans.inputs import derived, table, with_derived

LINEITEM_COLS = [
    ("l_orderkey", "num"), ("l_partkey", "num"), ("l_suppkey", "num"), ("l_linenumber", "num"),
    ("l_quantity", "num"), ("l_extendedprice", "num"), ("l_discount", "num"), ("l_tax", "num"),
    ("l_returnflag", "txt"), ("l_linestatus", "txt"), ("l_shipdate", "txt"),
]


def _role_sql(cols, src: str) -> str:
    parts = []
    for c, kind in cols:
        if kind == "num":
            role = f"CASE WHEN count({c}) = 0 THEN NULL WHEN count(DISTINCT {c}) > 10 THEN 'quantitative' ELSE 'qualitative' END"
        else:
            role = f"CASE WHEN count({c}) = 0 THEN NULL ELSE 'qualitative' END"
        parts.append(f"SELECT '{c}' AS column_name, {role} AS role FROM {src}")
    return "SELECT * FROM (\n" + "\nUNION ALL\n".join(parts) + "\n) WHERE role IS NOT NULL"


# --- T1 -------------------------------------------------------------------------------------


@query("t1_classify_columns", _role_sql(LINEITEM_COLS, "lineitem"))
def t1_classify_columns(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    qual, quant = schema.classify_columns(li)
    rows = [(c, "qualitative") for c in qual] + [(c, "quantitative") for c in quant]
    return spark.createDataFrame(rows, "column_name string, role string")


# --- P1 -------------------------------------------------------------------------------------


def _summary_sql(cols, src: str) -> str:
    qual = " + ".join(
        f"(CASE WHEN count({c}) > 0 AND ({'count(DISTINCT ' + c + ') <= 10' if k == 'num' else 'TRUE'}) THEN 1 ELSE 0 END)"
        for c, k in cols
    )
    quant = " + ".join(
        f"(CASE WHEN count({c}) > 0 AND count(DISTINCT {c}) > 10 THEN 1 ELSE 0 END)" for c, k in cols if k == "num"
    ) or "0"
    return f"""
SELECT count(*) AS num_rows, CAST({len(cols)} AS BIGINT) AS num_columns,
       CAST({qual} AS BIGINT) AS num_qualitative_columns,
       CAST({quant} AS BIGINT) AS num_quantitative_columns,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {src})) AS num_duplicates
FROM {src}"""


@query("p1_summary_duplicates", with_derived("orders_dups", _summary_sql([("o_orderstatus", "txt"), ("o_orderpriority", "txt")], "src")))
def p1_summary_duplicates(spark, sf_dir):
    return profile.dataset_summary(derived(spark, sf_dir, "orders_dups"))


@query("p1_summary_lineitem", _summary_sql(LINEITEM_COLS, "lineitem"))
def p1_summary_lineitem(spark, sf_dir):
    return profile.dataset_summary(table(spark, sf_dir, "lineitem"))


# --- P2 -------------------------------------------------------------------------------------

P2_COLS = [("o_orderkey", "int"), ("o_custkey", "int"), ("o_orderstatus", "txt"), ("o_totalprice", "dbl"), ("o_orderpriority", "txt")]


def _label_sql(c: str, kind: str) -> str:
    if kind == "dbl":
        return (
            f"CASE WHEN {c} = floor({c}) AND abs({c}) < 1e15 THEN CAST(CAST(floor({c}) AS BIGINT) AS VARCHAR) "
            f"ELSE CAST({c} AS VARCHAR) END"
        )
    return f"CAST({c} AS VARCHAR)"


def _p2_sql(columns, source: str) -> str:
    parts = []
    for c, kind in columns:
        lab = _label_sql(c, kind)
        mode = (
            f"(SELECT {{f}} FROM (SELECT {lab} AS lab, {c if kind not in ('txt', 'date') else 'NULL'} AS num, count(*) AS n FROM src "
            f"WHERE {c} IS NOT NULL GROUP BY ALL ORDER BY n DESC, num ASC NULLS LAST, lab ASC LIMIT 1))"
        )
        mf, mfc = mode.format(f="lab"), mode.format(f="n")
        if kind in ("txt", "date"):
            parts.append(
                f"SELECT '{c}' AS column_name, '{'Date' if kind == 'date' else 'character'}' AS type, count(*) - count({c}) AS missing, "
                f"count(DISTINCT {c}) AS \"distinct\", CAST(NULL AS BIGINT) AS zeros, CAST(NULL AS DOUBLE) AS mean, "
                f"CAST(NULL AS DOUBLE) AS median, CAST(NULL AS DOUBLE) AS sd, CAST(NULL AS DOUBLE) AS min, "
                f"CAST(NULL AS DOUBLE) AS max, CAST(NULL AS DOUBLE) AS iqr, CAST(NULL AS DOUBLE) AS skewness, "
                f"CAST(NULL AS BIGINT) AS outliers, {mf} AS most_frequent, {mfc} AS freq_count FROM src"
            )
            continue
        x = f"CAST({c} AS DOUBLE)"
        typ = "integer" if kind == "int" else "numeric"
        q = f"(SELECT quantile_cont({x}, [0.25, 0.5, 0.75]) FROM src)"
        outl = (
            f"(SELECT count(*) FROM src, (SELECT quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.75) AS q3 FROM src) qq "
            f"WHERE {x} < q1 - 1.5 * (q3 - q1) OR {x} > q3 + 1.5 * (q3 - q1))"
        )
        mom = (
            f"(SELECT avg(power({x} - m, 3)) / power(avg(power({x} - m, 2)), 1.5) FROM src, "
            f"(SELECT avg({x}) AS m FROM src) mm WHERE {c} IS NOT NULL)"
        )
        parts.append(
            f"SELECT '{c}' AS column_name, '{typ}' AS type, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS \"distinct\", "
            f"count(*) FILTER (WHERE {x} = 0) AS zeros, avg({x}) AS mean, {q}[2] AS median, stddev_samp({x}) AS sd, "
            f"min({x}) AS min, max({x}) AS max, {q}[3] - {q}[1] AS iqr, {mom} AS skewness, {outl} AS outliers, "
            f"{mf} AS most_frequent, {mfc} AS freq_count FROM src"
        )
    body = "\nUNION ALL\n".join(parts)
    return with_derived(
        source,
        f"""SELECT column_name, type, missing, "distinct", zeros, round(mean, 4) AS mean, round(median, 4) AS median,
       round(sd, 4) AS sd, round(min, 4) AS min, round(max, 4) AS max, round(iqr, 4) AS iqr,
       round(skewness, 6) AS skewness, outliers, most_frequent, freq_count
FROM ({body})""",
    )


def _column_stats(spark, sf_dir, source: str):
    out = profile.column_stats(derived(spark, sf_dir, source))
    return rnd(rnd(out, 4, ["mean", "median", "sd", "min", "max", "iqr"]), 6, ["skewness"])


@query("p2_column_stats", _p2_sql(P2_COLS, "orders_gaps"))
def p2_column_stats(spark, sf_dir):
    return _column_stats(spark, sf_dir, "orders_gaps")


@query("p2_column_stats_dates", _p2_sql([("o_orderkey", "int"), ("o_orderdate", "date"), ("o_totalprice", "dbl"), ("o_orderstatus", "txt")], "orders_dated"))
def p2_column_stats_dates(spark, sf_dir):
    """Column statistics with a date column that has gaps."""
    return _column_stats(spark, sf_dir, "orders_dated")


# --- P3 -------------------------------------------------------------------------------------

P3_COLS = [("l_linenumber", "int"), ("l_tax", "dbl"), ("l_returnflag", "txt"), ("l_linestatus", "txt"), ("l_shipdate", "txt")]


def _p3_sql() -> str:
    parts = []
    for c, kind in P3_COLS:
        num = f"CAST({c} AS DOUBLE)" if kind != "txt" else "CAST(NULL AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS column_name, {_label_sql(c, kind)} AS label, {num} AS num, count(*) AS count "
            f"FROM lineitem WHERE {c} IS NOT NULL GROUP BY ALL"
        )
    body = "\nUNION ALL\n".join(parts)
    return f"""
WITH vc AS ({body}),
rk AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY count DESC, num ASC NULLS LAST, label ASC) AS rank FROM vc)
SELECT column_name, CAST(rank AS INTEGER) AS rank, label, count,
       round_even(CAST(count AS DOUBLE) / sum(count) OVER (PARTITION BY column_name) * 100, 2) AS percentage
FROM rk WHERE rank <= 10"""


@query("p3_categorical_frequencies", _p3_sql())
def p3_categorical_frequencies(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return profile.categorical_frequencies(li, [c for c, _ in P3_COLS])


# --- P4 -------------------------------------------------------------------------------------


def _p4_sql_v2(src: str, c: str) -> str:
    """Histogram of one column in SQL: pretty() breakpoints by arithmetic,
    right-closed cells with the 1e-7 fuzz, empty cells kept."""
    return f"""
SELECT * FROM (WITH v AS (SELECT CAST({c} AS DOUBLE) AS x FROM {src} WHERE {c} IS NOT NULL),
  mm AS (SELECT min(x) AS lo, max(x) AS hi, (max(x) - min(x)) / 10 AS cell FROM v),
  b AS (SELECT *, power(10, floor(log10(cell))) AS base FROM mm),
  u1 AS (SELECT *, CASE WHEN 2 * base - cell < 1.5 * (cell - base) THEN 2 * base ELSE base END AS unit1 FROM b),
  u2 AS (SELECT *, CASE WHEN unit1 = 2 * base AND 5 * base - cell < 2.75 * (cell - unit1) THEN 5 * base ELSE unit1 END AS unit2 FROM u1),
  u3 AS (SELECT *, CASE WHEN unit2 = 5 * base AND 10 * base - cell < 1.5 * (cell - unit2) THEN 10 * base ELSE unit2 END AS unit FROM u2),
  n0 AS (SELECT *, floor(lo / unit + 1e-10) AS ns0, ceil(hi / unit - 1e-10) AS nu0 FROM u3),
  n1 AS (SELECT *, CASE WHEN ns0 * unit > lo + 1e-10 * unit THEN ns0 - 1 ELSE ns0 END AS ns,
                   CASE WHEN nu0 * unit < hi - 1e-10 * unit THEN nu0 + 1 ELSE nu0 END AS nu FROM n0),
  g AS (SELECT ns * unit AS st, nu * unit AS en, CAST(round(nu - ns) AS INTEGER) AS k FROM n1),
  g2 AS (SELECT *, (en - st) / k AS step FROM g),
  br AS (SELECT i, CASE WHEN i = 0 THEN st WHEN i = k THEN en ELSE st + i * step END AS b0, step, k
         FROM g2, range(0, 1001) t(i) WHERE i <= k),
  brk AS (SELECT i, CASE WHEN abs(b0) < 1e-14 * step THEN 0.0 ELSE b0 END AS b, step, k FROM br),
  cells AS (SELECT CAST(l.i AS INTEGER) AS bin, l.b AS lower, r.b AS upper FROM brk l JOIN brk r ON r.i = l.i + 1),
  inner_br AS (SELECT b + 1e-7 * step AS fb FROM brk WHERE i > 0 AND i < k),
  binned AS (SELECT CAST((SELECT count(*) FROM inner_br WHERE fb < v.x) AS INTEGER) AS bin FROM v),
  counted AS (SELECT bin, count(*) AS n FROM binned GROUP BY bin),
  joined AS (SELECT cells.*, COALESCE(n, 0) AS count FROM cells LEFT JOIN counted USING (bin))
 SELECT '{c}' AS column_name, bin, lower, upper, count,
        round_even(CAST(count AS DOUBLE) / sum(count) OVER () * 100, 2) AS percentage FROM joined)"""


P4_COLS = ["l_quantity", "l_extendedprice", "l_discount"]


@query("p4_histograms", "\nUNION ALL\n".join(_p4_sql_v2("lineitem", c) for c in P4_COLS))
def p4_histograms(spark, sf_dir):
    return profile.numeric_histograms(table(spark, sf_dir, "lineitem"), P4_COLS)


@query("p4_histogram_gaps", with_derived("orders_gaps", _p4_sql_v2("src", "o_totalprice")))
def p4_histogram_gaps(spark, sf_dir):
    return profile.numeric_histograms(derived(spark, sf_dir, "orders_gaps"), ["o_totalprice"])


P6_COLS = [("o_orderkey", "num"), ("o_custkey", "num"), ("o_orderstatus", "txt"), ("o_totalprice", "num"), ("o_orderpriority", "txt")]


def _p6_sql() -> str:
    """Summary plus the size of every profile part, derived from the data:
    roles per column, top-10 label rows of qualitative columns, histogram
    cells of quantitative ones, and (#quantitative)^2 correlation cells."""
    roles = []
    for c, kind in P6_COLS:
        quant = f"(count({c}) > 0 AND count(DISTINCT {c}) > 10)" if kind == "num" else "FALSE"
        qual = f"(count({c}) > 0 AND NOT {quant})"
        hist = f"(SELECT count(*) FROM ({_p4_sql_v2('src', c)}))" if kind == "num" else "0"
        roles.append(
            f"SELECT '{c}' AS col, CAST({quant} AS INTEGER) AS is_quant, "
            f"CASE WHEN {qual} THEN least(10, count(DISTINCT {c})) ELSE 0 END AS labels, "
            f"CASE WHEN {quant} THEN {hist} ELSE 0 END AS cells FROM src"
        )
    per_col = "\nUNION ALL\n".join(roles)
    return with_derived(
        "orders_gaps",
        f"""SELECT s.*, CAST({len(P6_COLS)} AS BIGINT) AS column_rows, CAST(r.labels AS BIGINT) AS categorical_rows,
       CAST(r.cells AS BIGINT) AS numerical_rows,
       CAST(CASE WHEN r.q > 1 THEN r.q * r.q ELSE 0 END AS BIGINT) AS correlation_rows
FROM ({_summary_sql(P6_COLS, "src")}) s,
     (SELECT sum(is_quant) AS q, sum(labels) AS labels, sum(cells) AS cells FROM ({per_col})) r""",
    )


@query("p6_profile_bundle", _p6_sql())
def p6_profile_bundle(spark, sf_dir):
    """The whole profile (P1-P5): the summary row plus the
    row counts of the column table, the frequency table, the histograms and
    the correlation matrix, so every part is computed."""
    prof = profile.profile(derived(spark, sf_dir, "orders_gaps"))
    parts = {
        "column_rows": prof.columns.count(),
        "categorical_rows": prof.categorical.count(),
        "numerical_rows": prof.numerical.count(),
        "correlation_rows": prof.correlation.count() if prof.correlation is not None else 0,
    }
    out = prof.summary
    for k, v in parts.items():
        out = out.withColumn(k, F.lit(v).cast("long"))
    return out  # a one-row frame built from collected numbers


_P6_NUM = [c for c, kind in P6_COLS if kind == "num"]
_P6_TXT = [c for c, kind in P6_COLS if kind == "txt"]


@query(
    "p6_profile_values",
    with_derived(
        "orders_gaps",
        "\nUNION ALL\n".join(
            [f"SELECT 'categorical' AS part, '{c}' AS a, {c} AS b, CAST(count(*) AS DOUBLE) AS value FROM src WHERE {c} IS NOT NULL GROUP BY {c}" for c in _P6_TXT]
            + [f"SELECT 'numerical' AS part, column_name AS a, CAST(bin AS VARCHAR) AS b, CAST(count AS DOUBLE) AS value FROM ({_p4_sql_v2('src', c)})" for c in _P6_NUM]
            + [f"SELECT 'correlation' AS part, '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS value FROM src" for a in _P6_NUM for b in _P6_NUM]
            + [f"SELECT 'columns' AS part, '{c}' AS a, 'missing' AS b, CAST(count(*) - count({c}) AS DOUBLE) AS value FROM src" for c, _ in P6_COLS]
        ),
    ),
)
def p6_profile_values(spark, sf_dir):
    """The values of every part of the whole profile in long form."""
    prof = profile.profile(derived(spark, sf_dir, "orders_gaps"))
    long = lambda df, part, a, b, value: df.select(
        F.lit(part).alias("part"), F.col(a).alias("a"), b.cast("string").alias("b"), value.cast("double").alias("value")
    )
    missing = next(c for c in prof.columns.columns if "missing" in c and "per" not in c)
    parts = [
        long(prof.categorical, "categorical", "column_name", F.col("label"), F.col("count")),
        long(prof.numerical, "numerical", "column_name", F.col("bin"), F.col("count")),
        long(prof.correlation, "correlation", "col_a", F.col("col_b"), F.round("r", 6)),
        long(prof.columns, "columns", prof.columns.columns[0], F.lit("missing"), F.col(missing)),
    ]
    rows = [tuple(r) for p in parts for r in p.collect()]  # a few dozen figures
    return spark.createDataFrame(rows, "part string, a string, b string, value double")


# --- P5 / P7 / P8 -----------------------------------------------------------------------------

P5_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount"]


def _pairs_sql(cols, src: str, expr) -> str:
    parts = [f"SELECT '{a}' AS col_a, '{b}' AS col_b, round({expr(a, b)}, 6) AS r FROM {src}" for a in cols for b in cols]
    return "\nUNION ALL\n".join(parts)


@query(
    "p5_pearson_matrix",
    _pairs_sql(P5_COLS, "lineitem", lambda a, b: f"corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))"),
)
def p5_pearson_matrix(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return rnd(correlation.pearson_matrix(li, P5_COLS))


GAP_COLS = ["l_quantity", "l_extendedprice", "l_discount"]


@query(
    "p5_pearson_pairwise_complete",
    with_derived("lineitem_gaps", _pairs_sql(GAP_COLS, "src", lambda a, b: f"corr({a}, {b})")),
)
def p5_pearson_pairwise_complete(spark, sf_dir):
    return rnd(correlation.pearson_matrix(derived(spark, sf_dir, "lineitem_gaps"), GAP_COLS))


def _spearman_sql(cols, src: str) -> str:
    parts = []
    for a in cols:
        for b in cols:
            parts.append(
                f"""SELECT '{a}' AS col_a, '{b}' AS col_b, round((SELECT corr(ra, rb) FROM (
   SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS ra,
          rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS rb
   FROM (SELECT CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y FROM {src} WHERE {a} IS NOT NULL AND {b} IS NOT NULL))), 6) AS r"""
            )
    return "\nUNION ALL\n".join(parts)


@query("p7_spearman_matrix", with_derived("lineitem_gaps", _spearman_sql(GAP_COLS, "src")))
def p7_spearman_matrix(spark, sf_dir):
    return rnd(correlation.spearman_matrix(derived(spark, sf_dir, "lineitem_gaps"), GAP_COLS))


KENDALL_COLS = ["p_size", "p_retailprice", "p_partkey"]


def _kendall_sql(cols, src: str) -> str:
    parts = []
    for a in cols:
        for b in cols:
            if a == b:
                parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, 1.0 AS r")
                continue
            parts.append(
                f"""SELECT '{a}' AS col_a, '{b}' AS col_b, round((
  WITH s AS (SELECT row_number() OVER () AS i, CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y FROM {src}
             WHERE {a} IS NOT NULL AND {b} IS NOT NULL),
  p AS (SELECT sign(s1.x - s2.x) * sign(s1.y - s2.y) AS sg, s1.x <> s2.x AS nx, s1.y <> s2.y AS ny
        FROM s s1 JOIN s s2 ON s1.i < s2.i)
  SELECT (count(*) FILTER (WHERE sg > 0) - count(*) FILTER (WHERE sg < 0))
         / sqrt(CAST(count(*) FILTER (WHERE nx) AS DOUBLE) * count(*) FILTER (WHERE ny)) FROM p), 6) AS r"""
            )
    return "\nUNION ALL\n".join(parts)


@query("p8_kendall_matrix", _kendall_sql(KENDALL_COLS, "part"))
def p8_kendall_matrix(spark, sf_dir):
    return rnd(correlation.kendall_matrix(table(spark, sf_dir, "part"), KENDALL_COLS))


# --- A1-A8 ------------------------------------------------------------------------------------

A_KEYS = "o_orderpriority, o_orderstatus"


def _agg_sql(expr: str, digits: int = 4, name: str = "agg_value") -> str:
    return with_derived("orders_group_gaps", f"SELECT {A_KEYS}, round({expr}, {digits}) AS {name} FROM src GROUP BY ALL")


@query("a1_group_count", with_derived("orders_group_gaps", f"SELECT {A_KEYS}, count(*) AS count FROM src GROUP BY ALL"))
def a1_group_count(spark, sf_dir):
    return agg_ops.aggregate(derived(spark, sf_dir, "orders_group_gaps"), ["o_orderpriority", "o_orderstatus"], "count")


def _agg_query(func: str, digits: int):
    def fn(spark, sf_dir):
        df = derived(spark, sf_dir, "orders_group_gaps")
        return rnd(agg_ops.aggregate(df, ["o_orderpriority", "o_orderstatus"], func, "o_totalprice"), digits)

    return fn


query("a2_group_mean", _agg_sql("avg(o_totalprice)"))(_agg_query("mean", 4))
query("a3_group_sum", _agg_sql("COALESCE(sum(o_totalprice), 0)", 2))(_agg_query("sum", 2))
query("a4_group_min", _agg_sql("min(o_totalprice)"))(_agg_query("min", 4))
query("a5_group_max", _agg_sql("max(o_totalprice)"))(_agg_query("max", 4))
query("a6_group_median", _agg_sql("quantile_cont(o_totalprice, 0.5)"))(_agg_query("median", 4))
query("a7_group_sd", _agg_sql("stddev_samp(o_totalprice)"))(_agg_query("sd", 4))
query("a8_group_var", _agg_sql("var_samp(o_totalprice)", 0))(_agg_query("var", 0))
query("a8_group_iqr", _agg_sql("quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25)"))(
    _agg_query("iqr", 4)
)
query(
    "a8_group_mad",
    with_derived(
        "orders_group_gaps",
        f"""SELECT {A_KEYS}, round(quantile_cont(abs(o_totalprice - med), 0.5) * 1.4826, 4) AS agg_value
FROM src JOIN (SELECT {A_KEYS}, quantile_cont(o_totalprice, 0.5) AS med FROM src GROUP BY ALL) m USING (o_orderpriority, o_orderstatus)
GROUP BY ALL""",
    ),
)(_agg_query("mad", 4))


def _null_key_query(func: str):
    def fn(spark, sf_dir):
        return rnd(agg_ops.aggregate(derived(spark, sf_dir, "orders_null_keys"), ["priority"], func, "price"), 4)

    return fn


query("a6_group_median_null_keys", with_derived("orders_null_keys", "SELECT priority, round(quantile_cont(price, 0.5), 4) AS agg_value FROM src GROUP BY 1"))(
    _null_key_query("median")
)
query(
    "a8_group_iqr_null_keys",
    with_derived("orders_null_keys", "SELECT priority, round(quantile_cont(price, 0.75) - quantile_cont(price, 0.25), 4) AS agg_value FROM src GROUP BY 1"),
)(_null_key_query("iqr"))
query(
    "a8_group_mad_null_keys",
    with_derived(
        "orders_null_keys",
        """SELECT src.priority, round(quantile_cont(abs(price - med), 0.5) * 1.4826, 4) AS agg_value
FROM src JOIN (SELECT priority, quantile_cont(price, 0.5) AS med FROM src GROUP BY 1) m ON m.priority IS NOT DISTINCT FROM src.priority GROUP BY 1""",
    ),
)(_null_key_query("mad"))


@query(
    "a8_group_prod",
    "SELECT p_brand, round(ln(product(1 + p_size / 1000.0)), 6) AS agg_value FROM part GROUP BY p_brand",
)
def a8_group_prod(spark, sf_dir):
    """Product per group, compared on the log scale (products of ~800 factors)."""
    part = table(spark, sf_dir, "part").select("p_brand", (1 + F.col("p_size") / 1000.0).alias("f"))
    out = agg_ops.aggregate(part, ["p_brand"], "prod", "f")
    return out.select("p_brand", F.round(F.log("agg_value"), 6).alias("agg_value"))


@query(
    "a8_group_range",
    with_derived(
        "orders_group_gaps",
        f"SELECT {A_KEYS}, round(min(o_totalprice), 4) AS agg_value_min, round(max(o_totalprice), 4) AS agg_value_max FROM src GROUP BY ALL",
    ),
)
def a8_group_range(spark, sf_dir):
    df = derived(spark, sf_dir, "orders_group_gaps")
    return rnd(agg_ops.aggregate(df, "o_orderpriority,o_orderstatus", "range", "o_totalprice"), 4)
