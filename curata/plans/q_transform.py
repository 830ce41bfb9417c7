"""Registered queries: normalisation, encoding, skewness, derived columns,
discretisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from curata.operators import derive as derive_ops
from curata.operators import discretize as disc
from curata.operators import encode as enc
from curata.operators import scale, skew
from curata.plans.catalog import query, rnd
from curata.plans.inputs import derived, table, with_derived

CUST = "c_custkey, c_nationkey, {v}, c_mktsegment"


def _cust(v: str) -> str:
    return CUST.format(v=v)


def _customer(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")


# --- N1-N4 -------------------------------------------------------------------------------------------

_N = {
    "minmax": "(c_acctbal - (SELECT min(c_acctbal) FROM customer)) / nullif((SELECT max(c_acctbal) - min(c_acctbal) FROM customer), 0)",
    "zscore": "(c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / nullif((SELECT stddev_samp(c_acctbal) FROM customer), 0)",
    "decimal": "c_acctbal / power(10, ceil(log10((SELECT max(abs(c_acctbal)) FROM customer))))",
    "robust": "(c_acctbal - (SELECT quantile_cont(c_acctbal, 0.5) FROM customer)) / nullif((SELECT quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25) FROM customer), 0)",
}

for _i, _m in enumerate(("minmax", "zscore", "decimal", "robust"), start=1):

    def _fn(spark, sf_dir, _m=_m):
        return rnd(scale.normalize(_customer(spark, sf_dir), "c_acctbal", _m))

    query(f"n{_i}_normalize_{_m}", f"SELECT {_cust(f'round({_N[_m]}, 6) AS c_acctbal')} FROM customer")(_fn)


# --- E1-E2 --------------------------------------------------------------------------------------------


@query(
    "e1_onehot_long",
    "SELECT c_custkey, level, CAST(c_mktsegment = level AS INTEGER) AS flag FROM customer, "
    "(SELECT DISTINCT c_mktsegment AS level FROM customer WHERE c_mktsegment IS NOT NULL) l",
)
def e1_onehot_long(spark, sf_dir):
    """One-hot encode, then unpivot the dummy columns to (row, level, flag) so
    the oracle can be written without knowing the levels."""
    out = enc.onehot(_customer(spark, sf_dir), "c_mktsegment")
    dummies = [c for c in out.columns if c.startswith("c_mktsegment_")]
    pairs = F.array(*[F.struct(F.lit(c[len("c_mktsegment_"):]).alias("level"), F.col(f"`{c}`").alias("flag")) for c in dummies])
    return out.select("c_custkey", F.explode(pairs).alias("p")).select("c_custkey", "p.level", "p.flag")


_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query(
    "e1_onehot",
    "SELECT * EXCLUDE (c_mktsegment), "
    + ", ".join(f"CAST(coalesce(c_mktsegment = '{s}', FALSE) AS INTEGER) AS c_mktsegment_{s}" for s in _SEGMENTS)
    + " FROM (SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer)",
)
def e1_onehot(spark, sf_dir):
    """The wide one-hot table itself."""
    return enc.onehot(_customer(spark, sf_dir), "c_mktsegment")


@query(
    "e1_onehot_sparse",
    "SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY kind) - 1 AS INTEGER) AS at, 1.0::DOUBLE AS value, "
    "CAST((SELECT count(DISTINCT c_nationkey || '/' || c_mktsegment) FROM customer) AS INTEGER) AS size "
    "FROM (SELECT c_custkey, c_nationkey || '/' || c_mktsegment AS kind FROM customer) WHERE kind IS NOT NULL",
)
def e1_onehot_sparse(spark, sf_dir):
    """Sparse one-hot vectors of nation and segment, one row per non-zero entry."""
    kind = F.concat(F.col("c_nationkey").cast("string"), F.lit("/"), "c_mktsegment").alias("kind")
    out = enc.onehot_sparse(table(spark, sf_dir, "customer").select("c_custkey", kind), "kind")
    entry = F.explode(F.arrays_zip("kind.indices", "kind.values")).alias("e")
    return out.select("c_custkey", F.col("kind.size").alias("size"), entry).select("c_custkey", F.col("e.indices").alias("at"), F.col("e.values").alias("value"), "size")


@query(
    "e2_label_encode",
    "SELECT o_orderkey, o_orderstatus, CAST(dense_rank() OVER (ORDER BY o_orderpriority) AS INTEGER) AS o_orderpriority FROM orders",
)
def e2_label_encode(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return enc.label(o, "o_orderpriority")


# --- K1-K11 -------------------------------------------------------------------------------------------

_K = {
    "log": ("log10(o_totalprice)", 6),
    "neglog": ("log10((SELECT max(o_totalprice) + 1 FROM orders) - o_totalprice)", 6),
    "log1p": ("ln(1 + o_totalprice)", 6),
    "sqrt": ("sqrt(o_totalprice)", 6),
    "negsqrt": ("sqrt((SELECT max(o_totalprice) + 1 FROM orders) - o_totalprice)", 6),
    "inv": ("1 / o_totalprice", 12),
    "neginv": ("1 / ((SELECT max(o_totalprice) + 1 FROM orders) - o_totalprice)", 12),
    "square": ("o_totalprice * o_totalprice", 2),
}

for _i, _m in enumerate(("log", "neglog", "log1p", "sqrt", "negsqrt", "inv", "neginv", "square"), start=4):
    _expr, _digits = _K[_m]

    def _fn(spark, sf_dir, _m=_m, _digits=_digits):
        o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
        return rnd(skew.reduce_skew(o, "o_totalprice", _m), _digits)

    query(f"k{_i}_skew_{_m}", f"SELECT o_orderkey, round({_expr}, {_digits}) AS o_totalprice FROM orders")(_fn)


def _boxcox_sql() -> str:
    grid = ", ".join(f"({round(-2 + 0.1 * i, 10)})" for i in range(41))
    return f"""
WITH x AS (SELECT o_orderkey, o_totalprice AS v FROM orders),
gm AS (SELECT exp(avg(ln(v))) AS g FROM x),
y AS (SELECT v / g AS y FROM x, gm),
lam AS (SELECT * FROM (VALUES {grid}) t(l)),
ll AS (SELECT l, var_pop(CASE WHEN abs(l) > 0.02 THEN (power(y, l) - 1) / l
                              ELSE ln(y) * (1 + l * ln(y) / 2 * (1 + l * ln(y) / 3 * (1 + l * ln(y) / 4))) END) AS vp
       FROM y, lam GROUP BY l),
best AS (SELECT l FROM ll ORDER BY -ln(vp) DESC, l LIMIT 1),
fin AS (SELECT CASE WHEN abs(l) < 0.2 THEN 0.0 WHEN abs(l - 1) < 0.2 THEN NULL ELSE l END AS l, abs(l - 1) < 0.2 AS keep FROM best)
SELECT o_orderkey, round(CASE WHEN keep THEN v WHEN l = 0 THEN ln(v) ELSE (power(v, l) - 1) / l END, 6) AS o_totalprice
FROM x, fin"""


@query("k1_skew_boxcox", _boxcox_sql())
def k1_skew_boxcox(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return rnd(skew.reduce_skew(o, "o_totalprice", "boxcox"))


def _yj_sql() -> str:
    """Yeo-Johnson in SQL: the same refined 41-point grid (4 rounds) over
    lambda in (-5, 5), then standardisation."""
    def t(l: str) -> str:
        return (
            f"CASE WHEN x >= 0 THEN (CASE WHEN abs({l}) < 0.001 THEN ln(1 + x) ELSE (power(x + 1, {l}) - 1) / {l} END) "
            f"ELSE (CASE WHEN abs({l} - 2) < 0.001 THEN -ln(1 - x) ELSE -(power(1 - x, 2 - {l}) - 1) / (2 - {l}) END) END"
        )

    ctes = [
        "x AS (SELECT c_custkey, c_nationkey, c_mktsegment, c_acctbal AS x FROM customer)",
        "st AS (SELECT count(x) AS n, sum(sign(x) * ln(1 + abs(x))) AS c FROM x)",
        "b0 AS (SELECT CAST(-5.0 AS DOUBLE) AS lo, CAST(5.0 AS DOUBLE) AS hi)",
    ]
    for r in range(1, 5):
        ctes.append(
            f"g{r} AS (SELECT lo + i * ((hi - lo) / 40) AS l, (hi - lo) / 40 AS step FROM b{r - 1}, range(0, 41) t(i))"
        )
        ctes.append(
            f"v{r} AS (SELECT l, step, var_pop({t('l')}) AS vp FROM x, g{r} WHERE x IS NOT NULL GROUP BY l, step)"
        )
        ctes.append(
            f"best{r} AS (SELECT l, step FROM v{r}, st WHERE vp > 0 "
            f"ORDER BY -0.5 * n * ln(vp) + (l - 1) * c DESC, l ASC LIMIT 1)"
        )
        ctes.append(
            f"b{r} AS (SELECT greatest(-5.0, l - step) AS lo, least(5.0, l + step) AS hi FROM best{r})"
        )
    ctes.append(f"tr AS (SELECT x.*, {t('best4.l')} AS tx FROM x, best4)")
    return (
        "WITH " + ",\n".join(ctes) + "\n"
        "SELECT c_custkey, c_nationkey, round((tx - (SELECT avg(tx) FROM tr)) / (SELECT stddev_samp(tx) FROM tr), 6) AS c_acctbal, "
        "c_mktsegment FROM tr"
    )


@query("k2_skew_yeojohnson", _yj_sql())
def k2_skew_yeojohnson(spark, sf_dir):
    """Yeo-Johnson on account balances (negative values), standardised."""
    return rnd(skew.reduce_skew(_customer(spark, sf_dir), "c_acctbal", "yeojohnson"))


@query("k3_skew_auto", _boxcox_sql())
def k3_skew_auto(spark, sf_dir):
    """auto -> Box-Cox here (all values positive); Yeo-Johnson otherwise."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return rnd(skew.reduce_skew(o, "o_totalprice", "auto"))


# --- V1-V5 ---------------------------------------------------------------------------------------------

_V = {
    "add": "l_quantity + l_discount",
    "subtract": "l_quantity - l_discount",
    "multiply": "l_quantity * l_discount",
    "divide": "l_quantity / nullif(l_discount, 0)",
    "mod": "l_quantity - floor(l_quantity / nullif(l_discount, 0)) * nullif(l_discount, 0)",
}

for _i, _op in enumerate(("add", "subtract", "multiply", "divide", "mod"), start=1):

    def _fn(spark, sf_dir, _op=_op):
        li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
        return rnd(derive_ops.derive(li, "l_quantity", "l_discount", _op, "derived"))

    query(
        f"v{_i}_derive_{_op}",
        f"SELECT l_orderkey, l_linenumber, l_quantity, l_discount, round({_V[_op]}, 6) AS derived FROM lineitem",
    )(_fn)


@query(
    "v5_derive_mod_signs",
    "SELECT c_custkey, c_acctbal, c_nationkey, round(c_acctbal - floor(c_acctbal / nullif(c_nationkey - 12, 0)) * nullif(c_nationkey - 12, 0), 6) AS derived FROM customer",
)
def v5_derive_mod_signs(spark, sf_dir):
    """Mod with negative dividends and divisors (sign follows the divisor)."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", (F.col("c_nationkey") - 12).alias("_div"), "c_nationkey")
    out = derive_ops.derive(c, "c_acctbal", "_div", "mod", "derived").drop("_div")
    return rnd(out)


# --- D1-D4 ----------------------------------------------------------------------------------------------


def _ew_sql() -> str:
    return """
WITH mm AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
b AS (SELECT lo + 1 * ((hi - lo) / 4) AS b1, lo + 2 * ((hi - lo) / 4) AS b2, lo + 3 * ((hi - lo) / 4) AS b3 FROM mm)
SELECT o_orderkey, o_totalprice,
       CAST(1 + (o_totalprice > b1)::INT + (o_totalprice > b2)::INT + (o_totalprice > b3)::INT AS INTEGER) AS o_totalprice_discretized
FROM orders, b"""


@query("d1_equal_width", _ew_sql())
def d1_equal_width(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return disc.discretize(o, "o_totalprice", "equalwidth")


@query(
    "d2_equal_frequency",
    """
WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS q2,
                  quantile_cont(o_totalprice, 0.75) AS q3 FROM orders)
SELECT o_orderkey, o_totalprice,
       CAST(1 + (o_totalprice > q1)::INT + (o_totalprice > q2)::INT + (o_totalprice > q3)::INT AS INTEGER) AS o_totalprice_discretized
FROM orders, q""",
)
def d2_equal_frequency(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return disc.discretize(o, "o_totalprice", "equalfreq")


@query(
    "d2_equal_frequency_ties",
    """
WITH q AS (SELECT DISTINCT unnest([quantile_cont(l_linenumber, 0.25), quantile_cont(l_linenumber, 0.5),
                  quantile_cont(l_linenumber, 0.75)]) AS b,
                  quantile_cont(l_linenumber, 0.0) AS lo, quantile_cont(l_linenumber, 1.0) AS hi FROM lineitem),
inner_b AS (SELECT b FROM q WHERE b > lo AND b < hi)
SELECT l_orderkey, l_linenumber,
       CAST(1 + (SELECT count(*) FROM inner_b WHERE b < l_linenumber) AS INTEGER) AS l_linenumber_discretized
FROM lineitem""",
)
def d2_equal_frequency_ties(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return disc.discretize(li, "l_linenumber", "equalfreq")


def _kmeans_sql(k: int, rounds: int) -> str:
    """Lloyd's rounds over all orders from the quantiles of the distinct prices, one CTE a round."""
    starts = " UNION ALL ".join(f"SELECT {i} AS i, quantile_cont(x, {(2 * i + 1) / (2 * k)}) AS c FROM v" for i in range(k))
    ctes = [
        "v AS MATERIALIZED (SELECT CAST(o_totalprice AS DOUBLE) AS x, count(*) AS n FROM orders GROUP BY 1)",
        f"c0 AS MATERIALIZED ({starts})",
    ]
    for r in range(rounds + 1):
        ctes.append(f"b{r} AS MATERIALIZED (SELECT list((a.c + b.c) / 2 ORDER BY a.i) AS b FROM c{r} a JOIN c{r} b ON b.i = a.i + 1)")
        if r < rounds:
            ctes.append(
                f"c{r + 1} AS MATERIALIZED (SELECT c.i, coalesce(m.c, c.c) AS c FROM c{r} c LEFT JOIN (SELECT len(list_filter(b, lambda z: z < x)) AS i, sum(x * n) / sum(n) AS c FROM v, b{r} GROUP BY 1) m ON m.i = c.i)"
            )
    body = f"SELECT o_orderkey, o_totalprice, CAST(len(list_filter(b, lambda z: z < CAST(o_totalprice AS DOUBLE))) + 1 AS INTEGER) AS o_totalprice_discretized FROM orders, b{rounds}"
    return f"WITH {', '.join(ctes)}\n{body}"


@query("d3_kmeans", _kmeans_sql(disc.DEFAULT_BINS, disc.KMEANS_MAX_ITER))
def d3_kmeans(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return disc.discretize(o, "o_totalprice", "kmeans")


@query(
    "d4_entropy_mdlp_classes",
    with_derived("lineitem_classes", "SELECT l_orderkey, l_linenumber, class, CAST(CASE WHEN l_quantity > 33 THEN 3 WHEN l_quantity > 12 THEN 2 ELSE 1 END AS INTEGER) AS code FROM src"),
)
def d4_entropy_mdlp_classes(spark, sf_dir):
    """Supervised MDLP cuts of the quantity against a class with three levels of it and some noise."""
    df = derived(spark, sf_dir, "lineitem_classes")
    out = disc.discretize(df, "l_quantity", "entropy", target="class")
    return out.select("l_orderkey", "l_linenumber", "class", F.col("l_quantity_discretized").alias("code"))


@query("d4_entropy_mdlp")
def d4_entropy_mdlp(spark, sf_dir):
    """Supervised MDLP cuts of document length against the quality label."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    df = docs.join(labels, "doc_id")
    return disc.discretize(df, "n_chars", "entropy", target="quality")
