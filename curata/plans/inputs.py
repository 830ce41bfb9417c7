"""Inputs of the registered queries: the given test tables and frames derived
from them by the same deterministic expression in Spark and in the oracle SQL.

The test tables hold no NULLs, so gaps, spikes, duplicates, mixed case and
mixed date text are derived here (the rules are listed in FIXTURES.md).  The
derivations only shape input rows; every operator's work runs in the library.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, names) -> None:
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(n)


# --- derived inputs, written in SQL that Spark and DuckDB both accept ------------------

DERIVED = {
    # o_totalprice missing on every 7th order
    "orders_gaps": """
        SELECT o_orderkey, o_custkey, o_orderstatus,
               CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
               o_orderpriority
        FROM orders""",
    # every 13th order without its date
    "orders_dated": """
        SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS o_orderdate, o_totalprice, o_orderstatus
        FROM orders""",
    # text priority with NULLs on every 11th order (for the mode)
    "orders_text_gaps": """
        SELECT o_orderkey, o_totalprice,
               CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority
        FROM orders""",
    # far values on every 200th event
    "events_spikes": """
        SELECT event_id, user_id, event_type,
               CASE WHEN event_id % 200 = 0 THEN value * 50 ELSE value END AS value
        FROM events""",
    # events with a missing value on every 11th row (ordered smoothing)
    "events_gaps": """
        SELECT event_id, ts, CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS value
        FROM events""",
    # a key with NULLs beside gaps in the value
    "orders_null_keys": """
        SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE o_orderpriority END AS priority,
               CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice END AS price
        FROM orders""",
    # NaN and NULL side by side
    "orders_nan": """
        SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN CAST('NaN' AS DOUBLE)
               ELSE CAST(o_orderkey % 11 AS DOUBLE) END AS v
        FROM orders""",
    # features of very different width: a key up to about 10^11 beside a discount
    "lineitem_wide": """
        SELECT l_orderkey * 1000000 AS wide_key, l_linenumber, l_discount,
               CASE WHEN (l_orderkey + l_linenumber) % 10 = 0 THEN NULL ELSE l_extendedprice END AS l_extendedprice
        FROM lineitem""",
    # a class that follows the quantity but for one row in twenty
    "lineitem_classes": """
        SELECT l_orderkey, l_linenumber, l_quantity,
               CASE WHEN (l_orderkey + 3 * l_linenumber) % 20 = 0 THEN 'odd' WHEN l_quantity <= 12 THEN 'low'
                    WHEN l_quantity <= 33 THEN 'mid' ELSE 'high' END AS class
        FROM lineitem""",
    # exact duplicates: two categorical columns of orders
    "orders_dups": "SELECT o_orderstatus, o_orderpriority FROM orders",
    # mixed case and padding (spaces and a tab)
    "orders_messy_text": """
        SELECT o_orderkey,
               CASE o_orderkey % 4
                    WHEN 0 THEN upper(o_orderpriority)
                    WHEN 1 THEN concat('  ', o_orderpriority)
                    WHEN 2 THEN concat(chr(9), lower(o_orderpriority), ' ')
                    ELSE o_orderpriority END AS priority_text
        FROM orders""",
    # numbers as text with junk, null tokens and padding
    "orders_number_text": """
        SELECT o_orderkey,
               CASE o_orderkey % 9
                    WHEN 0 THEN 'abc'
                    WHEN 1 THEN 'NaN'
                    WHEN 2 THEN 'inf'
                    WHEN 3 THEN '-INF'
                    WHEN 4 THEN 'null'
                    WHEN 5 THEN ''
                    WHEN 6 THEN concat(' ', CAST(o_custkey AS STRING), ' ')
                    ELSE CAST(CAST(o_custkey AS DOUBLE) / 4 AS STRING) END AS raw
        FROM orders""",
    # lineitem with missing extended price on every 13th line (regression imputation)
    "lineitem_gaps": """
        SELECT l_orderkey, l_linenumber, l_quantity, l_discount,
               CASE WHEN (l_orderkey * 7 + l_linenumber) % 13 = 0 THEN NULL ELSE l_extendedprice END AS l_extendedprice
        FROM lineitem""",
    # second gap column for the unimputable-row report
    "lineitem_gaps2": """
        SELECT l_orderkey, l_linenumber, l_discount,
               CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE l_quantity END AS l_quantity,
               CASE WHEN (l_orderkey * 7 + l_linenumber) % 13 = 0 THEN NULL ELSE l_extendedprice END AS l_extendedprice
        FROM lineitem""",
    # whole-number values with far spikes
    "events_whole": """
        SELECT event_id,
               CAST(CASE WHEN event_id % 200 = 0 THEN floor(value) * 50 ELSE floor(value) END AS DOUBLE) AS value
        FROM events""",
    # groups including one whose values are all missing
    "orders_group_gaps": """
        SELECT o_orderpriority, o_orderstatus,
               CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN NULL
                    WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice
        FROM orders""",
}


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = DERIVED[name]
    register(spark, sf_dir, [t for t in TABLES if f"FROM {t}" in sql])
    return spark.sql(sql)


def with_derived(name: str, body: str) -> str:
    """Oracle SQL: ``body`` over the derived input ``name`` (as CTE ``src``)."""
    return f"WITH src AS ({DERIVED[name]})\n{body}"


# --- dates rendered as text (engine-specific formatting functions) -------------------------

# (o_orderkey % 4) -> text form of o_orderdate
DATE_TEXT_FORMS = (("yyyy-MM-dd", "%Y-%m-%d"), ("dd/MM/yyyy", "%d/%m/%Y"), ("MM.dd.yyyy", "%m.%d.%Y"), ("dd-MM-yy", "%d-%m-%y"))


def orders_date_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 4
    txt = F.lit(None).cast("string")
    for i, (pat, _) in enumerate(DATE_TEXT_FORMS):
        txt = F.when(k == i, F.date_format("o_orderdate", pat)).otherwise(txt)
    return o.select("o_orderkey", txt.alias("date_text"))


def orders_date_text_sql() -> str:
    cases = " ".join(f"WHEN {i} THEN strftime(o_orderdate, '{fmt}')" for i, (_, fmt) in enumerate(DATE_TEXT_FORMS))
    return f"SELECT o_orderkey, CASE o_orderkey % 4 {cases} END AS date_text FROM orders"
