"""Registered queries: sources and sinks (S1-S4) and the end-to-end slice."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from curata import sources
from curata.operators import aggregate as agg_ops
from curata.operators import missing, scale
from curata.plans.catalog import query, rnd
from curata.plans.inputs import derived, table, with_derived
from curata.session import ensure_checkpoint_dir

_ORD_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


def _scratch(spark, tag: str) -> str:
    """A fresh folder under the shared checkpoint location."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/curata-io/{tag}-{uuid.uuid4().hex}"


def _typed(df):
    return df.select(
        F.col("o_orderkey").cast("long").alias("o_orderkey"),
        F.col("o_custkey").cast("long").alias("o_custkey"),
        F.col("o_orderstatus").cast("string").alias("o_orderstatus"),
        F.col("o_totalprice").cast("double").alias("o_totalprice"),
        F.col("o_orderpriority").cast("string").alias("o_orderpriority"),
    )


@query("s1_csv_header_roundtrip", f"SELECT {', '.join(_ORD_COLS)} FROM orders")
def s1_csv_header_roundtrip(spark, sf_dir):
    path = _scratch(spark, "csv-h")
    sources.write_table(table(spark, sf_dir, "orders").select(*_ORD_COLS), path, "csv")
    return _typed(sources.read_csv(spark, path, has_headers=True))


@query(
    "s1_csv_no_header",
    'SELECT o_orderkey AS "1", o_custkey AS "2", o_orderstatus AS "3", o_totalprice AS "4", o_orderpriority AS "5" FROM orders',
)
def s1_csv_no_header(spark, sf_dir):
    path = _scratch(spark, "csv-n")
    df = table(spark, sf_dir, "orders").select(*_ORD_COLS)
    df.write.mode("overwrite").option("header", "false").csv(path)
    back = sources.read_csv(spark, path, has_headers=False)
    return back.select(
        F.col("1").cast("long").alias("1"), F.col("2").cast("long").alias("2"), F.col("3").alias("3"),
        F.col("4").cast("double").alias("4"), F.col("5").alias("5"),
    )


@query(
    "s2_csv_null_tokens",
    with_derived("orders_gaps", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM src"),
)
def s2_csv_null_tokens(spark, sf_dir):
    """Missing values written as ``NA`` come back as NULL."""
    path = _scratch(spark, "csv-na")
    df = derived(spark, sf_dir, "orders_gaps")
    df.write.mode("overwrite").option("header", "true").option("nullValue", "NA").csv(path)
    return _typed(sources.read_csv(spark, path))


@query("s4_parquet_roundtrip", f"SELECT {', '.join(_ORD_COLS)} FROM orders")
def s4_parquet_roundtrip(spark, sf_dir):
    path = _scratch(spark, "pq")
    sources.write_table(table(spark, sf_dir, "orders").select(*_ORD_COLS), path, "parquet")
    return sources.read_table(spark, path)


# --- the end-to-end slice: profile stats -> mean imputation -> z-score -> group mean ---------------

SLICE_SQL = with_derived(
    "orders_gaps",
    """, imp AS (SELECT o_orderpriority, COALESCE(o_totalprice, (SELECT avg(o_totalprice) FROM src)) AS v FROM src),
z AS (SELECT o_orderpriority, (v - (SELECT avg(v) FROM imp)) / (SELECT stddev_samp(v) FROM imp) AS z FROM imp)
SELECT o_orderpriority, round(avg(z), 6) AS agg_value FROM z GROUP BY 1""",
).replace(")\n, imp AS", "),\nimp AS")


def slice_impute_scale_group(spark, sf_dir):
    df = derived(spark, sf_dir, "orders_gaps")
    df = missing.handle_missing(df, "o_totalprice", "mean")
    df = scale.normalize(df, "o_totalprice", "zscore")
    return rnd(agg_ops.aggregate(df, ["o_orderpriority"], "mean", "o_totalprice"))


query("slice_impute_zscore_group_mean", SLICE_SQL)(slice_impute_scale_group)
