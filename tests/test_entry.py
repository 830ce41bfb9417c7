import math
from collections import Counter

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from curata.plans.inputs import TABLES

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "slice_impute_zscore_group_mean", "t1_classify_columns", "p2_column_stats", "p3_categorical_frequencies",
    "p4_histograms", "p8_kendall_matrix", "a6_group_median", "c10_bin_means", "c17_iqr_mode", "c20_dbscan_remove_noise",
    "c25_standardize_dates", "e2_label_encode", "k1_skew_boxcox", "d2_equal_frequency_ties", "m1_collinear_spearman",
]


def test_entry_runs(spark):
    out = entry(spark)
    assert out.columns == ["o_orderpriority", "agg_value"]
    assert out.count() == 5


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())
    assert len(queries()) >= 100


def _norm(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else (0.0 if v == 0 else v)
    if hasattr(v, "as_integer_ratio") and not isinstance(v, (int, bool)):
        return float(v)
    return v


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle_small(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    sdf = queries()[name](spark, SF)
    rel = con.sql(oracle_sql()[name])
    assert sorted(sdf.columns) == sorted(rel.columns)
    a = Counter(tuple(_norm(r[c]) for c in sorted(sdf.columns)) for r in sdf.collect())
    cols = rel.columns
    idx = sorted(range(len(cols)), key=lambda i: cols[i])
    b = Counter(tuple(_norm(r[i]) for i in idx) for r in rel.fetchall())
    assert a == b


def test_every_oracle_plans_in_duckdb():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    for name, sql in oracle_sql().items():
        con.execute("EXPLAIN " + sql)  # raises on a syntax or binding error


def test_query_names():
    import re

    from curata.plans.catalog import REGISTRY

    for name in queries():
        assert re.fullmatch(r"[a-z][a-z0-9_]*", name)
    for name in REGISTRY:  # these names belong to the optional operators
        assert "pipeline" not in name and not re.match(r"op\d+_", name)
