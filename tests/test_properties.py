import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from curata.functions.stats import exact_percentiles
from curata.operators import consistency, discretize, encode, missing, scale

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
values = st.lists(st.one_of(st.none(), st.floats(-1e6, 1e6, allow_nan=False).map(lambda v: round(v, 3))), min_size=2, max_size=40)


def frame(spark, vals, parts=1):
    return spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id bigint, v double").repartition(parts)


@SETTINGS
@given(vals=values)
def test_impute_leaves_no_nulls(spark, vals):
    df = frame(spark, vals)
    if all(v is None for v in vals):
        return
    for m in ("mean", "median", "mode"):
        assert missing.handle_missing(df, "v", m).where(F.col("v").isNull()).count() == 0


@SETTINGS
@given(vals=values)
def test_minmax_within_unit_interval(spark, vals):
    out = [r.v for r in scale.normalize(frame(spark, vals), "v", "minmax").collect() if r.v is not None]
    assert all(-1e-12 <= v <= 1 + 1e-12 for v in out)


@SETTINGS
@given(vals=values)
def test_dedupe_idempotent(spark, vals):
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    once = consistency.remove_duplicates(df)
    assert once.count() == consistency.remove_duplicates(once).count() == len(set(vals))


@SETTINGS
@given(labels=st.lists(st.one_of(st.none(), st.sampled_from(["a", "b", "c", "d"])), min_size=1, max_size=30))
def test_onehot_rows_sum_to_one(spark, labels):
    df = spark.createDataFrame(list(enumerate(labels)), "id bigint, c string")
    if all(x is None for x in labels):
        return
    out = encode.onehot(df, "c")
    for r in out.collect():
        s = sum(r[k] for k in out.columns if k.startswith("c_"))
        assert s == (0 if labels[r.id] is None else 1)


@SETTINGS
@given(vals=values)
def test_codes_within_bins(spark, vals):
    df = frame(spark, vals)
    present = [v for v in vals if v is not None]
    if len(set(present)) < 2:
        return
    for m in ("equalwidth", "equalfreq"):
        codes = [r.v_discretized for r in discretize.discretize(df, "v", m).collect()]
        assert all(c is None or 1 <= c <= 4 for c in codes)


@SETTINGS
@given(vals=values, parts=st.sampled_from([1, 3, 16]))
def test_percentiles_independent_of_partitioning(spark, vals, parts):
    probs = [0.1, 0.5, 0.9]
    a = exact_percentiles(frame(spark, vals, 1), "v", probs).first()
    b = exact_percentiles(frame(spark, vals, parts), "v", probs, buckets=4).first()
    for x, y in zip(a, b):
        assert (x is None and y is None) or math.isclose(x, y, rel_tol=1e-12, abs_tol=1e-9)
