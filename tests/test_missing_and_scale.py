import numpy as np
import pytest
from pyspark.sql import functions as F

from curata import sources
from curata.functions import stats
from curata.operators import aggregate, encode, missing, outliers, reduce, schema


@pytest.mark.parametrize("buckets", [None, 1, 3, 16])
def test_null_key_groups_keep_their_quantiles(spark, buckets):
    rows = [(None, float(i)) for i in range(6)] + [("a", 4.0), ("a", 8.0), ("b", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    got = {r.g: (r.p0, r.p1) for r in stats.exact_percentiles(df, "v", [0.5, 0.25], by=["g"], buckets=buckets).collect()}
    assert got == {None: (2.5, 1.25), "a": (6.0, 5.0), "b": (None, None)}
    ranks = {(r.g, r.v): (r._before, r._cnt) for r in stats.value_ranks(df, "v", by=["g"], buckets=buckets).collect()}
    assert ranks[(None, 3.0)] == (3, 1) and ranks[("a", 8.0)] == (1, 1) and len(ranks) == 8
    sums = df.where("v is not null").withColumn("n", F.lit(2))
    run = {(r.g, r.v): r._cumn for r in stats.running_sums(sums, "v", ["n"], by=["g"], buckets=buckets).collect()}
    assert run[(None, 5.0)] == 12 and run[("a", 4.0)] == 2


def test_mad_of_the_null_key_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), (None, 9.0), ("a", 1.0)], "g string, v double")
    got = {r.g: r.agg_value for r in aggregate.aggregate(df, ["g"], "mad", "v").collect()}
    assert got[None] == pytest.approx(1.4826) and got["a"] == 0.0


@pytest.mark.parametrize("wide", [1.0, 1e3, 1e6, 1e9, 1e12])
def test_least_squares_at_any_width(spark, wide):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=300), rng.normal(size=300) / 1000
    y = 3 + 2 * a / wide * wide + 1000 * b
    df = spark.createDataFrame([(float(p), float(q * wide), float(r)) for p, q, r in zip(y, a, b)], "y double, a double, b double")
    intercept, beta, n = missing.fit_least_squares(df, "y", ["a", "b"])
    assert n == 300 and intercept == pytest.approx(3, abs=1e-6)
    assert beta[0] * wide == pytest.approx(2, rel=1e-6) and beta[1] == pytest.approx(1000, rel=1e-6)
    beta, rank = stats.solve_normal(np.array([[1e24, 1e12, 0], [1e12, 1.0, 0], [0, 0, 0]]), np.array([2e12, 2.0, 0]))
    assert rank == 1 and beta[0] * 1e12 + beta[1] == pytest.approx(2)


def test_nan_is_missing_everywhere(spark):
    rows = [(1, 1.0), (2, float("nan")), (3, None), (4, 1.0), (5, 2.0)]
    df = spark.createDataFrame(rows, "id int, v double")
    value = lambda out: {r.id: r.v for r in out.collect()}
    assert value(missing.handle_missing(df, "v", "mode")) == {1: 1.0, 2: 1.0, 3: 1.0, 4: 1.0, 5: 2.0}
    assert value(missing.handle_missing(df, "v", "constant", constant=7.0))[2] == 7.0
    assert set(value(missing.handle_missing(df, "v", "remove_row"))) == set(value(schema.drop_null_rows(df, "v"))) == {1, 4, 5}
    with pytest.raises(ValueError):
        reduce.pca_reduce(df)


def test_tree_imputation_uses_text_columns(spark):
    rows = [(f"k{i % 4}", float(i % 4) * 10 if i % 7 else None) for i in range(200)]
    got = missing.handle_missing(spark.createDataFrame(rows, "k string, v double"), "v", "tree").collect()
    assert all(r.v == float(r.k[1]) * 10 for r in got)


def test_csv_tokens_do_not_make_text(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b,c,d\n1,null,x,NaN\n2,2.5,null,1.5\nnull,NA,y,\n")
    df = sources.read_csv(spark, str(tmp_path / "t.csv"), null_tokens=("", "NA", "null"))
    assert dict(df.dtypes) == {"a": "int", "b": "double", "c": "string", "d": "double"}
    assert [tuple(r) for r in df.collect()] == [(1, None, "x", None), (2, 2.5, None, 1.5), (None, None, "y", None)]
    assert [r.d for r in sources.read_csv(spark, str(tmp_path / "t.csv")).collect()] == [None, 1.5, None]


def test_positions_do_not_depend_on_partitions(spark):
    rows = [(i % 5, i) for i in range(200)]
    want = {i: n for n, (_, i) in enumerate(sorted(rows))}
    for parts in (1, 3, 11):
        df = spark.createDataFrame(rows, "k int, i int").repartition(parts)
        assert {r.i: r._pos for r in stats.with_position(df, ["k"]).collect()} == want


def test_many_levels_and_labels(spark):
    df = spark.range(5000).select(F.concat(F.lit("v"), F.col("id").cast("string")).alias("c"))
    assert len(encode.onehot(df, "c").columns) == 5000
    assert [r.label for r in schema.factor_labels(spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "c string"), "c").collect()] == ["a", "b"]
    wide = spark.range(3000).select(F.col("id").cast("double").alias("x"))
    assert schema.classify_columns(wide, 2990) == ([], ["x"]) and schema.classify_columns(wide, 3000) == (["x"], [])


def test_outliers_and_skew_need_numbers(spark):
    df = spark.createDataFrame([("a",)], "c string")
    with pytest.raises(ValueError):
        outliers.zscore_outliers(df, "c")


def test_report_and_derive_take_nan_as_missing(spark):
    from curata.operators import derive, missing

    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(1, None, nan), (2, nan, None), (3, 1.0, nan), (4, nan, 2.0), (5, 1e308, 1e308), (6, inf, 1.0), (7, 4.0, 2.0)], "id int, a double, b double")
    report = {r["id"]: r["missing_predictors"] for r in missing.unimputable_report(df, "a").collect()}
    assert report == {1: ["b"], 2: ["b"]}
    for op, last in (("add", 6.0), ("subtract", 2.0), ("multiply", 8.0), ("divide", 2.0), ("mod", 0.0)):
        got = {r["id"]: r["v"] for r in derive.derive(df, "a", "b", op, "v").collect()}
        assert [got[i] for i in (1, 2, 3, 4, 6)] == [None] * 5 and got[7] == last
        if op in ("add", "multiply"):
            assert got[5] is None  # beyond the range of numbers
