import pytest

from curata.operators import aggregate, encode, missing, outliers, scale, skew, smoothing


def test_error_paths(spark):
    empty = spark.createDataFrame([(1, None), (2, None)], "id int, c string")
    with pytest.raises(ValueError):
        missing.handle_missing(empty, "c", "mode")  # no values to take a mode from
    with pytest.raises(ValueError):
        missing.handle_missing(empty, "c", "nonsense")
    rare = spark.createDataFrame([("a",), ("b",)], "c string")
    with pytest.raises(ValueError):
        outliers.rare_categories(rare, "c", 0.9, action="replace")  # every category is rare
    wide = spark.createDataFrame([(str(i),) for i in range(1001)], "c string")
    with pytest.raises(ValueError):
        encode.fit_onehot(wide, "c", max_levels=1000)
    for call in (lambda: skew.reduce_skew(rare, "c", "log"), lambda: outliers.zscore_outliers(rare, "c"), lambda: outliers.iqr_outliers(rare, "c")):
        with pytest.raises(ValueError):
            call()  # text has no skewness and no outliers
    nan = spark.createDataFrame([(1, 1.0), (2, float("nan"))], "id int, v double")
    with pytest.raises(ValueError):
        outliers.dbscan_noise_flags(nan, ["v"], id_col="id")
    nums = spark.createDataFrame([(1, 1.0), (1, 2.0)], "g int, v double")
    with pytest.raises(ValueError):
        aggregate.aggregate(nums, ["g"], "quantile", "v")  # not on the allow-list
    with pytest.raises(ValueError):
        aggregate.aggregate(nums, ["g"], "mean")  # needs a column
    with pytest.raises(ValueError):
        scale.normalize(nums, "v", "softmax")
    with pytest.raises(ValueError):
        skew.reduce_skew(nums, "v", "cube")
    with pytest.raises(ValueError):
        smoothing.smooth(nums, "v", "spline", ["g"])
    with pytest.raises(ValueError):
        encode.encode(rare, "c", "target")
    with pytest.raises(ValueError):
        outliers.detect_outliers(nums, "v", "mad")


def test_aggregate_null_group_rules(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", 2.0), (None, 3.0)], "g string, v double")
    res = {r.g: r.agg_value for r in aggregate.aggregate(df, ["g"], "sum", "v").collect()}
    assert res == {"a": 0.0, "b": 2.0, None: 3.0}  # sum over no values is 0; NULL key is a group
    res = {r.g: r.agg_value for r in aggregate.aggregate(df, ["g"], "mean", "v").collect()}
    assert res["a"] is None
    res = {r.g: r.agg_value for r in aggregate.aggregate(df, ["g"], "sd", "v").collect()}
    assert res["b"] is None  # one value
