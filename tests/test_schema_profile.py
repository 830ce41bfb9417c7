import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from curata.operators import profile, schema
from tests.conftest import rows


@pytest.fixture(scope="module")
def mixed(spark):
    data = []
    for i in range(20):
        data.append((i, float(i * 1.5), i % 4, f"t{i % 3}", i % 2 == 0, dt.date(2020, 1, 1 + i), None))
    return spark.createDataFrame(data, "id bigint, num double, few int, txt string, flag boolean, d date, allnull double")


def test_classify_columns(mixed):
    qual, quant = schema.classify_columns(mixed)
    assert set(quant) == {"id", "num"}
    assert set(qual) == {"few", "txt", "flag", "d"}
    assert "allnull" not in qual + quant


def test_prepare_and_null_tokens(spark):
    dirty = spark.createDataFrame(
        [(i, v) for i, v in enumerate(["1.5", "abc", "", "NA", "NaN", "inf", "-INF", "null", None, " 7 "])],
        "id bigint, raw string",
    )
    num = {r.id: r.raw for r in schema.prepare(dirty, quantitative=["id", "raw"]).collect()}
    assert num[0] == 1.5 and num[9] == 7.0
    assert all(num[i] is None for i in (1, 2, 3, 4, 5, 6, 7, 8))
    txt = {int(r.id): r.raw for r in schema.prepare(dirty, qualitative=["id", "raw"]).collect()}
    assert txt[2] == "" and txt[3] == "NA" and txt[1] == "abc"
    assert all(txt[i] is None for i in (4, 5, 6, 7, 8))
    with pytest.raises(ValueError):
        schema.prepare(dirty)


def test_typecasts(spark):
    df = spark.createDataFrame([(1, "1.5", 0.0), (2, "2", 3.0), (3, None, None), (4, "x", -1.0)], "id int, s string, v double")
    ints = dict(rows(schema.typecast(df, "s", "integer"), "id", "s"))
    assert ints == {1: None, 2: 2, 3: None, 4: None}
    with pytest.raises(ValueError):
        schema.typecast(df, "s", "integer", strict=True).collect()
    logi = dict(rows(schema.typecast(df, "v", "logical"), "id", "v"))
    assert logi == {1: False, 2: True, 3: None, 4: True}
    txt = dict(rows(schema.typecast(df, "s", "logical"), "id", "s"))
    assert txt[1] is True and txt[3] is None
    dates = spark.createDataFrame([("2020-12-31",), ("12/31/2020",), ("31/12/2020",), ("x",), (None,)], "s string")
    got = [r.s for r in schema.typecast(dates, "s", "date").collect()]
    assert got[:3] == [dt.datetime(2020, 12, 31)] * 3 and got[3:] == [None, None]
    assert schema.typecast(dates, "s", "date").schema["s"].dataType.simpleString() == "timestamp_ntz"


def test_drop_columns_ignores_unknown_and_null_mask_keeps(spark):
    df = spark.createDataFrame([(1, None), (2, 5.0), (3, 50.0)], "a int, b double")
    assert schema.drop_columns(df, ["b", "nope"]).columns == ["a"]
    kept = schema.drop_flagged(df, F.col("b") > 10)
    assert sorted(r.a for r in kept.collect()) == [1, 2]


def test_pretty_breaks_match_appendix():
    assert profile.pretty_breaks(1, 50) == [float(x) for x in range(0, 51, 5)]
    b = profile.pretty_breaks(873.54, 499866.64)
    assert b[0] == 0 and b[-1] == 500000 and len(b) == 11
    assert profile.pretty_breaks(0.0, 0.1) == pytest.approx([i / 100 for i in range(11)])


def test_histogram_right_closed(spark):
    vals = [1.0, 5.0, 5.0, 10.0, 49.0, 50.0, None]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    h = {r.bin: r["count"] for r in profile.numeric_histograms(df, ["x"]).collect()}
    # breaks 0,5,...,50: (0,5] holds 1,5,5; (5,10] holds 10; (45,50] holds 49,50
    assert h[0] == 3 and h[1] == 1 and h[9] == 2 and sum(h.values()) == 6 and len(h) == 10


def test_column_stats(mixed):
    st = {r.column_name: r for r in profile.column_stats(mixed).collect()}
    x = np.arange(20) * 1.5
    n = st["num"]
    assert n.type == "numeric" and n.missing == 0 and n.distinct == 20 and n.zeros == 1
    assert n.mean == pytest.approx(x.mean()) and n.median == pytest.approx(np.median(x))
    assert n.sd == pytest.approx(x.std(ddof=1)) and n.iqr == pytest.approx(np.subtract(*np.quantile(x, [0.75, 0.25])))
    assert n.skewness == pytest.approx(0.0, abs=1e-12) and n.outliers == 0
    f = st["few"]
    assert f.most_frequent == "0" and f.freq_count == 5 and f.type == "integer"
    t = st["txt"]
    assert t.mean is None and t.most_frequent == "t0" and t.freq_count == 7
    a = st["allnull"]
    assert a.missing == 20 and a.distinct == 0 and a.mean is None


def test_skewness_is_population(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double")
    st = profile.column_stats(df).first()
    assert st.skewness == pytest.approx(1.0182, abs=1e-4)


def test_categorical_frequencies_top_total(spark):
    data = [("a",)] * 5 + [("b",)] * 5 + [(f"c{i}",) for i in range(12)] + [(None,)]
    df = spark.createDataFrame(data, "c string")
    fr = profile.categorical_frequencies(df, ["c"]).orderBy("rank").collect()
    assert [r.label for r in fr] == ["a", "b", "c0", "c1", "c10", "c11", "c2", "c3", "c4", "c5"]
    assert fr[0].percentage == pytest.approx(round(5 / 18 * 100, 2))


def test_dataset_summary_duplicates(spark):
    df = spark.createDataFrame([("x", 1.0), ("x", 1.0), ("y", None), ("y", None), ("z", 2.0)], "a string, b double")
    s = profile.dataset_summary(df).first()
    assert (s.num_rows, s.num_columns, s.num_duplicates) == (5, 2, 2)
    assert s.num_qualitative_columns == 2 and s.num_quantitative_columns == 0
    assert profile.duplicate_count(df).first()[0] == 2


def test_profile_bundle(mixed):
    p = profile.profile(mixed)
    assert set(p.quantitative) == {"id", "num"}
    corr = {(r.col_a, r.col_b): r.r for r in p.correlation.collect()}
    assert corr[("id", "num")] == pytest.approx(1.0)
    assert not math.isnan(p.summary.first().num_rows)
