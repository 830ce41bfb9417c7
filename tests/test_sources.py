import os
import tempfile

import pytest

from curata import sources


def _dir():
    return tempfile.mkdtemp(prefix="curata-src-", dir=os.environ.get("CURATA_SCRATCH", "/tmp"))


def test_csv_header_and_null_tokens(spark):
    path = os.path.join(_dir(), "t.csv")
    with open(path, "w") as f:
        f.write("a,b,c\n1,x,2.5\n2,NA,\n3,null,4.0\n")
    df = sources.read_csv(spark, path, null_tokens=("", "NA", "null"))
    assert df.columns == ["a", "b", "c"]
    got = sorted((r.a, r.b, r.c) for r in df.collect())
    assert got == [(1, "x", 2.5), (2, None, None), (3, None, 4.0)]
    assert dict(df.dtypes)["a"] == "int" and dict(df.dtypes)["c"] == "double"


def test_csv_without_header_gets_positional_names(spark):
    path = os.path.join(_dir(), "n.csv")
    with open(path, "w") as f:
        f.write("1,x\n2,y\n")
    df = sources.read_csv(spark, path, has_headers=False)
    assert df.columns == ["1", "2"] and df.count() == 2


def test_write_table_roundtrip_and_empty_error(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, s string")
    for fmt in ("parquet", "csv", "json", "orc"):
        out = os.path.join(_dir(), fmt)
        sources.write_table(df, out, fmt)
        back = sources.read_table(spark, out, fmt)
        assert back.count() == 2
    with pytest.raises(ValueError):
        sources.write_table(df.limit(0), os.path.join(_dir(), "empty"), "parquet")
    with pytest.raises(ValueError):
        sources.write_table(df, os.path.join(_dir(), "x"), "xlsx")
