import os
import tempfile

import pytest
from pyspark.sql import functions as F

from curata.operators import discretize, encode, missing, outliers, scale, skew
from curata.streaming import read_stream, transform_stream, write_stream

SF = "/root/testdata/sf0.001"


def test_fitted_steps_give_the_same_rows_on_a_stream(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    src = orders.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 7 == 0, None).otherwise(F.col("o_totalprice")))
    steps = [
        missing.fit_imputer(src, "o_totalprice", "median"),
        outliers.fit_outlier_handler(src, "o_totalprice", "iqr", "mean"),
        skew.fit_skew(src, "o_totalprice", "log1p"),
        scale.fit_scaler(src, "o_totalprice", "zscore"),
        discretize.fit_discretizer(src, "o_totalprice", "equalfreq"),
        encode.fit_label(src, "o_orderpriority"),
    ]
    batch = transform_stream(src, steps)

    base = tempfile.mkdtemp(prefix="curata-stream-", dir=os.environ.get("CURATA_SCRATCH", "/tmp"))
    stream_in = os.path.join(base, "in")
    src.write.mode("overwrite").parquet(stream_in)
    stream = read_stream(spark, stream_in, src.schema, max_files_per_trigger=1)
    out = transform_stream(stream, steps)
    q = write_stream(out, os.path.join(base, "out"), os.path.join(base, "ckpt"))
    q.awaitTermination(120)
    got = spark.read.parquet(os.path.join(base, "out"))
    cols = ["o_orderkey", "o_totalprice", "o_totalprice_discretized", "o_orderpriority"]
    a = sorted(tuple(r) for r in got.select(*cols).collect())
    b = sorted(tuple(r) for r in batch.select(*cols).collect())
    assert len(a) == orders.count()
    assert a == b
