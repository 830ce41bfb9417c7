"""Sources and sinks.

Tables arrive as DataFrames; files are read and written by Spark's own
distributed readers/writers (no single-file codecs on the driver).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.functions import READ_NULL_TOKENS, nan_as_null

FORMATS = ("csv", "parquet", "json", "orc")


def read_csv(spark: SparkSession, path: str, has_headers: bool = True, null_tokens=READ_NULL_TOKENS) -> DataFrame:
    """Read CSV with a full-scan type inference.

    Without a header the columns are named ``"1".."n"``.  Empty fields and
    every token in ``null_tokens`` (``""`` and ``NA``) become NULL before the
    types are inferred, so other tokens do not turn a numeric column into text.
    A NaN field of a numeric column is NULL too.
    """
    extra = [t for t in null_tokens if t not in ("", "NA")]
    reader = (
        spark.read.option("header", str(bool(has_headers)).lower())
        .option("samplingRatio", "1.0")
        .option("nullValue", "NA" if "NA" in null_tokens else "")
        .option("emptyValue", None)
    )
    df = reader.option("inferSchema", str(not extra).lower()).csv(path)
    if not has_headers:
        df = df.toDF(*[str(i + 1) for i in range(len(df.columns))])
    if extra:
        texts = {f: F.when(~F.col(f"`{f}`").isin(extra), F.col(f"`{f}`")) for f in df.columns}
        df = _retyped(df.select(*[c.alias(f) for f, c in texts.items()]))
    return df.select(*[nan_as_null(df, f).alias(f) for f in df.columns])


def _retyped(df: DataFrame) -> DataFrame:
    """Text columns cast to the first type that fits all their values (one pass over the table)."""
    kinds = ("int", "bigint", "double", "date", "timestamp", "boolean")
    fits = [
        F.coalesce(F.bool_and(F.expr(f"try_cast(`{f}` AS {k})").isNotNull() | F.col(f"`{f}`").isNull()), F.lit(False)) & (F.count(f"`{f}`") > 0)
        for f in df.columns
        for k in kinds
    ]
    row = df.agg(*[x.alias(f"_{i}") for i, x in enumerate(fits)]).first()
    out = []
    for i, f in enumerate(df.columns):
        kind = next((k for j, k in enumerate(kinds) if row[i * len(kinds) + j]), "string")
        out.append(F.col(f"`{f}`").cast(kind).alias(f))
    return df.select(*out)


def read_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """S3: any table Spark reads (parquet by default)."""
    if fmt == "csv":
        return read_csv(spark, path)
    return spark.read.format(fmt).load(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> str:
    """Write the processed table (distributed, one file per partition).

    An empty table is an error, as in the export step it re-expresses.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unsupported format {fmt!r}; choose one of {FORMATS}")
    if df.limit(1).count() == 0:
        raise ValueError("no data to export")
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer = writer.option("header", "true")
    writer.format(fmt).save(path)
    return path
