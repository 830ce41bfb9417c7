"""Line deduplication over overlapping windows of three lines, in DataFrame functions alone.

A document's text is cut at line feeds.  Every run of three consecutive lines
is hashed (two 64-bit hashes with different seeds, 128 bits together); a
window that occurs more than once anywhere keeps its first occurrence, in
order of (doc_id, position), and each later occurrence gives up its three
lines.  Overlapping windows of a document are merged before they are cut out.

Only hashes are shuffled to find the repeats: counts and first occurrences
come from a partial aggregation, so a window that a third of all documents
share is one row per map task, and the join that marks later occurrences has
one row a key on its right side, so AQE can split its hot keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curata.llm.common import text_or_empty


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lines: int = 3) -> DataFrame:
    """(id, _ld_text_key, _ld_at): sorted starts (from 0) of the windows to cut out of each document that has some.

    Windows of blank lines only (blank, tab, carriage return) never count.  Rows
    that repeat an id together with its text are one document.  Null ids sort first.
    """
    base = docs.select(F.col(f"`{id_col}`").alias("_ld_id"), text_or_empty(text_col).alias("_ld_text"))
    split = base.select("_ld_id", F.xxhash64("_ld_text").alias("_ld_text_key"), F.split("_ld_text", "\n", -1).alias("_ld_lines"))
    hashed = split.filter(F.size("_ld_lines") >= lines).select(
        "_ld_id",
        "_ld_text_key",
        F.transform(
            "_ld_lines",
            lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"), (F.translate(x, " \t\r", "") == "").alias("blank")),
        ).alias("_ld_h"),
    )
    line = lambda i, j, what: F.get("_ld_h", i + j)[what]
    window = lambda i: F.struct(
        i.alias("at"),
        F.xxhash64(*[line(i, j, "a") for j in range(lines)]).alias("k1"),
        F.xxhash64(F.lit(2), *[line(i, j, "b") for j in range(lines)]).alias("k2"),
        F.forall(F.slice("_ld_h", i + 1, lines), lambda h: h["blank"]).alias("blank"),
    )
    windows = (
        hashed.select("_ld_id", "_ld_text_key", F.explode(F.transform(F.sequence(F.lit(0), F.size("_ld_h") - lines), window)).alias("w"))
        .filter(~F.col("w.blank"))
        .select("_ld_id", "_ld_text_key", F.col("w.at").alias("_ld_pos"), F.col("w.k1").alias("_ld_k1"), F.col("w.k2").alias("_ld_k2"))
    )
    place = F.struct("_ld_id", "_ld_text_key", "_ld_pos")
    first = windows.groupBy("_ld_k1", "_ld_k2").agg(F.min(place).alias("_ld_first"), F.count(F.lit(1)).alias("_ld_n")).filter("_ld_n > 1").drop("_ld_n")
    later = windows.join(first, ["_ld_k1", "_ld_k2"]).filter(~place.eqNullSafe(F.col("_ld_first")))
    return later.groupBy("_ld_id", "_ld_text_key").agg(F.array_sort(F.collect_set("_ld_pos")).alias("_ld_at"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lines: int = 3) -> DataFrame:
    """Every input row with its text after the cut, ``n_lines`` (before it) and ``n_removed`` (lines cut out).

    Null and empty texts are one empty line and stay empty; texts under three
    lines stay whole; a text that loses every line becomes empty, its row stays.
    Input columns named ``n_lines`` or ``n_removed`` are replaced, others kept.
    """
    cuts = repeated_windows(docs, id_col, text_col, lines)
    rows = docs.withColumn("_ld_key", F.xxhash64(text_or_empty(text_col)))
    joined = rows.join(cuts, rows[f"`{id_col}`"].eqNullSafe(cuts["_ld_id"]) & (rows["_ld_key"] == cuts["_ld_text_key"]), "left")
    all_lines = F.split(text_or_empty(text_col), "\n", -1)
    # kept segments lie between merged windows: [0, at_0), [at_i + lines, at_i+1), ..., [at_last + lines, n)
    begins = F.concat(F.array(F.lit(0)), F.transform("_ld_at", lambda x: x + lines))
    ends = F.concat(F.col("_ld_at"), F.array(F.size("_ld_lines")))
    length = lambda i: F.greatest(F.get("_ld_ends", i) - F.get("_ld_begins", i), F.lit(0))
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size("_ld_begins") - 1), lambda i: F.slice("_ld_lines", F.get("_ld_begins", i) + 1, length(i))))
    out = (
        joined.withColumn("_ld_lines", all_lines)
        .withColumns({"_ld_begins": begins, "_ld_ends": ends})
        .withColumn("_ld_kept", F.when(F.col("_ld_at").isNotNull(), kept))
        .withColumns(
            {
                "n_lines": F.size("_ld_lines").cast("long"),
                "n_removed": F.coalesce(F.size("_ld_lines") - F.when(F.col("_ld_kept").isNotNull(), F.size("_ld_kept")), F.lit(0)).cast("long"),
                text_col: F.when(F.col("_ld_kept").isNull(), text_or_empty(text_col)).otherwise(F.array_join("_ld_kept", "\n")),
            }
        )
    )
    return out.drop("_ld_key", "_ld_id", "_ld_text_key", "_ld_at", "_ld_lines", "_ld_begins", "_ld_ends", "_ld_kept")


ORACLE_LINE_DEDUP = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, i AS pos, ls[i] || chr(10) || ls[i + 1] || chr(10) || ls[i + 2] AS k
      FROM (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS i FROM d)),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) AS n FROM w
      WHERE translate(k, ' ' || chr(9) || chr(13) || chr(10), '') <> ''),
cut AS (SELECT DISTINCT doc_id, pos + o AS line FROM r, (VALUES (0), (1), (2)) v(o) WHERE n > 1),
l AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS line FROM d),
k AS (SELECT l.doc_id, string_agg(l.ls[l.line], chr(10) ORDER BY l.line) AS text, count(*) AS n
      FROM l LEFT JOIN cut ON cut.doc_id = l.doc_id AND cut.line = l.line WHERE cut.line IS NULL GROUP BY l.doc_id)
SELECT d.doc_id, CAST(len(d.ls) AS BIGINT) AS n_lines, CAST(len(d.ls) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
       coalesce(k.text, '') AS text
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""
