"""Vector code compression: product codes learnt and assigned through value dictionaries.

Components are integers floor(scale * x); a vector is cut into equal
consecutive parts, each with a codebook of its own.  In every batch each
dimension's distinct integers form a dictionary, and the squared differences of
each of them to all codebook entries are tabulated once; a part's distances to
all entries are then gathers of table rows by dictionary code, added up over
the part's dimensions.  All of it is integer arithmetic, so assignments and
means are exact and do not depend on the partitioning.

Codebooks (parts x entries x width) are all that is sent to tasks.  Each task
adds up the parts of its own rows by entry and returns at most one row an entry
and dimension; rows never meet by code.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.llm.common import shuffle_partitions
from curata.llm.topk import quantised, usable
from curata.session import ensure_checkpoint_dir

CHUNK = 1024  # rows whose distances to all entries are held at once
LONG_MAX = (1 << 63) - 1
WIDE = "decimal(38,0)"


def part_edges(d: int, parts: int) -> list[int]:
    """Where the parts begin, and d; equal parts if d is a multiple of their number."""
    return [i * d // parts for i in range(parts + 1)]


def _number_type(most: int, width: int):
    """The narrowest type that holds ``width`` squared differences of numbers up to ``most``."""
    top = (2 * most) ** 2 * max(width, 1)
    return np.int32 if top < 1 << 31 else np.int64 if top < 1 << 63 else object


def nearest(vectors: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest entry (ties to the lower index) and its squared distance, through per-dimension dictionaries."""
    n, width = vectors.shape
    index, error = np.zeros(n, np.int64), np.zeros(n, object)
    if not width or not n:
        return index, error
    most = max(int(vectors.max()), -int(vectors.min()), int(book.max()), -int(book.min()))
    kind = _number_type(most, width)
    tables, codes = [], []
    for j in range(width):
        values, code = np.unique(vectors[:, j], return_inverse=True)
        off = values.astype(object if kind is object else np.int64)[:, None] - book[:, j].astype(object if kind is object else np.int64)[None, :]
        tables.append((off * off).astype(kind))
        codes.append(code)
    for s in range(0, n, CHUNK):
        total = tables[0][codes[0][s : s + CHUNK]]
        for j in range(1, width):
            total += tables[j][codes[j][s : s + CHUNK]]
        best = total.argmin(axis=1)
        index[s : s + CHUNK], error[s : s + CHUNK] = best, total[np.arange(len(best)), best]
    return index, error


def _matrix(batch: pa.RecordBatch, name: str, d: int) -> np.ndarray:
    lists = batch.column(batch.schema.get_field_index(name))
    return np.asarray(lists.values)[np.asarray(lists.offsets)[:-1][:, None] + np.arange(d)]


def _entry_sums(rows: DataFrame, books: list[np.ndarray], edges: list[int]) -> DataFrame:
    """(part, entry, dim, total, n): sums of the parts assigned to each entry; entries without any are absent."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros((len(b), b.shape[1]), object) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            v = _matrix(batch, "v", edges[-1])
            for p, book in enumerate(books):
                own = v[:, edges[p] : edges[p + 1]]
                index, _ = nearest(own, book)
                order = np.argsort(index, kind="stable")
                used, starts = np.unique(index[order], return_index=True)
                if not len(used):
                    continue
                counts[p][used] += np.diff(np.append(starts, len(order)))
                kind = object if int(np.abs(own.astype(np.float64)).max(initial=0)) * len(order) >= 1 << 62 else np.int64
                totals[p][used] += np.add.reduceat(own[order].astype(kind), starts, axis=0).astype(object)
        for p, book in enumerate(books):
            used = np.flatnonzero(counts[p])
            if len(used) and book.shape[1]:
                e, i = (x.reshape(-1) for x in np.meshgrid(used, np.arange(book.shape[1]), indexing="ij"))
                total = pa.array([Decimal(int(x)) for x in totals[p][e, i]], pa.decimal128(38, 0))
                columns = [pa.array(np.full(len(e), p)), pa.array(e), pa.array(i), total, pa.array(counts[p][e])]
                yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "dim", "total", "n"])

    tasks = rows.select("v").mapInArrow(partial, f"part long, entry long, dim long, total {WIDE}, n long")
    return tasks.groupBy("part", "entry", "dim").agg(F.sum("total").cast(WIDE).alias("total"), F.sum("n").alias("n"))


def _coded(rows: DataFrame, books: list[np.ndarray], edges: list[int]) -> DataFrame:
    """(vec_id, label, code, error) of every row."""
    kind = rows.schema["label"].dataType.simpleString()

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch, "v", edges[-1])
            found = [nearest(v[:, edges[p] : edges[p + 1]], book) for p, book in enumerate(books)]
            code = ["".join(f"{int(c):02x}" for c in row) for row in zip(*[index for index, _ in found], strict=True)]
            error = [min(int(e), LONG_MAX) for e in sum(err for _, err in found)]
            columns = [batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(error, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "code", "error"])

    return rows.select("vec_id", "label", "v").mapInArrow(assigned, f"vec_id long, label {kind}, code string, error long")


def learn_codebooks(rows: DataFrame, parts: int, entries: int, rounds: int) -> tuple[list[np.ndarray], list[int]]:
    """Codebooks of ``rows`` (vec_id, v): the parts of the first ``entries`` rows by id, then ``rounds`` of means.

    The sums that reach the driver are one row an entry and dimension, whatever the number of rows.
    """
    seeds = rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()
    d = len(seeds[0].v)
    edges = part_edges(d, parts)
    first = np.array([r.v for r in seeds], np.int64).reshape(len(seeds), d)
    books = [first[:, a:b].copy() for a, b in zip(edges[:-1], edges[1:], strict=True)]
    for _ in range(rounds):
        for r in _entry_sums(rows, books, edges).collect():
            books[r["part"]][r["entry"], r["dim"]] = int(r["total"]) // r["n"]
    return books, edges


def compress(
    vectors: DataFrame,
    parts: int = 4,
    entries: int = 256,
    rounds: int = 4,
    scale: int = 1024,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error, label_error) of every usable vector, and the final codebooks.

    ``code`` is two hex digits a part (``entries`` is at most 256), ``error`` the squared distance to the coded vector,
    ``label_error`` its sum over the rows of the label (null labels together).  Vectors that are null or hold a null or
    non-finite component take no part, nor do those of another length than the first one's by id.  Rows without an id
    are coded and counted but start no entry before all others; repeated rows count each, and equal ids go by their
    vectors.  With fewer rows than ``entries`` the codebooks are shorter; a length that is no multiple of ``parts`` is cut
    as evenly as possible.  Errors beyond long end there.  Other input columns take no part, whatever they are called.
    An empty table gives an empty result and no codebooks.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    spark = vectors.sparkSession
    own = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), F.col(f"`{vec_col}`").alias("v"))
    own = own.filter(usable(F.col("v"))).repartition(shuffle_partitions(spark)).withColumn("v", quantised(F.col("v"), scale))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    own.write.option("compression", "zstd").parquet(f"{path}/rows")
    rows = spark.read.schema(own.schema).parquet(f"{path}/rows")
    head = rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(1).collect()
    if not head:
        return rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error")), []
    rows = rows.filter(F.size("v") == len(head[0].v))
    books, edges = learn_codebooks(rows, parts, entries, rounds)
    found = _coded(rows, books, edges)
    found.write.option("compression", "zstd").parquet(f"{path}/codes")
    coded = spark.read.schema(found.schema).parquet(f"{path}/codes")
    total = F.least(F.sum(F.col("error").cast(WIDE)), F.lit(LONG_MAX).cast(WIDE)).cast("long")
    by_label = coded.groupBy(F.col("label").alias("_cc_label")).agg(total.alias("label_error"))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("_cc_label"))).drop("_cc_label"), books


def codebooks_digest(books: list[np.ndarray]) -> Column:
    """SHA-256 of all components in decimal, by part, entry and position, joined by commas."""
    return F.lit(hashlib.sha256(",".join(str(int(x)) for book in books for x in book.reshape(-1)).encode()).hexdigest())


def _oracle() -> str:
    """Four rounds and a last assignment, one after another."""
    dist = "CAST(list_dot_product(p.s, p.s) - 2 * list_dot_product(p.s, c.s) + list_dot_product(c.s, c.s) AS BIGINT)"
    steps = [
        """k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        """p AS MATERIALIZED (SELECT vec_id, label, g.part, list_slice(v, CAST(g.part * len(v) // 4 + 1 AS BIGINT), CAST((g.part + 1) * len(v) // 4 AS BIGINT)) AS s
      FROM k, (SELECT unnest(range(4)) AS part) g)""",
        "c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, s FROM p QUALIFY entry < 256)",
    ]
    for r in range(5):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT p.vec_id, any_value(p.label) AS label, p.part, any_value(p.s) AS s, min({{'d': {dist}, 'e': c.entry}}) AS b
      FROM p JOIN c{r} c ON p.part = c.part GROUP BY p.vec_id, p.part)""")
        if r < 4:
            steps.append(f"""c{r + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.s, c.s) AS s FROM c{r} c LEFT JOIN (
        SELECT part, e, list(floor(t / n) ORDER BY i) AS s FROM (
          SELECT part, b.e AS e, i, sum(s[i]) AS t, count(*) AS n FROM a{r}, (SELECT unnest(range(1, 1025)) AS i) j WHERE i <= len(s) GROUP BY ALL) GROUP BY part, e) m
      ON m.part = c.part AND m.e = c.entry)""")
    steps.append("""o AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', CAST(b.e AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(b.d) AS BIGINT) AS error
      FROM a4 GROUP BY vec_id)""")
    steps.append("""h AS (SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, i)) AS sha FROM (
        SELECT part, entry, unnest(s) AS x, generate_subscripts(s, 1) AS i FROM c4))""")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h.sha AS codebooks_sha256 FROM o, h"""


ORACLE_VECTOR_CODES = _oracle()
