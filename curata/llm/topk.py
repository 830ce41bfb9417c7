"""Exact top-k search by inner product over quantised vectors.

Every vector's components become floor(scale * x).  For a stretch (segment) of
components with mean m and deviation r (root of the summed squares around the
mean), squared distance is at least  len (m_q - m_x)^2 + (r_q - r_x)^2,  so with
|q|^2 + |x|^2 - 2 q.x the segments bound the inner product from above.  A
vector's features (sqrt(len) m, r) make that bound one small matrix product.
Candidates go through coarse, then fine segments; only pairs whose bound
reaches the query's k-th best score so far get exact distances.

Queries are worked on in blocks of bounded size, each sent to all tasks and its
rows written before the next is read; candidates stay where they are read, and
each task returns its k best.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curata.llm.common import cut
from curata.session import ensure_checkpoint_dir

QUERY_BLOCK = 4096  # queries that are sent to the tasks at once (times 8 bytes a component)
CHUNK = 1024  # candidates that are compared at once
LEVELS = (16, 4)  # components of a segment, coarse to fine
EXACT = float(1 << 53)
OUT = "query_id long, rank int, vec_id long, score long"


def quantised(vector: Column, scale: int = 1024) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def usable(vector: Column) -> Column:
    """Neither null nor holding a null or non-finite component."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: finite(x.cast("double"))), F.lit(False))


def features(vectors: np.ndarray, width: int) -> np.ndarray:
    """sqrt(length) * mean and deviation of each segment of ``width`` components; products of them bound inner products."""
    n, d = vectors.shape
    starts = np.arange(0, d, width)
    lengths = np.diff(np.append(starts, d))
    sums = np.add.reduceat(vectors, starts, axis=1)
    squares = np.add.reduceat(vectors * vectors, starts, axis=1)
    mean = sums / lengths
    return np.concatenate([np.sqrt(lengths) * mean, np.sqrt(np.maximum(squares - lengths * mean * mean, 0.0))], axis=1)


class Best:
    """The k best (score, smaller id) of each query among the pairs seen so far."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.floor = np.full(n, -np.inf)  # a score below it cannot enter
        self.q, self.score, self.vec = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, q: np.ndarray, score: np.ndarray, vec: np.ndarray) -> None:
        worth = score >= self.floor[q]
        if not worth.any():
            return
        q, score, vec = (np.concatenate([a, b[worth]]) for a, b in ((self.q, q), (self.score, score), (self.vec, vec)))
        order = np.lexsort((vec, -score, q))
        q, score, vec = q[order], score[order], vec[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < self.k
        full = rank == self.k - 1
        self.q, self.score, self.vec = q[keep], score[keep], vec[keep]
        self.floor[q[full]] = score[full]


def search(best: Best, queries: np.ndarray, query_ids: np.ndarray, levels: list[np.ndarray], vectors: np.ndarray, ids: np.ndarray) -> None:
    """Adds the exact scores of all pairs that the bounds cannot rule out."""
    if not vectors.shape[1] or len(vectors) and float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max()) * vectors.shape[1] >= EXACT:
        wide = vectors.astype(object)  # products that doubles cannot hold exactly; scores end at the range of long
        for j in range(len(vectors)):
            score = [min(max(int(x), -(1 << 63)), (1 << 63) - 1) for x in queries.astype(object) @ wide[j]] if vectors.shape[1] else [0] * len(queries)
            other = query_ids != ids[j]
            best.add(np.flatnonzero(other), np.array(score, dtype=np.int64)[other], np.full(int(other.sum()), ids[j]))
        return
    q, x = queries.astype(np.float64), vectors.astype(np.float64)
    for a in range(0, len(x), CHUNK):
        part, own = x[a : a + CHUNK], ids[a : a + CHUNK]
        alive = query_ids[:, None] != own[None, :]
        slack = 1e-9 * np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(part, axis=1)[None, :] + 1e-6
        for width, mine in zip(LEVELS, levels, strict=True):
            theirs = features(part, width)
            if width == LEVELS[0]:
                alive &= mine @ theirs.T + slack >= best.floor[:, None]
                qi, ci = np.nonzero(alive)
            elif len(qi):
                bound = np.concatenate([np.einsum("ij,ij->i", mine[qi[s : s + 65536]], theirs[ci[s : s + 65536]]) for s in range(0, len(qi), 65536)])
                near = bound + slack[qi, ci] >= best.floor[qi]
                qi, ci = qi[near], ci[near]
        for s in range(0, len(qi), 65536):
            i, j = qi[s : s + 65536], ci[s : s + 65536]
            best.add(i, np.rint(np.einsum("ij,ij->i", q[i], part[j])).astype(np.int64), own[j])


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for every query row its k highest integer inner products, ties to the smaller id.

    Candidates are all rows but those of the query's own id.  Rows without an id, and vectors that are null or hold a
    null or non-finite component, take no part; vectors of another length than the query's are no candidates for it.
    Repeated candidate rows count each.  Scores beyond long end at its range.  Input columns of other names take no
    part, whatever they are called (also ``rank`` and ``score``); an empty table gives an empty result.
    """
    rows = vectors.filter(F.col(f"`{id_col}`").isNotNull() & usable(F.col(f"`{vec_col}`")))
    rows = rows.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), quantised(F.col(f"`{vec_col}`")).alias("v"), is_query.alias("asks"))
    asking = cut(rows.filter("asks").select("vec_id", "v").distinct())
    blocks = max(1, -(-asking.count() // QUERY_BLOCK))
    part = F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
    spark = vectors.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    spark.createDataFrame([], OUT).write.parquet(path)
    for b in range(blocks):
        _block(rows, asking.filter(part == b), k, path)
    return spark.read.schema(OUT).parquet(path)


def _block(rows: DataFrame, block: DataFrame, k: int, path: str) -> None:
    """Appends the rows of one block of queries, which is bounded and therefore sent to all tasks, and lets go of it."""
    by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    local = block.collect()
    for d in {len(r.v) for r in local}:
        own = [r for r in local if len(r.v) == d]
        by_length[d] = np.array([r.vec_id for r in own], dtype=np.int64), np.array([r.v for r in own], dtype=np.int64).reshape(len(own), d)
    sent = rows.sparkSession.sparkContext.broadcast(by_length)

    def nearest(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = {d: (ids, q, [features(q.astype(np.float64), w) for w in LEVELS] if d else [], Best(len(ids), k)) for d, (ids, q) in sent.value.items()}
        for batch in source:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            lists = batch.column(1)
            at = np.asarray(lists.offsets)
            flat = np.asarray(lists.values)
            lengths = np.diff(at)
            for d, (query_ids, q, levels, best) in state.items():
                own = np.flatnonzero(lengths == d)
                if len(own):
                    search(best, q, query_ids, levels, flat[at[own][:, None] + np.arange(d)], ids[own])
        for query_ids, _, _, best in state.values():
            if len(best.q):
                yield pa.RecordBatch.from_arrays([pa.array(query_ids[best.q]), pa.array(best.vec), pa.array(best.score)], ["query_id", "vec_id", "score"])

    found = rows.select("vec_id", "v").mapInArrow(nearest, "query_id long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    best = found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    best.write.mode("append").parquet(path)
    sent.destroy()


ORACLE_TOP_K = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
      FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
