"""Hard-negative mining with segment summaries.

Every vector's components become floor(scale * x).  For a segment with means
m_q, m_x and deviations r_q, r_x (roots of the summed squares around the mean)
the inner product lies in  len m_q m_x -+ r_q r_x.  Each row stores
sqrt(len) m and r of its coarse and of its fine segments, so a bound is one
small matrix product; pairs go through coarse, then fine segments, and only
those that can still enter a list get exact scores.

An anchor's positives are its best rows of the same label.  A positive of score
p asks for the best rows of other labels whose score lies in [low p, high p]:
a row is dropped as soon as its upper bound is below, or its lower bound above,
all the windows of the anchor, and the lower ends rise with the lists' last
places.

Anchors are worked on in blocks of bounded size, each sent to all tasks; its
lists are written to the shared folder before the next block is read.
Candidates stay where they are, and each task returns its own best ones.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curata.llm.common import cut, shuffle_partitions
from curata.llm.topk import quantised, usable
from curata.session import ensure_checkpoint_dir

ANCHOR_BLOCK = 4096  # anchors that are sent to the tasks at once
CHUNK = 1024  # candidates that are compared at once
PAIRS = 1 << 16  # pairs whose exact scores are taken at once
LEVELS = (16, 4)  # components of a segment, coarse to fine
EXACT = float(1 << 53)
FLOAT_SAFE = 1e30  # beyond it products of float32 could overflow: nothing is ruled out
LONG = (-(1 << 63), (1 << 63) - 1)
OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def summaries(vectors: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """sqrt(length) * mean and deviation of each segment of ``width`` components, as float32."""
    starts = np.arange(0, vectors.shape[1], width)
    lengths = np.diff(np.append(starts, vectors.shape[1]))
    sums = np.add.reduceat(vectors, starts, axis=1)
    mean = sums / lengths
    off = vectors - np.repeat(mean, lengths, axis=1)
    return (np.sqrt(lengths) * mean).astype(np.float32), np.sqrt(np.add.reduceat(off * off, starts, axis=1)).astype(np.float32)


def matrix(lists: pa.Array, rows: np.ndarray, d: int) -> np.ndarray:
    """The lists of ``rows``, all of length d, as a matrix."""
    return np.asarray(lists.values)[np.asarray(lists.offsets)[rows][:, None] + np.arange(d)]


def _with_summaries(rows: DataFrame) -> DataFrame:
    """Adds ``means`` and ``devs``: the summaries of all levels, coarse first."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            lengths = np.diff(np.asarray(lists.offsets))
            held: list[list] = [[None] * batch.num_rows, [None] * batch.num_rows]
            for d in np.unique(lengths):
                own = np.flatnonzero(lengths == d)
                v = matrix(lists, own, int(d)).astype(np.float64)
                levels = [summaries(v, w) for w in LEVELS] if d else [(np.zeros((len(own), 0), np.float32),) * 2]
                for side in (0, 1):
                    for at, x in zip(own, np.concatenate([lv[side] for lv in levels], axis=1), strict=True):
                        held[side][at] = x
            names = ["vec_id", "label", "v", "means", "devs"]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(h, pa.list_(pa.float32())) for h in held]], names)

    return rows.mapInArrow(summed, "vec_id long, label long, v array<bigint>, means array<float>, devs array<float>")


def products(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact inner products of the pairs (q[i], x[j]); beyond long they end at its range."""
    if not q.shape[1]:
        return np.zeros(len(i), np.int64)
    if float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1] < EXACT:
        qf, xf = q.astype(np.float64), x.astype(np.float64)
        parts = [np.einsum("ij,ij->i", qf[i[s : s + PAIRS]], xf[j[s : s + PAIRS]]) for s in range(0, len(i), PAIRS)]
        return np.rint(np.concatenate([np.zeros(0), *parts])).astype(np.int64)
    qo, xo = q.astype(object), x.astype(object)
    return np.array([min(max(int((qo[a] * xo[b]).sum()), LONG[0]), LONG[1]) for a, b in zip(i, j, strict=True)], dtype=np.int64)


class Places:
    """The k best (score, smaller id) of each list among the rows offered so far."""

    def __init__(self, lowest: np.ndarray, k: int):
        self.k, self.floor = k, lowest.astype(np.int64)  # a score below the floor cannot enter
        self.at, self.score, self.vec = (np.zeros(0, np.int64) for _ in range(3))

    def offer(self, at: np.ndarray, score: np.ndarray, vec: np.ndarray) -> None:
        worth = score >= self.floor[at]
        if not worth.any():
            return
        at, score, vec = (np.concatenate([a, b[worth]]) for a, b in ((self.at, at), (self.score, score), (self.vec, vec)))
        order = np.lexsort((vec, ~score, at))
        at, score, vec = at[order], score[order], vec[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        keep = place < self.k
        last = place == self.k - 1
        self.at, self.score, self.vec = at[keep], score[keep], vec[keep]
        self.floor[at[last]] = np.maximum(self.floor[at[last]], score[last])


class Anchors:
    """Anchors of one vector length: ids, labels, vectors and summaries by level."""

    def __init__(self, rows: list):
        d = len(rows[0].v)
        self.d = d
        self.key = np.array([r.key for r in rows], np.int64)  # place in the block
        self.ids = np.array([r.vec_id for r in rows], np.int64)
        self.labels = np.array([r.label for r in rows], np.int64)
        self.v = np.array([r.v for r in rows], np.int64).reshape(len(rows), d)
        self.levels = [summaries(self.v.astype(np.float64), w) for w in LEVELS] if d else []
        self.norm = np.sqrt(sum((s.astype(np.float64) ** 2).sum(axis=1) for s in self.levels[0])) if d else np.zeros(len(rows))


def _bounds(anchors: Anchors, level: int, means: np.ndarray, devs: np.ndarray, i=None, j=None) -> tuple[np.ndarray, np.ndarray]:
    """Middle and half width of the scores' bounds: of all pairs, or of the pairs (i, j)."""
    m, r = anchors.levels[level]
    if i is None:
        return m @ means.T, r @ devs.T
    cut_at = range(0, len(i), PAIRS)
    both = [(np.einsum("ij,ij->i", m[i[s : s + PAIRS]], means[j[s : s + PAIRS]]), np.einsum("ij,ij->i", r[i[s : s + PAIRS]], devs[j[s : s + PAIRS]])) for s in cut_at]
    return tuple(np.concatenate([np.zeros(0, np.float32), *[b[k] for b in both]]) for k in (0, 1))


def candidates(anchors: Anchors, allowed: np.ndarray, least: np.ndarray, most: np.ndarray, means: np.ndarray, devs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (anchor, candidate) among the allowed whose score may lie in [least, most] of the anchor."""
    if not anchors.d or float(np.abs(means).max(initial=0) + np.abs(devs).max(initial=0)) * float(anchors.norm.max()) > FLOAT_SAFE:
        return np.nonzero(allowed)
    at = np.cumsum([0, *[s[0].shape[1] for s in anchors.levels]])
    split = [(means[:, a:b], devs[:, a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
    norm = np.sqrt(sum((s.astype(np.float64) ** 2).sum(axis=1) for s in split[0]))
    slack = lambda i, j: 1e-5 * anchors.norm[i] * norm[j] + 1e-3  # noqa: E731  beyond what float32 can be wrong by
    mid, half = _bounds(anchors, 0, *split[0])
    some = 1e-5 * anchors.norm[:, None] * norm[None, :] + 1e-3
    i, j = np.nonzero(allowed & (mid + half + some >= least[:, None]) & (mid - half - some <= most[:, None]))
    for level in range(1, len(split)):
        mid, half = _bounds(anchors, level, *split[level], i, j)
        near = (mid + half + slack(i, j) >= least[i]) & (mid - half - slack(i, j) <= most[i])
        i, j = i[near], j[near]
    return i, j


def _chunks(batches: Iterator[pa.RecordBatch], lengths_of) -> Iterator[tuple]:
    """(length, ids, labels, vectors, means, devs) of at most CHUNK rows of one vector length."""
    for batch in batches:
        ids, labels = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        lists = batch.column(2)
        lengths = np.diff(np.asarray(lists.offsets))
        for d in np.unique(lengths):
            own = np.flatnonzero(lengths == d)
            if int(d) not in lengths_of:
                continue
            width = sum(-(-int(d) // w) for w in LEVELS) if d else 0
            for s in range(0, len(own), CHUNK):
                rows = own[s : s + CHUNK]
                yield int(d), ids[rows], labels[rows], matrix(lists, rows, int(d)), matrix(batch.column(3), rows, width), matrix(batch.column(4), rows, width)


def _emitted(key: np.ndarray, slot: np.ndarray, vec: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (key, slot, vec, score)], ["key", "slot", "vec_id", "score"])


def _positives(rows: DataFrame, sent, k: int) -> DataFrame:
    """Each task's k best rows of the same label for every anchor (slot 0)."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = {d: (a, Places(np.full(len(a.ids), LONG[0]), k)) for d, a in sent.value.items()}
        for d, ids, labels, v, means, devs in _chunks(batches, state):
            a, places = state[d]
            allowed = (a.labels[:, None] == labels[None, :]) & (a.ids[:, None] != ids[None, :])
            i, j = candidates(a, allowed, places.floor, np.full(len(a.ids), np.inf), means, devs)
            places.offer(i, products(a.v, v, i, j), ids[j])
        for a, places in state.values():
            if len(places.at):
                yield _emitted(a.key[places.at], np.zeros(len(places.at)), places.vec, places.score)

    return rows.mapInArrow(best, "key long, slot long, vec_id long, score long")


def _negatives(rows: DataFrame, sent, windows, k: int, slots: int) -> DataFrame:
    """Each task's k best rows of other labels inside the score window of every (anchor, positive)."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = {}
        for d, a in sent.value.items():
            low, high = (w[a.key] for w in windows.value)
            state[d] = (a, low, high, Places(np.where(low <= high, low, LONG[1]).reshape(-1), k))
        for d, ids, labels, v, means, devs in _chunks(batches, state):
            a, low, high, places = state[d]
            least = places.floor.reshape(-1, slots).min(axis=1)
            most = np.where(low <= high, high, LONG[0]).max(axis=1)
            allowed = (a.labels[:, None] != labels[None, :]) & (a.ids[:, None] != ids[None, :])
            i, j = candidates(a, allowed, least, most, means, devs)
            score = products(a.v, v, i, j)
            for s in range(slots):
                inside = (score >= low[i, s]) & (score <= high[i, s])
                places.offer(i[inside] * slots + s, score[inside], ids[j[inside]])
        for a, _, _, places in state.values():
            if len(places.at):
                yield _emitted(a.key[places.at // slots], places.at % slots, places.vec, places.score)

    return rows.mapInArrow(best, "key long, slot long, vec_id long, score long")


def _first(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("key", "slot").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k)


def mine_hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    label: Column | str = "label",
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    scale: int = 256,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    block: int = ANCHOR_BLOCK,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): the hard negatives of all anchors.

    Anchors are the rows for which ``is_anchor`` holds, their positives the ``positives`` other rows of the same label
    with the highest integer inner products, and for each positive the first ``negatives`` rows of another label with
    low * positive_score <= 100 * negative_score <= high * positive_score (higher scores first, ties to the smaller id).
    A positive of a score below 0 has no such row, one of 0 those of score 0; fewer rows than asked for are all returned.

    Rows without an id or label, and vectors that are null or hold a null or non-finite component, take no part; vectors
    of another length than the anchor's are no candidates for it, empty ones score 0.  Rows of the anchor's own id are
    none of its candidates.  Repeated candidate rows count each, repeated anchor rows once; an id with several vectors
    is an anchor with each.  Scores beyond long end at its range.  Input columns of other names take no part, whatever
    they are called; an empty table gives an empty result.
    """
    label = F.col(f"`{label}`") if isinstance(label, str) else label
    own = vectors.select(
        F.col(f"`{id_col}`").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(f"`{vec_col}`").alias("v"), is_anchor.alias("asks")
    ).filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v")))
    spark = vectors.sparkSession
    dealt = own.select("vec_id", "label", "v").repartition(shuffle_partitions(spark)).withColumn("v", quantised(F.col("v"), scale))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    _with_summaries(dealt).write.option("compression", "zstd").parquet(f"{path}/rows")
    rows = spark.read.schema("vec_id long, label long, v array<bigint>, means array<float>, devs array<float>").parquet(f"{path}/rows")
    asking = cut(own.filter("asks").select("vec_id", "label", quantised(F.col("v"), scale).alias("v")).distinct())
    blocks = max(1, -(-asking.count() // block))
    part = F.pmod(F.xxhash64("vec_id", "label", "v"), F.lit(blocks))
    spark.createDataFrame([], OUT).write.parquet(f"{path}/found")
    for b in range(blocks):
        _mine_block(rows, asking.filter(part == b).collect(), positives, negatives, low, high, f"{path}/found")
    return spark.read.schema(OUT).parquet(f"{path}/found")


def _mine_block(rows: DataFrame, local: list, positives: int, negatives: int, low: int, high: int, path: str) -> None:
    """Appends the rows of one block of anchors, which is bounded and therefore sent to all tasks."""
    if not local:
        return
    context, spark = rows.sparkSession.sparkContext, rows.sparkSession
    ids = [r.vec_id for r in local]
    by_length: dict[int, list] = {}
    for key, r in enumerate(local):
        by_length.setdefault(len(r.v), []).append(type("Anchor", (), {"key": key, "vec_id": r.vec_id, "label": r.label, "v": r.v}))
    sent = context.broadcast({d: Anchors(own) for d, own in by_length.items()})
    lows, highs = np.zeros((len(local), positives), np.int64), np.full((len(local), positives), -1)
    asked = []
    for r in _first(_positives(rows, sent, positives), positives).collect():  # at most a few for each anchor
        s = r["rank"] - 1
        lows[r["key"], s], highs[r["key"], s] = -(-low * r["score"] // 100), high * r["score"] // 100
        asked.append((r["key"], s, ids[r["key"]], r["vec_id"], r["score"]))
    windows = context.broadcast((lows, highs))
    best = _first(_negatives(rows, sent, windows, negatives, positives), negatives)
    known = spark.createDataFrame(asked, "key long, slot long, anchor_id long, positive_id long, positive_score long")
    out = best.join(known, ["key", "slot"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
    out.write.mode("append").parquet(path)
    sent.destroy()
    windows.destroy()


ORACLE_HARD_NEGATIVES = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
      FROM e a JOIN e c ON a.vec_id <> c.vec_id AND len(a.v) = len(c.v) WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
        AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
