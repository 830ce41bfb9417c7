"""Document fingerprints from closed syncmers.

A k-mer (k code points) is a closed syncmer if the smallest hash among its
inner s-mers is the first or the last of them.  The choice depends on the
k-mer alone, so equal passages have equal anchors wherever they stand.  A
fingerprint keeps all anchors with a hash in the lowest 32nd of its range, and
at least the 64 smallest, each with its first position: their number grows with
the text (about 5 a thousand code points), so long texts that share a passage of
a few hundred words share anchors.  Two fingerprints are alike as far as their
shared anchors come in the same order.  With n anchors compared, the likeness
estimates that of all anchors to about 0.5 / sqrt(n): 0.06 at 64, 0.02 at 600.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curata.llm.common import schema_with, shuffle_partitions, text_or_empty, with_columns

K, S = 16, 5  # code points of a k-mer (a power of two) and of its inner substrings
ANCHORS = 64  # smallest hashes that a fingerprint keeps whatever they are
SHIFT = 5  # it keeps every hash below 2^64 / 2^SHIFT too
PIECE = 1 << 20  # code points that are worked on together
_ROOT = np.uint64(0x9E3779B97F4A7C15)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_ROOT), n, 1 << 64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def closed_syncmers(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the closed syncmers among all k-mers of ``points`` (code points)."""
    n = len(points) - K + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    h = {1: points.astype(np.uint64) + np.uint64(1)}
    for w in (1, 2, 4, 8):  # a doubled width from two halves; K is the last
        a = h[w]
        h[2 * w] = a[:-w] * _power(w) + a[w:]
    inner = _mixed(h[4][: n + K - S] * _ROOT + h[1][4 : 4 + n + K - S])
    span = K - S + 1
    low, w = inner, 1
    while 2 * w <= span:
        low, w = np.minimum(low[:-w], low[w:]), 2 * w
    low = np.minimum(low[:n], low[span - w : span - w + n])
    at = np.flatnonzero((inner[:n] == low) | (inner[span - 1 : span - 1 + n] == low))
    return at, _mixed(h[K][at])


def _smallest(doc: np.ndarray, at: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each document's ANCHORS smallest different hashes and all low ones, with their first positions."""
    order = np.lexsort((at, h, doc))
    doc, at, h = doc[order], at[order], h[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    doc, at, h = doc[new], at[new], h[new]
    rank = np.arange(len(doc)) - np.searchsorted(doc, doc)
    keep = (rank < ANCHORS) | (h >> np.uint64(64 - SHIFT) == 0)
    return doc[keep], at[keep], h[keep]


def fingerprints(texts: list[str]) -> list[str]:
    """The fingerprint of each text: its anchors as ``hash@position`` in hex, by hash, comma-joined.

    An empty text has the empty fingerprint; a text without a closed syncmer
    has one anchor, the hash of all of it.
    """
    parts: list[list] = [[], [], []]

    def flush(group: list[tuple[int, int, np.ndarray]]) -> None:
        if not group:
            return
        lengths = np.array([len(p) for _, _, p in group])
        ends = np.cumsum(lengths)
        at, h = closed_syncmers(np.concatenate([p for _, _, p in group]))
        piece = np.searchsorted(ends, at, side="right")
        inside = at + K <= ends[piece]
        at, h, piece = at[inside], h[inside], piece[inside]
        doc = np.array([d for d, _, _ in group])[piece]
        at = at - (ends - lengths)[piece] + np.array([o for _, o, _ in group])[piece]
        for held, found in zip(parts, _smallest(doc, at, h), strict=True):
            held.append(found)

    group, size = [], 0
    for d, text in enumerate(texts):
        if len(text) < K:
            continue
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        for o in range(0, len(points) - K + 1, PIECE):
            piece = points[o : o + PIECE + K - 1]
            group.append((d, o, piece))
            size += len(piece)
            if size >= PIECE:
                flush(group)
                group, size = [], 0
    flush(group)
    out = ["" if not t else None for t in texts]
    if parts[0]:
        doc, at, h = _smallest(*(np.concatenate(p) for p in parts))
        words = [f"{x >> 24:010x}@{a:x}" for x, a in zip(h.tolist(), at.tolist(), strict=True)]
        cuts = np.flatnonzero(np.diff(doc)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(doc)], strict=True):
            if hi > lo:
                out[doc[lo]] = ",".join(words[lo:hi])
    return [hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=5).hexdigest() + "@0" if f is None else f for t, f in zip(texts, out, strict=True)]


def _anchors(fingerprint: str) -> dict[str, int]:
    return {w[:10]: int(w[11:], 16) for w in fingerprint.split(",")} if fingerprint else {}


def likeness(a: str, b: str) -> float:
    """Of the low hashes of both fingerprints together (at least the ANCHORS smallest), the share that both hold in the same order (0 to 1).

    Both fingerprints are whole as far as these hashes go.  Two empty fingerprints are alike (1), an empty and another are not (0).
    """
    if a == b:
        return 1.0
    x, y = _anchors(a), _anchors(b)
    shared = x.keys() & y.keys()
    if not shared:
        return 0.0
    union = sorted(x.keys() | y.keys())
    union = union[: max(ANCHORS, bisect_left(union, f"{1 << 40 - SHIFT:010x}"))]
    chain: list[int] = []  # longest increasing run of second positions in order of the first
    for _, q in sorted((x[w], y[w]) for w in union if w in shared):
        i = bisect_left(chain, q)
        chain[i : i + 1] = [q]
    return len(chain) / len(union)


def fingerprint(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (default: all) and ``fingerprint`` of every row's whole text; null texts are empty."""
    keep = list(docs.columns) if keep is None else keep

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            texts = b.column(b.schema.get_field_index(text_col)).fill_null("").to_pylist()
            yield with_columns(b, keep, {"fingerprint": pa.array(fingerprints(texts), pa.string())})

    needed = list(dict.fromkeys([*keep, text_col]))
    return docs.select(*[f"`{c}`" for c in needed]).mapInArrow(batches, schema_with(docs, keep, {"fingerprint": "string"}))


def edited(text: str, following: str) -> str:
    """The last third (rounded down) replaced by as many first code points of the following text, or all it has."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third] if third else text


RESULT = T.StructType(
    [T.StructField("doc_id", T.LongType())]
    + [T.StructField("n_chars", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")]
    + [T.StructField(c, T.DoubleType()) for c in ("near_edited", "near_next")]
)


def edited_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and their likeness (columns of ``RESULT``).

    The next document is the one of the next smaller id, after the smallest the
    one of the largest; rows of one id follow each other by descending text,
    rows without an id come last.  Null texts are empty; very long ones are worked
    on in pieces, with the same result.  Other columns do not matter, whatever
    their names.

    The texts are dealt out once, by id range.  The first row of each range is
    also sent to the range before it, as that range's last neighbour.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    ranges = 4 * parts
    bounds = rows.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0] if ranges > 1 else []
    edges = np.unique(np.array(bounds or [], dtype=np.int64))
    last = len(edges) + 1

    @F.pandas_udf("int")
    def range_of(ids):  # 0 for the largest ids; rows without an id come last
        filled = ids.astype("Int64")
        place = len(edges) - np.searchsorted(edges, filled.fillna(0).to_numpy(dtype=np.int64), side="right")
        place[filled.isna().to_numpy()] = last
        return type(ids)(place.astype(np.int32))

    ranged = rows.withColumn("at", range_of("doc_id"))
    order = F.struct(F.col("doc_id"), F.col("text"))  # null ids are the smallest in a struct's order
    heads = ranged.groupBy("at").agg(F.max(order).alias("head"))


    everything = Window.orderBy("at")  # one row a range
    before = F.coalesce(F.lag("at").over(everything), F.max("at").over(everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    guests = heads.select(before.alias("at"), F.col("head.doc_id").alias("doc_id"), F.col("head.text").alias("text"), F.lit(True).alias("guest"))
    dealt = (
        ranged.select("at", "doc_id", "text", F.lit(False).alias("guest"))
        .unionByName(guests)
        .repartition(parts, "at")
        .sortWithinPartitions("at", "guest", F.desc_nulls_last("doc_id"), F.desc("text"))
    )

    def results(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row so far: its range, id, text and fingerprint
        for batch in source:
            at, ids, texts, guest = (batch.column(i).to_pylist() for i in range(4))
            prints = fingerprints(texts)
            found = list(zip(at, ids, texts, prints, guest, strict=True))
            follow = found if held is None else [held, *found]
            pairs = [(x, y) for x, y in zip(follow[:-1], follow[1:], strict=True) if not x[4] and x[0] == y[0]]
            held = follow[-1] if follow else held
            if pairs:
                yield _result(pairs)

    return dealt.mapInArrow(results, RESULT)


def _result(pairs) -> pa.RecordBatch:
    new = [edited(x[2], y[2]) for x, y in pairs]
    prints = fingerprints(new)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([x[1] for x, _ in pairs], pa.int64()),
            pa.array([len(x[2]) for x, _ in pairs], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in new], pa.string()),
            pa.array([x[3] for x, _ in pairs], pa.string()),
            pa.array(prints, pa.string()),
            pa.array([likeness(x[3], p) for (x, _), p in zip(pairs, prints, strict=True)], pa.float64()),
            pa.array([likeness(x[3], y[3]) for x, y in pairs], pa.float64()),
        ],
        [f.name for f in RESULT.fields],
    )
