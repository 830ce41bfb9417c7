"""Mixture-controlled packing: deficit round-robin over source queues.

Each source is a queue of token ids, document after document.  The next token
of the packed stream always goes to the queue that lags its target share most
(the largest weight / (2 sent + 1)), so every window of the stream is filled
to the target proportions and what a queue is owed carries on to the next
window.  How much each queue has sent after h tokens has a closed form (the
divisor method with h seats), so any task can enter the schedule at any window
with the deficits that all windows and partitions before it have left.  A
queue that runs out leaves its share to the others.

Texts are tokenized once and their ids written to the shared folder with each
document's place in its queue inside its task; the queues are joined up from
one total a task and source.  Ids are never shuffled: documents are cut where
they are read, each piece knows its sequence and offset.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curata.llm.common import text_or_empty, utf8_buffers, written
from curata.llm.words import encoder

LENGTH = 4096
END = 2  # id that closes each document
BROADCAST_ROWS = 50_000  # totals by task and source up to here go to all tasks, beyond it they are joined by a shuffle
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def shares(weights: np.ndarray, seats: np.ndarray) -> np.ndarray:
    """Seats of each weight for every number of ``seats``, by the divisor method with d + 1/2 (ties: the earlier weight).

    A row never has fewer seats than a row for fewer seats.
    """
    w = weights.astype(np.float64)
    out = np.floor(seats[:, None] * (w / w.sum())[None, :] + 0.5).astype(np.int64)
    index = np.arange(len(seats))

    def gain(a):  # priority of the next seat of each
        return w / (2.0 * a + 1.0)

    def loss(a):  # priority of the last seat of each
        return np.where(a > 0, w / np.maximum(2.0 * a - 1.0, 1.0), np.inf)

    last = len(w) - 1 - np.arange(len(w))
    for _ in range(4 * len(w) + 8):
        short = seats - out.sum(axis=1)
        best = gain(out).argmax(axis=1)
        worst = last[loss(out)[:, ::-1].argmin(axis=1)]
        high, low = gain(out)[index, best], loss(out)[index, worst]
        swap = (short == 0) & ((high > low) | ((high == low) & (best < worst)))
        up, down = (short > 0) | swap, (short < 0) | swap
        if not (up | down).any():
            return out
        out[index[up], best[up]] += 1
        out[index[down], worst[down]] -= 1
    raise AssertionError("seats do not settle")


class Schedule:
    """How many tokens each queue has sent after h tokens of the packed stream."""

    def __init__(self, totals: list[int], weights: list[float] | None = None):
        left = np.array(totals, dtype=np.int64)
        wanted = left.astype(np.float64) if weights is None else np.array(weights, dtype=np.float64)
        self.totals, self.stream = left.copy(), int(left.sum())
        self.phases: list[tuple[int, np.ndarray, np.ndarray]] = []  # first h, sent before it, weights from it on
        h, sent = 0, np.zeros(len(left), dtype=np.int64)
        while left.any():
            active = np.where(left > 0, wanted, 0.0)
            if not active.any():
                active = left.astype(np.float64)
            self.phases.append((h, sent.copy(), active))
            on = np.flatnonzero(active > 0)
            first = int(on[np.argmin(left[on] / active[on])])
            low, high = 0, int(left[on].sum())
            while high - low > 1:  # the fewest seats that use up the first queue to end
                middle = (low + high) // 2
                low, high = (low, middle) if self._seats(active, np.array([middle]))[0, first] >= left[first] else (middle, high)
            got = np.minimum(self._seats(active, np.array([high]))[0], left)
            h, sent, left = h + int(got.sum()), sent + got, left - got
        self.starts = np.array([p[0] for p in self.phases], dtype=np.int64)

    @staticmethod
    def _seats(active: np.ndarray, seats: np.ndarray) -> np.ndarray:
        on = np.flatnonzero(active > 0)
        out = np.zeros((len(seats), len(active)), dtype=np.int64)
        out[:, on] = shares(active[on], seats)
        return out

    def sent(self, h: np.ndarray) -> np.ndarray:
        h = np.minimum(h, self.stream)
        phase = np.searchsorted(self.starts, h, side="right") - 1
        out = np.empty((len(h), len(self.totals)), dtype=np.int64)
        for p in np.unique(phase):
            own = phase == p
            first, before, active = self.phases[p]
            out[own] = before + self._seats(active, h[own] - first)
        return out

    def window_of(self, queue: np.ndarray, place: np.ndarray, length: int) -> np.ndarray:
        """The window that holds the token at ``place`` of ``queue``, for each pair."""
        low, high = np.zeros(len(queue), dtype=np.int64), np.full(len(queue), -(-self.stream // length), dtype=np.int64)
        if len(self.phases) and len(queue):  # a first guess at the target share, mostly right to a window or two
            guess = (place * (self.stream / np.maximum(self.totals[queue], 1)) / length).astype(np.int64)
            for slack in (2, 64):
                a, b = np.clip(guess - slack, low, high - 1), np.clip(guess + slack, low + 1, high)
                row = np.arange(len(queue))
                low = np.where(self.sent(a * length)[row, queue] <= place, a, low)
                high = np.where(self.sent(b * length)[row, queue] > place, b, high)
        while (open_ := np.flatnonzero(high - low > 1)).size:
            middle = (low[open_] + high[open_]) // 2
            past = self.sent(middle * length)[np.arange(len(open_)), queue[open_]] <= place[open_]
            low[open_[past]], high[open_[~past]] = middle[past], middle[~past]
        return low


def tokenized(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """doc_id, queue, task, before (tokens of the queue earlier in the task), n_tokens and packed ids, written once."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        end = np.array([END], dtype=encoder(tokenizer).kind).tobytes()
        task, sent = TaskContext.get().partitionId(), {}
        for b in source:
            queues = b.column(1).to_pylist()
            data, at = utf8_buffers(b.column(2))
            raw, at = data.tobytes(), at.tolist()
            ids = [encode(raw[x:y]) + end for x, y in zip(at[:-1], at[1:], strict=True)]
            sizes = [len(x) // len(end) for x in ids]
            before = []
            for q, n in zip(queues, sizes, strict=True):
                before.append(sent.get(q, 0))
                sent[q] = before[-1] + n
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([task] * len(ids), pa.int32()), pa.array(before, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())],
                ["doc_id", "queue", "task", "before", "n_tokens", "ids"],
            )

    queue = F.when(F.col(f"`{source_col}`").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col(f"`{source_col}`").cast("string")))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), queue.alias("queue"), text_or_empty(text_col).alias("text"))
    return written(rows.mapInArrow(batches, "doc_id long, queue string, task int, before long, n_tokens long, ids binary"))


def pack(
    docs: DataFrame,
    tokenizer: str,
    targets: dict[str | None, float] | None = None,
    length: int = LENGTH,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    with_ids: bool = False,
) -> DataFrame:
    """Packs every document's ids, closed by END, into sequences of ``length``: one row per piece (columns of PIECES).

    ``targets``: weight of each source; by default its share of all tokens, which keeps every window at the target
    to the end.  Sources without a weight follow when the others have run out.  All sequences but the last are full.
    Null and empty texts are the closing id alone; rows without a source form a queue of their own; repeated rows are
    packed each.  ``with_ids`` adds the piece's ids (array of int).  Totals are one row a source on the driver.
    """
    spark = docs.sparkSession
    rows = tokenized(docs, tokenizer, id_col, text_col, source_col)
    per_task = rows.groupBy("queue", "task").agg(F.sum("n_tokens").alias("n"))
    totals = {r.queue: r.n for r in per_task.groupBy("queue").agg(F.sum("n").alias("n")).collect()}
    names = sorted(totals)
    kind = PIECES + ", ids array<int>" * with_ids
    if not names:
        return spark.createDataFrame([], kind)
    weights = None
    if targets is not None:
        named = {"n" if k is None else f"s{k}": float(v) for k, v in targets.items()}
        weights = [named.get(q, 0.0) for q in names]
    schedule = Schedule([totals[q] for q in names], weights)
    number = {q: i for i, q in enumerate(names)}
    earlier = Window.partitionBy("queue").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = per_task.select("queue", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    base = F.broadcast(base) if per_task.count() <= BROADCAST_ROWS else base
    placed = rows.join(base, ["queue", "task"]).select("doc_id", "queue", (F.col("base") + F.col("before")).alias("first"), "n_tokens", "ids")

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = encoder(tokenizer).kind
        for b in source:
            if b.num_rows:
                queue = np.array([number[q] for q in b.column(1).to_pylist()], dtype=np.int64)
                first, size = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
                yield from _pieces(schedule, length, b.column(0), queue, first, size, b.column(4).to_pylist(), wide, with_ids)

    return placed.mapInArrow(batches, kind)


def _pieces(schedule, length, doc_ids, queue, first, size, ids, wide, with_ids, limit: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    a, b = schedule.window_of(queue, first, length), schedule.window_of(queue, first + size - 1, length)
    counts = b - a + 1
    stops = np.cumsum(counts)
    done = 0
    while done < len(queue):  # bounded groups of documents; one document is always taken
        to = max(done + 1, int(np.searchsorted(stops, (stops[done - 1] if done else 0) + limit, side="right")))
        n = counts[done:to]
        doc = np.repeat(np.arange(done, to), n)
        window = a[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
        seen, place = np.unique(window, return_inverse=True)
        before, after = schedule.sent(seen * length), schedule.sent((seen + 1) * length)
        ahead = np.cumsum(after - before, axis=1) - (after - before)
        q = queue[doc]
        lo = np.maximum(before[place, q], first[doc])
        hi = np.minimum(after[place, q], first[doc] + size[doc])
        real = hi > lo  # a window may have no token of a small queue
        doc, place, q, lo, hi, window = (x[real] for x in (doc, place, q, lo, hi, window))
        start, count = lo - first[doc], hi - lo
        crc, own, last, raw = [], [], -1, b""
        for d, s, c in zip(doc.tolist(), start.tolist(), count.tolist(), strict=True):
            if d != last:
                last, raw = d, memoryview(np.frombuffer(ids[d], dtype=wide).astype("<u4").tobytes())
            crc.append(zlib.crc32(raw[4 * s : 4 * (s + c)]))
            if with_ids:
                own.append(np.frombuffer(raw[4 * s : 4 * (s + c)], dtype=np.int32))
        columns = [doc_ids.take(pa.array(doc)), pa.array(start), pa.array(count), pa.array(crc, pa.int64()), pa.array(size[doc]), pa.array(window), pa.array(ahead[place, q] + lo - before[place, q])]
        names = [x.split()[0] for x in PIECES.split(", ")]
        if with_ids:
            columns, names = [*columns, pa.array(own, pa.list_(pa.int32()))], [*names, "ids"]
        yield pa.RecordBatch.from_arrays(columns, names)
        done = to
