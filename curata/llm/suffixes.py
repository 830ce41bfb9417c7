"""Exact substring deduplication over sampled suffixes, sorted outside memory and induced to all others.

A byte is removed if a stretch of LENGTH bytes that covers it also starts
anywhere else.  Sorting every suffix is not needed for that: a sample of them
(``anchors``) serves all starts.  The sample's tuples are sorted by Spark's
external sort, the disk-backed queue that every shuffle merges its runs with,
and what the sort learns is induced to the starts in rounds:

1. Tuples (CORE bytes from the anchor, all bytes of the starts it serves) as
   hashes.  Equal tuples settle all their starts; a core that stands alone
   settles them too.  A task first merges its own equal tuples, so a stretch
   that very many texts share reaches the shuffle once a task.
2. What shares a core but not all bytes (the edges of repeats, short shared
   passages) is cut into classes of STEP starts, whose common bytes are STEP - 1
   short of LENGTH.  The tuples now carry their bytes.  Within equal common
   bytes names are induced one byte at a time to either side, each from the
   name before it and the next byte, so that two starts have equal names if and
   only if they have a common prefix of LENGTH bytes.  The tuples of a core with
   more than CLASS of them (a passage that very many texts have in different
   surroundings) would make classes that no task should hold: their starts go
   by hashes of their own LENGTH bytes instead, equal ones merged in each task.

Texts are known by 81 bits of hashes.  A text's bytes are shuffled twice, once
to carry the bytes of round 2 and once to be cut; everything else is tuples.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curata.llm.anchors import CORE, LENGTH, anchors
from curata.llm.common import shuffle_partitions, text_or_empty, utf8_buffers, with_columns, written

STEP = 32  # starts of a class in round 2
ROWS = 1 << 16  # tuples that a task works on together
# Cores with very many tuples are dealt out over several tasks; a sample of the texts tells which (routes alone depend
# on it, never results).  The list is bounded; a core it misses is streamed by one task.
SAMPLE, HEAVY, HEAVY_CORES, SALTS = 16, 1 << 16, 2000, 16
CLASS = 1 << 15  # tuples of a core that are compared in classes at most
STARTS = 1 << 18  # starts whose hashes a task merges together
TAG_BITS = 17
# A tuple's spot: the anchor's place, whether equal tuples were merged into it, the text's tag, the bytes served before
# the place and after the first start.
_TAG, _BACK = 14, 7


def _packed(place, many, tag, back, ahead):
    return (place << 32) | (many << 31) | (tag << _TAG) | (back << _BACK) | ahead


def _unpacked(spot):
    """place, many, tag, first and last start."""
    place = spot >> 32
    first = place - ((spot >> _BACK) & 127)
    return place, (spot >> 31) & 1, (spot >> _TAG) & ((1 << TAG_BITS) - 1), first, first + (spot & 127)


TUPLE = "core long, outer long, text_key long, spot long, stop long"


def _tuples(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (text_key, tag, text): the anchors' tuples, equal ones of a batch merged (stop -1), and the starts that the
    merging has settled (outer and stop: the first and last of consecutive ones)."""
    for batch in source:
        key, tag = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
        data, offsets = utf8_buffers(batch.column(2))
        doc, place, first, last = anchors(data, offsets)
        if not len(doc):
            continue
        raw, base = data.tobytes(), offsets[doc]
        digest = xxhash.xxh3_64_intdigest
        core = np.fromiter((digest(raw[x : x + CORE]) for x in (base + place).tolist()), dtype=np.uint64, count=len(doc)).view(np.int64)
        outer = np.fromiter((digest(raw[x:y]) for x, y in zip((base + first).tolist(), (base + last + LENGTH).tolist(), strict=True)), dtype=np.uint64, count=len(doc)).view(np.int64)
        order = np.lexsort((outer, core))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (np.diff(core[order]) != 0) | (np.diff(outer[order]) != 0)
        run = np.cumsum(new) - 1
        many = np.bincount(run) > 1
        own = order[new]
        yield _batch(core[own], outer[own], key[doc[own]], _packed(place[own], many.astype(np.int64), tag[doc[own]], place[own] - first[own], last[own] - first[own]), np.full(len(own), -1))
        settled = np.sort(order[many[run]])  # in order of text and start
        if len(settled):
            d, a, z = doc[settled], first[settled], last[settled]
            begins = np.ones(len(d), dtype=bool)
            begins[1:] = (d[1:] != d[:-1]) | (a[1:] != z[:-1] + 1)
            at = np.flatnonzero(begins)
            d, a, z = d[at], a[at], z[np.append(at[1:], len(z)) - 1]
            once = np.unique(np.stack([key[d], tag[d], a, z], axis=1), axis=0)  # copies of a text settle alike
            yield _batch(once[:, 0], once[:, 2], once[:, 0], once[:, 1] << _TAG, once[:, 3])


def _batch(*columns: np.ndarray, names: str = TUPLE) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], [n.split()[0] for n in names.split(", ")])


SETTLED = "open long, core long, text_key long, tag long, place long, first long, last long, many long"


def _first_round(source: Iterator[pa.RecordBatch], heavy: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of tuples sorted by core and outer: settled starts (open 0), and one tuple of each outer of a core that has
    several (open 1; many: its starts are settled, others may repeat them).  A heavy core, whose outers are dealt out,
    counts as one with several.

    Works on bounded stretches; only the last run of equal tuples and the core before it are carried on.
    """

    def settled(key, tag, first, last):
        zero = np.zeros(len(key))
        return _batch(zero, zero, key, tag, zero, first, last, zero, names=SETTLED)

    rest = np.zeros((0, 4), dtype=np.int64)
    before: int | None = None  # core of the last run that is done

    def work(rows: np.ndarray, following: int | None) -> Iterator[pa.RecordBatch]:
        nonlocal before
        core, outer, key, spot = rows.T
        place, many, tag, first, last = _unpacked(spot)
        new = np.ones(len(core), dtype=bool)
        new[1:] = (np.diff(core) != 0) | (np.diff(outer) != 0)
        at = np.flatnonzero(new)
        sizes = np.diff(np.append(at, len(core)))
        repeated = (sizes > 1) | (many[at] == 1)
        now = np.repeat(repeated, sizes) & (many == 0)
        yield settled(key[now], tag[now], first[now], last[now])
        c = core[at]
        same = np.zeros(len(at), dtype=bool)
        same[1:] |= c[1:] == c[:-1]
        same[:-1] |= c[1:] == c[:-1]
        same[0] |= before is not None and c[0] == before
        same[-1] |= following is not None and c[-1] == following
        same |= np.isin(c, heavy)
        before = int(c[-1])
        own = at[same]
        yield _batch(np.ones(len(own)), core[own], key[own], tag[own], place[own], first[own], last[own], repeated[same], names=SETTLED)

    parts, held = [], 0
    for batch in source:
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
        done = columns[4] >= 0
        if done.any():
            yield settled(columns[2][done], columns[3][done] >> _TAG, columns[1][done], columns[4][done])
        parts.append(np.stack([c[~done] for c in columns[:4]], axis=1))
        held += len(parts[-1])
        if held >= ROWS:
            rows = np.concatenate([rest, *parts])
            differ = np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(axis=1))
            whole = int(differ[-1]) + 1 if len(differ) else 0
            if whole:
                yield from work(rows[:whole], int(rows[whole, 0]))
            rest, parts, held = rows[whole:], [], 0
    rows = np.concatenate([rest, *parts]) if parts else rest
    if len(rows):
        yield from work(rows, None)


# Two more kinds of rows, told by the size of ``bytes``: a start of a core with very many tuples (class and 8 bytes: the hash
# of its LENGTH bytes, base: the start) and a range of settled starts (0 bytes).
CARRIED = "class long, bytes binary, text_key long, tag long, base long, low int, high int, many long"


def _carried(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (text_key, tag, text, open tuples): for each class of starts a tuple with its bytes, zeros where no start of it
    is served; class is a hash of the bytes that all its starts share, the core among them.  Of crowded tuples: the starts by
    hash, those that recur in a stretch of the task settled here."""
    span = LENGTH + STEP - 1
    names = [n.split()[0] for n in CARRIED.split(", ")]
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]

    def rows(out: list[tuple]) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(out), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[a : a + 10_000], strict=True), kinds, strict=True)], names)

    def merged(starts: dict[bytes, list[tuple]]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        settled: dict[tuple[int, int], list[int]] = {}
        for digest, held in starts.items():
            many = int(len(held) > 1 or held[0][3])
            out.append((int.from_bytes(digest[:8], "little", signed=True), digest[8:], *held[0][:3], 0, 0, many))
            if len(held) > 1:
                for key, tag, start, done in held:
                    if not done:
                        settled.setdefault((key, tag), []).append(start)
        for (key, tag), found in settled.items():
            own = np.sort(np.array(found, dtype=np.int64))
            at = np.flatnonzero(np.diff(own, prepend=-2) != 1)
            for first, last in zip(own[at].tolist(), own[np.append(at[1:], len(own)) - 1].tolist(), strict=True):
                out.append((key, b"", key, tag, first, 0, last - first, 1))
        yield from rows(out)

    starts: dict[bytes, list[tuple]] = {}
    n = 0
    for batch in source:
        out: list[tuple] = []
        for key, tag, text, tuples in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            raw = text.encode()
            for t in tuples:
                if t["crowded"]:
                    for x in range(t["first"], t["last"] + 1):
                        starts.setdefault(xxhash.xxh3_128_digest(raw[x : x + LENGTH]), []).append((key, tag, x, t["many"]))
                    n += t["last"] - t["first"] + 1
                    if n >= STARTS:
                        yield from merged(starts)
                        starts, n = {}, 0
                    continue
                for c in range((t["place"] - t["last"]) // STEP, (t["place"] - t["first"]) // STEP + 1):
                    base = t["place"] - STEP * c - STEP + 1  # the class's first start
                    low, high = max(t["first"], base), min(t["last"], base + STEP - 1)
                    held = raw[low : high + LENGTH]
                    shared = xxhash.xxh3_64_intdigest(raw[base + STEP - 1 : base + LENGTH], seed=c)
                    out.append((shared - (1 << 63), b"\0" * (low - base) + held + b"\0" * (span - (low - base) - len(held)), key, tag, base, low - base, high - base, t["many"]))
        yield from rows(out)
    yield from merged(starts)


RANGES = "text_key long, tag long, first long, last long"


def _induced(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of carried rows sorted by class: the starts that another tuple repeats, as ranges."""

    def work(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        size = pc.binary_length(rows.column("bytes")).to_numpy()
        by_size = {n: rows.filter(pa.array(size == n)) for n in np.unique(size).tolist()}
        for n, own in by_size.items():
            yield settled(own) if n == 0 else alike(own) if n == 8 else induced(own)

    def settled(rows: pa.Table) -> pa.RecordBatch:
        base, high, key, tag = (rows.column(c).to_numpy().astype(np.int64) for c in ("base", "high", "text_key", "tag"))
        return _batch(key, tag, base, base + high, names=RANGES)

    def alike(rows: pa.Table) -> pa.RecordBatch:
        hashed = np.stack([rows.column("class").to_numpy(), np.frombuffer(b"".join(rows.column("bytes").to_pylist()), dtype="<i8")], axis=1)
        _, which, counts = np.unique(hashed, axis=0, return_inverse=True, return_counts=True)
        many, base, key, tag = (rows.column(c).to_numpy().astype(np.int64) for c in ("many", "base", "text_key", "tag"))
        which = which.reshape(-1)
        # a row that stands for several starts (many) has settled them; they repeat the others
        now = (counts[which] > 1) & (many == 0)
        return _batch(key[now], tag[now], base[now], base[now], names=RANGES)

    def induced(rows: pa.Table) -> pa.RecordBatch:
        data = np.frombuffer(b"".join(rows.column("bytes").to_pylist()), dtype=np.uint8).reshape(rows.num_rows, -1)
        low, high, many, base, key, tag = (rows.column(c).to_numpy().astype(np.int64) for c in ("low", "high", "many", "base", "text_key", "tag"))
        shared = np.ascontiguousarray(data[:, STEP - 1 : LENGTH]).view(np.dtype((np.void, LENGTH - STEP + 1))).reshape(-1)
        _, name = np.unique(shared, return_inverse=True)

        def induce(names: np.ndarray, byte: np.ndarray) -> np.ndarray:
            return np.unique(names * 256 + byte, return_inverse=True)[1].reshape(-1)

        left = [name.reshape(-1)]  # names of the bytes from start t to the end of the shared ones, t = STEP - 1 down to 0
        for t in range(STEP - 2, -1, -1):
            left.append(induce(left[-1], data[:, t]))
        right, found = name.reshape(-1), np.zeros((rows.num_rows, STEP), dtype=bool)
        for t in range(STEP):
            live = np.flatnonzero((low <= t) & (t <= high))
            if len(live):
                _, which, counts = np.unique(left[STEP - 1 - t][live] * rows.num_rows + right[live], return_inverse=True, return_counts=True)
                found[live, t] = counts[which.reshape(-1)] > 1
            if t < STEP - 1:
                right = induce(right, data[:, LENGTH + t])
        found[many == 1] = False  # settled before
        edges = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, a = np.nonzero(edges == 1)
        _, z = np.nonzero(edges == -1)
        return _batch(key[row], tag[row], base[row] + a, base[row] + z - 1, names=RANGES)

    held: list[pa.RecordBatch] = []
    n = 0
    for batch in source:
        held.append(batch)
        n += batch.num_rows
        if n >= ROWS:
            rows = pa.Table.from_batches(held)
            of = rows.column("class").to_numpy()
            differ = np.flatnonzero(of != of[-1])
            whole = int(differ[-1]) + 1 if len(differ) else 0
            if whole:
                yield from work(rows.slice(0, whole))
                held, n = rows.slice(whole).to_batches(), rows.num_rows - whole
    if n:
        yield from work(pa.Table.from_batches(held))


def _heavy_cores(keyed: DataFrame) -> list[int]:
    """The cores with the most tuples in a sample of the texts, HEAVY_CORES at most, if they have HEAVY in all texts."""
    sample = keyed.filter((F.pmod("text_key", F.lit(SAMPLE)) == 0) & (F.octet_length("text") >= LENGTH)).select("text_key", "tag", "text")
    counts = sample.mapInArrow(_tuples, TUPLE).filter("stop < 0").groupBy("core").count().filter(F.col("count") >= HEAVY // SAMPLE)
    return [r.core for r in counts.orderBy(F.desc("count"), "core").limit(HEAVY_CORES).collect()]


def repeated_starts(keyed: DataFrame) -> DataFrame:
    """Of (text_key, tag, text): ranges of starts whose LENGTH bytes also start elsewhere (columns of RANGES)."""
    parts = shuffle_partitions(keyed.sparkSession)
    tuples = keyed.filter(F.octet_length("text") >= LENGTH).select("text_key", "tag", "text").mapInArrow(_tuples, TUPLE)
    heavy = _heavy_cores(keyed)
    salt = F.when(F.col("core").isin(heavy), F.pmod("outer", F.lit(SALTS))).otherwise(F.lit(0)) if heavy else F.lit(0)
    listed = np.array(heavy, dtype=np.int64)
    dealt = tuples.withColumn("salt", salt).repartition(parts, "core", "salt").drop("salt").sortWithinPartitions("core", "outer")
    first = written(dealt.mapInArrow(lambda source: _first_round(source, listed), SETTLED))
    settled = first.filter("open = 0").select("text_key", "tag", "first", "last")
    opened = first.filter("open = 1")
    crowded = opened.groupBy("core").count().filter(F.col("count") > CLASS).select("core", F.lit(True).alias("crowded"))  # one row for CLASS tuples at most
    told = opened.join(F.broadcast(crowded), "core", "left").withColumn("crowded", F.coalesce("crowded", F.lit(False)))
    asked = told.groupBy("text_key", "tag").agg(F.collect_list(F.struct("place", "first", "last", "many", "crowded")).alias("tuples"))
    texts = keyed.select("text_key", "tag", "text").dropDuplicates(["text_key", "tag"])
    carried = texts.join(asked, ["text_key", "tag"]).select("text_key", "tag", "text", "tuples").mapInArrow(_carried, CARRIED)
    found = carried.repartition(parts, "class").sortWithinPartitions("class").mapInArrow(_induced, RANGES)
    return settled.unionByName(found)


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = False) -> DataFrame:
    """Per row: its id, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs), ``kept_sha256`` of the bytes left,
    and with ``with_kept`` those bytes (``kept``, binary: a cut may fall inside a character) and the removed runs
    (``spans``: begin and end).

    Texts are judged as they come in, as UTF-8 bytes; matches never cross rows.  Null texts are empty; texts under
    LENGTH bytes lose nothing; of rows that repeat a text of LENGTH bytes or more each loses all of it.
    """
    second = F.xxhash64(F.lit(1), text_or_empty(text_col)).bitwiseAND(F.lit((1 << TAG_BITS) - 1))
    keyed = docs.select(F.col(f"`{id_col}`").alias(id_col), text_or_empty(text_col).alias("text")).withColumns({"text_key": F.xxhash64("text"), "tag": second})
    ranges = repeated_starts(keyed).groupBy("text_key", "tag").agg(F.collect_set(F.struct("first", "last")).alias("ranges"))
    joined = keyed.join(ranges, ["text_key", "tag"], "left").select(id_col, "text", "ranges")
    more = {"kept": "binary", "spans": "array<struct<begin:bigint,end:bigint>>"} if with_kept else {}
    added = {"n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"} | more

    def cut(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            data, at = utf8_buffers(batch.column(1))
            raw, at = data.tobytes(), at.tolist()
            out: dict[str, list] = {k: [] for k in added}
            for x, y, own in zip(at[:-1], at[1:], batch.column(2).to_pylist(), strict=True):
                text, kept, spans, end = raw[x:y], [], [], 0
                for r in sorted(own or [], key=lambda r: r["first"]):
                    a, z = r["first"], r["last"] + LENGTH
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], z)
                    else:
                        spans.append([a, z])
                for a, z in spans:
                    kept.append(text[end:a])
                    end = z
                kept = b"".join([*kept, text[end:]])
                row = {"n_bytes": len(text), "n_removed": len(text) - len(kept), "n_spans": len(spans), "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept": kept, "spans": [{"begin": a, "end": z} for a, z in spans]}
                for k, held in out.items():
                    held.append(row[k])
            kinds = {"kept_sha256": pa.string(), "kept": pa.binary(), "spans": pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))}
            yield with_columns(batch, [id_col], {k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()})

    kind = docs.schema[id_col].dataType.simpleString()
    return joined.mapInArrow(cut, ", ".join([f"`{id_col}` {kind}", *(f"{k} {v}" for k, v in added.items())]))
