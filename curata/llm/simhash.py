"""SimHash near duplicates through a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most d <= 3 bits differ in at most d
of their 8 bytes, so they share the bytes of at least 8 - d positions.  Posting
lists by single bytes would be too long, so the index is keyed by four byte
positions at once: the 14 position sets of a block design (sets whose numbers
cancel under xor) of which every choice of five positions contains one.  A
pair that shares five positional bytes therefore meets in a list.  There its
shared positional bytes are tallied, pairs under the guaranteed minimum are
left, and the rest are verified on all bits.

Only different fingerprints enter the index, each once.  Within a list pairs
are compared in arrays and only a spanning forest of the links is returned, so
rows stay in proportion to the fingerprints; a list beyond LIST members is
split in blocks, and each pair of blocks is a task's work of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curata.llm.common import cut, schema_with, text_or_empty, utf8_buffers, with_columns
from curata.llm.components import components

SHINGLE, SEED = 3, 42
DISTANCE = 3  # at most: five positions must be shared
LIST = 4096  # members of a posting list that are compared in one go
ROWS = 1 << 17  # rows that a task works on together, unless one list has more
POSITIONS = [c for c in combinations(range(8), 4) if not c[0] ^ c[1] ^ c[2] ^ c[3]]


def simhash(text: bytes, words: int = SHINGLE) -> int:
    """64-bit SimHash of UTF-8 text: bit set where over half the shingles' XXH64 have it; no word: 0."""
    parts = text.lower().split()  # bytes: A-Z alone are lowered, and split at 0x20 and 0x09 to 0x0D
    if not parts:
        return 0
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(b" ".join(parts), SEED)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1)
    begins = [0, *ends[: -words].tolist()]
    stops = (ends[words - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(begins, stops, strict=True)), dtype=np.uint64, count=len(stops))
    counts = np.zeros(64, dtype=np.int64)
    for a in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[a : a + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprint(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, words: int = SHINGLE) -> DataFrame:
    """The kept columns (default: all) and ``fingerprint`` (long, the 64 bits) of every whole text; null texts are empty."""
    keep = list(docs.columns) if keep is None else keep

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            data, at = utf8_buffers(b.column(b.schema.get_field_index(text_col)))
            raw, at = data.tobytes(), at.tolist()
            prints = np.array([simhash(raw[x:y], words) for x, y in zip(at[:-1], at[1:], strict=True)], dtype=np.uint64)
            yield with_columns(b, keep, {"fingerprint": pa.array(prints.view(np.int64))})

    needed = list(dict.fromkeys([*keep, text_col]))
    return docs.select(*[f"`{c}`" for c in needed]).mapInArrow(batches, schema_with(docs, keep, {"fingerprint": "bigint"}))


def _unequal_bytes(x: np.ndarray) -> np.ndarray:
    """How many bytes of each value are not zero."""
    for s in (4, 2, 1):
        x = x | (x >> np.uint64(s))
    return np.bitwise_count(x & np.uint64(0x0101010101010101))


def _forest(prints: np.ndarray, sizes: np.ndarray, distance: int) -> np.ndarray:
    """For rows that lie list by list: the index of the first row that links connect each with, inside its list."""
    label = np.arange(len(prints))
    stop = np.repeat(np.cumsum(sizes), sizes)
    left, lag = np.flatnonzero(label + 1 < stop), 1
    while len(left):
        differ = prints[left] ^ prints[left + lag]
        enough = _unequal_bytes(differ) <= distance  # the tally: 8 less the shared positional bytes
        near = left[enough]
        near = near[np.bitwise_count(differ[enough]) <= distance]
        while True:
            a, b = label[near], label[near + lag]
            apart = a != b
            if not apart.any():
                break
            near, a, b = near[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(further := label[label], label):
                label = further
        lag += 1
        left = left[left + lag < stop[left]]
    return label


def _links_of(distance: int):
    def links(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (which, bytes, lo, hi, fingerprint), sorted: a forest of the links of each list."""

        def found(keys: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
            new = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
            label = _forest(prints.view(np.uint64), np.diff(np.append(new, len(prints))), distance)
            moved = label != np.arange(len(label))
            return pa.RecordBatch.from_arrays([pa.array(prints[moved]), pa.array(prints[label[moved]])], ["a", "b"])

        keys, prints = np.zeros((0, 4), dtype=np.int64), np.zeros(0, dtype=np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for batch in source:
            columns = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)]
            parts.append((np.stack(columns[:4], axis=1), columns[4]))
            held += len(columns[4])
            if held >= ROWS:
                keys, prints = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                own = np.flatnonzero((keys != keys[-1]).any(axis=1))
                whole = int(own[-1]) + 1 if len(own) else 0  # the last list may go on
                if whole:
                    yield found(keys[:whole], prints[:whole])
                parts, held = [(keys[whole:], prints[whole:])], len(prints) - whole
        if held:
            yield found(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))

    return links


def links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b): links between different fingerprints (column ``fingerprint``, each once), enough to connect whatever
    is connected by pairs at most ``distance`` bits apart; every returned pair is connected by such pairs."""
    if not 0 <= distance <= DISTANCE:
        raise ValueError("the index guarantees distances up to 3 bits")
    masks = [sum(0xFF << 8 * p for p in c) for c in POSITIONS]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    entries = F.array(*[F.struct(F.lit(i).alias("which"), F.col("fingerprint").bitwiseAND(F.lit(signed(m))).alias("bytes")) for i, m in enumerate(masks)])
    postings = prints.select("fingerprint", F.explode(entries).alias("e")).select("e.which", "e.bytes", "fingerprint")
    sizes = postings.groupBy("which", "bytes").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    lists = postings.join(sizes, ["which", "bytes"])
    blocks = F.ceil(F.col("n") / LIST)
    own = F.pmod(F.xxhash64("fingerprint"), blocks)
    dealt = lists.select("which", "bytes", "fingerprint", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other")).select(
        "which", "bytes", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fingerprint"
    )
    keys = ["which", "bytes", "lo", "hi"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_links_of(distance), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One row per input row: doc_id, text_key (hash of the text), fingerprint (long), component_id and root.

    Rows are linked if their fingerprints differ in at most ``distance`` bits; component_id is the smallest doc_id of
    all rows that links connect (null only if none of them has an id); root is one of their fingerprints, the same for
    all of them and for no others, whatever the ids.  Null and empty texts have fingerprint 0.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("text_key", F.xxhash64("text"))
    prints = cut(fingerprint(rows, keep=["doc_id", "text_key"], words=words))
    nodes = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    roots = components(links(nodes.select("fingerprint"), distance))
    rooted = nodes.join(roots, nodes["fingerprint"] == roots["node"], "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    found = rooted.join(ids, "root").select("fingerprint", "component_id", "root")
    return prints.join(found, "fingerprint").select("doc_id", "text_key", "fingerprint", "component_id", "root")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One row of each group of near duplicates with all its columns: the one with the smallest (id, hash of the text).

    Groups go by what links connect, not by ids, so unlinked rows stay even if they share an id or have none.  Null ids
    are the smallest; of rows that repeat id and text one stays.
    """
    found = near_duplicates(docs, id_col, text_col, words, distance)
    stay = found.groupBy("root").agg(F.min(F.struct("doc_id", "text_key")).alias("s")).select(F.col("s.doc_id").alias("_sh_id"), F.col("s.text_key").alias("_sh_key"))
    keyed = docs.withColumn("_sh_text", F.xxhash64(text_or_empty(text_col)))
    same = keyed[f"`{id_col}`"].cast("long").eqNullSafe(stay["_sh_id"]) & (keyed["_sh_text"] == stay["_sh_key"])
    return keyed.join(stay, same, "left_semi").dropDuplicates([id_col, "_sh_text"]).drop("_sh_text")
