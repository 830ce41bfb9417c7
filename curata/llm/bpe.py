"""BPE encoding and decoding through tables of distinct words.

Spark splits every text into units: a run of non-blank characters with the one
space before it, or a stretch of white space, cut just where the vocabulary's
own pattern cuts around white space, so that a text's ids are its units' ids
in order.  The units of an Arrow batch become a table of distinct words and a
column of positions into it; each distinct word is encoded once (and then
remembered by the worker), ids are joined back by position, and decoding joins
ids to the pieces of the vocabulary.  Documents stay where they are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from curata.llm.common import schema_with, text_or_empty, with_columns
from curata.llm.words import byte_signs

KEEP = 500_000  # words whose ids a worker remembers at most
KEEP_BYTES = 1 << 26  # bytes of remembered words and ids at most, without what Python adds for each
LONGEST = 256  # characters of a unit that is remembered
GROUP = 1 << 19  # units whose ids are joined back together; a longer text is a group of its own
# All white space of the vocabulary's pattern.
_SPACES = r" \t\n\x0B\f\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WHITE, _OTHER = f"[{_SPACES}]", f"[^{_SPACES}]"
UNIT = f" ?{_OTHER}+|{_WHITE}+(?!{_OTHER})|{_WHITE}+"


class WordTable:
    """Ids of units by the library, remembered, and the bytes of every id."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.ids: dict[str, np.ndarray] = {}
        self.held = 0  # bytes of them
        own = {c: b for b, c in byte_signs().items()}
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        special = {i: t.content.encode() for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        pieces = [special.get(i) or bytes(own[c] for c in self.tokenizer.id_to_token(i)) for i in range(size)]
        self.piece_at = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        self.piece_bytes = np.frombuffer(b"".join(pieces), dtype=np.uint8)

    def of(self, words: list[str]) -> list[np.ndarray]:
        if len(self.ids) > KEEP or self.held > KEEP_BYTES:
            self.ids.clear()
            self.held = 0
        long: dict[str, np.ndarray] = {}  # for this call only
        new = [w for w in words if w not in self.ids]
        for a in range(0, len(new), 8192):
            part = new[a : a + 8192]
            for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                ids = np.array(e.ids, dtype="<u4")
                if len(w) > LONGEST:
                    long[w] = ids
                else:
                    self.ids[w] = ids
                    self.held += 4 * len(w) + ids.nbytes
        return [long[w] if w in long else self.ids[w] for w in words]


_tables: dict[str, WordTable] = {}


def table(path: str) -> WordTable:
    """One a worker process and vocabulary."""
    if path not in _tables:
        _tables[path] = WordTable(path)
    return _tables[path]


def special_tokens(path: str) -> list[str]:
    return [t.content for t in Tokenizer.from_file(path).get_added_tokens_decoder().values()]


def units(text: Column, special: list[str]) -> Column:
    """The units of a text; none for an empty one.  A text that holds a special token is one unit."""
    whole = F.lit(False)
    for s in special:
        whole = whole | text.contains(s)
    return F.when(text == "", F.array().cast("array<string>")).when(whole, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)))


def gathered(at: np.ndarray, values: np.ndarray, take: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches ``values[at[i]:at[i + 1]]`` for i in ``take``, one after the other, and where each begins."""
    sizes = (at[1:] - at[:-1])[take]
    begins = np.concatenate([[0], np.cumsum(sizes)])
    return values[np.arange(begins[-1]) + np.repeat(at[take] - begins[:-1], sizes)], begins


def encode_decode(docs: DataFrame, tokenizer: str, text_col: str = "text", keep: list[str] | None = None, with_ids: bool = False) -> DataFrame:
    """The kept columns (default: all) of every row and what encoding its whole text gives.

    Added: ``n_tokens`` (long), ``ids_sha256`` (of the ids as little-endian unsigned 32-bit integers),
    ``decoded_sha256`` (of the text decoded from the ids, UTF-8), both in lowercase hex, and with ``with_ids`` the ids
    and the decoded text (``ids``, ``decoded``).  Null and empty texts have no ids and decode to the empty text.
    Added columns replace kept ones of their name; repeated rows get equal results.
    """
    keep = list(docs.columns) if keep is None else keep
    added = {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"} | ({"ids": "array<bigint>", "decoded": "string"} if with_ids else {})

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = table(tokenizer)
        for b in source:
            lists = b.column(b.num_columns - 1)
            at = np.asarray(lists.offsets).astype(np.int64)
            flat = lists.values.slice(int(at[0]), int(at[-1] - at[0])).dictionary_encode()
            at = at - at[0]
            own = words.of(flat.dictionary.to_pylist())
            own_at = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)
            own_ids = np.concatenate(own) if own else np.zeros(0, dtype="<u4")
            position = flat.indices.to_numpy(zero_copy_only=False)
            out: dict[str, list] = {k: [] for k in added}
            a = 0
            while a < b.num_rows:
                z = max(a + 1, int(np.searchsorted(at, at[a] + GROUP, side="right")) - 1)
                ids, begins = gathered(own_at, own_ids, position[at[a] : at[z]])
                text, text_at = gathered(words.piece_at, words.piece_bytes, ids)
                for d in range(a, z):
                    lo, hi = int(begins[at[d] - at[a]]), int(begins[at[d + 1] - at[a]])
                    decoded = text[text_at[lo] : text_at[hi]].tobytes()
                    out["n_tokens"].append(hi - lo)
                    out["ids_sha256"].append(hashlib.sha256(ids[lo:hi].tobytes()).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(decoded).hexdigest())
                    if with_ids:
                        out["ids"].append(ids[lo:hi].astype(np.int64))
                        out["decoded"].append(decoded.decode("utf-8", "replace"))
                a = z
            kinds = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int64())}
            yield with_columns(b, keep, {k: pa.array(v, kinds.get(k, pa.string())) for k, v in out.items()})

    rows = docs.select(*[f"`{c}`" for c in keep], units(text_or_empty(text_col), special_tokens(tokenizer)).alias("_bpe_units"))
    return rows.mapInArrow(batches, schema_with(docs, keep, added))
