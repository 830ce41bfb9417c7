"""Secret scans with one combined deterministic automaton.

All rules are compiled together (``automaton.compile_rules``); each task scans
its texts' bytes once, whatever the number of rules.  Where the automaton
reports a match, the stretch in which that rule was under way is resolved to
leftmost, non-overlapping, longest matches by the rule's own small automaton.
There is no shuffle: every row is scanned where it is read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from curata.llm import automaton
from curata.llm.common import schema_with, utf8_buffers, with_columns

BLOCK = 1 << 21  # bytes that are scanned together; a longer text is a block of its own


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its byte regex, the least length of a match and, for ``key = value`` rules, of the value.

    A match that is too short is dropped but still uses up its text.
    """

    kind: str
    pattern: str
    least: int = 0
    least_value: int = 0


def any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


_KEYS = "|".join([any_case("password"), any_case("passwd"), any_case("secret"), any_case("token"), any_case("api") + "_?" + any_case("key")])
# The three base kinds as the contract gives them.  The least length of hex runs is in the pattern, so
# that single hex letters of prose are no events; a shorter run cannot hold another match.
BASE_RULES = (
    Rule("assign", f"({_KEYS})[\"']?\\x20*[:=]\\x20*[\"']?[A-Za-z0-9+/_.=\\-]+", least_value=8),
    Rule("access", "AKIA[A-Z0-9]+", least=16),
    Rule("hex", "[0-9a-f]{32,}"),
)
# Further kinds with a fixed public prefix.
MORE_RULES = (
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge_token", "gh[opsu]_[A-Za-z0-9]+", least=34),
    Rule("chat_token", "xox[abprs]-[A-Za-z0-9\\-]+", least=15),
)
RULES = BASE_RULES + MORE_RULES


@functools.lru_cache(maxsize=4)
def _compiled(rules: tuple[Rule, ...]):
    patterns = [r.pattern for r in rules]
    return automaton.compile_rules(patterns), [automaton.compile_rules([p], searching=False) for p in patterns]


def _value_length(match: bytes) -> int:
    """Length of the assigned value: what follows the first ``:`` or ``=``, blanks and one quote."""
    at = min(i for i in (match.find(b":"), match.find(b"=")) if i >= 0)
    rest = match[at + 1 :].lstrip(b" ")
    return len(rest) - (rest[:1] in (b'"', b"'"))


def _blocks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    start = 0
    for i in range(1, len(offsets)):
        if i == len(offsets) - 1 or offsets[i + 1] - offsets[start] > BLOCK:
            yield start, i
            start = i


def scan(data: np.ndarray, offsets: np.ndarray, rules: tuple[Rule, ...] = RULES) -> dict[int, list[tuple[int, int, int]]]:
    """For each text with a match: (start, rule, end) in code points, by start, then rule."""
    combined, single = _compiled(rules)
    out: dict[int, list[tuple[int, int, int]]] = {}
    for a, b in _blocks(offsets):
        lengths = np.diff(offsets[a : b + 1])
        block = np.full(int(lengths.sum()) + b - a, automaton.RESET, dtype=np.uint8)
        begins = offsets[a:b] - offsets[a] + np.arange(b - a)
        block[np.arange(int(lengths.sum())) + np.repeat(np.arange(b - a), lengths)] = data[offsets[a] : offsets[b]]
        states = automaton.run(combined, block)
        hits = np.flatnonzero(combined.accepts[states])
        for doc in np.unique(np.searchsorted(begins, hits, side="right") - 1):
            lo, hi = int(begins[doc]), int(begins[doc] + lengths[doc])
            raw, own = block[lo:hi].tobytes(), states[lo:hi]
            spans = [(s, r, e) for r in range(len(rules)) for s, e in _resolved(raw, own, r, combined, single[r], rules[r])]
            if spans:
                points = np.concatenate([[0], np.cumsum((block[lo:hi] & 0xC0) != 0x80)])
                out[a + int(doc)] = [(int(points[s]), r, int(points[e])) for s, r, e in sorted(spans)]
    return out


def _resolved(raw: bytes, states: np.ndarray, r: int, combined, own, rule: Rule) -> list[tuple[int, int]]:
    """Leftmost non-overlapping longest matches of rule ``r``, in bytes.

    A match lies inside one stretch of bytes after each of which the rule is
    under way, so only stretches that hold an accepting state are looked at.
    """
    ends = np.flatnonzero((combined.accepts[states] >> r) & 1)
    if not len(ends):
        return []
    under = np.concatenate([[0], (combined.alive[states] >> r) & 1, [0]])
    edges = np.flatnonzero(np.diff(under))
    begins, stops = edges[::2], edges[1::2]
    spans = []
    for w in np.unique(np.searchsorted(begins, ends, side="right") - 1):
        s, stop = int(begins[w]), int(stops[w])
        while s < stop:
            e = automaton.longest_match(own, raw, s, stop)
            if e < 0:
                s += 1
                continue
            if e - s >= rule.least and (not rule.least_value or _value_length(raw[s:e]) >= rule.least_value):
                spans.append((s, e))
            s = e
    return spans


def _joined(spans: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> str:
    return ",".join(f"{rules[r].kind}:{s}:{e}" for s, r, e in spans)


def find_secrets(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The kept columns (default: all) of every row, with what the scan of its whole text found.

    Added: ``n_<kind>`` (long) for each base kind, ``base_sha256`` (lowercase hex of the base spans' list) and
    ``spans`` (all spans).  A span is ``kind:start:end`` in code points, end exclusive; lists are ordered by start,
    then kind in the rules' order, and joined by commas.  Null and empty texts have no span.  Added columns replace
    kept ones of their name; repeated rows get equal results.
    """
    keep = list(docs.columns) if keep is None else keep
    base = [i for i, r in enumerate(rules) if r in BASE_RULES]
    added = {**{f"n_{rules[i].kind}": "bigint" for i in base}, "base_sha256": "string", "spans": "string"}

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8_buffers(batch.column(batch.schema.get_field_index(text_col)))
            spans = scan(data, offsets, rules)
            n = batch.num_rows
            counts = {i: np.zeros(n, dtype=np.int64) for i in base}
            none = hashlib.sha256(b"").hexdigest()
            sha, text = [none] * n, [""] * n
            for doc, own in spans.items():
                for i in base:
                    counts[i][doc] = sum(r == i for _, r, _ in own)
                sha[doc] = hashlib.sha256(_joined([x for x in own if x[1] in counts], rules).encode()).hexdigest()
                text[doc] = _joined(own, rules)
            columns = {f"n_{rules[i].kind}": pa.array(counts[i]) for i in base}
            yield with_columns(batch, keep, columns | {"base_sha256": pa.array(sha, pa.string()), "spans": pa.array(text, pa.string())})

    needed = list(dict.fromkeys([*keep, text_col]))
    return docs.select(*[f"`{c}`" for c in needed]).mapInArrow(found, schema_with(docs, keep, added))


def redact_secrets(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Every row with all columns; each secret in its text becomes ``[kind]`` (overlapping spans: one mark, of the first).

    Null texts become empty; texts without a secret stay as they are.
    """

    def redacted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col))
            spans = scan(*utf8_buffers(column), rules)
            texts = column.fill_null("")
            if spans:
                values = texts.to_pylist()
                for doc, own in spans.items():
                    parts, at = [], 0
                    for s, r, e in own:
                        if s >= at:
                            parts += [values[doc][at:s], f"[{rules[r].kind}]"]
                        at = max(at, e)
                    values[doc] = "".join(parts) + values[doc][at:]
                texts = pa.array(values, column.type)
            yield batch.set_column(batch.schema.get_field_index(text_col), batch.schema.field(text_col).with_nullable(True), texts)

    return docs.mapInArrow(redacted, docs.schema)
