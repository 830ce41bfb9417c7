"""Toxicity by a subsequence string kernel, Nyström landmarks and a linear support vector machine.

Texts are read as sentences of units: words in lower case, windows of words
that are very long, runs of single characters ("i d i o t"), and windows of
scripts without spaces.  The kernel
of two units sums, over all triples of letters that both hold in order within
SPAN places, DECAY to the power of both spans, so gaps and inserted characters
cost weight but not the match; it is normalised by the units' lengths.

Labels belong to whole texts, so training is by bags: in each toxic text some
units are witnesses, all units of clean texts are clean.  Landmarks are spread
over the witnesses and clean units by the kernel; the machine is trained on the
Nyström features, and witnesses and hardest clean units are chosen anew a few
times.  As the kernel is a product over triples, the trained machine comes to
one weight a triple, which is what the tasks get to score whole texts with.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.llm.common import schema_with, text_or_empty, with_columns

SPAN, DECAY = 6, 0.7
PATTERNS = [(p, q) for q in range(2, SPAN + 1) for p in range(1, q)]
CODES = 102  # to the power of three: places of the table of weights; the first OWN**3 of them are of triples of own letters
OWN = 64
LONG, STEP = 24, 12  # units over LONG characters are cut into windows of LONG, one every STEP
TRAINING_TEXTS = 1500  # toxic texts that a model is fitted on at most; of clean ones twice as many
LANDMARKS = 128
ROUNDS = 4
KEEP = 500_000  # words whose decision a worker remembers
_SPACED = re.compile(r"(?<!\S)\S(?:[ ]\S){2,}(?!\S)")
_SENTENCE = re.compile(r"[.!?\n]+")
_EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»“”„‘’…–—"
# Scripts that put no space between words: their runs are units in windows of 2 and of 4 characters.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U00033fff]+")
# Signs that stand for letters inside a word; then letters with codes below OWN, all others have one of OWN and above.
_ALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "$": "s", "@": "a", "!": "i"}
_LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7) + "\x02\x03"  # and a word's begin and end


def _code_table() -> np.ndarray:
    """The code of every code point that has one: letters and the marks that belong to them."""
    table = np.zeros(0x34000, dtype=np.int32)
    for c in range(0x100, len(table)):
        if unicodedata.category(chr(c))[0] in "LM":
            table[c] = OWN + c
    for i, c in enumerate(_LETTERS):
        table[ord(c)] = i + 1
    for c, as_letter in _ALIKE.items():
        table[ord(c)] = table[ord(as_letter)]
    return table


_CODE = _code_table()


def units(text: str) -> set[str]:
    """The different units of a text (or sentence)."""
    low = text.lower()
    found = set(low.split())
    if "  " in low or "\n" in low or "\t" in low:
        low = " ".join(low.split())
    found.update(_SPACED.findall(low))
    if not low.isascii():
        for run in {r for w in found for r in _UNSPACED.findall(w)}:
            found.update(run[i : i + n] for n in (2, 4) for i in range(len(run) - n + 1))
    for w in [w for w in found if len(w) > LONG]:
        found.discard(w)
        found.update(w[i : i + LONG] for i in range(0, len(w) - LONG + STEP, STEP))
    return found


def _coded(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all units, SPAN gaps after each, where each begins, and the units' norms.

    Signs at a unit's edges and between its letters are left out; its begin and end count as letters.
    """
    marked = [f"\x02{w.strip(_EDGES)}\x03" for w in words]
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = _CODE[np.where(points < len(_CODE), points, 0)]
    owner = np.repeat(np.arange(len(words)), [len(m) for m in marked])[codes > 0]
    codes = codes[codes > 0]
    sizes = np.bincount(owner, minlength=len(words))
    begins = np.cumsum(sizes + SPAN) - sizes - SPAN
    out = np.zeros(int((sizes + SPAN).sum()) + SPAN, dtype=np.int32)
    out[np.arange(len(codes)) + SPAN * owner] = codes
    norm = np.sqrt(np.maximum(sum(np.maximum(sizes - q, 0) * DECAY ** (2 * q) for _, q in PATTERNS), DECAY**4))
    return out, begins, norm


def _triples(codes: np.ndarray, n: int) -> Iterator[tuple[float, np.ndarray]]:
    """For each pattern: its weight and the triple that begins at each place (0 where one of its places is a gap)."""
    c = codes.astype(np.int64)
    wide = c >= OWN
    some = bool(wide.any())
    for p, q in PATTERNS:
        x, y, z = c[:n], c[p : n + p], c[q : n + q]
        held = (x > 0) & (y > 0) & (z > 0)
        triple = np.where(held, (x * OWN + y) * OWN + z, 0)
        if some:
            at = np.flatnonzero(held & (wide[:n] | wide[p : n + p] | wide[q : n + q]))
            mixed = ((x[at] << 40) ^ (y[at] << 20) ^ z[at]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            triple[at] = OWN**3 + ((mixed >> np.uint64(32)) % np.uint64(CODES**3 - OWN**3)).astype(np.int64)
        yield DECAY**q, triple


def decisions(words: list[str], weights: np.ndarray, bias: float, part: int = 16384) -> np.ndarray:
    """The machine's decision for each unit."""
    out = [np.zeros(0)]
    for a in range(0, len(words), part):
        codes, begins, norm = _coded(words[a : a + part])
        n = len(codes) - SPAN
        at = np.zeros(n)
        for w, triple in _triples(codes, n):
            at += w * weights[triple]
        out.append(np.add.reduceat(at, begins) / norm + bias)
    return np.concatenate(out)


class Landmarks:
    """Units expanded to their normalised weights on triples; one row for each triple that any of them holds."""

    def __init__(self, words: list[str]):
        codes, begins, norm = _coded(words)
        n = len(codes) - SPAN
        owner = np.searchsorted(begins, np.arange(n), side="right") - 1
        held = [(w, triple) for w, triple in _triples(codes, n)]
        self.used = np.unique(np.concatenate([t for _, t in held]))
        self.used = self.used[self.used > 0]
        self.row = np.zeros(CODES**3, dtype=np.int32)  # row 0 is of all other triples
        self.row[self.used] = np.arange(1, len(self.used) + 1)
        self.rows = np.zeros((len(self.used) + 1, len(words)), dtype=np.float32)
        for w, triple in held:
            np.add.at(self.rows, (self.row[triple], owner), w)
        self.rows[0] = 0
        self.rows /= norm.astype(np.float32)

    def kernel(self, words: list[str], part: int = 2048) -> np.ndarray:
        """Kernel of each unit with each landmark."""
        out = [np.zeros((0, self.rows.shape[1]))]
        for a in range(0, len(words), part):
            codes, begins, norm = _coded(words[a : a + part])
            n = len(codes) - SPAN
            at = np.zeros((n, self.rows.shape[1]), dtype=np.float32)
            for w, triple in _triples(codes, n):
                at += np.float32(w) * self.rows[self.row[triple]]
            out.append(np.add.reduceat(at, begins, axis=0) / norm[:, None])
        return np.concatenate(out)

    def weights(self, coefficients: np.ndarray) -> np.ndarray:
        """One weight a triple that stands for a weighted sum of kernels with the landmarks."""
        out = np.zeros(CODES**3)
        out[self.used] = self.rows[1:] @ coefficients
        return out


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 10.0) -> np.ndarray:
    """Linear machine with squared hinge loss by Newton steps; the last coefficient is the bias."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    ridge = np.ones(x.shape[1])
    ridge[-1] = 1e-3

    def loss(w):
        return 0.5 * (ridge * w * w).sum() + cost * (weight * np.maximum(1 - y * (x @ w), 0) ** 2).sum()

    for _ in range(40):
        miss = np.maximum(1 - y * (x @ w), 0)
        on = miss > 0
        gradient = ridge * w - 2 * cost * ((weight * y * miss) @ x)
        hessian = np.diag(ridge) + 2 * cost * (x[on] * weight[on, None]).T @ x[on]
        step, scale, now = np.linalg.solve(hessian, gradient), 1.0, loss(w)
        while scale > 1e-4 and loss(w - scale * step) > now:
            scale /= 2
        if scale <= 1e-4 or np.abs(scale * step).max() < 1e-7:
            break
        w = w - scale * step
    return w


def _with_insertion(word: str, rng: np.random.Generator) -> str:
    """The word with one more letter inside."""
    at = int(rng.integers(1, max(2, len(word))))
    return word[:at] + chr(97 + int(rng.integers(0, 26))) + word[at:]


@dataclass(frozen=True)
class Model:
    """Weight of every triple, bias, and the line that makes a text's highest decision a score."""

    weights: np.ndarray
    bias: float
    threshold: float
    slope: float

    def score(self, highest: float) -> float:
        return 1.0 / (1.0 + math.exp(-max(min(self.slope * (highest - self.threshold), 60.0), -60.0)))


def fit(texts: list[str], toxic: list[int], seed: int = 7) -> Model:
    """A model from labelled texts; without texts of both classes, one that scores everything near 0."""
    number: dict[str, int] = {}

    def known(found: set[str]) -> np.ndarray:
        return np.array([number.setdefault(u, len(number)) for u in sorted(found)], dtype=np.int32)

    every = [known(units(t)) for t in texts]
    bad = [i for i, y in enumerate(toxic) if y == 1 and len(every[i])]
    good = [i for i, y in enumerate(toxic) if y == 0 and len(every[i])]
    none = Model(np.zeros(CODES**3), -1.0, 0.0, 6.0)
    if not bad or not good:
        return none
    bad, good = _without_near_copies(bad, every, list(number)), _without_near_copies(good, every, list(number))
    sentences = {i: [known(units(s)) for s in _SENTENCE.split(texts[i]) if s.strip()] for i in bad}
    words = list(number)
    rng = np.random.default_rng(seed)
    count = lambda own: np.bincount(np.concatenate([every[i] for i in own]), minlength=len(words))
    in_bad, in_good = count(bad), count(good)
    odds = np.log((in_bad + 0.5) / (len(bad) + 1)) - np.log((in_good + 0.5) / (len(good) + 1))
    # first witnesses: in every toxic text the unit that speaks most for toxic texts; texts without one wait
    speaks = np.where((in_bad >= 3) & (odds > 2.0), in_bad * odds, 0.0)
    loud = speaks > 0.05 * speaks.max()
    always = [int(u) for i in bad for u in every[i] if loud[u]]
    witnesses = always + [int(own[np.argmax(speaks[own])]) for i in bad if speaks[own := every[i]].any() and not loud[own].any()]
    if not witnesses:
        witnesses = [int(every[i][np.argmax(odds[every[i]])]) for i in bad]
    clean = np.flatnonzero(in_good)
    model = none
    hard = np.zeros(0, dtype=np.int64)
    value = np.zeros(len(words))
    for _ in range(ROUNDS):
        counts = Counter(witnesses)
        positive = sorted(counts, key=lambda w: (-counts[w], words[w]))[:2000]
        negative = list(dict.fromkeys([*hard.tolist(), *clean[rng.permutation(len(clean))[:3000]].tolist()]))
        negative = [w for w in negative if w not in counts]
        name = lambda own: [words[w] for w in own]
        chosen = Landmarks(_spread(name(positive), LANDMARKS // 2) + _spread(name(negative), LANDMARKS // 2))
        size, vector = np.linalg.eigh(chosen.rows.T.astype(np.float64) @ chosen.rows)
        ok = size > 1e-6 * size.max()
        root = vector[:, ok] / np.sqrt(size[ok])
        spoilt = [_with_insertion(words[w], rng) for w in positive[:300]]
        x = chosen.kernel([*name(positive), *spoilt, *name(negative)]) @ root
        y = np.concatenate([np.ones(len(positive) + len(spoilt)), -np.ones(len(negative))])
        seen = np.sqrt(np.array([counts[w] for w in positive + positive[:300]], dtype=np.float64))
        seen[len(positive) :] *= 0.3
        against = np.where(np.isin(negative, hard), 3.0, 1.0)
        weight = np.concatenate([seen / seen.sum(), 3.0 * against / max(against.sum(), 1.0)]) * 1000
        w = _svm(x, y, weight)
        model = Model(chosen.weights(root @ w[:-1]), float(w[-1]), 0.0, 6.0)
        value = decisions(words, model.weights, model.bias)
        hard = np.array(list(dict.fromkeys([*clean[np.argsort(-value[clean], kind="stable")[:1500]].tolist(), *hard.tolist()])), dtype=np.int64)
        # the best unit of each sentence that is toxic by itself
        best = [int(s[np.argmax(value[s])]) for i in bad for s in sentences[i] if len(s)]
        witnesses = always + [u for u in best if value[u] > 0 and odds[u] > 0]
        if not witnesses:
            break
    top_good, top_bad = (np.sort([value[every[i]].max() for i in own]) for own in (good, bad))
    # the threshold with the fewest errors, in the middle of the gap that allows it; a clean text counts three times;
    # well above the decision for a unit that shares nothing with any landmark
    cuts = np.unique(np.concatenate([top_good, top_bad]))
    cuts = np.concatenate([[cuts[0] - 1], (cuts[:-1] + cuts[1:]) / 2, [cuts[-1] + 1]])
    cuts = np.maximum(cuts, model.bias + 0.3 * (np.median(top_bad) - model.bias))
    errors = (len(top_good) - np.searchsorted(top_good, cuts)) / len(top_good) * 3 + np.searchsorted(top_bad, cuts) / len(top_bad)
    best_cuts = np.flatnonzero(errors == errors.min())
    return Model(model.weights, model.bias, float(cuts[best_cuts[len(best_cuts) // 2]]), 6.0)


def _without_near_copies(own: list[int], every: list[np.ndarray], words: list[str]) -> list[int]:
    """The texts but those that share 7 of 10 units with an earlier one: copies would lend their rare words weight."""
    crc = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words], dtype=np.uint64)
    leaders: dict[tuple, int] = {}
    left = []
    for i in own:
        keys = []
        for salt in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F):
            h = crc[every[i]] * np.uint64(salt) % np.uint64((1 << 32) - 5)
            keys.append((salt, *np.sort(h)[:3].tolist()))
        near = {leaders[k] for k in keys if k in leaders}
        shared = (len(np.intersect1d(every[i], every[j])) for j in near)
        if all(n < 0.7 * (len(every[i]) + len(every[j]) - n) for n, j in zip(shared, near, strict=True)):
            left.append(i)
            for k in keys:
                leaders.setdefault(k, i)
    return left


def _spread(words: list[str], n: int) -> list[str]:
    """Up to n of the units, each as unlike those before it as can be; the first word first."""
    if len(words) <= n:
        return list(words)
    words = words[:800]
    chosen, near = [0], np.full(len(words), -np.inf)
    while len(chosen) < n:
        near = np.maximum(near, Landmarks([words[chosen[-1]]]).kernel(words)[:, 0])
        near[chosen[-1]] = np.inf
        chosen.append(int(np.argmin(near)))
    return [words[i] for i in chosen]


def held_out(doc_id: Column) -> Column:
    """Rows whose crc32 of the id as text is divisible by 5; false without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = TRAINING_TEXTS) -> Model:
    """Fits a model on the labelled texts that are not held out, at most ``most`` toxic and twice as many clean
    ones (those with the smallest hash of the id), so that what reaches the driver is bounded."""
    rows = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("toxic"))
    rows = rows.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).distinct()
    pick = lambda y: rows.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit((2 - y) * most)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    sample = texts.join(F.broadcast(pick(0).unionByName(pick(1))), "doc_id").select("doc_id", "text", "toxic").collect()
    sample.sort(key=lambda r: (r.doc_id, r.text, r.toxic))
    return fit([r.text for r in sample], [r.toxic for r in sample])


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """The kept columns (default: all), ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on) of every whole text.

    A text's score comes from its highest unit.  Null, empty and blank texts score near 0.
    Added columns (their names are a parameter) replace kept ones of their name; repeated rows get equal results.
    """
    keep = list(docs.columns) if keep is None else keep
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        known: dict[str, float] = {}
        for b in source:
            out = []
            texts = b.column(b.schema.get_field_index(text_col))
            for a in range(0, b.num_rows, 512):
                bags = [units(t or "") for t in texts.slice(a, 512).to_pylist()]
                if len(known) > KEEP:
                    known.clear()
                new = list(set().union(*bags).difference(known))
                for c in range(0, len(new), 8192):
                    part = new[c : c + 8192]
                    known.update(zip(part, decisions(part, m.weights, m.bias).tolist(), strict=True))
                out += [m.score(max(map(known.__getitem__, x), default=m.threshold - 1.0)) for x in bags]
            yield with_columns(b, keep, {names[0]: pa.array(out, pa.float64()), names[1]: pa.array([int(s >= 0.5) for s in out], pa.int32())})

    needed = list(dict.fromkeys([*keep, text_col]))
    return docs.select(*[f"`{c}`" for c in needed]).mapInArrow(batches, schema_with(docs, keep, {names[0]: "double", names[1]: "int"}))
