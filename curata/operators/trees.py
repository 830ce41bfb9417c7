"""Histogram trees for imputation.

Predictors become codes of one byte: 0 is missing, 1..255 are bins.  A numeric
predictor of up to 255 values has a bin for each, any other one for each of 255
quantile ranges.  A text predictor has a bin for each level, levels numbered by
their mean target; beyond 255 levels neighbours in that order share a bin.

Training rows of equal codes are one row with their number and the sum of their
targets, written once, ``BLOCK`` of them as one record, a partition a core or
more.  A level of a tree is one pass: each task routes its rows
through the splits so far, adds up counts and targets per (node, predictor, bin,
class) and returns only those sums.  They are as many as the bins of the open nodes, at most
``CELLS`` a pass, whatever the number of rows; the splits are chosen from them.
Up to ``GATHERED`` of them from all tasks are added up where the split is chosen,
more than that by Spark first.
Targets are whole numbers (fixed point), so sums, and with them the trees, do
not depend on the partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.functions import is_numeric_type, numeric_column
from curata.functions.stats import _running, with_position
from curata.session import cut_lineage

BINS = 255
CELLS = 1 << 22  # (node, predictor, bin, class) sums of one pass
SURROGATES = 5
ROUNDS_KEPT = 5  # boosting rounds after which the rows' scores are written anew
BLOCK = 1 << 16  # rows of one record
PART_ROWS = (1 << 12, 1 << 20)  # a partition of fewer rows is not worth a task; one of more is cut
GATHERED = 1 << 21  # partial sums of one pass that are added up without a shuffle


# --- a tree and how rows go down it ---------------------------------------------------------


@dataclass
class Split:
    """Rows whose code of ``feature`` is marked in ``left`` go to node 2i + 1, the others to 2i + 2.

    ``surrogates``: (feature, left) in falling agreement, asked one after another for rows that lack ``feature``; rows
    that lack all of them go the way of ``left[0]``.
    """

    feature: int
    left: np.ndarray
    surrogates: list[tuple[int, np.ndarray]] = field(default_factory=list)


@dataclass
class Tree:
    splits: dict[int, Split]
    leaves: dict[int, float]

    def route(self, codes: np.ndarray) -> np.ndarray:
        """The node that each row (of codes) ends in."""
        at = np.zeros(len(codes), np.int64)
        if not self.splits:
            return at
        if not any(x.surrogates for x in self.splits.values()):
            names, ends = self._ends(codes)
            return names[ends]
        names = np.array(sorted(self.splits), dtype=np.int64)
        splits = [self.splits[n] for n in names]
        feature, left = np.array([x.feature for x in splits]), np.array([x.left for x in splits])
        rows = np.arange(len(codes))
        while len(rows):  # a level at a time
            slot = np.minimum(np.searchsorted(names, at[rows]), len(names) - 1)
            inner = names[slot] == at[rows]
            rows, slot = rows[inner], slot[inner]
            own = codes[rows, feature[slot]]
            goes = left[slot, own]
            lacking = np.flatnonzero(own == 0)
            for k in np.unique(slot[lacking]):
                rest = lacking[slot[lacking] == k]
                for other, mask in splits[k].surrogates:
                    code = codes[rows[rest], other]
                    goes[rest[code > 0]] = mask[code[code > 0]]
                    rest = rest[code == 0]
            at[rows] = 2 * at[rows] + np.where(goes, 1, 2)
        return at

    def _ends(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tree's nodes, and the place among them where each row ends: by tables, for splits without surrogates."""
        names = np.array(sorted({0} | {m for n in self.splits for m in (n, 2 * n + 1, 2 * n + 2)}), dtype=np.int64)
        place = {int(n): i for i, n in enumerate(names)}
        feature, left = np.zeros(len(names), np.int64), np.zeros((len(names), BINS + 1), np.int64)
        child = np.repeat(np.arange(len(names)), 2)  # right, left; a leaf's are itself
        for n, split in self.splits.items():
            i = place[n]
            feature[i], left[i] = split.feature, split.left
            child[2 * i], child[2 * i + 1] = place[2 * n + 2], place[2 * n + 1]
        flat, goes, start = np.ascontiguousarray(codes).reshape(-1), left.reshape(-1), np.arange(len(codes)) * codes.shape[1]
        at = np.zeros(len(codes), np.int64)
        for _ in range(max((int(n + 1).bit_length() for n in self.splits), default=0)):
            at = child[2 * at + goes[at * (BINS + 1) + flat[start + feature[at]]]]
        return names, at

    def values(self, codes: np.ndarray) -> np.ndarray:
        """The value of each row's leaf."""
        if not any(x.surrogates for x in self.splits.values()):
            names, ends = self._ends(codes)
            return np.array([self.leaves.get(int(n), 0.0) for n in names], dtype=np.float64)[ends]
        names = np.array(sorted(self.leaves), dtype=np.int64)
        value = np.array([self.leaves[n] for n in names], dtype=np.float64)
        return value[np.searchsorted(names, self.route(codes))]


# --- predictors to codes ---------------------------------------------------------------------


@dataclass
class Binning:
    """Bin edges of the numeric predictors, level tables of the others."""

    features: list[str]
    edges: dict[str, np.ndarray]
    levels: dict[str, DataFrame]

    @property
    def ordered(self) -> np.ndarray:
        return np.array([f in self.edges for f in self.features])

    def columns(self, df: DataFrame) -> tuple[DataFrame, list[Column]]:
        """The frame with level bins joined, and one DOUBLE column a predictor: the number, or the level's bin.

        A level that no training row has is missing.
        """
        columns = []
        for i, f in enumerate(self.features):
            if f in self.edges:
                columns.append(numeric_column(df, f))
                continue
            table = self.levels[f].select(F.col("_level").alias(f"_level{i}"), F.col("_bin").alias(f"_bin{i}"))
            df = df.join(table, F.col(f"`{f}`").cast("string") == F.col(f"_level{i}"), "left").drop(f"_level{i}")
            columns.append(F.col(f"_bin{i}").cast("double"))
        return df, columns

    def coder(self):
        """A function of arrays (one a predictor, NaN for missing) that returns a codes matrix."""
        edges = [self.edges.get(f) for f in self.features]

        def codes(arrays: Sequence[np.ndarray]) -> np.ndarray:
            out = np.zeros((len(arrays[0]), len(edges)), np.uint8)
            for i, (x, e) in enumerate(zip(arrays, edges, strict=True)):
                known = ~np.isnan(x)
                out[known, i] = x[known] if e is None else np.searchsorted(e, x[known]) + 1
            return out

        return codes


def fit_binning(train: DataFrame, features: Sequence[str], target: Column) -> Binning:
    """Bins from the training rows.  ``target``: what text levels are ordered by, a whole number."""
    numeric = [f for f in features if is_numeric_type(train, f)]
    edges = {f: np.zeros(0) for f in numeric}
    if numeric:
        pairs = [F.struct(F.lit(i).alias("_col"), numeric_column(train, f).alias("_v")) for i, f in enumerate(numeric)]
        long = train.select(F.explode(F.array(*pairs)).alias("_p")).select("_p.*").filter("_v IS NOT NULL")
        values = cut_lineage(long.groupBy("_col", "_v").agg(F.count(F.lit(1)).alias("_n")))
        sizes = {r["_col"]: r["_k"] for r in values.groupBy("_col").agg(F.count(F.lit(1)).alias("_k")).collect()}
        few = [c for c, k in sizes.items() if k <= BINS]
        found: dict[int, list[float]] = {}
        for r in values.filter(F.col("_col").isin(few)).collect() if few else []:  # at most 255 a predictor
            found.setdefault(r["_col"], []).append(r["_v"])
        for c, v in found.items():
            v = np.sort(np.array(v))
            edges[numeric[c]] = v[:-1] + (v[1:] - v[:-1]) / 2
        many = values.filter(F.col("_col").isin([c for c in sizes if c not in few]))
        if len(few) < len(sizes):
            ranked = _running(many, ["_col"], "_v", ["_n"], None)
            share = F.floor(F.col("_before_n") * F.lit(BINS) / F.col("_all_n")).alias("_share")
            for r in ranked.groupBy("_col", share).agg(F.max("_v").alias("_v")).collect():  # at most 255 a predictor
                found.setdefault(r["_col"], []).append(r["_v"])
            for c in set(sizes) - set(few):
                edges[numeric[c]] = np.sort(np.array(found[c]))[:-1]
    levels = {}
    for f in features:
        if f in edges:
            continue
        known = train.select(F.col(f"`{f}`").cast("string").alias("_level"), target.alias("_t")).filter("_level IS NOT NULL")
        means = known.groupBy("_level").agg((F.sum("_t") / F.count(F.lit(1))).alias("_mean"))
        placed = with_position(means, ["_mean", "_level"], "_at")
        total = placed.count()
        place = F.col("_at") if total <= BINS else F.floor(F.col("_at") * F.lit(BINS) / F.lit(total))
        levels[f] = placed.select("_level", (place + 1).cast("int").alias("_bin"))
    return Binning(list(features), edges, levels)


# --- sums of one pass ------------------------------------------------------------------------


@dataclass
class Rows:
    """Training rows of ``width`` codes: records of (codes, target, rows, score), each the bytes of up to ``BLOCK`` rows."""

    blocks: DataFrame
    parts: int
    width: int


_KINDS = (np.uint8, np.int64, np.int64, np.float64)
_PACKED = "codes binary, target binary, rows binary, score binary"


def _binary(column: pa.Array, width: int) -> np.ndarray:
    """A column of equally long byte strings as a matrix."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].reshape(-1, width) if len(column) else np.zeros((0, width), np.uint8)


def _unpacked(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(codes, target, rows, score) of each record."""
    for batch in batches:
        for i in range(batch.num_rows):
            codes, *others = (np.frombuffer(batch.column(j)[i].as_buffer(), kind) for j, kind in enumerate(_KINDS))
            yield codes.reshape(-1, width), *others


def _record(parts: Sequence[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p.astype(kind, copy=False).tobytes()], pa.binary()) for p, kind in zip(parts, _KINDS, strict=True)], ["codes", "target", "rows", "score"])


def _pack(width: int):
    """Rows (codes, target, rows) to records, with the score 0."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for batch in batches:
            held.append((_binary(batch.column(0), width), *(batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))))
            many += batch.num_rows
            if many >= BLOCK:
                codes, target, rows = (np.concatenate(x) for x in zip(*held, strict=True))
                for a in range(0, many - many % BLOCK, BLOCK):
                    yield _record([codes[a : a + BLOCK], target[a : a + BLOCK], rows[a : a + BLOCK], np.zeros(BLOCK)])
                a = many - many % BLOCK
                held, many = [(codes[a:], target[a:], rows[a:])], many % BLOCK
        if many:
            codes, target, rows = (np.concatenate(x) for x in zip(*held, strict=True))
            yield _record([codes, target, rows, np.zeros(many)])

    return pack


def _sums(rows: Rows, nodes: Sequence[int], kinds: int, place) -> tuple[np.ndarray, np.ndarray]:
    """Counts and totals, each [node, predictor, bin, kind], of the rows that ``place`` puts into ``nodes``.

    ``place(codes, target, rows, score)`` returns (node, kind, amount) of each row; a node that is not asked for is left out.
    """
    width, names = rows.width, np.array(nodes, dtype=np.int64)
    shape = (len(names), width, BINS + 1, kinds)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, g = np.zeros(math.prod(shape), np.int64), np.zeros(math.prod(shape), np.int64)
        for codes, target, many, score in _unpacked(batches, width):
            node, kind, amount = place(codes, target, many, score)
            slot = np.minimum(np.searchsorted(names, node), len(names) - 1)
            own = np.flatnonzero(names[slot] == node)
            slot, kind, many, amount, codes = slot[own], kind[own], many[own], amount[own], codes[own]
            for f in range(width):
                cell = ((slot * width + f) * (BINS + 1) + codes[:, f]) * kinds + kind
                np.add.at(n, cell, many)
                np.add.at(g, cell, amount)
        cells = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(n[cells]), pa.array(g[cells])], ["cell", "n", "g"])

    found = rows.blocks.mapInArrow(add, "cell long, n long, g long")
    if rows.parts * math.prod(shape) > GATHERED:
        found = found.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("g").alias("g"))
    found = found.toArrow()
    n, g = np.zeros(math.prod(shape), np.int64), np.zeros(math.prod(shape), np.int64)
    cells = found.column("cell").to_numpy()
    np.add.at(n, cells, found.column("n").to_numpy())
    np.add.at(g, cells, found.column("g").to_numpy())
    return n.reshape(shape), g.reshape(shape)


def _in_passes(rows: Rows, nodes: Sequence[int], kinds: int, place) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(node, counts, totals) of each node, as many nodes in a pass as ``CELLS`` allows."""
    cells = rows.width * (BINS + 1) * kinds
    if cells > CELLS:
        raise ValueError(f"{rows.width} predictors and {kinds} classes are too many for a tree")
    step = max(1, CELLS // cells)
    for a in range(0, len(nodes), step):
        some = sorted(nodes)[a : a + step]
        n, g = _sums(rows, some, kinds, place)
        yield from zip(some, n, g, strict=True)


# --- the best split of a node ----------------------------------------------------------------


def _best(n: np.ndarray, g: np.ndarray, ordered: np.ndarray, classes: bool, min_leaf: int, missing_side: bool) -> tuple[float, int, np.ndarray] | None:
    """(gain, predictor, bins that go left) with the largest fall of the squared error, or of the Gini impurity.

    Bins of a text predictor are put in order of their mean target (share of the node's commonest class) first: the best
    of all subsets then is a run.  With ``missing_side`` missing rows go with either side, whichever is better, or
    are one by themselves; without it they take no part.  Ties: the first predictor, the lower cut.
    """
    moments = (n if classes else g).astype(np.float64)  # [predictor, bin, class or 1]
    count = n.sum(axis=2).astype(np.float64)
    common = int(np.argmax(moments.sum(axis=(0, 1)))) if classes else 0
    best = None
    for f in range(len(n)):
        bins = np.flatnonzero(count[f, 1:]) + 1
        if not len(bins):
            continue
        if not ordered[f]:
            bins = bins[np.lexsort((bins, moments[f, bins, common] / count[f, bins]))]
        left_n, left_m = np.cumsum(count[f, bins]), np.cumsum(moments[f, bins], axis=0)
        sides = [(left_n, left_m, False)]
        if missing_side and count[f, 0]:
            sides.append((left_n + count[f, 0], left_m + moments[f, 0], True))
        all_n, all_m = left_n[-1], left_m[-1]
        if missing_side:
            all_n, all_m = all_n + count[f, 0], all_m + moments[f, 0]
        for ln, lm, with_missing in sides:
            rn, rm = all_n - ln, all_m - lm
            fits = (ln >= min_leaf) & (rn >= min_leaf) & (rn > 0)
            if not fits.any():
                continue
            gain = np.full(len(ln), -np.inf)
            gain[fits] = ((lm[fits] ** 2).sum(1) / ln[fits] + (rm[fits] ** 2).sum(1) / rn[fits]) - (all_m**2).sum() / all_n
            at = int(np.argmax(gain))
            if best is None or gain[at] > best[0]:
                left = np.zeros(BINS + 1, bool)
                left[bins[: at + 1]] = True
                if ordered[f]:  # bins that no row here has go where their neighbours go
                    left[1 : bins[at] + 1] = True
                left[0] = with_missing
                best = float(gain[at]), f, left
    return best


def _surrogates(n: np.ndarray, primary: int, ordered: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Splits of other predictors that send rows the way of the primary one more often than its commoner side does.

    ``n``: counts [predictor, bin, side] of the rows that have the primary predictor; side 1 is left.
    """
    found = []
    for f in range(len(n)):
        right, left = n[f, 1:, 0].astype(np.int64), n[f, 1:, 1].astype(np.int64)
        if f == primary or not (right + left).any():
            continue
        if ordered[f]:
            low, high = np.cumsum(left) + right.sum() - np.cumsum(right), np.cumsum(right) + left.sum() - np.cumsum(left)
            up, at = (False, int(np.argmax(low))) if low.max() >= high.max() else (True, int(np.argmax(high)))
            agree = int(max(low.max(), high.max()))
            mask = np.concatenate([[False], (np.arange(BINS) <= at) != up])
        else:
            mask = np.concatenate([[False], left > right])
            agree = int(np.maximum(left, right).sum())
        if agree > max(int(left.sum()), int(right.sum())):
            found.append((-agree, f, mask))
    return [(f, mask) for _, f, mask in sorted(found, key=lambda s: s[:2])[:SURROGATES]]


# --- C9: one tree ----------------------------------------------------------------------------


def _risk(total_n: np.ndarray, total_g: np.ndarray, squares: float, classes: bool) -> float:
    """Rows of other classes than the commonest one; or the fall of the squared error that is still to be had, at most."""
    if classes:
        return float(total_n.sum() - total_n.max())
    return squares - float(total_g.sum()) ** 2 / max(1.0, float(total_n.sum()))


def grow(
    rows: Rows, ordered: np.ndarray, kinds: int, scale: float, squares: float, max_depth: int, min_split: int, min_leaf: int, complexity: float
) -> tuple[Tree, dict[int, np.ndarray]]:
    """One tree with surrogate splits, pruned by complexity, and the class counts of its nodes.

    ``rows``: as from ``training_rows``.  ``kinds``: number of classes, or 0 for a numeric target, which is target / scale
    and whose squares add up to ``squares``.  A subtree stays only if each of its splits lowers the risk (squared error, or rows of the wrong
    class) on average by more than ``complexity`` times the root's.
    """
    classes = kinds > 0
    tree = Tree({}, {})
    counts, totals, gains = {}, {}, {}
    open_ = [0]
    for depth in range(max_depth + 1):
        if not open_:
            break
        splits = dict(tree.splits)

        def place(codes, target, many, score, splits=splits):
            node = Tree(splits, {}).route(codes)
            return node, target if classes else np.zeros(len(node), np.int64), np.zeros(len(node), np.int64) if classes else target

        chosen = {}
        for node, n, g in _in_passes(rows, open_, max(1, kinds), place):
            counts[node], totals[node] = n[0].sum(axis=0), g[0].sum(axis=0)
            if depth == max_depth or counts[node].sum() < min_split or (classes and (counts[node] > 0).sum() < 2):
                continue
            best = _best(n, g, ordered, classes, min_leaf, missing_side=False)
            if best is not None and best[0] > 1e-12 * max(squares, float(counts[node].sum() if classes else 0)):
                gains[node], chosen[node] = best[0], Split(best[1], best[2])
        if not chosen:
            break

        def sides(codes, target, many, score, splits=splits, chosen=chosen):
            node = Tree(splits, {}).route(codes)
            kind, used = np.zeros(len(node), np.int64), np.zeros(len(node), bool)
            for name, split in chosen.items():
                mine = (node == name) & (codes[:, split.feature] > 0)
                kind[mine] = split.left[codes[mine, split.feature]]
                used |= mine
            return np.where(used, node, -1), kind, np.zeros(len(node), np.int64)

        for node, n, _ in _in_passes(rows, list(chosen), 2, sides):
            split = chosen[node]
            going = n[split.feature].sum(axis=0)
            split.left[0] = going[1] >= going[0]
            split.surrogates = _surrogates(n, split.feature, ordered)
        tree.splits.update(chosen)
        open_ = [child for node in chosen for child in (2 * node + 1, 2 * node + 2)]
    _prune(tree, counts, totals, squares, classes, complexity)
    for node in _leaves(tree):
        tree.leaves[node] = float(np.argmax(counts[node])) if classes else float(totals[node].sum()) / max(1.0, float(counts[node].sum())) / scale
    return tree, counts


def _leaves(tree: Tree) -> list[int]:
    return [0] if not tree.splits else sorted(c for n in tree.splits for c in (2 * n + 1, 2 * n + 2) if c not in tree.splits)


def _prune(tree: Tree, counts: dict, totals: dict, squares: float, classes: bool, complexity: float) -> None:
    """Weakest links first: a subtree goes if a split of it saves no more than ``complexity`` of the root's risk."""

    def risk(node: int) -> float:
        if classes:
            return float(counts[node].sum() - counts[node].max())
        return -(float(totals[node].sum()) ** 2) / max(1.0, float(counts[node].sum()))  # up to a constant: the sum of squares

    least = complexity * _risk(counts[0], totals[0], squares, classes)
    while complexity > 0 and tree.splits:
        below = {}
        for node in sorted(tree.splits, reverse=True):  # (risk of the leaves, their number) under each split
            parts = [below.get(c, (risk(c), 1)) for c in (2 * node + 1, 2 * node + 2)]
            below[node] = parts[0][0] + parts[1][0], parts[0][1] + parts[1][1]
        worth = {node: (risk(node) - r) / (k - 1) for node, (r, k) in below.items()}
        weakest = min(worth, key=lambda node: (worth[node], node))
        if worth[weakest] > least:
            return
        gone = [weakest]
        while gone:
            node = gone.pop()
            if tree.splits.pop(node, None) is not None:
                gone += [2 * node + 1, 2 * node + 2]


# --- C8: boosting ----------------------------------------------------------------------------


def boost(rows: Rows, ordered: np.ndarray, rounds: int, rate: float, max_depth: int, min_leaf: int, digits: int) -> list[Tree]:
    """Trees whose values add up to the target, in squared error; missing values go to the better side of a split.

    ``rows``: as from ``training_rows``, targets as whole multiples of 2^-digits from the middle.  The first tree counts in
    full, each other one by ``rate``.  Ends early when a tree gains a millionth of the first one's.
    """
    trees: list[Tree] = []
    recent: list[Tree] = []
    unit = float(2.0**digits)
    first = None
    for step in range(rounds):
        tree, open_, gained = Tree({}, {}), [0], 0.0
        for _ in range(max_depth):
            if not open_:
                break

            def place(codes, target, many, score, splits=dict(tree.splits), recent=tuple(recent)):
                for t in recent:
                    score = score + t.values(codes)
                rest = target - many * np.rint(score * unit).astype(np.int64)
                return Tree(splits, {}).route(codes), np.zeros(len(codes), np.int64), rest

            following = []
            for node, n, g in _in_passes(rows, open_, 1, place):
                factor = (1.0 if step == 0 else rate) / unit
                tree.leaves.setdefault(node, float(g[0].sum()) / max(1, int(n[0].sum())) * factor)
                best = _best(n, g, ordered, False, min_leaf, missing_side=True)
                if best is None or best[0] <= 0.5 * float(n[0].sum()):  # not beyond the rounding of the residuals
                    continue
                gain, f, left = best
                del tree.leaves[node]
                tree.splits[node] = Split(f, left)
                gained += gain
                for child, side in ((2 * node + 1, left), (2 * node + 2, ~left)):
                    tree.leaves[child] = float(g[f][side].sum()) / int(n[f][side].sum()) * factor
                    following.append(child)
            open_ = following
        trees.append(tree)
        recent.append(tree)
        first = gained if first is None else first
        if not tree.splits or gained <= 1e-6 * first:
            break
        if len(recent) == ROUNDS_KEPT and step + 1 < rounds:
            rows, recent = _rescored(rows, tuple(recent)), []
    return trees


def _rescored(rows: Rows, trees: Sequence[Tree]) -> Rows:
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for codes, target, many, score in _unpacked(batches, width):
            for t in trees:
                score = score + t.values(codes)
            yield _record([codes, target, many, score])

    width = rows.width
    return Rows(cut_lineage(rows.blocks.mapInArrow(add, _PACKED)), rows.parts, width)


# --- frames in, frames out -------------------------------------------------------------------


def training_rows(train: DataFrame, binning: Binning, target: Column, classes: bool = False) -> Rows:
    """Training rows of equal codes as one, with the sum of their targets, their number and the score 0, written once.

    With ``classes`` the target is a class number, and rows of equal codes and class are one.
    """
    framed, columns = binning.columns(train)
    code, width = binning.coder(), len(binning.features)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix = code([x.cast(pa.float64()).to_numpy(zero_copy_only=False) for x in batch.columns[:width]])
            ends = np.arange(len(matrix) + 1, dtype=np.int32) * np.int32(width)
            codes = pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(matrix))])
            yield pa.RecordBatch.from_arrays([codes, batch.column(width)], ["codes", "target"])

    numbers = framed.select(*[c.cast("double").alias(f"_x{i}") for i, c in enumerate(columns)], target.cast("long").alias("target"))
    each = numbers.mapInArrow(coded, "codes binary, target long")
    many = F.count(F.lit(1)).alias("rows")
    alike = each.groupBy("codes", "target").agg(many) if classes else each.groupBy("codes").agg(F.sum("target").alias("target"), many)
    alike = cut_lineage(alike)
    count, (least, most) = alike.count(), PART_ROWS
    parts = max(1, min(train.sparkSession.sparkContext.defaultParallelism, -(-count // least)), -(-count // most))
    return Rows(cut_lineage(alike.repartition(parts).mapInArrow(_pack(width), _PACKED)), parts, width)


def with_prediction(df: DataFrame, binning: Binning, trees: Sequence[Tree], base: float, name: str, asked: Column) -> DataFrame:
    """``df`` with ``base`` and the values of the trees added up as a DOUBLE column ``name``, NULL or NaN where not ``asked``."""
    framed, columns = binning.columns(df)
    code, trees = binning.coder(), list(trees)

    @F.pandas_udf("double")
    def predicted(wanted: pd.Series, *xs: pd.Series) -> pd.Series:
        own = np.flatnonzero(wanted.to_numpy(bool))
        codes = code([x.to_numpy(np.float64, na_value=np.nan)[own] for x in xs])
        sums = np.zeros(len(codes))
        for t in trees:
            sums = sums + t.values(codes)
        out = np.full(len(wanted), np.nan)
        out[own] = base + sums
        return pd.Series(out)

    return framed.withColumn(name, predicted(F.coalesce(asked, F.lit(False)), *columns)).select(*df.columns, name)
