"""Second-order boosted trees: histograms summed by Spark, and a search over many settings at once.

A tree grows from sums of gradients, Hessians and rows per node, feature and bin. Fitting one model on
all rows, the tasks add up their own rows and Spark adds up the tasks, one job a level; only the smaller
of two siblings is counted, the other is what its parent has besides. What reaches the driver is bounded
by nodes x features x bins. The tasks hold their rows as persisted blocks, column by column; the margins in
them are renewed every few trees, so each job applies few trees. What a lost executor held is made again
from the stored rows. Tables of few rows (`in_task`) are cheaper to fit in one task,
where a job a level would take longer than its work; the functions, and the trees, are the same.

A search fits each setting on all rows but those of the fold left out, and scores it on all rows of that fold.
A model of 200 trees has that of 100 in it, so one fit serves both. Up to `SEARCH_IN_TASK` rows each fit is a task
of its own that reads the stored rows; beyond, many fits grow together from the persisted blocks, a job a level.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce
from itertools import product
from math import prod
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepline.session import as_table

# The search grid.
GRID = {"trees": (100, 200), "depth": (3, 5), "rate": (0.05, 0.1), "rows": (0.8, 1.0), "columns": (0.8, 1.0)}
BINS = 64
SETTLED = 10  # trees after which the blocks are made anew with their margins
BLOCK = 1 << 17  # rows of a block
FEW_PARTS = 64  # partitions whose sums meet on the driver at once
PARTS_A_CORE = 2  # partitions of the blocks, at most: each level is a job over all of them
IN_TASK = 250_000  # rows up to which one task fits a model
SEARCH_IN_TASK = 2_000_000  # rows up to which a task fits one of the many models of a search, at about 100 bytes a row
AT_ONCE = 40  # models of a search that grow together; each has a margin of 8 bytes a row in the blocks
SEARCH_SETTLED = 2  # as SETTLED, where many models share the blocks
TOGETHER = 8  # features of two bins that are counted at once; their joint code is a byte
CELLS = 1 << 12  # joint values of features of any bins that are counted at once; a code is two bytes
NEAR = 1e-9  # share by which equal gains may differ where sums are taken jointly


@dataclass(frozen=True)
class TreeParams:
    """rows and columns: the shares drawn for each tree. l2: on leaf values. least: Hessian of a child."""

    trees: int = 100
    depth: int = 3
    rate: float = 0.1
    rows: float = 1.0
    columns: float = 1.0
    l2: float = 1.0
    least: float = 1.0
    seed: int = 42


class Tree(NamedTuple):
    """Nodes in the order they were made; feature is -1 at leaves, the right child follows the left."""

    feature: np.ndarray
    split: np.ndarray  # the last bin that goes left
    left: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    g: np.ndarray
    h: np.ndarray
    n: np.ndarray


def _task_functions():
    """Made here so that they travel to executors by value; they need not have this package."""

    def node_of(tree, bins: np.ndarray, depth: int) -> np.ndarray:
        """The node each row of bins ends in after `depth` steps at most; quickest where bins lie column by column."""
        feature, split, left = tree[:3]
        if len(feature) > 256:
            at, rows = np.zeros(len(bins), dtype=np.int64), np.arange(len(bins))
            for _ in range(depth):
                f = feature[at]
                at = np.where(f < 0, at, left[at] + (bins[rows, np.maximum(f, 0)] > split[at]))
            return at
        at, todo = np.zeros(len(bins), dtype=np.uint8), [(0, np.ones(len(bins), dtype=bool), 0)]
        while todo:
            node, mine, steps = todo.pop()
            if feature[node] < 0 or steps == depth:
                at += mine.view(np.uint8) * np.uint8(node)
                continue
            right = bins[:, feature[node]] > bins.dtype.type(split[node])
            todo += [(left[node], mine > right, steps + 1), (left[node] + 1, mine & right, steps + 1)]
        return at

    def margins(trees: list, bins: np.ndarray, depth: int, start) -> np.ndarray:
        out, bins = np.zeros(len(bins)) + start, np.asfortranarray(bins)
        for tree in trees:
            out += tree[3][node_of(tree, bins, depth)]
        return out

    def slopes(margin: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        g, h = np.empty(len(margin)), np.empty(len(margin))
        for i in range(0, len(margin), 1 << 14):  # few at once stay in the cache
            some = slice(i, i + (1 << 14))
            p = 1.0 / (1.0 + np.exp(-margin[some]))
            g[some] = weight[some] * (p - label[some])
            h[some] = weight[some] * p * (1.0 - p)
        return g, h

    def drawn(row: np.ndarray, tree: int, share: float, seed: int) -> np.ndarray:
        """Which rows a tree learns from: a hash of row and tree decides."""
        x = row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(tree * 1_000_003 + seed)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (x >> np.uint64(11)).astype(float) < share * 2.0**53

    def coded(bins: np.ndarray, joint: list, sizes: list[int]) -> np.ndarray:
        """[groups, rows]: what the features of each group are jointly, as one number."""
        codes = np.zeros((len(joint), len(bins)), dtype=np.uint16)
        for code, group in zip(codes, joint):
            for f in group:
                code *= np.uint16(sizes[f])
                code += bins[:, f]
        return codes

    def spread(cells: np.ndarray, group: list[int], sizes: list[int], sums: np.ndarray) -> None:
        """Sums by joint value [nodes, 3, values] to sums by the bin of each feature, as in `histograms`."""
        if len(group) == 1:
            sums[:, group[0], : cells.shape[2]] = cells.swapaxes(1, 2)
            return
        half = len(group) // 2
        both = cells.reshape(*cells.shape[:2], prod(sizes[f] for f in group[:half]), -1)
        spread(both.sum(axis=3), group[:half], sizes, sums)
        spread(both.sum(axis=2), group[half:], sizes, sums)

    def histograms(
        bins: np.ndarray, at: np.ndarray, g: np.ndarray, h: np.ndarray, wanted: list[int], n_bins: int, keep=None, joint=(),
        sizes=None, codes=None,
    ) -> np.ndarray:
        """[wanted nodes, features, bins, 3]: sums of g, h and rows, those of `keep` alone if given. The features of a
        group of `joint` are counted together, by what they are jointly: `codes`, worked out here if not given.
        `sizes` are the bins of each feature, two if not given."""
        sums = np.zeros((len(wanted), bins.shape[1], n_bins, 3))
        if joint:
            sizes = [2] * bins.shape[1] if sizes is None else sizes
            codes = coded(bins, joint, sizes) if codes is None else codes
            cells = [np.zeros((len(wanted), 3, prod(sizes[f] for f in group))) for group in joint]
            for i, node in enumerate(wanted):
                some = np.flatnonzero(at == node if keep is None else (at == node) & keep)
                whole = len(some) == len(at)
                own = (g, h, None) if whole else (g[some], h[some], None)
                for code, found in zip(codes, cells):
                    code = (code if whole else code[some]).astype(np.intp)
                    for x, sum_ in zip(own, found[i]):
                        sum_[:] = np.bincount(code, x, len(sum_))
            for group, found in zip(joint, cells):
                spread(found, group, sizes, sums)
        alone = sorted(set(range(bins.shape[1])).difference(*joint))
        if not alone:
            return sums
        place = np.full(max(at.max(initial=0), *wanted) + 1, -1)
        place[wanted] = np.arange(len(wanted))
        spot = place[at] if keep is None else np.where(keep, place[at], -1)
        some = np.flatnonzero(spot >= 0)
        whole = len(some) == len(spot)
        base, g, h = (x if whole else x[some] for x in (spot * n_bins, g, h))
        for f in alone:
            code = base + (bins[:, f] if whole else bins[:, f][some])
            for i, x in enumerate((g, h, None)):
                sums[:, f, :, i] = np.bincount(code, x, len(wanted) * n_bins).reshape(len(wanted), n_bins)
        return sums

    def best_split(sums: np.ndarray, columns: np.ndarray, l2: float, least: float, near: float = 0.0):
        """(gain, feature, bin, left sums) of the split that gains most, the first of equal ones; None: none.
        Gains apart by the share `near` at most are equal: sums taken in another order differ that much."""
        left = np.cumsum(sums, axis=1)[:, :-1]
        whole = sums[0].sum(axis=0)
        right = whole - left
        score = lambda s: s[..., 0] ** 2 / (s[..., 1] + l2)
        gain = score(left) + score(right) - score(whole)
        closed = (left[..., 1] < least) | (right[..., 1] < least) | (left[..., 2] < 1) | (right[..., 2] < 1)
        gain = np.where(closed, -np.inf, gain)
        gain[~columns] = -np.inf
        most = gain.max(initial=-np.inf)
        f, b = np.unravel_index(int(np.argmax(gain >= most - near * abs(most))), gain.shape) if most > 0 else (0, 0)
        if not most > 1e-6:
            return None
        return float(gain[f, b]), int(f), int(b), left[f, b]

    def growing(columns: np.ndarray, p, near: float = 0.0):
        """One tree, level by level; asks for the histograms of some nodes by (nodes, tree so far)."""
        names = ("feature", "split", "left", "value", "gain", "g", "h", "n")
        nodes = {c: [] for c in names}

        def add(total: np.ndarray) -> int:
            g, h, n = (float(v) for v in total)
            made = {"feature": -1, "split": 0, "left": -1, "value": -p.rate * g / (h + p.l2), "gain": 0.0, "g": g, "h": h, "n": n}
            for c in names:
                nodes[c].append(made[c])
            return len(nodes["g"]) - 1

        def so_far() -> tuple:
            kinds = (np.int64, np.int64, np.int64, float, float, float, float, float)
            return tuple(np.array(nodes[c], dtype=k) for c, k in zip(names, kinds))

        root = (yield [0], (np.array([-1]), np.array([0]), np.array([-1])))[0]
        add(root[0].sum(axis=0))
        open_ = {0: root}
        for level in range(p.depth):
            split = {}
            for node, sums in open_.items():
                found = best_split(sums, columns, p.l2, p.least, near)
                if found:
                    gain, f, b, left = found
                    nodes["feature"][node], nodes["split"][node], nodes["gain"][node] = f, b, gain
                    nodes["left"][node] = add(left)
                    add(sums[0].sum(axis=0) - left)
                    split[node] = sums
            open_ = {}
            if not split or level + 1 == p.depth:
                break
            lefts = {node: nodes["left"][node] for node in split}
            less = {node: c + (nodes["n"][c + 1] < nodes["n"][c]) for node, c in lefts.items()}
            counted = yield list(less.values()), so_far()
            for (node, sums), own in zip(split.items(), counted):
                other = 2 * lefts[node] + 1 - less[node]
                open_[less[node]], open_[other] = own, sums - own
        return so_far()

    def grow(sums_of, columns: np.ndarray, p, near: float = 0.0) -> tuple:
        """One tree; sums_of(nodes, tree so far) gives the histograms of some nodes."""
        steps = growing(columns, p, near)
        asked = next(steps)
        while True:
            try:
                asked = steps.send(sums_of(*asked))
            except StopIteration as done:
                return done.value

    def columns_of(tree: int, n_features: int, share: float, seed: int) -> np.ndarray:
        chosen = np.random.default_rng([seed, tree]).permutation(n_features)[: max(1, int(share * n_features))]
        return np.isin(np.arange(n_features), chosen)

    def fit_here(pieces: list, p, n_bins, joint=(), sizes=None, near: float = 0.0) -> list:
        """The trees of rows held in one task, as (bins, row, label, weight) of some rows each."""
        pieces = [(np.asfortranarray(bins), *rest) for bins, *rest in pieces]
        codes = [coded(bins, joint, sizes) if joint else None for bins, *_ in pieces]
        margin, trees, n_features = [np.zeros(len(bins)) for bins, *_ in pieces], [], pieces[0][0].shape[1]
        for t in range(p.trees):
            slope = [slopes(m, label, weight) for m, (_, _, label, weight) in zip(margin, pieces)]
            keep = [drawn(row, t, p.rows, p.seed) if p.rows < 1 else None for _, row, *_ in pieces]

            def sums_of(wanted, tree, keep=keep, slope=slope):
                return reduce(
                    lambda a, b: a + b,
                    (
                        histograms(bins, node_of(tree, bins, p.depth), g, h, wanted, n_bins, kept, joint, sizes, code)
                        for (bins, *_), (g, h), kept, code in zip(pieces, slope, keep, codes)
                    ),
                )

            tree = grow(sums_of, columns_of(t, n_features, p.columns, p.seed), p, near)
            trees.append(tree)
            for m, (bins, *_) in zip(margin, pieces):
                m += tree[3][node_of(tree, bins, p.depth)]
        return trees

    def matrix(column, n_features: int) -> np.ndarray:
        parts = []
        for chunk in getattr(column, "chunks", [column]):
            ends = np.frombuffer(chunk.buffers()[1], dtype=np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
            if len(chunk):
                parts.append(np.frombuffer(chunk.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]])
        data = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint8)
        return np.asfortranarray(data.reshape(-1, n_features))

    return node_of, margins, slopes, drawn, coded, histograms, best_split, growing, grow, columns_of, fit_here, matrix


node_of, margins, slopes, drawn, coded, histograms, best_split, growing, grow, columns_of, fit_here, matrix = _task_functions()


@dataclass
class BoostedTrees:
    """A fitted model: feature names, upper edges of their bins, and trees. Margins start at 0."""

    features: list[str]
    edges: list[np.ndarray]
    trees: list[Tree]

    @property
    def depth(self) -> int:
        deepest = 0
        for t in self.trees:
            depth = np.zeros(len(t.feature), dtype=int)
            for i in np.flatnonzero(t.feature >= 0):
                depth[t.left[i] : t.left[i] + 2] = depth[i] + 1
            deepest = max(deepest, int(depth.max()))
        return deepest

    def nodes(self, spark: SparkSession) -> DataFrame:
        """One row per node: split, gain, value, and the sums of gradients, Hessians (cover) and rows."""
        parts = []
        for i, t in enumerate(self.trees):
            inner = t.feature >= 0
            edge = [float(self.edges[f][b]) if f >= 0 else None for f, b in zip(t.feature, t.split)]
            parts.append(
                pd.DataFrame(
                    {
                        "treeID": np.int32(i), "weight": 0.5, "id": np.arange(len(inner), dtype=np.int32),
                        "prediction": t.value, "cover": t.h, "left": t.left.astype(np.int32),
                        "right": np.where(inner, t.left + 1, -1).astype(np.int32), "feature": t.feature.astype(np.int32),
                        "threshold": pd.Series(edge, dtype=float), "n_categories": np.int32(-1),
                        "gain": t.gain, "gradient": t.g, "n": np.round(t.n).astype(np.int64),
                    }
                )
            )
        kinds = (
            "treeID int, weight double, id int, prediction double, cover double, left int, right int, feature int, "
            "threshold double, n_categories int, gain double, gradient double, n long"
        )
        table = pd.concat(parts) if parts else pd.DataFrame(columns=[c.split()[0] for c in kinds.split(", ")])
        return spark.createDataFrame(pa.Table.from_pandas(table, preserve_index=False), kinds)

    def score(self, df: DataFrame, out: str = "churn_prob") -> DataFrame:
        """df with P(positive); only the features cross to Python. A null feature is an error."""
        shared = df.sparkSession.sparkContext.broadcast((self.edges, [tuple(t) for t in self.trees], self.depth))
        of, binned_ = margins, binned

        @F.pandas_udf("double")
        def probability(*columns: pd.Series) -> pd.Series:
            edges, trees, depth = shared.value
            x = np.column_stack([c.to_numpy(dtype=float) for c in columns])
            return pd.Series(1.0 / (1.0 + np.exp(-of(trees, binned_(x, edges), depth, 0.0))))

        return df.withColumn(out, probability(*[F.col(f"`{f}`").cast("double") for f in self.features]))


def _binning():
    def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        """Bins of values: the number of edges below them."""
        if np.isnan(x).any():
            raise ValueError("a feature is null")
        return np.column_stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(edges)]).astype(np.uint8)

    return binned


binned = _binning()


def _two_valued(df: DataFrame, features: list[str]) -> dict[str, tuple[float, int, int]]:
    """Features of exactly two values: (smaller value, rows that have it, all rows). A null is an error."""
    values = {f: F.col(f"`{f}`").cast("double") for f in features}
    ends = df.agg(
        *[a(x).alias(f"{k}{i}") for i, x in enumerate(values.values()) for k, a in (("lo", F.min), ("hi", F.max))],
        F.count_if(reduce(lambda a, b: a | b, [F.col(f"`{f}`").isNull() for f in features])).alias("nulls"),
    ).first()
    if ends["nulls"]:
        raise ValueError(f"{ends['nulls']} rows have a null feature")
    wide = {f: (ends[f"lo{i}"], ends[f"hi{i}"]) for i, f in enumerate(features) if ends[f"lo{i}"] != ends[f"hi{i}"]}
    if not wide:
        return {}
    tests = [F.count_if(values[f] == F.lit(v)).alias(f"{k}{i}") for i, (f, e) in enumerate(wide.items()) for k, v in zip(("lo", "hi"), e)]
    n = df.agg(F.count(F.lit(1)).alias("n"), *tests).first()
    return {f: (e[0], n[f"lo{i}"], n["n"]) for i, (f, e) in enumerate(wide.items()) if n[f"lo{i}"] + n[f"hi{i}"] == n["n"]}


def bin_edges(df: DataFrame, features: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Edges between `bins` about equal groups of each feature's values, from three aggregations. A feature with
    so few values has an edge after each but the last. Features of two values are counted, without a sketch."""
    if not 2 <= bins <= 256:
        raise ValueError("between 2 and 256 bins")
    two = _two_valued(df, features)
    rest = [f for f in features if f not in two]
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins + 1)])
    sketches = [F.percentile_approx(F.col(f"`{f}`").cast("double"), shares, F.lit(10_000)).alias(f"q{i}") for i, f in enumerate(rest)]
    found = dict(zip(rest, df.agg(*sketches).first() if rest else ()))
    for f, (low, n_low, n) in two.items():
        found[f] = [low, np.inf] if n_low >= np.ceil(n / bins) else [np.inf]
    return [np.unique(np.array(found[f] or [], dtype=float))[:-1] for f in features]


def binned_rows(df: DataFrame, features: list[str], label: str, weight: str, edges: list[np.ndarray], *keep: str) -> DataFrame:
    """(row, label, weight, margin, bins, *keep), stored: one byte a feature. Features of two bins cross to Python
    as bits of whole numbers; one that is null or no number makes them null, which is an error."""
    of, n_features = binned, len(features)
    values = [F.col(f"`{f}`").cast("double") for f in features]
    two = _two_bins(edges)
    groups = [two[i : i + 60] for i in range(0, len(two), 60)]
    rest = [i for i in range(n_features) if i not in two]

    def bits(group: list[int]) -> Column:
        above = [F.when(~F.isnan(values[i]), values[i] > F.lit(float(edges[i][0]))).cast("long") for i in group]
        return reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(x, at) for at, x in enumerate(above)])

    wanted = df.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(label).cast("double").alias("label"),
        F.col(weight).cast("double").alias("weight"),
        F.lit(0.0).alias("margin"),
        *[F.col(k).cast("long") for k in keep],
        *[bits(g).alias(f"b{i}") for i, g in enumerate(groups)],
        *[values[i].alias(f"x{i}") for i in rest],
    )
    n_kept, n_bits, wide = 4 + len(keep), len(groups), [edges[i] for i in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.empty((len(batch), n_features), dtype=np.uint8)
            for group, column in zip(groups, batch.columns[n_kept : n_kept + n_bits]):
                if column.null_count:
                    raise ValueError("a feature is null")
                packed = column.to_numpy()
                for at, f in enumerate(group):
                    x[:, f] = packed >> at & 1
            if rest and len(x):
                x[:, rest] = of(np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[n_kept + n_bits :]]).astype(float), wide)
            rows = pa.FixedSizeBinaryArray.from_buffers(pa.binary(n_features), len(x), [None, pa.py_buffer(x.tobytes())]).cast(pa.binary())
            names = [*batch.schema.names[:n_kept], "bins"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_kept], rows], names)

    kept = "".join(f", {k} long" for k in keep)
    return as_table(wanted.mapInArrow(run, f"row long, label double, weight double, margin double{kept}, bins binary"), "binned")


def _blocks(rows: DataFrame, n_features: int, two: list[int], drawn_rows: bool, fold: str | None = None) -> RDD:
    """The rows as persisted (row, label, weight, margin, wide, bits, fold) blocks, bytes each and as few as will do:
    row numbers only where rows are drawn, labels of 0 and 1 as a byte, features of two bins (`two`) as bits, the
    others column by column, the fold if one is named."""
    cut, most, names = matrix, BLOCK, ("row", "label", "weight", "margin")
    folds, kinds = [fold] if fold else [], (*names, "wide", "bits", "fold")
    others, n_bytes = [f for f in range(n_features) if f not in two], (len(two) + 7) // 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(held: list) -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            row, label, weight, margin = (np.ascontiguousarray(table.column(c).to_numpy()) for c in names)
            bins, bits = cut(table.column("bins"), n_features), np.zeros((len(row), n_bytes), dtype=np.uint8, order="F")
            for at, f in enumerate(two):
                bits[:, at // 8] |= bins[:, f] * np.uint8(1 << at % 8)
            plain = np.isin(label, (0.0, 1.0)).all()
            values = [row if drawn_rows else row[:0], label.astype(np.uint8) if plain else label, weight, margin]
            values = [*(v.tobytes() for v in values), bins[:, others].tobytes(order="F"), bits.tobytes(order="F")]
            values.append(b"".join(table.column(c).to_numpy().tobytes() for c in folds))
            return pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in values], list(kinds))

        held, n = [], 0
        for batch in batches:
            held, n = [*held, batch], n + batch.num_rows
            if n >= most:
                yield block(held)
                held, n = [], 0
        if n:
            yield block(held)

    made = rows.select(*names, "bins", *folds).mapInArrow(run, ", ".join(f"{c} binary" for c in kinds))
    held = made.rdd.map(lambda r: tuple(bytes(v) for v in r))
    parts = PARTS_A_CORE * held.context.defaultParallelism  # a task takes its blocks one by one, so it may have many
    return (held.coalesce(parts) if held.getNumPartitions() > parts else held).persist(StorageLevel.MEMORY_AND_DISK)


def _opened(n_features: int, two: list[int]) -> Callable:
    others = [f for f in range(n_features) if f not in two]

    def opened(block: tuple) -> tuple:
        """(row, label, weight, margins, bins, fold) of a block; margins are one a row, or one a model and row."""
        row, label, weight, margin, wide, bits, fold = block
        n = len(weight) // 8
        bins = np.empty((n, n_features), dtype=np.uint8, order="F")
        for at, f in enumerate(others):
            bins[:, f] = np.frombuffer(wide, np.uint8, n, at * n)
        for at, f in enumerate(two):
            np.not_equal(np.frombuffer(bits, np.uint8, n, at // 8 * n) & np.uint8(1 << at % 8), 0, out=bins[:, f].view(bool))
        label = np.frombuffer(label, np.uint8 if len(label) == n else float)
        margin = np.frombuffer(margin, float).reshape(-1, n)
        return np.frombuffer(row, np.int64), label, np.frombuffer(weight, float), margin, bins, np.frombuffer(fold, np.int64)

    return opened


def _two_bins(edges: list[np.ndarray]) -> list[int]:
    return [f for f, e in enumerate(edges) if len(e) == 1]


def _joint(features: list[int], sizes: list[int] | None = None, most: int = 1 << TOGETHER) -> list[list[int]]:
    """Features in groups of at most so many joint values, counted at once; `sizes` are their bins, two if not given."""
    groups: list[tuple[list[int], int]] = []
    size = lambda f: sizes[f] if sizes else 2
    for f in sorted(features, key=lambda f: -size(f)):
        at = next((i for i, (_, cells) in enumerate(groups) if cells * size(f) <= most), len(groups))
        held, cells = groups[at] if at < len(groups) else ([], 1)
        groups[at : at + 1] = [([*held, f], cells * size(f))]
    return [held for held, _ in groups]


def _sizes(edges: list[np.ndarray]) -> list[int]:
    return [len(e) + 1 for e in edges]


def _spark_sums(blocks: RDD, recent: list[list], asked: list, t: int, fits: list, sizes: list[int], two: list[int]) -> list:
    """What the fits that grow together ask for, over all rows: one job that counts the wanted nodes of each."""
    of, add_up, slope, draw, count, code, opened = node_of, margins, slopes, drawn, histograms, coded, _opened(len(sizes), two)
    n_bins, joint = max(sizes, default=1), _joint(range(len(sizes)), sizes, CELLS)
    live = (np.arange(n_bins) < np.array(sizes)[:, None]).reshape(-1)  # bins that there are
    todo = [i for i, ask in enumerate(asked) if ask]
    ends = np.cumsum([0, *[len(asked[i][0]) for i in todo]]).tolist()
    plain = [(p.depth, p.rows, p.seed, out) for p, out in fits]
    levels = 1 if blocks.getNumPartitions() <= FEW_PARTS else 2
    shared = blocks.context.broadcast([(i, recent[i], asked[i][0], asked[i][1][:3]) for i in todo])

    def run(held: Iterator[tuple]) -> Iterator[np.ndarray]:
        sums = np.zeros((ends[-1], int(live.sum()), 3))
        for block in held:
            row, label, weight, margin, bins, part = opened(block)
            codes, taken = code(bins, joint, sizes), {}
            for (i, before, wanted, now), first in zip(shared.value, ends):
                depth, share, seed, out = plain[i]
                g, h = slope(add_up(before, bins, depth, margin[min(i, len(margin) - 1)]), label, weight)
                if (share, seed, out) not in taken:
                    keep = draw(row, t, share, seed) if share < 1 else None
                    if out is not None:
                        keep = part != out if keep is None else keep & (part != out)
                    taken[share, seed, out] = keep
                found = count(bins, of(now, bins, depth), g, h, wanted, n_bins, taken[share, seed, out], joint, sizes, codes)
                sums[first : first + len(wanted)] += found.reshape(len(wanted), -1, 3)[:, live]
        yield sums

    added = blocks.mapPartitions(run).treeReduce(lambda a, b: a + b, levels)
    shared.destroy()
    found = np.zeros((len(added), len(live), 3))
    found[:, live] = added
    found = found.reshape(len(added), len(sizes), n_bins, 3)
    own = {i: found[first:last] for i, first, last in zip(todo, ends, ends[1:])}
    return [own.get(i) for i in range(len(fits))]


def _settled(blocks: RDD, recent: list[list], fits: list, n_features: int, two: list[int]) -> RDD:
    """The blocks made anew with the recent trees of each fit in its margins."""
    add_up, opened, depths = margins, _opened(n_features, two), [p.depth for p, _ in fits]
    shared = blocks.context.broadcast(recent)  # stays, for blocks that are lost

    def renewed(block: tuple) -> tuple:
        _, _, _, margin, bins, _ = opened(block)
        own = [add_up(new, bins, d, margin[min(i, len(margin) - 1)]) for i, (new, d) in enumerate(zip(shared.value, depths))]
        return *block[:3], np.concatenate(own).tobytes(), *block[4:]

    made = blocks.map(renewed).persist(StorageLevel.MEMORY_AND_DISK)
    made.count()
    blocks.unpersist()
    return made


def _fit_together(rows: DataFrame, sizes: list[int], fits: list[tuple[TreeParams, int | None]], fold: str | None = None) -> list[list]:
    """The trees of each fit (parameters, fold left out) on all rows: all fits grow at once, a job a level."""
    two = [f for f, n in enumerate(sizes) if n == 2]
    blocks = _blocks(rows, len(sizes), two, any(p.rows < 1 for p, _ in fits), fold)
    trees: list[list] = [[] for _ in fits]
    settled, most = 0, SETTLED if len(fits) == 1 else SEARCH_SETTLED
    for t in range(max(p.trees for p, _ in fits)):
        recent = [[x[:4] for x in made[settled:]] for made in trees]
        if t - settled == most:
            blocks, settled = _settled(blocks, recent, fits, len(sizes), two), t
            recent = [[] for _ in fits]
        steps = [growing(columns_of(t, len(sizes), p.columns, p.seed), p, NEAR) if t < p.trees else None for p, _ in fits]
        asked = [next(s) if s else None for s in steps]
        while any(asked):
            found = _spark_sums(blocks, recent, asked, t, fits, sizes, two)
            for i, step in enumerate(steps):
                if asked[i]:
                    try:
                        asked[i] = step.send(found[i])
                    except StopIteration as done:
                        asked[i] = None
                        trees[i].append(done.value)
    blocks.unpersist()
    return trees


def _task_fit(p: TreeParams, sizes: list[int], joint: list, near: float) -> Callable:
    """For `mapInArrow` over (row, label, weight, bins) in one task: a row with the pickled trees."""
    fit, cut, plain, most, n_features = fit_here, matrix, vars(p), BLOCK if joint else None, len(sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from types import SimpleNamespace

        def piece(held: list) -> tuple:
            table = pa.Table.from_batches(held)
            return np.asfortranarray(cut(table.column("bins"), n_features)), *(table.column(c).to_numpy() for c in ("row", "label", "weight"))

        pieces, held, n = [], [], 0
        for batch in batches:
            held, n = [*held, batch], n + batch.num_rows
            if most and n >= most:
                pieces.append(piece(held))
                held, n = [], 0
        if n:
            pieces.append(piece(held))
        empty = np.zeros((0, n_features), dtype=np.uint8), np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0)
        trees = fit(pieces or [empty], SimpleNamespace(**plain), max(sizes, default=1), joint, sizes, near)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(trees)], pa.binary())], ["trees"])

    return run


def _fit_in_task(rows: DataFrame, sizes: list[int], p: TreeParams, joint: list, near: float) -> list[tuple]:
    task = _task_fit(p, sizes, joint, near)
    return pickle.loads(rows.select("row", "label", "weight", "bins").coalesce(1).mapInArrow(task, "trees binary").first()[0])


def _fit_apart(rows: DataFrame, sizes: list[int], fits: list[tuple[TreeParams, int]], fold: str) -> list[list]:
    """The trees of each fit (parameters, fold left out), each in a task that reads the stored rows; the deepest first."""
    joint = _joint(range(len(sizes)), sizes, CELLS)
    order = sorted(range(len(fits)), key=lambda i: -fits[i][0].depth)
    made = []
    for i in order:
        p, out = fits[i]
        side = rows.where(F.col(fold) != out).select("row", "label", "weight", "bins").coalesce(1)
        made.append(side.mapInArrow(_task_fit(p, sizes, joint, NEAR), "trees binary").select(F.lit(i).alias("id"), "trees"))
    found = rows.sparkSession.sparkContext.union([df.rdd for df in made]).collect()  # SQL's union may join single partitions
    trees = dict(map(tuple, found))
    return [pickle.loads(trees[i]) for i in range(len(fits))]


def fit_on(
    rows: DataFrame, features: list[str], edges: list[np.ndarray], p: TreeParams, in_task: int = IN_TASK, jointly: bool = False
) -> BoostedTrees:
    """A model of all the binned rows, of which there is at least one. `jointly`: features are counted together in a
    task too, where gains equal up to `NEAR` go to the first feature, as they do over all tasks."""
    sizes, n = _sizes(edges), rows.limit(in_task + 1).count()
    if not n:
        raise ValueError("no rows to fit")
    if n <= in_task:
        joint, near = (_joint(range(len(sizes)), sizes, CELLS), NEAR) if jointly else ([], 0.0)
        trees = _fit_in_task(rows, sizes, p, joint, near)
    else:
        trees = _fit_together(rows, sizes, [(p, None)])[0]
    return BoostedTrees(list(features), edges, [Tree(*t) for t in trees])


def fit_trees(
    df: DataFrame, features: list[str], label: str, weight: str = "weight", bins: int = BINS, in_task: int = IN_TASK, **params
) -> BoostedTrees:
    """Second-order boosted trees on all rows of df. Labels are 0 and 1; a null feature is an error."""
    edges = bin_edges(df, features, bins)
    return fit_on(binned_rows(df, features, label, weight, edges), features, edges, TreeParams(**params), in_task)


def _sampled(rows: DataFrame, most: int) -> pa.Table:
    """About `most` rows by a hash of their number, never more than a tenth above; all if there are no more."""
    n = rows.count()
    some = rows if n <= most else rows.where(F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < int((1 << 30) * most / n))
    return some.limit(most + most // 10).toArrow()


def tune_trees(
    df: DataFrame,
    features: list[str],
    label: str,
    fold: str,
    grid: dict[str, tuple] | None = None,
    weight: str = "weight",
    bins: int = BINS,
    sample: int | None = None,
    seed: int = 42,
    in_task: int = SEARCH_IN_TASK,
) -> tuple[BoostedTrees, DataFrame]:
    """Grid search over given folds by mean F1 of the positive class, then a fit of the best on all rows.

    Each setting is fitted on all rows but those of a fold, for each fold, and scored on all rows of the fold left
    out. Settings that differ in the number of trees alone share a fit. The second result is (params, f1,
    is_best), best first; equal scores go to the smaller params text. A caller in a hurry may set `sample`: the
    settings are then fitted on about so many rows, and the best still on all.
    """
    spark = df.sparkSession
    edges = bin_edges(df, features, bins)
    rows = binned_rows(df, features, label, weight, edges, fold)
    n_features, sizes = len(features), _sizes(edges)
    choices = {k: tuple(sorted(v)) for k, v in (grid or GRID).items()}
    stages = choices.pop("trees", (TreeParams.trees,))
    settings = [replace(TreeParams(seed=seed, trees=max(stages)), **dict(zip(choices, v))) for v in product(*choices.values())]
    folds = sorted(r[0] for r in rows.select(fold).distinct().collect())
    fits = [(p, out) for p in settings for out in folds]
    learned = rows if sample is None else spark.createDataFrame(_sampled(rows, sample))
    if learned.limit(in_task + 1).count() <= in_task:
        trees = _fit_apart(learned, sizes, fits, fold)
    else:  # as many at once as the margins in the blocks allow, the deep ones together
        trees = [[] for _ in fits]
        order = sorted(range(len(fits)), key=lambda i: -fits[i][0].depth)
        for some in (order[i : i + AT_ONCE] for i in range(0, len(order), AT_ONCE)):
            for i, made in zip(some, _fit_together(learned, sizes, [fits[i] for i in some], fold)):
                trees[i] = made
    cut, add_up, most, plain = matrix, margins, BLOCK, [vars(s) for s in settings]
    known = spark.sparkContext.broadcast([[t[:4] for t in made] for made in trees])

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: dict[tuple[int, int, int], np.ndarray] = {}

        def blocks() -> Iterator[pa.Table]:  # many rows at once, for the steps of a tree to be worth their calls
            held, n = [], 0
            for batch in batches:
                held, n = [*held, batch], n + batch.num_rows
                if n >= most:
                    yield pa.Table.from_batches(held)
                    held, n = [], 0
            if n:
                yield pa.Table.from_batches(held)

        for block in blocks():
            x, y, part = cut(block.column("bins"), n_features), block.column("label").to_numpy(), block.column(fold).to_numpy()
            for out, name in enumerate(folds):
                own = np.flatnonzero(part == name)
                mine = np.asfortranarray(x[own])
                for s in range(len(plain)) if len(own) else ():
                    margin, done = np.zeros(len(own)), 0
                    for stage in stages:
                        margin = add_up(known.value[s * len(folds) + out][done:stage], mine, plain[s]["depth"], margin)
                        done, yes, true = stage, margin >= 0, y[own] == 1
                        got = np.array([(yes & true).sum(), (yes & ~true).sum(), (~yes & true).sum()])
                        tally[s, stage, name] = tally.get((s, stage, name), 0) + got
        keys = list(tally)
        columns = [pa.array([k[i] for k in keys], pa.int64()) for i in range(3)]
        columns += [pa.array([int(tally[k][i]) for k in keys], pa.int64()) for i in range(3)]
        yield pa.RecordBatch.from_arrays(columns, ["setting", "trees", "fold", "tp", "fp", "fn"])

    counts = rows.select("bins", "label", fold).mapInArrow(judged, "setting long, trees long, fold long, tp long, fp long, fn long")
    sums = counts.groupBy("setting", "trees", "fold").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    whole = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    f1 = F.when(whole > 0, 2 * F.col("tp") / whole).otherwise(0.0)
    means = sums.groupBy("setting", "trees").agg(F.avg(f1).alias("f1")).collect()
    named = sorted(
        (-r["f1"], ", ".join(sorted(f"{k}={v}" for k, v in ({c: getattr(settings[r["setting"]], c) for c in choices} | {"trees": r["trees"]}).items())), r["setting"], r["trees"])
        for r in means
    )
    best = replace(settings[named[0][2]], trees=named[0][3])
    found = spark.createDataFrame([(name, -less, i == 0) for i, (less, name, _, _) in enumerate(named)], "params string, f1 double, is_best boolean")
    return fit_on(rows, features, edges, best, jointly=True), found


def save_trees(model: BoostedTrees, spark: SparkSession, path: str) -> None:
    """Node table and feature edges, two small tables."""
    model.nodes(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
    edges = [(i, f, e.tolist()) for i, (f, e) in enumerate(zip(model.features, model.edges))]
    spark.createDataFrame(edges, "ordinal int, feature string, edges array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/features")


def load_trees(spark: SparkSession, path: str) -> BoostedTrees:
    rows = spark.read.parquet(f"{path}/features").orderBy("ordinal").collect()
    edges = [np.array(r["edges"], dtype=float) for r in rows]
    nodes = spark.read.parquet(f"{path}/nodes").toPandas().sort_values(["treeID", "id"])
    trees = []
    for _, t in nodes.groupby("treeID"):
        split = [int(np.searchsorted(edges[f], e)) if f >= 0 else 0 for f, e in zip(t["feature"], t["threshold"])]
        columns = (t["feature"], split, t["left"], t["prediction"], t["gain"], t["gradient"], t["cover"], t["n"])
        trees.append(Tree(*(np.array(c) for c in columns)))
    return BoostedTrees([r["feature"] for r in rows], edges, trees)


def importance_table(model: BoostedTrees, spark: SparkSession) -> DataFrame:
    """(feature, ordinal, importance): mean gain of the splits on each feature, as a share of all; 0 without splits."""
    total, splits = np.zeros(len(model.features)), np.zeros(len(model.features))
    for t in model.trees:
        inner = t.feature >= 0
        np.add.at(total, t.feature[inner], t.gain[inner])
        np.add.at(splits, t.feature[inner], 1)
    mean = total / np.maximum(splits, 1)
    share = mean / (mean.sum() or 1.0)
    rows = [(n, i + 1, float(s)) for i, (n, s) in enumerate(zip(model.features, share))]
    return spark.createDataFrame(rows, "feature string, ordinal int, importance double")
