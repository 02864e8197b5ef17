"""Tree Shapley values of a boosted-tree model, as a Spark job over the rows to explain.

For one leaf with path features f1..fD a row matters only through D yes/no answers: does it
satisfy all splits on fj along the path? For each answer pattern the Shapley values of "this
leaf is reached" have a closed form. Short paths are tabulated per leaf and looked up per row; for
long ones the closed form is an integral of a polynomial, which a few points give exactly.
The tables are bounded by the model, and large models are dealt in chunks of trees.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepline.operators.boost import BoostedTrees
from keepline.operators.train import feature_names
from keepline.session import as_table, new_path

# What is broadcast at once is bounded: whole trees of so many nodes together (a larger tree goes by
# itself). All 2^depth patterns are tabulated only for short paths within the byte budget.
CHUNK_NODES = 200_000
TABLE_DEPTH = 8
TABLE_BYTES = 256 * 2**20
BLOCK_LEAVES = 256  # leaves handled together
BLOCK_CELLS = 2**20  # rows x leaves x depth handled together


class TreeTable(NamedTuple):
    """Leaves of one tree, or some of them: features and intervals (lo, hi] per path position, padded."""

    feature: np.ndarray  # [leaves, depth] feature index, 0 where padded
    lo: np.ndarray
    hi: np.ndarray
    share: np.ndarray  # cover share of the path on that feature, 1 where padded
    used: np.ndarray  # how many positions are real
    value: np.ndarray  # leaf value in log-odds
    table: np.ndarray | None  # [leaves, 2^depth, depth]


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """Node table of a saved boosted-tree model: one row per node, with its tree's weight."""
    nodes = spark.read.parquet(f"{path}/data")
    # the saved metadata columns are positional
    meta = spark.read.parquet(f"{path}/treesMetadata").toDF("treeID", "metadata", "weight").drop("metadata")
    return nodes.join(meta, "treeID").select(
        "treeID",
        "weight",
        F.col("nodeData.id").alias("id"),
        F.col("nodeData.prediction").alias("prediction"),
        F.get("nodeData.impurityStats", F.lit(0)).alias("cover"),
        F.col("nodeData.leftChild").alias("left"),
        F.col("nodeData.rightChild").alias("right"),
        F.col("nodeData.split.featureIndex").alias("feature"),
        F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
        F.col("nodeData.split.numCategories").alias("n_categories"),
    )


def node_table(model: PipelineModel | BoostedTrees, spark: SparkSession) -> DataFrame:
    """Node table of a fitted model; of a pipeline, through its own saved form."""
    if isinstance(model, BoostedTrees):
        return model.nodes(spark)
    path = new_path(spark, "trees")
    model.stages[-1].write().save(path)
    return read_nodes(spark, path)


def _closed_form():
    """Made here so that it travels to executors by value; they need not have this package."""

    def pattern_values(bits: np.ndarray, share: np.ndarray) -> np.ndarray:
        """Shapley values of reaching a leaf, per answer pattern: [patterns, depth]."""
        m, d = bits.shape
        out = np.zeros((m, d))
        weight = [math.factorial(k) * math.factorial(d - k - 1) / math.factorial(d) for k in range(d)]
        for i in range(d):
            # column k holds the sum over all k-subsets of the other features being known
            subsets = np.zeros((m, d))
            subsets[:, 0] = 1.0
            for j in range(d):
                if j != i:
                    known = np.zeros_like(subsets)
                    known[:, 1:] = subsets[:, :-1] * bits[:, [j]]
                    subsets = subsets * share[j] + known
            out[:, i] = (bits[:, i] - share[i]) * (subsets @ np.array(weight))
        return out

    return pattern_values


pattern_values = _closed_form()


def _by_points():
    """Made here so that it travels to executors by value, as above."""

    def path_values(bits: np.ndarray, share: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Shapley values of leaves with paths of any length: bits [rows, leaves, depth] to the same shape.

        The weight k!(d-k-1)!/d! is the integral of t^k (1-t)^(d-1-k) over [0, 1]. Summed over all sets of
        known features, feature i has (bit_i - share_i) times the integral of the product over j != i of
        t bit_j + (1-t) share_j. That has degree d - 1, so d/2 Gauss points give it exactly. A padded
        position (bit 1, share 1) is a factor of 1 and gets 0.
        """
        points, weights = np.polynomial.legendre.leggauss((bits.shape[-1] + 1) // 2)
        total = np.zeros(bits.shape)
        for t, w in zip((points + 1) / 2, weights / 2):
            factor = t * bits + (1 - t) * share
            others = np.ones(bits.shape)
            others[..., 1:] = np.cumprod(factor[..., :-1], axis=-1)
            others[..., :-1] *= np.cumprod(factor[..., :0:-1], axis=-1)[..., ::-1]
            total += w * others
        return total * (bits - share) * value[:, None]

    return path_values


path_values = _by_points()


def _all_patterns(d: int) -> np.ndarray:
    codes = np.arange(2**d)
    return ((codes[:, None] >> np.arange(d)) & 1).astype(float)


def chunks_of(nodes: DataFrame, most: int = CHUNK_NODES) -> list[tuple[int, int]]:
    """Ranges of tree numbers (first, last) with at most ``most`` nodes together, or a single tree."""
    out: list[tuple[int, int]] = []
    held = 0
    for r in sorted(nodes.groupBy("treeID").count().collect()):
        if out and held + r["count"] <= most:
            out[-1], held = (out[-1][0], r["treeID"]), held + r["count"]
        else:
            out, held = [*out, (r["treeID"], r["treeID"])], r["count"]
    return out


def tree_tables(nodes: DataFrame) -> tuple[list[TreeTable], float]:
    """Lookup tables, one or more per tree, and the base value (expected log-odds).

    Give it the nodes of one chunk: they are held on the driver.
    """
    trees: dict[int, dict[int, object]] = {}
    for r in nodes.collect():
        if r["left"] >= 0 and r["n_categories"] != -1:
            raise ValueError("categorical splits are not supported; one-hot the column first")
        trees.setdefault(r["treeID"], {})[r["id"]] = r
    tables, base, spent = [], 0.0, 0
    for _, tree in sorted(trees.items()):
        leaves = []
        stack = [(0, {})]
        while stack:
            node_id, path = stack.pop()
            node = tree[node_id]
            if node["left"] < 0:
                leaves.append((2.0 * node["weight"] * node["prediction"], path))
                continue
            f, t = node["feature"], node["threshold"]
            lo, hi, share = path.get(f, (-np.inf, np.inf, 1.0))
            for child, bounds in ((node["left"], (lo, min(hi, t))), (node["right"], (max(lo, t), hi))):
                part = tree[child]["cover"] / node["cover"] if node["cover"] else 0.0
                stack.append((child, {**path, f: (*bounds, share * part)}))
        for i in range(0, len(leaves), BLOCK_LEAVES):
            block = leaves[i : i + BLOCK_LEAVES]
            depth = max(max(len(p) for _, p in block), 1)
            size = len(block) * 2**depth * depth * 8
            tabulated = depth <= TABLE_DEPTH and spent + size <= TABLE_BYTES
            spent += size if tabulated else 0
            t = _table_of(block, depth, tabulated)
            base += float(t.value @ np.prod(t.share, axis=1))
            tables.append(t)
    return tables, base


def _table_of(leaves: list, depth: int, tabulated: bool) -> TreeTable:
    n = len(leaves)
    t = TreeTable(
        np.zeros((n, depth), dtype=np.int64), np.full((n, depth), -np.inf),
        np.full((n, depth), np.inf), np.ones((n, depth)), np.zeros(n, dtype=np.int64),
        np.zeros(n), np.zeros((n, 2**depth, depth)) if tabulated else None,
    )
    for k, (value, path) in enumerate(leaves):
        for j, (f, (lo, hi, share)) in enumerate(path.items()):
            t.feature[k, j], t.lo[k, j], t.hi[k, j], t.share[k, j] = f, lo, hi, share
        t.used[k], t.value[k] = len(path), value
        d = len(path)
        if tabulated and d:
            # a padded position always answers yes: its bit is set in every code
            codes = np.arange(2**d) + (2**depth - 2**d)
            t.table[k, codes, :d] = value * pattern_values(_all_patterns(d), t.share[k, :d])
    return t


def _attributor(shared, where_features: list[int], long_paths, cells: int):
    """Arrow-batch function: the given columns and one list column out. Features are columns too."""
    n_features = len(where_features)
    places: list[np.ndarray | None] = []  # of each tabulated block: its leaves' places to their features

    def scatters() -> list[np.ndarray | None]:
        if not places:
            for feature, *_, table in shared.value:
                place = None
                if table is not None:
                    place = np.zeros((feature.size, n_features))
                    place[np.arange(feature.size), feature.reshape(-1)] = 1.0
                places.append(place)
        return places

    def attribute(x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), n_features))
        for (feature, lo, hi, share, _, value, table), place in zip(shared.value, scatters()):
            if table is not None:
                seen = x[:, feature]
                codes = ((seen > lo) & (seen <= hi)) @ (1 << np.arange(feature.shape[1]))
                phi = table[np.arange(len(feature))[None, :], codes]
                out += phi.reshape(len(x), -1) @ place
                continue
            flat = feature.reshape(-1)
            order = np.argsort(flat, kind="stable")
            names, starts = np.unique(flat[order], return_index=True)
            step = max(1, cells // feature.size)
            for i in range(0, len(x), step):
                seen = x[i : i + step][:, feature]
                phi = long_paths(((seen > lo) & (seen <= hi)).astype(float), share, value)
                out[i : i + step, names] += np.add.reduceat(phi.reshape(len(phi), -1)[:, order], starts, axis=1)
        return out

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            x = np.column_stack(
                [batch.column(i).cast(pa.float64()).to_numpy(zero_copy_only=False) for i in where_features]
            ) if batch.num_rows else np.zeros((0, n_features))
            parts = [attribute(x[i : i + 2048]) for i in range(0, len(x), 2048)]
            phi = np.concatenate(parts) if parts else np.zeros((0, n_features))
            offsets = np.arange(len(x) + 1, dtype=np.int32) * n_features
            values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(phi.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, values], names=[*batch.schema.names, "_phi"])

    return run


def tree_contributions(
    df: DataFrame,
    model: PipelineModel | BoostedTrees,
    nodes: DataFrame | None = None,
    out: str = "contributions",
    chunk_nodes: int = CHUNK_NODES,
) -> DataFrame:
    """Adds per-feature Shapley values in log-odds and the base value.

    Give it flagged rows and needed columns only: neither a filter nor the choice of columns can move
    past the Arrow stage by itself. Each column crosses it once, features included. Base
    value plus the sum of contributions is the model's margin.

    A model of more than ``chunk_nodes`` nodes is worked off in chunks of trees, with the rows stored in
    between: contributions of trees add up, and driver and tasks hold one chunk at a time.
    """
    spark = df.sparkSession
    features = feature_names(model)
    nodes = nodes if nodes is not None else node_table(model, spark)
    chunks = chunks_of(nodes, chunk_nodes)
    made, base = df, 0.0
    for i, (first, last) in enumerate(chunks or [(0, 0)]):
        tables, part = tree_tables(nodes.where(F.col("treeID").between(first, last)))
        base += part
        made = _add_chunk(made if i == 0 else as_table(made, "attributed"), features, tables)
    names = F.array(*[F.lit(f) for f in features])
    pairs = F.transform(
        F.arrays_zip(names.alias("feature"), F.col("_phi").alias("contribution")),
        lambda z: F.struct(z["feature"].alias("feature"), z["contribution"].alias("contribution")),
    )
    return made.withColumns({out: pairs, "base_value": F.lit(base)}).drop("_phi")


def _add_chunk(df: DataFrame, features: list[str], tables: list[TreeTable]) -> DataFrame:
    """df with the contributions of some trees in ``_phi``, added to those that are there."""
    before = "_phi" in df.columns
    df = df.withColumnRenamed("_phi", "_before") if before else df
    shared = df.sparkSession.sparkContext.broadcast([tuple(t) for t in tables])
    where_features = [df.columns.index(f) for f in features]
    schema = T.StructType([*df.schema.fields, T.StructField("_phi", T.ArrayType(T.DoubleType()))])
    made = df.mapInArrow(_attributor(shared, where_features, path_values, BLOCK_CELLS), schema)
    if not before:
        return made
    return made.withColumn("_phi", F.zip_with("_before", "_phi", lambda a, b: a + b)).drop("_before")


def sample_contributions(df: DataFrame, model: PipelineModel | BoostedTrees, key: str, n: int = 200) -> DataFrame:
    """Attribution of the first ``n`` rows by key, for a quick global chart."""
    return tree_contributions(df.orderBy(key).limit(n), model)
