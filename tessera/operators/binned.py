"""Boosted regression trees over the cells of binned features.

Spark ML's trees look at a feature only through its bins (at most 32), so
rows whose features lie in the same bins take the same way in every tree and
always carry the same prediction.  For few features there are few such cells,
whatever the number of rows, and what a squared-error tree needs of a cell is
the number and the sum of the targets drawn for it.  ``fit_cells`` therefore
passes over the rows three times (their number, the sample of the candidate
splits, the sums) instead of some times a tree and level, and ``boost`` grows
the trees in one task on the sums.

The model is the one ``GBTRegressor`` gives with the same seed on the same
rows (up to the rounding of sums, which decides between splits of equal gain);
bin edges, draws and gains are those of ``tessera.operators.trees``, and
``minInstancesPerNode`` holds for drawn rows, as a weight of the node.

``fit_cells`` returns None where it does not apply (more than ``MAX_FEATURES`` features, more cells than
``MAX_VALUES`` allows, no rows or no finite bins); callers then grow the trees on rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import trees as grown
from tessera.session import checkpoint_dir, cut_lineage

BINS = grown.BINS
MAX_FEATURES = 3                # with more, cells are about as many as rows
MAX_VALUES = 1 << 23            # cells x trees held by a task (two doubles each)
PIECE = 1 << 25                 # rows x trees summed at once (a byte each)
OUT_ROWS = 1 << 16


def bin_names(features: list[str]) -> list[str]:
    return [f"__b{i}" for i in range(len(features))]


def bucketizer(features: list[str], edges: list[list[float]]) -> Bucketizer:
    """Bins from 1 on; a value equal to an edge lies below it, as in the trees (a bucket holds its lower bound)."""
    low, high = -float("inf"), float("inf")
    splits = [[low, -1.7976931348623157e308, *sorted({math.nextafter(e, high) for e in es}), high] for es in edges]
    return Bucketizer(splitsArray=splits, inputCols=features, outputCols=bin_names(features), handleInvalid="error")


@dataclass
class Cells:
    """Nonempty cells: rows ``(cell, tree, w, s)``, the number and target sum of the rows drawn for each tree (tree 0 only if all rows are)."""

    table: DataFrame
    features: list[str]
    edges: list[list[float]]
    columns: int
    trees: int

    @property
    def shape(self) -> list[int]:
        return [len(e) + 1 for e in self.edges]


def _cell_sums(edges: list[list[float]], seeds: list[int], rate: float):
    """Arrow batches (partition, y, features) -> rows (cell, tree, w, s), one a task, cell and tree; without ``seeds`` all rows are drawn."""
    shape = [len(e) + 1 for e in edges]
    bounds = [np.array(e, dtype=np.float64) for e in edges]
    trees = max(1, len(seeds))

    piece = max(1, PIECE // trees)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros((math.prod(shape), trees))
        s = np.zeros_like(w)
        draws, held, rows = None, [], 0

        def add() -> None:
            cell, y = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            order = np.argsort(cell, kind="stable")
            at, first = np.unique(cell[order], return_index=True)
            y = y[order]
            if draws is None:
                w[at, 0] += np.diff(np.append(first, len(y)))
                s[at, 0] += np.add.reduceat(y, first)
                return
            drawn, each = draws.take(len(y))[order], np.vstack([np.ones(len(y)), y])
            for c, lo, hi in zip(at, first, np.append(first[1:], len(y))):   # one small product a cell
                n, total = each[:, lo:hi] @ drawn[lo:hi].astype(np.float64)
                w[c] += n
                s[c] += total

        for b in batches:
            if not b.num_rows:
                continue
            if draws is None and seeds:
                draws = grown.Draws(seeds, rate, b.column(0)[0].as_py())
            bins = grown.binned_batch(b, 2, bounds)
            held.append((np.ravel_multi_index(bins, shape) if shape else np.zeros(b.num_rows, dtype=np.int64), b.column(1).to_numpy(zero_copy_only=False)))
            rows += b.num_rows
            if rows >= piece:
                add()
                held, rows = [], 0
        if held:
            add()
        for lo in range(0, w.shape[0], max(1, OUT_ROWS // trees)):
            ws, ss = w[lo:lo + max(1, OUT_ROWS // trees)], s[lo:lo + max(1, OUT_ROWS // trees)]
            at, tree = np.nonzero(ws)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(at + lo, pa.int64()), pa.array(tree, pa.int32()), pa.array(ws[at, tree]), pa.array(ss[at, tree])],
                                                 names=["cell", "tree", "w", "s"])

    return of


def fit_cells(known: DataFrame, target: str, features: list[str], trees: int, subsampling: float, seed: int) -> Cells | None:
    """The cells of the rows of ``known`` and, for each of ``trees`` trees, the rows drawn in them."""
    checkpoint_dir(known.sparkSession)
    columns = 1 if subsampling == 1.0 else trees
    if len(features) > MAX_FEATURES or BINS ** len(features) * columns > MAX_VALUES:
        return None                 # before any pass over the rows
    _, edges = grown.bin_edges(known, features, seed)
    if edges is None:
        return None
    rows = known.select(F.spark_partition_id().alias("p"), F.col(f"`{target}`").cast("double").alias("y"),
                        *[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(features)])
    seeds = [] if subsampling == 1.0 else [seed + m + 1 for m in range(trees)]
    sums = (rows.mapInArrow(_cell_sums(edges, seeds, subsampling), "cell long, tree int, w double, s double")
            .groupBy("cell", "tree").agg(F.sum("w").alias("w"), F.sum("s").alias("s")))
    return Cells(cut_lineage(sums), features, edges, columns, trees)


def _cell_points(batches: Iterator[pa.RecordBatch], shape: list[int], columns: int) -> grown.Points:
    w = np.zeros((columns, math.prod(shape)))
    s = np.zeros_like(w)
    for b in batches:
        cell, tree, n, total = (c.to_numpy() for c in b.columns)
        w[tree, cell], s[tree, cell] = n, total
    full = np.flatnonzero(w.any(axis=0))
    w, s = w[:, full], s[:, full]
    bins = np.array(np.unravel_index(full, shape), dtype=np.uint8).reshape(len(shape), len(full))

    def drawn(m: int):
        n = w[m if columns > 1 else 0]
        at = np.flatnonzero(n)
        return at, n[at]

    def targets(m: int, at, prediction):
        k = m if columns > 1 else 0
        return s[k, at] if m == 0 else 2.0 * (s[k, at] - w[k, at] * prediction[at])

    return grown.Points(bins, shape, drawn, targets)


def _boosted(cells: Cells, trees: int, max_depth: int, step_size: float, min_instances: int, thresholds: list[list[float]]) -> GBTRegressionModel:
    shape, columns, least = cells.shape, cells.columns, float(max(1, min_instances))
    # one task: what it holds is bounded by MAX_VALUES
    nodes = cut_lineage(cells.table.coalesce(1).mapInArrow(
        lambda it: grown.boosted(_cell_points(it, shape, columns), trees, max_depth, step_size, least), grown.NODES))
    form = GBTRegressor(featuresCol="__x", labelCol="__y", predictionCol="__pred", maxIter=trees, maxDepth=max_depth, stepSize=step_size, minInstancesPerNode=min_instances)
    return grown.spark_model(nodes, thresholds, trees, step_size, form)


def boost(cells: Cells, trees: int, max_depth: int, step_size: float, min_instances: int) -> GBTRegressionModel:
    """The first ``trees`` trees over the bins of ``cells`` (squared error, the first tree at full weight)."""
    return _boosted(cells, trees, max_depth, step_size, min_instances, [[j + 1.5 for j in range(len(e))] for e in cells.edges])


def moments(rows: DataFrame, target: str, cells: Cells) -> DataFrame:
    """Per cell of other rows (its bins): number, mean and squared deviation from it of the target, written once."""
    y = F.col(f"`{target}`").cast("double")
    names = bin_names(cells.features)
    found = bucketizer(cells.features, cells.edges).transform(rows).groupBy(*names).agg(
        F.count(F.lit(1)).alias("__n"), F.avg(y).alias("__mean"), (F.var_pop(y) * F.count(F.lit(1))).alias("__m2"))
    return cut_lineage(found)


def pipeline(cells: Cells, trees: int, max_depth: int, step_size: float, min_instances: int) -> PipelineModel:
    """Rows with the features -> ``__pred`` (and ``__x``)."""
    model = _boosted(cells, trees, max_depth, step_size, min_instances, cells.edges)
    return PipelineModel([VectorAssembler(inputCols=cells.features, outputCol="__x", handleInvalid="error"), model])
