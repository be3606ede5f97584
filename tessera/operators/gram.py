"""Pairwise-complete moments of wide tables by blocked Gram products.

``profile.corr_matrix`` writes one aggregate expression a pair, which is the
right plan for a handful of columns and the wrong one for hundreds.  Here each
task turns its Arrow batches into a value matrix and a presence mask, and the
six sums every pair needs are matrix products of the two (``M'M`` counts the
complete pairs, ``X'M``, ``M'X``, ``X'X`` and the two products of squares give
the moments over just those rows).  Columns are cut into blocks, and a wave of
block pairs takes one scan and at most ``state_bytes`` a task, so 64 or 2,000
columns are one scan and wider tables a few.

A task's state is means and centred moments, not raw sums, so columns far
from 0 lose no digits; states are merged by the parallel-variance rule, in the
task over its batches and in the JVM over the tasks.  What is shuffled is one
small row a task and pair.

Cases: NULL, NaN and infinite values are missing; a column that is constant
over a pair's complete rows, and a pair with no complete row, have a NULL
correlation; an empty table gives every pair with ``n_complete`` 0; repeated
rows count each time; a column named twice is refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 256
STATE_BYTES = 256 << 20
_STATE = "i int, j int, n long, mi double, mj double, cij double, cii double, cjj double"
_NAMES = [x.split()[0] for x in _STATE.split(", ")]


def _matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Deviations from the batch's column means (0 where missing), presence, and those means."""
    x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1).astype(np.float64, copy=False)
    seen = np.isfinite(x)
    x = np.where(seen, x, 0.0)
    n = np.maximum(seen.sum(axis=0), 1)
    first = x[seen.argmax(axis=0), np.arange(x.shape[1])]          # a constant column deviates by exactly 0
    mean = first + np.where(seen, x - first, 0.0).sum(axis=0) / n
    return np.where(seen, x - mean, 0.0), seen.astype(np.float64), mean


def _products(xi, mi, si, xj, mj, sj) -> tuple[np.ndarray, ...]:
    """State of one block pair: n, means and centred moments over the rows where both are present."""
    n = mi.T @ mj
    a, b = xi.T @ mj, mi.T @ xj
    aa, bb, ab = (xi * xi).T @ mj, mi.T @ (xj * xj), xi.T @ xj
    d = np.maximum(n, 1.0)

    def centred(square, total):
        c = square - total * total / d
        return np.where(c <= 64 * np.finfo(float).eps * square, 0.0, c)       # rounding of a constant
    return n, si[:, None] + a / d, sj[None, :] + b / d, ab - a * b / d, centred(aa, a), centred(bb, b)


def _merge(p: tuple[np.ndarray, ...], q: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    n = p[0] + q[0]
    d = np.maximum(n, 1.0)
    u, v, w = q[1] - p[1], q[2] - p[2], p[0] * q[0] / d
    mi = np.where(p[0] == 0, q[1], p[1] + np.where(q[0] == 0, 0.0, u * q[0] / d))
    mj = np.where(p[0] == 0, q[2], p[2] + np.where(q[0] == 0, 0.0, v * q[0] / d))
    return n, mi, mj, p[3] + q[3] + u * v * w, p[4] + q[4] + u * u * w, p[5] + q[5] + v * v * w


def _task(batches: Iterator[pa.RecordBatch], wave: list[tuple[int, int]], block: int) -> Iterator[pa.RecordBatch]:
    state: dict[tuple[int, int], tuple] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        x, m, s = _matrix(batch)
        for a, b in wave:
            i, j = slice(a * block, (a + 1) * block), slice(b * block, (b + 1) * block)
            new = _products(x[:, i], m[:, i], s[i], x[:, j], m[:, j], s[j])
            state[a, b] = _merge(state[a, b], new) if (a, b) in state else new
    for (a, b), (n, *rest) in state.items():
        i, j = np.meshgrid(np.arange(n.shape[0]) + a * block, np.arange(n.shape[1]) + b * block, indexing="ij")
        use = (i <= j) & (n > 0)
        cols = [i[use].astype(np.int32), j[use].astype(np.int32), n[use].astype(np.int64), *(r[use] for r in rest)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=_NAMES)


def waves(width: int, block: int = BLOCK, state_bytes: int = STATE_BYTES) -> list[list[tuple[int, int]]]:
    """Block pairs in waves whose state in one task is at most ``state_bytes`` (one block pair at least)."""
    blocks = -(-width // block)
    side = min(block, width)
    pairs = [(a, b) for a in range(blocks) for b in range(a, blocks)]
    each = max(1, state_bytes // (6 * 8 * side * side))
    return [pairs[k:k + each] for k in range(0, len(pairs), each)]


def _folded(states: Column) -> Column:
    """The states of one pair, merged by the parallel-variance rule."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), *[F.lit(0.0).alias(c) for c in _NAMES[3:]])

    def step(p: Column, q: Column) -> Column:
        n = p["n"] + q["n"]
        share = q["n"] / F.greatest(n, F.lit(1))
        u, v, w = q["mi"] - p["mi"], q["mj"] - p["mj"], p["n"] * share
        both = F.struct(n.alias("n"), (p["mi"] + u * share).alias("mi"), (p["mj"] + v * share).alias("mj"), (p["cij"] + q["cij"] + u * v * w).alias("cij"),
                        (p["cii"] + q["cii"] + u * u * w).alias("cii"), (p["cjj"] + q["cjj"] + v * v * w).alias("cjj"))
        return F.when(p["n"] == 0, q).when(q["n"] == 0, p).otherwise(both)
    return F.aggregate(states, zero, step)


def pair_moments(df: DataFrame, columns: list[str], block: int = BLOCK, state_bytes: int = STATE_BYTES) -> DataFrame:
    """``(i, j, n, mi, mj, cij, cii, cjj)`` for positions ``i <= j`` of ``columns``: over the rows where both are
    present their number, the two means, and the centred sums of products and squares."""
    if len(set(columns)) != len(columns):
        raise ValueError("a column is named twice")
    x = df.select(*[F.col(f"`{c}`").cast("double").alias(f"x{k}") for k, c in enumerate(columns)])      # plain names: Arrow maps split a dot
    width = len(columns)
    pairs = df.sparkSession.range(width).select(F.col("id").cast("int").alias("i")) \
        .select("i", F.explode(F.sequence("i", F.lit(width - 1))).alias("j"))
    out = pairs.select("i", "j", F.lit(0).cast("long").alias("n"), *[F.lit(0.0).alias(c) for c in _NAMES[3:]])     # pairs that no row completes
    for wave in waves(width, block, state_bytes):
        out = out.unionByName(x.mapInArrow(lambda it, wave=wave: _task(it, wave, block), _STATE))
    grouped = out.groupBy("i", "j").agg(F.collect_list(F.struct(*_NAMES[2:])).alias("s"))
    return grouped.select("i", "j", _folded(F.col("s")).alias("s")).select("i", "j", "s.*")


def corr_wide(df: DataFrame, columns: list[str], digits: int | None = 6, block: int = BLOCK, state_bytes: int = STATE_BYTES) -> DataFrame:
    """``(column_a, column_b, n_complete, corr)`` of every pair, ``column_a`` before ``column_b`` in ``columns``."""
    m = pair_moments(df, columns, block, state_bytes).where("i < j")
    names = F.array(*[F.lit(c) for c in columns])
    corr = F.when((F.col("cii") > 0) & (F.col("cjj") > 0), F.col("cij") / (F.sqrt("cii") * F.sqrt("cjj")))
    if digits is not None:
        corr = F.round(corr, digits)
    return m.select(F.element_at(names, F.col("i") + 1).alias("column_a"), F.element_at(names, F.col("j") + 1).alias("column_b"),
                    F.col("n").alias("n_complete"), corr.alias("corr"))


def corr_wide_with_label(df: DataFrame, columns: list[str], label: str, digits: int | None = 6) -> DataFrame:
    """``(column_name, n_complete, corr)`` of every column with ``label``, from the same products."""
    out = corr_wide(df, [*columns, label], digits).where(F.col("column_b") == F.lit(label))
    return out.select(F.col("column_a").alias("column_name"), "n_complete", "corr")
