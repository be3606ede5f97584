"""Fuzzy memberships to fixed centres and the fuzzy c-means fit.

Memberships are pure column expressions (the centres are a few literals).
The c-means loop keeps only the centres between iterations (c x d doubles):
memberships are a function of the previous centres, so one aggregate per
iteration yields the next centres *and* the membership change of the
previous iteration.  Rows are never collected; the input is checkpointed
once (lineage cut into ``spark.checkpoint.dir``) and persisted.  Rows that fit
one task (``PACKED_BYTES``) are iterated over in it, without a job an iteration.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import cut_lineage

PACKED_BYTES = 64 << 20            # rows that one task iterates over; more are passed over in a job an iteration
_EPS = sys.float_info.epsilon      # the clip used by the common c-means code


def _dist(cols: list[Column], center: list[float]) -> Column:
    return F.sqrt(reduce(lambda a, b: a + b, [(x - F.lit(float(c))) * (x - F.lit(float(c)))
                                              for x, c in zip(cols, center)]))


def membership_exprs(features: list[str], centers: list[list[float]], m: float = 2.0) -> list[Column]:
    """u_i = 1 / sum_j (d_i / d_j)^(2/(m-1)); any zero distance -> 1 for each
    zero-distance centre, 0 for the others."""
    cols = [F.col(f).cast("double") for f in features]
    d = [_dist(cols, c) for c in centers]
    any_zero = reduce(lambda a, b: a | b, [x == 0 for x in d])
    e = 2.0 / (m - 1.0)
    out = []
    for i in range(len(centers)):
        denom = reduce(lambda a, b: a + b, [F.pow(d[i] / d[j], F.lit(e)) for j in range(len(centers))])
        out.append(F.when(any_zero, F.when(d[i] == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
                   .otherwise(F.lit(1.0) / denom))
    return out


def memberships(df: DataFrame, features: list[str], centers: list[list[float]], m: float = 2.0,
                prefix: str = "u") -> DataFrame:
    """Append u0..u{c-1}."""
    ex = membership_exprs(features, centers, m)
    return df.withColumns({f"{prefix}{i}": e for i, e in enumerate(ex)})


def _fcm_u(cols: list[Column], centers, m: float) -> list[Column]:
    """c-means update: u_i = d_i^(-2/(m-1)) / sum_j d_j^(-2/(m-1)), d clipped at eps.

    ``centers`` holds per-cluster lists of Columns (or floats)."""
    def dist(center):
        return F.sqrt(reduce(lambda a, b: a + b, [(x - (cc if isinstance(cc, Column) else F.lit(float(cc))))
                                                  * (x - (cc if isinstance(cc, Column) else F.lit(float(cc))))
                                                  for x, cc in zip(cols, center)]))
    d = [F.greatest(dist(c), F.lit(_EPS)) for c in centers]
    p = [F.pow(x, F.lit(-2.0 / (m - 1.0))) for x in d]
    s = reduce(lambda a, b: a + b, p)
    return [x / s for x in p]


def hash_init(key: str, c: int, seed: int = 42) -> list[Column]:
    """Initial memberships: uniform [0,1) per (key, cluster) from md5, normalised."""
    raw = [F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}|{i}"))), 1, 8),
                  16, 10).cast("double") / F.lit(float(16 ** 8)) for i in range(c)]
    s = reduce(lambda a, b: a + b, raw)
    return [F.greatest(x / s, F.lit(_EPS)) for x in raw]


def _fit_packed(d: int, c: int, m: float, error: float, maxiter: int):
    """All iterations of :func:`fcm_fit` over the rows of one task: Arrow batches (features, initial memberships, weight) -> one row."""
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, nulls = [], []
        for b in batches:
            parts.append(np.array([col.to_numpy(zero_copy_only=False) for col in b.columns], dtype=np.float64))
            nulls.append(np.array([col.is_null().to_numpy(zero_copy_only=False) for col in b.columns], dtype=bool))
        rows, gone = np.concatenate(parts, axis=1), np.concatenate(nulls, axis=1)
        x, w, some = rows[:d], np.where(gone[-1], 0.0, rows[-1]), gone[:d].any(axis=0)
        x[gone[:d]] = 0.0                               # NULL cells take no part in a sum, as in the aggregate

        def memberships(centers):
            # greatest() passes over NULL: a row with a NULL cell lies at _EPS from every centre
            dist = [np.sqrt(sum(np.square(x[j] - at[j]) for j in range(d))) for at in centers]
            p = np.array([np.power(np.where(some, _EPS, np.maximum(at, _EPS)), -2.0 / (m - 1.0)) for at in dist])
            return p / p.sum(axis=0)

        def moved(u):
            um = np.power(u, m) * w
            return [[float((um[i] * x[j]).sum() / um[i].sum()) for j in range(d)] for i in range(c)]

        before = rows[d:d + c]
        centers, it, norm = moved(before), 1, float("inf")
        while it < maxiter - 1:
            u = memberships(centers)
            norm = float((np.square(u - before).sum(axis=0) * w).sum()) ** 0.5
            if norm < error:
                break
            before, centers, it = u, moved(u), it + 1
        yield pa.RecordBatch.from_arrays([pa.array([it], pa.int32()), pa.array([norm]), pa.array([[v for at in centers for v in at]], pa.list_(pa.float64()))],
                                         names=["it", "norm", "centers"])

    return of


def fcm_fit(df: DataFrame, features: list[str], key: str, c: int = 2, m: float = 2.0,
            error: float = 1e-5, maxiter: int = 1000, weight: str | None = None, seed: int = 42,
            sort_centers: bool = True) -> tuple[list[list[float]], int, float]:
    """Fit fuzzy c-means; returns (centers, iterations, last membership-change norm).

    ``weight`` counts a row that many times (same as duplicating it), in the
    centre sums and in the Frobenius norm of the membership change.
    """
    cols = [F.col(f).cast("double") for f in features]
    data = df.select(*[x.alias(f) for x, f in zip(cols, features)],
                     *(hash_init(key, c, seed)), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("__w"))
    init_names = [f"__i{i}" for i in range(c)]
    data = data.toDF(*features, *init_names, "__w")
    # iterative job: cut the lineage once (reliable checkpoint in the shared
    # checkpoint folder) so each iteration plans against a plain scan
    data = cut_lineage(data)
    n = data.count()
    if 0 < n * 8 * len(data.columns) <= PACKED_BYTES:
        # one task: what it holds is bounded by PACKED_BYTES, and hundreds of iterations start no job each
        found = data.coalesce(1).mapInArrow(_fit_packed(len(features), c, m, error, maxiter), "it int, norm double, centers array<double>").first()
        centers = np.array(found["centers"]).reshape(c, len(features)).tolist()
        return sorted(centers) if sort_centers else centers, found["it"], found["norm"]
    data = data.persist()
    x = [F.col(f) for f in features]
    w = F.col("__w")

    def sums(u: list[Column]) -> list[Column]:
        aggs = []
        for i in range(c):
            um = F.pow(u[i], F.lit(m)) * w
            aggs.append(F.sum(um).alias(f"s{i}"))
            aggs += [F.sum(um * xj).alias(f"s{i}_{j}") for j, xj in enumerate(x)]
        return aggs

    def centers_from(row) -> list[list[float]]:
        return [[row[f"s{i}_{j}"] / row[f"s{i}"] for j in range(len(features))] for i in range(c)]

    init = [F.col(n) for n in init_names]
    # iteration 1 centres come from the (normalised, eps-clipped) initial memberships
    row = data.agg(*sums(init)).collect()[0]
    prev_centers = centers_from(row)
    older = None
    it, norm = 1, float("inf")
    while it < maxiter - 1:                     # at most maxiter - 1 iterations, as in the common c-means loop
        step = data
        u = _fcm_u(x, prev_centers, m)          # memberships after iteration `it`
        pu = init if older is None else _fcm_u(x, older, m)
        # memberships become columns first, so the sums reference them
        # instead of inlining the distance expressions many times
        step = step.select(*x, w, *[e.alias(f"__u{i}") for i, e in enumerate(u)],
                           *[e.alias(f"__q{i}") for i, e in enumerate(pu)])
        uc = [F.col(f"__u{i}") for i in range(c)]
        qc = [F.col(f"__q{i}") for i in range(c)]
        change = reduce(lambda a, b: a + b, [(uc[i] - qc[i]) * (uc[i] - qc[i]) for i in range(c)])
        row = step.agg(*sums(uc), F.sum(change * w).alias("__d")).collect()[0]
        norm = (row["__d"] or 0.0) ** 0.5
        if norm < error:
            break                               # stop: centres of iteration `it`
        older, prev_centers = prev_centers, centers_from(row)
        it += 1
    data.unpersist()
    centers = prev_centers
    if sort_centers:
        centers = sorted(centers)
    return centers, it, norm


def centers_frame(spark, centers: list[list[float]], features: list[str]) -> DataFrame:
    rows = [(i, *map(float, cc)) for i, cc in enumerate(centers)]
    return spark.createDataFrame(rows, ["cluster"] + features)
