"""Exact k-nearest-neighbour search and KNN classification over a pivot index, without a cross join.

1. **Index.** Pivots are picked farthest-first from a bounded sample of the
   training rows (``SAMPLE`` rows of the smallest key hash).  Every training
   row belongs to the cell of its nearest pivot and keeps its distance to it.
   A range sort by (cell, distance) cuts every cell, however hot, into blocks
   of at most ``block_rows`` rows, each a ring ``lo .. hi`` around the pivot.
2. **Bound.** The k-th distance to the sample bounds a query's true k-th
   distance.  By the triangle inequality a block with ``d(q, pivot) - hi`` or
   ``lo - d(q, pivot)`` above the bound holds no neighbour.
3. **Search.** Queries of neighbouring cells form groups of bounded size, and a
   block goes once to each group in which a query may need it.  A task holds
   its group's queries and their best ``k`` rows so far and streams the blocks
   past them, nearest first, so the bounds tighten on the way and blocks are
   skipped query by query.  What is written grows with the rows times the number of
   groups, never with query-block pairs, and each query leaves ``k`` rows.
4. **Screen.** Within a block, Chebyshev candidates are the rows inside the
   query's box, by bit sets over cuts of every dimension; Euclidean and cosine
   candidates come from one matrix product, Minkowski ones of order 3, 4 and 5
   from products of powers (``_Moments``).  All only err on the side of more
   candidates; distances themselves are then computed as defined.

The triangle inequality is that of the metric itself where it is one; for
Minkowski with p < 1 the Chebyshev distance, never larger, stands in, and for
cosine the Euclidean distance of unit vectors (``sqrt(2 * distance)``; a zero
vector stays zero).  The result is exact, ties broken by training key.  The
driver holds the sample, the pivots and one row per block (at most ``BLOCKS``
and a few per partition and cell): all bounded by parameters.  Work follows the structure of the data: where every distance is
alike, no exact search can skip much, and the blocks bound each task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut_lineage

SAMPLE = 4096
PIVOTS = 256
CELL_ROWS = 128
BLOCKS = 1 << 16
GROUP_ROWS = 1 << 16         # queries a task holds,
GROUP_BEST = 1 << 22         # and rows found for them
PIECE = 8192                 # training rows screened at once
CUTS = 64
FEW = 200_000
_MINKOWSKI = ("chebyshev", "manhattan", "cityblock", "l1", "euclidean", "l2", "minkowski")


def as_vector(df: DataFrame, key: str, features: list[str] | str, label: str | None = None) -> DataFrame:
    """(key, vec ARRAY<DOUBLE>[, label]) from a column list or an array column."""
    if isinstance(features, str):
        vec = F.col(features).cast("array<double>")
    else:
        vec = F.array(*[F.col(c).cast("double") for c in features])
    cols = [F.col(key).alias("key"), vec.alias("vec")]
    if label is not None:
        cols.append(F.col(label).alias("label"))
    return df.select(*cols)


def _np_dist(metric: str, p: float, Q, T):
    """Distances ``[query, row]``, one dimension after the other: no array beyond the result's size."""
    if metric == "cosine":
        nq = np.sqrt((Q * Q).sum(1))[:, None]
        nt = np.sqrt((T * T).sum(1))[None, :]
        return 1.0 - np.divide(Q @ T.T, nq * nt, out=np.zeros((len(Q), len(T))), where=nq * nt > 0)
    out = np.zeros((len(Q), len(T)))
    x, y = np.empty_like(out), np.empty_like(out)
    T = np.ascontiguousarray(T.T)                        # a dimension's values side by side
    for j in range(Q.shape[1] if len(Q) else 0):
        np.subtract(Q[:, j:j + 1], T[j], out=x)
        np.abs(x, out=x)
        if metric == "chebyshev":
            np.maximum(out, x, out=out)
        elif metric in ("manhattan", "cityblock", "l1"):
            out += x
        elif metric in ("euclidean", "l2"):
            x *= x
            out += x
        elif p == int(p) and 1 <= p <= 8:
            np.copyto(y, x)
            for _ in range(int(p) - 1):
                y *= x
            out += y
        else:
            out += x ** p
    if metric in ("euclidean", "l2"):
        return np.sqrt(out)
    return out ** (1.0 / p) if metric == "minkowski" else out


def _unit(V):
    norm = np.sqrt((V * V).sum(1, keepdims=True))
    return np.divide(V, norm, out=np.zeros_like(V), where=norm > 0)


def _matrix(column) -> np.ndarray:
    """An Arrow list column as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return np.asarray(column.flatten(), dtype=np.float64).reshape(n, -1) if n else np.zeros((0, 0))


class Gauge:
    """The metric and the distance whose triangle inequality prunes."""

    def __init__(self, metric: str, p: float):
        self.metric, self.p = metric.lower(), p
        if self.metric != "cosine" and self.metric not in _MINKOWSKI:
            raise ValueError(metric)

    def distance(self, Q, T):
        return _np_dist(self.metric, self.p, Q, T)

    def gauge(self, Q, T):
        if self.metric == "cosine":
            return _np_dist("euclidean", 2.0, _unit(Q), _unit(T))
        if self.metric == "minkowski" and self.p < 1:
            return _np_dist("chebyshev", 2.0, Q, T)
        return self.distance(Q, T)

    def reach(self, r):
        """What the gauge may be at distance ``r``, rounding included (numpy arrays and columns alike)."""
        if self.metric == "cosine":
            r = (2.0 * r) ** 0.5 if not isinstance(r, Column) else F.sqrt(2.0 * r)
        return r * (1 + 1e-9) + 1e-9


def farthest_first(points: np.ndarray, m: int, gauge: Gauge) -> np.ndarray:
    """At most ``m`` pivots: each next one is the point farthest from those before."""
    if not len(points):
        return points
    chosen, near = [0], gauge.gauge(points[:1], points)[0]
    while len(chosen) < m:
        k = int(np.nanargmax(near)) if not np.isnan(near).all() else 0
        if not near[k] > 0:
            break
        chosen.append(k)
        near = np.minimum(near, gauge.gauge(points[k:k + 1], points)[0])
    return points[chosen]


class PivotIndex:
    """``train(key, vec[, label])`` in cells and blocks around pivots."""

    def __init__(self, train: DataFrame, metric: str = "chebyshev", p: float = 2.0, block_rows: int = 2048, pivots: int = PIVOTS):
        self.train, self.block_rows, self.gauge = train, block_rows, Gauge(metric, p)
        size = F.size("vec")
        n, low, high = train.agg(F.count(F.lit(1)), F.min(size), F.max(size)).first()
        if low != high:
            raise ValueError("vectors of different lengths")
        first = train.select("vec").orderBy(F.xxhash64("key"), "key").limit(SAMPLE).toArrow()      # bounded
        self.rows, self.sample = n, _matrix(first.column("vec"))
        self.block_rows = block_rows = max(block_rows, math.ceil(n / BLOCKS))
        self.pivots = farthest_first(self.sample, min(pivots, math.ceil(n / CELL_ROWS)), self.gauge)
        self.key_type = dict(train.dtypes)["key"]
        label = F.col("label").cast("double") if "label" in train.columns else F.lit(None).cast("double")
        rows = train.select("key", "vec", label.alias("label"))
        gauge, pv = self.gauge, self.pivots

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                V = _matrix(b.column("vec"))
                d = np.nan_to_num(np.concatenate([gauge.gauge(V[a:a + 256], pv) for a in range(0, len(V), 256)]), nan=np.inf) if b.num_rows else np.zeros((0, 1))
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])],
                                                 names=["key", "vec", "label", "cell", "at"])

        schema = f"key {self.key_type}, vec array<double>, label double, cell int, at double"
        parts = int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        placed = rows.mapInArrow(assign, schema).repartitionByRange(parts, "cell", "at", "key").sortWithinPartitions("cell", "at", "key")
        place = F.monotonically_increasing_id()          # partition, then row in it
        row = place.bitwiseAND(F.lit((1 << 33) - 1))
        self.table = cut_lineage(placed.withColumn("part", place - row + F.floor(row / block_rows)))
        self.blocks = self.table.groupBy("cell", "part").agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.count(F.lit(1)).alias("n"))
        held = self.blocks.select("cell", "part", "lo", "hi").orderBy("cell", "part").toArrow()          # bounded
        self.cell, self.part, self.lo, self.hi = (held.column(c).to_numpy() for c in ("cell", "part", "lo", "hi"))
        self.far = np.full(len(self.pivots), -np.inf)
        np.maximum.at(self.far, self.cell, self.hi)

    def bound(self, queries: DataFrame, k: int) -> DataFrame:
        """``(q_key, vec, r, home)``: each query's bound by the sample and the cell of its nearest pivot."""
        gauge, pv, far, sample = self.gauge, self.pivots, self.far, self.sample

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for s in range(0, b.num_rows, 64):       # 64 x 512: what a core's cache holds
                    part = b.slice(s, 64)
                    Q = _matrix(part.column("vec"))
                    d = np.nan_to_num(gauge.gauge(Q, pv), nan=np.inf)
                    if len(sample) >= k:
                        d_s = np.concatenate([gauge.distance(Q, sample[a:a + 512]) for a in range(0, len(sample), 512)], axis=1)
                        r = np.partition(np.nan_to_num(d_s, nan=np.inf), k - 1, axis=1)[:, k - 1]
                    else:
                        r = np.full(len(Q), np.inf)
                    home = np.argmin(np.where(np.isfinite(far), d, np.inf), axis=1)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(r, pa.float64()), pa.array(home.astype(np.int32))], names=["q_key", "vec", "r", "home"])

        parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))          # a file may be one split
        return queries.select("key", "vec").repartition(parts).mapInArrow(run, f"q_key {dict(queries.dtypes)['key']}, vec array<double>, r double, home int")

    def _seen(self, Q: np.ndarray, r: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Cell by cell: ``(cell, queries, blocks, gap)``, the queries whose bound reaches the cell and their gaps ``[query, block]`` (within reach: 0 or more, else NaN)."""
        d = np.nan_to_num(self.gauge.gauge(Q, self.pivots), nan=np.inf)
        reach = self.gauge.reach(r)
        first = np.searchsorted(self.cell, np.arange(len(self.pivots) + 1))
        near = (d - self.far[None, :] <= reach[:, None]) & (self.far[None, :] > -np.inf)
        for c in np.flatnonzero(near.any(axis=0)):
            q, blocks = np.flatnonzero(near[:, c]), np.arange(first[c], first[c + 1])
            gap = _gap(d[q, c][:, None], self.lo[blocks][None, :], self.hi[blocks][None, :])
            yield int(c), q, blocks, np.where(gap <= reach[q][:, None], gap, np.nan)

    def cells(self, queries: DataFrame, k: int, bounded: bool = False) -> DataFrame:
        """``(q_key, cell)``: the cells within a query's bound; ``bounded``: ``queries`` bring their ``r``."""
        return self._each(queries, k, bounded, lambda c, q, blocks, gap: (q, np.full(len(q), c)), "cell")

    def visits(self, queries: DataFrame, k: int) -> DataFrame:
        """``(q_key, part)``: every block within a query's bound."""
        part = self.part

        def of(c, q, blocks, gap):
            i, j = np.nonzero(gap >= 0)
            return q[i], part[blocks[j]]

        return self._each(queries, k, False, of, "part")

    def _each(self, queries: DataFrame, k: int, bounded: bool, of, name: str) -> DataFrame:
        key_type = dict(queries.dtypes)["key"]
        rows = queries.select(F.col("key").alias("q_key"), "vec", "r") if bounded else self.bound(queries, k).select("q_key", "vec", "r")
        index = self._light()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for s in range(0, b.num_rows, 256):
                    part = b.slice(s, 256)
                    for seen in index._seen(_matrix(part.column("vec")), part.column("r").to_numpy(zero_copy_only=False)):
                        q, x = of(*seen)
                        yield pa.RecordBatch.from_arrays([part.column("q_key").take(pa.array(q)), pa.array(x.astype(np.int64))], names=["q_key", name])

        return rows.mapInArrow(run, f"q_key {key_type}, {name} long")

    def _light(self) -> PivotIndex:
        """The index without its frames, for tasks."""
        out = object.__new__(PivotIndex)
        for name in ("gauge", "pivots", "cell", "part", "lo", "hi", "far"):
            setattr(out, name, getattr(self, name))
        return out

    def grouped(self, queries: DataFrame, k: int) -> tuple[DataFrame, int]:
        """``(group, q_key, vec, r)``, written once, and the number of groups: a small cell's queries stay together, a large one's are dealt by key."""
        spark = queries.sparkSession
        rows = cut_lineage(self.bound(queries, k))
        count = np.zeros(len(self.pivots), dtype=np.int64)
        for r in rows.groupBy("home").count().collect():                 # one row per pivot
            count[r[0]] = r[1]
        n = int(count.sum())
        most = max(1, min(GROUP_ROWS, GROUP_BEST // k))
        groups = max(math.ceil(n / most), min(spark.sparkContext.defaultParallelism, math.ceil(n / 256)), 1)
        size = max(1, math.ceil(n / groups))
        start, width = np.zeros(len(count), dtype=np.int64), np.ones(len(count), dtype=np.int64)
        group, room = 0, size
        for c in _chain(self.pivots, self.gauge):
            if count[c] > room and room < size:
                group, room = group + 1, size
            start[c], width[c] = group, max(1, math.ceil(count[c] / size))
            if count[c] >= room:
                group, room = group + int(width[c]), size
            else:
                room -= count[c]
        first, wide = (F.element_at(F.lit([int(x) for x in v]), F.col("home") + 1) for v in (start, width))
        return rows.select((first + F.pmod(F.xxhash64("q_key"), wide)).cast("int").alias("group"), "q_key", "vec", "r"), group + 1

    def wanted(self, rows: DataFrame) -> DataFrame:
        """``(group, cell, part, gap)``: the blocks that a query of the group may need, with the smallest gap."""
        index = self._light()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                of = b.column("group").to_numpy()
                for g in np.unique(of):
                    mine = np.flatnonzero(of == g)
                    Q, r = _matrix(b.column("vec").take(pa.array(mine))), b.column("r").to_numpy()[mine]
                    least = np.full(len(index.part), np.inf)
                    for s in range(0, len(Q), 256):
                        for _, _, blocks, gap in index._seen(Q[s:s + 256], r[s:s + 256]):
                            least[blocks] = np.fmin(least[blocks], np.fmin.reduce(gap, axis=0))
                    at = np.flatnonzero(least < np.inf)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), g, dtype=np.int32)), pa.array(index.cell[at]), pa.array(index.part[at]), pa.array(least[at])],
                                                     names=["group", "cell", "part", "gap"])

        return rows.mapInArrow(run, "group int, cell int, part long, gap double").groupBy("group", "cell", "part").agg(F.min("gap").alias("gap"))

    def meet(self, rows: DataFrame, groups: int, k: int) -> DataFrame:
        """The best ``k`` rows of every query: ``(q_key, n_key, distance, label)``."""
        key_type = dict(rows.dtypes)["q_key"]
        blank = F.lit(None)
        wanted = cut_lineage(self.wanted(rows))
        if wanted.count() <= FEW:                        # 24 bytes a row: the blocks stay where they lie
            wanted = F.broadcast(wanted)
        t = self.table.join(wanted, ["cell", "part"]).select("group", "gap", "cell", "part", blank.cast(key_type).alias("q_key"), F.col("key").alias("n_key"), "vec", blank.cast("double").alias("r"), "label")
        q = rows.select("group", F.lit(-1.0).alias("gap"), F.lit(-1).alias("cell"), F.lit(-1).cast("long").alias("part"), "q_key", blank.cast(self.key_type).alias("n_key"), "vec", "r", blank.cast("double").alias("label"))
        dealt = q.unionByName(t).repartitionById(groups, "group").sortWithinPartitions("group", "gap", "cell", "part")
        index = self._light()
        return dealt.mapInArrow(lambda it: _stream(it, index, k), f"q_key {key_type}, n_key {self.key_type}, distance double, label double")

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """``(q_key, rank, n_key, distance[, label])``."""
        if not len(self.pivots):
            found = queries.sparkSession.createDataFrame([], f"q_key {dict(queries.dtypes)['key']}, n_key {self.key_type}, distance double, label double")
        else:
            found = self.meet(*self.grouped(queries, k), k)
        w = Window.partitionBy("q_key").orderBy("distance", "n_key")
        out = found.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
        if "label" in self.train.columns:
            out = out.withColumn("label", F.col("label").cast(dict(self.train.dtypes)["label"]))
            return out.select("q_key", "rank", "n_key", "distance", "label")
        return out.select("q_key", "rank", "n_key", "distance")


def knn(train: DataFrame, queries: DataFrame, k: int, metric: str = "chebyshev", p: float = 2.0, block_rows: int = 2048) -> DataFrame:
    """Exact k nearest training rows for every query.

    ``train``: (key, vec[, label]); ``queries``: (key, vec).  Returns
    (q_key, rank 1..k, n_key, distance[, label]).  Ties by training key.  The
    cosine distance of a zero vector to any vector is 1.
    """
    return PivotIndex(train, metric, p, block_rows).search(queries, k)


def _gap(at, lo, hi):
    """The least distance that the triangle inequality leaves between a query at ``at`` from a pivot and the ring ``lo .. hi``."""
    return np.maximum(np.maximum(at - hi, lo - at), 0.0)


def _chain(pivots: np.ndarray, gauge: Gauge) -> list[int]:
    """The pivots in an order in which each is followed by the nearest one left."""
    out, left = [0], set(range(1, len(pivots)))
    d = gauge.gauge(pivots, pivots)
    while left:
        out.append(min(left, key=lambda c: d[out[-1], c]))
        left.remove(out[-1])
    return out


def _pairs(gauge: Gauge, Q, T):
    """Distances of rows ``Q[i]`` and ``T[i]``, term by term as in :func:`_np_dist`."""
    if gauge.metric == "cosine":
        n = np.sqrt((Q * Q).sum(1)) * np.sqrt((T * T).sum(1))
        return 1.0 - np.divide((Q * T).sum(1), n, out=np.zeros(len(Q)), where=n > 0)
    out = np.zeros(len(Q))
    for s in range(0, len(Q), PIECE):
        x = np.abs(Q[s:s + PIECE] - T[s:s + PIECE])
        out[s:s + PIECE] = _np_dist(gauge.metric, gauge.p, np.zeros((1, x.shape[1])), x)[0]
    return out


class _Moments:
    """What tells from matrix products that a Minkowski distance of order 3, 4 or 5 passes a bound.

    The sums ``S(n)`` of the n-th powers of the differences are polynomials in the coordinates for even n, and log-convex
    in n (Hoelder): ``S3^2 >= S4^3 / S6`` and ``S5^2 >= S4^3 / S2``.  Products are in single precision; ``slack`` bounds their
    rounding, so the test only errs on the side of more candidates."""

    NEED = {3.0: (4, 6), 4.0: (4,), 5.0: (4, 2)}

    def __init__(self, p: float, T: np.ndarray):
        self.p, self.scale = p, float(np.abs(T).max()) or 1.0
        t = T / self.scale
        self.rows = {n: (np.hstack([t ** k for k in range(1, n)]).astype(np.float32).T.copy(), (t ** n).sum(axis=1)) for n in self.NEED[p]}

    def far(self, Q: np.ndarray, limit: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """``(first row, [query, row])``, block by block: True where the distance is above the query's limit."""
        q, most = Q / self.scale, limit / self.scale
        own = {n: (np.hstack([(-1) ** k * math.comb(n, k) * q ** (n - k) for k in range(1, n)]).astype(np.float32), (q ** n).sum(axis=1)) for n in self.rows}
        with np.errstate(over="ignore", invalid="ignore"):
            power = (most ** (2 * self.p if len(own) > 1 else self.p) * (1 + 1e-5)).astype(np.float32)[:, None]
            for lo in range(0, len(next(iter(self.rows.values()))[1]), 1024):
                sums = {}
                for n, (a, q_n) in own.items():
                    b, t_n = self.rows[n]
                    t_n = t_n[lo:lo + 1024]
                    slack = (a.shape[1] + 16) * 1.2e-7 * 2.0 ** (n - 1)      # sum of |q|^n + |t|^n times this bounds the rounding
                    side = -slack if n == 4 else slack
                    x = a @ b[:, lo:lo + 1024]
                    x += (q_n * (1 + side)).astype(np.float32)[:, None]
                    x += (t_n * (1 + side)).astype(np.float32)
                    sums[n] = x
                least = np.maximum(sums.pop(4), 0.0)
                if sums:
                    other = sums.popitem()[1]
                    other *= power
                    yield lo, least * least * least > other
                else:
                    yield lo, least > power


class _Screen:
    """Candidate pairs within the queries' bounds among the rows ``T`` of a piece."""

    def __init__(self, gauge: Gauge, T: np.ndarray, queries: int):
        self.gauge, self.T = gauge, T
        self.box = gauge.metric == "chebyshev" and len(T) >= 256 and queries >= 64 and T.shape[1] > 0 and np.isfinite(T).all()
        if self.box:                                     # bit sets of the rows below each cut, dimension by dimension
            inner = np.sort(T, axis=0)[np.linspace(0, len(T) - 1, CUTS).astype(int)[1:-1]]
            self.cuts = np.vstack([np.full(T.shape[1], -np.inf), inner, np.full(T.shape[1], np.inf)])
            wide = -(-len(T) // 64) * 64
            below = np.zeros((T.shape[1], len(self.cuts), wide), dtype=bool)
            for j in range(T.shape[1]):
                np.less(T[None, :, j], self.cuts[:, j:j + 1], out=below[j, :, :len(T)])
            self.below = np.packbits(below, axis=-1, bitorder="little").view(np.uint64)
        elif gauge.metric in ("euclidean", "l2"):
            self.V, self.norm = T, (T * T).sum(1)
        elif gauge.metric == "cosine":
            self.V, self.norm = _unit(T), None
        elif gauge.metric == "minkowski" and gauge.p in _Moments.NEED and T.size and np.isfinite(T).all():
            self.moments = _Moments(float(gauge.p), T)

    def within(self, Q: np.ndarray, r: np.ndarray):
        """``(query, row, distance)`` of the pairs within ``r``."""
        limit = r * (1 + 1e-9) + 1e-12
        parts = [self._box(Q, limit)] if self.box else [self._dense(Q[s:s + 128], limit[s:s + 128], s) for s in range(0, len(Q), 128)]
        return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def _checked(self, Q, limit, q, t):
        found = []
        for s in range(0, len(q), 1 << 16):              # bounded, whatever the bounds let through
            i, j = q[s:s + (1 << 16)], t[s:s + (1 << 16)]
            d = _pairs(self.gauge, Q[i], self.T[j])
            ok = (d <= limit[i]) & np.isfinite(d)
            found.append((i[ok], j[ok], d[ok]))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (q, t, np.zeros(0))

    def _box(self, Q, limit):
        dims = np.arange(Q.shape[1])
        reach = (limit * (1 + 1e-9) + 1e-300)[:, None]
        low, high = Q - reach, Q + reach
        low, high = low - np.abs(low) * 1e-15, high + np.abs(high) * 1e-15
        lo, hi = (np.empty(Q.shape, dtype=np.int64) for _ in range(2))
        for j in dims:
            lo[:, j] = np.maximum(np.searchsorted(self.cuts[:, j], low[:, j], side="right") - 1, 0)
            hi[:, j] = np.minimum(np.searchsorted(self.cuts[:, j], high[:, j], side="right"), len(self.cuts) - 1)
        found, qs, ts, held = [], [], [], 0
        for i in range(len(Q)):
            inside = np.bitwise_and.reduce(self.below[dims, hi[i]] ^ self.below[dims, lo[i]], axis=0)
            words = np.flatnonzero(inside)
            if not len(words):
                continue
            bits = np.unpackbits(inside[words].view(np.uint8).reshape(len(words), 8), axis=1, bitorder="little")
            w, bit = np.nonzero(bits)
            qs.append(np.full(len(w), i))
            ts.append(words[w] * 64 + bit)
            held += len(w)
            if held >= 1 << 16:
                found.append(self._checked(Q, limit, np.concatenate(qs), np.concatenate(ts)))
                qs, ts, held = [], [], 0
        if held:
            found.append(self._checked(Q, limit, np.concatenate(qs), np.concatenate(ts)))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def _dense(self, Q, limit, at: int):
        gauge = self.gauge
        if hasattr(self, "moments") and np.isfinite(Q).all():
            near = [(lo, *np.nonzero(~far)) for lo, far in self.moments.far(Q, limit)]
            q, t = np.concatenate([i for _, i, _ in near]), np.concatenate([j + lo for lo, _, j in near])
            q, t, d = self._checked(Q, limit, q, t)
            return q + at, t, d
        if not hasattr(self, "V"):
            found = []
            for lo in range(0, len(self.T), 256):            # 128 x 256: what a core's cache holds
                D = gauge.distance(Q, self.T[lo:lo + 256])
                q, t = np.nonzero((D <= limit[:, None]) & np.isfinite(D))
                found.append((q + at, t + lo, D[q, t]))
            return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        if gauge.metric == "cosine":
            far = (1.0 - _unit(Q) @ self.V.T) > (limit + 1e-9)[:, None]
        else:
            own = (Q * Q).sum(1)[:, None] + self.norm[None, :]
            far = own - 2.0 * (Q @ self.V.T) - 1e-9 * own > (limit * limit)[:, None]
        q, t = np.nonzero(~far)                          # not-a-number stays a candidate
        q, t, d = self._checked(Q, limit, q, t)
        return q + at, t, d


class _Group:
    """A group's queries and the best ``k`` rows of each so far, by (distance, key)."""

    def __init__(self, index: PivotIndex, k: int, batches: list[pa.RecordBatch]):
        q = pa.Table.from_batches(batches)
        self.index, self.k, self.keys, self.Q = index, k, q.column("q_key").combine_chunks(), _matrix(q.column("vec"))
        self.r = q.column("r").to_numpy().copy()
        self.at = np.nan_to_num(index.gauge.gauge(self.Q, index.pivots), nan=np.inf)
        self.best: list[tuple] = []                      # (query, distance, key, label)
        self.pending, self.held, self.open = 0, 0, []
        self.share = 16 if index.gauge.metric in ("chebyshev", "euclidean", "l2", "cosine") else 2

    def add(self, cell: int, block: int, piece: pa.RecordBatch) -> None:
        """Rows of one block.  Where many queries need them they are gathered to ``PIECE`` rows first: screens are cheap, bare distances are not."""
        gap = _gap(self.at[:, cell], self.index.lo[block], self.index.hi[block])
        active = np.flatnonzero(gap <= self.index.gauge.reach(self.r))
        if self.share * len(active) > len(self.Q):
            self.open.append(piece)
            if sum(p.num_rows for p in self.open) >= PIECE:
                self.flush()
        elif len(active):
            self.screen(active, pa.Table.from_batches([piece]))

    def flush(self) -> None:
        if self.open:
            self.screen(np.arange(len(self.Q)), pa.Table.from_batches(self.open))
            self.open = []

    def screen(self, active: np.ndarray, rows: pa.Table) -> None:
        screen = _Screen(self.index.gauge, _matrix(rows.column("vec")), len(active))
        for s in range(0, len(active), 1024):
            mine = active[s:s + 1024]
            q, t, d = screen.within(self.Q[mine], self.r[mine])
            if len(q):
                t = pa.array(t)
                self.best.append((mine[q], d, rows.column("n_key").take(t).combine_chunks(), rows.column("label").take(t).combine_chunks()))
                self.pending += len(q)
                if self.pending >= max(self.held, 1 << 18):
                    self.settle()

    def settle(self) -> None:
        """Keep the best ``k``; a query that has ``k`` is bounded by its last."""
        if not self.pending:
            return
        q, d = (np.concatenate([b[c] for b in self.best]) for c in (0, 1))
        key, label = (pa.concat_arrays([b[c] for b in self.best]) for c in (2, 3))
        rank = np.empty(len(q), dtype=np.int64)          # the keys' order, whatever their type
        rank[pa.compute.sort_indices(key, null_placement="at_start").to_numpy()] = np.arange(len(q))
        order = np.lexsort((rank, d, q))
        q, d = q[order], d[order]
        first = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
        pos = np.arange(len(q)) - np.repeat(first, np.diff(np.concatenate((first, [len(q)]))))
        keep = pos < self.k
        last = pos == self.k - 1
        self.r[q[last]] = np.minimum(self.r[q[last]], d[last])
        at = pa.array(order[keep])
        self.best, self.pending, self.held = [(q[keep], d[keep], key.take(at), label.take(at))], 0, int(keep.sum())

    def result(self) -> Iterator[pa.RecordBatch]:
        self.flush()
        self.settle()
        for q, d, key, label in self.best:
            yield pa.RecordBatch.from_arrays([self.keys.take(pa.array(q)), key, pa.array(d, pa.float64()), label], names=["q_key", "n_key", "distance", "label"])


def _stream(batches: Iterator[pa.RecordBatch], index: PivotIndex, k: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (group, gap, cell, part), a group's queries before its blocks."""
    now, queries, group = None, [], None
    block = {(int(c), int(p)): i for i, (c, p) in enumerate(zip(index.cell, index.part))}
    for b in batches:
        g, cell, part = (b.column(c).to_numpy() for c in ("group", "cell", "part"))
        edge = np.flatnonzero((np.diff(g) != 0) | (np.diff(cell) != 0) | (np.diff(part) != 0)) + 1
        for s, e in zip(np.concatenate(([0], edge)), np.concatenate((edge, [b.num_rows]))) if b.num_rows else ():
            if g[s] != now:
                if group is not None:
                    yield from group.result()
                now, queries, group = g[s], [], None
            piece = b.slice(s, e - s)
            if cell[s] < 0:
                queries.append(piece)
                continue
            group = group or _Group(index, k, queries)
            group.add(int(cell[s]), block[int(cell[s]), int(part[s])], piece)
    if group is not None:
        yield from group.result()


def knn_classify(train: DataFrame, queries: DataFrame, k: int = 22, metric: str = "chebyshev",
                 p: float = 2.0, threshold: float = 0.5, weights: str = "uniform") -> DataFrame:
    """(key, p_pos, pred): share of positive labels among the k neighbours.

    ``weights="distance"``: weight 1/d; when any neighbour has d = 0, only
    those vote.  ``pred = p_pos > threshold`` (a 50/50 vote gives 0).
    """
    nb = knn(train, queries, k, metric, p)
    y = F.col("label").cast("double")
    if weights == "uniform":
        prob = F.avg(y)
    else:
        zero = F.col("distance") == 0
        prob = F.when(F.count_if(zero) > 0,
                      F.sum(F.when(zero, y)) / F.count_if(zero)).otherwise(
            F.sum(y / F.col("distance")) / F.sum(F.lit(1.0) / F.col("distance")))
    return (nb.groupBy(F.col("q_key").alias("key")).agg(prob.alias("p_pos"))
            .withColumn("pred", (F.col("p_pos") > threshold).cast("int")))


def knn_k_sweep(neighbors: DataFrame, truth: DataFrame, ks: list[int], weights: list[str] | str = "uniform",
                threshold: float = 0.5) -> DataFrame:
    """Accuracy for every k and vote weighting from one ranked neighbour list (max k), via running sums.

    ``neighbors``: (q_key, rank, distance, label); ``truth``: (key, label).
    Returns (k, weights, accuracy, n).  Running sums are windows per query (k
    rows each); all weightings come from the same pass.
    """
    weights = [weights] if isinstance(weights, str) else weights
    w = Window.partitionBy("q_key").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    y = F.col("label").cast("double")
    zero = (F.col("distance") == 0).cast("double")
    run = neighbors.select(
        "q_key", "rank",
        F.sum(y).over(w).alias("sy"),
        F.sum(zero).over(w).alias("z"), F.sum(zero * y).over(w).alias("zy"),
        F.sum(F.when(F.col("distance") > 0, 1.0 / F.col("distance")).otherwise(0.0)).over(w).alias("sw"),
        F.sum(F.when(F.col("distance") > 0, y / F.col("distance")).otherwise(0.0)).over(w).alias("swy"))
    run = run.where(F.col("rank").isin(*ks))
    share = {"uniform": F.col("sy") / F.col("rank"),
             "distance": F.when(F.col("z") > 0, F.col("zy") / F.col("z")).otherwise(F.col("swy") / F.col("sw"))}
    t = truth.select(F.col("key").alias("q_key"), F.col("label").alias("y_true"))
    right = [F.avg(((share[x] > threshold).cast("int") == F.col("y_true")).cast("double")).alias(x) for x in weights]
    scored = run.join(t, "q_key").groupBy(F.col("rank").alias("k")).agg(*right, F.count(F.lit(1)).alias("n"))
    return scored.unpivot(["k", "n"], weights, "weights", "accuracy").select("k", "weights", "accuracy", "n")
