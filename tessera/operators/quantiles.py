"""Exact quantiles (linear interpolation, NULL ignored) without a global sort.

Spark's exact ``percentile`` aggregate keeps a value->count map whose final
merge lands in a single task; on a 100 TB column that map is the whole
column.  Instead each requested order statistic is found by bracketing:

1. ``percentile_approx`` (a mergeable sketch, partial aggregation per task)
   gives a value bracket around the wanted rank, with a margin of twice the
   sketch's rank error.
2. One counting pass gives the exact number of values below and inside each
   bracket plus an approximate distinct count.  If the sketch missed, the
   bracket moves to the side that holds the rank.
3. When a bracket holds few *distinct* values, its ``(value, count)`` pairs
   are collected (bounded by ``max_exact``) and the rank is read off the
   cumulative counts.  A bracket that is one repeated value (a hot value may
   hold a third of all rows) resolves immediately.  A bracket that the
   sketch no longer narrows is halved by value until it does; the size test
   is never passed over (``max_exact`` must be 32 or more).

Every pass is a map-side-combined aggregate over the long ``(column, value)``
form, so all columns and all quantiles share the same scans.  Each narrowing
round shrinks a bracket by about ``accuracy / 4``; 10^12 values need about
three rounds.
"""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ACCURACY = 10000


@dataclass
class _Target:
    tid: int
    column: str
    rank: int            # 0-based order statistic wanted
    lo: float            # bracket, inclusive both ends
    hi: float
    below: int           # exact count of values < lo
    inside: int          # exact count of values in [lo, hi]
    ndv: int             # approximate distinct values in [lo, hi]
    value: float | None = None
    halve: bool = False  # the sketch no longer narrows this bracket: halve it by value


def to_long(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column STRING, value DOUBLE) rows; NULL and NaN are missing and dropped."""
    casted = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    long = casted.unpivot([], columns, "column", "value")
    return long.where(F.col("value").isNotNull() & ~F.isnan("value"))


def _clean(c: str):
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x), x)


def column_stats(df: DataFrame, columns: list[str], probs: list[float] = (), delta: float = 0.0) -> dict:
    """count / min / max / approx distinct per column and -- in the same pass --
    sketch values at ``q - delta`` and ``q + delta`` for each wanted q.  One
    global aggregate over the wide columns (no unpivot, no grouping shuffle)."""
    aggs = []
    pts = [min(1.0, max(0.0, x)) for q in probs for x in (q - delta, q + delta)]
    for i, c in enumerate(columns):
        x = _clean(c)
        aggs += [F.count(x).alias(f"n{i}"), F.min(x).alias(f"mn{i}"), F.max(x).alias(f"mx{i}"),
                 F.approx_count_distinct(x).alias(f"d{i}")]
        if pts:
            aggs.append(F.percentile_approx(x, F.array(*[F.lit(v) for v in pts]), _ACCURACY).alias(f"s{i}"))
    r = df.agg(*aggs).collect()[0]
    out = {}
    for i, c in enumerate(columns):
        if r[f"n{i}"]:
            out[c] = {"n": r[f"n{i}"], "mn": r[f"mn{i}"], "mx": r[f"mx{i}"], "ndv": r[f"d{i}"],
                      "sk": r[f"s{i}"] if pts else None}
    return out


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float],
                    max_exact: int = 50_000, persist: bool = False) -> dict[str, dict]:
    """Return ``{column: {"n", "min", "max", q: value for q in probs}}``.

    Linear interpolation between the order statistics at ``pos = (n-1)*q``
    (the rule of ``percentile``, ``quantile_cont`` and pandas ``quantile``).
    Usually three passes: stats + sketch, bracket counts, exact resolve.
    Only one small row per column / per wanted rank reaches the driver.
    """
    spark = df.sparkSession
    long = to_long(df, columns)
    if persist:
        long = long.persist()
    delta = 3.0 / _ACCURACY
    stats = column_stats(df, columns, probs, delta)

    targets: list[_Target] = []
    needed: dict[tuple[str, int], _Target] = {}
    for c in columns:
        s = stats.get(c)
        if s is None:
            continue
        n = s["n"]
        for qi, q in enumerate(probs):
            pos = (n - 1) * q
            for r in sorted({int(math.floor(pos)), int(math.ceil(pos))}):
                if (c, r) in needed:
                    continue
                t = _Target(len(targets), c, r, s["mn"], s["mx"], 0, n, s["ndv"])
                if r == 0:
                    t.value = s["mn"]
                elif r == n - 1 or s["mn"] == s["mx"]:
                    t.value = s["mx"]
                elif n > max_exact and s["ndv"] * 1.1 + 16 > max_exact:
                    t.lo, t.hi = s["sk"][2 * qi], s["sk"][2 * qi + 1]     # sketch bracket, counts unknown
                    t.inside = -1
                needed[(c, r)] = t
                targets.append(t)

    pending = [t for t in targets if t.value is None and t.inside < 0]
    if pending:
        _count_brackets(df, pending, stats)

    rounds = 0
    while True:
        open_ = [t for t in targets if t.value is None]
        if not open_:
            break
        rounds += 1
        # few enough by the exact row count, or by the approximate count of distinct values with its error and some slack
        small = [t for t in open_ if t.inside <= max_exact or t.ndv * 1.1 + 16 <= max_exact or not t.lo < _middle(t) < t.hi]
        large = [t for t in open_ if t not in small]
        for t in large:
            t.halve = t.halve or rounds > 12
        if small:
            _resolve_small(long, spark, small)
        if large:
            _narrow(long, spark, large)

    if persist:
        long.unpersist()
    out: dict[str, dict] = {}
    for c in columns:
        s = stats.get(c)
        if s is None:
            out[c] = {"n": 0, "min": None, "max": None, **{q: None for q in probs}}
            continue
        n = s["n"]
        res = {"n": n, "min": s["mn"], "max": s["mx"]}
        for q in probs:
            pos = (n - 1) * q
            lo_r, hi_r = int(math.floor(pos)), int(math.ceil(pos))
            lo_v, hi_v = needed[(c, lo_r)].value, needed[(c, hi_r)].value
            res[q] = lo_v + (hi_v - lo_v) * (pos - lo_r)
        out[c] = res
    return out


def _count_brackets(df: DataFrame, targets: list[_Target], stats: dict) -> None:
    """Exact counts below / inside each sketch bracket: one global aggregate
    of conditional counts over the wide columns."""
    aggs = []
    for t in targets:
        x = _clean(t.column)
        inside = (x >= F.lit(t.lo)) & (x <= F.lit(t.hi))
        aggs += [F.count_if(x < F.lit(t.lo)).alias(f"b{t.tid}"), F.count_if(inside).alias(f"i{t.tid}"),
                 F.approx_count_distinct(F.when(inside, x)).alias(f"d{t.tid}")]
    r = df.agg(*aggs).collect()[0]
    for t in targets:
        below, inside = r[f"b{t.tid}"], r[f"i{t.tid}"]
        if below <= t.rank < below + inside:
            t.below, t.inside, t.ndv = below, inside, r[f"d{t.tid}"]
            if t.lo == t.hi:
                t.value = t.lo
        else:                        # sketch missed the rank: fall back to the whole range
            s = stats[t.column]
            t.lo, t.hi, t.below, t.inside, t.ndv = s["mn"], s["mx"], 0, s["n"], s["ndv"]


def _in_bracket(long: DataFrame, spark, targets: list[_Target]) -> DataFrame:
    # one row per wanted order statistic: at most len(columns)*len(probs)*2
    # rows, so broadcasting it is size-bounded by construction
    rows = [(t.tid, t.column, float(t.lo), float(t.hi)) for t in targets]
    tf = F.broadcast(spark.createDataFrame(rows, "tid INT, column STRING, lo DOUBLE, hi DOUBLE"))
    return (long.join(tf, "column")
            .where((F.col("value") >= F.col("lo")) & (F.col("value") <= F.col("hi")))
            .select("tid", "value"))


def _resolve_small(long: DataFrame, spark, targets: list[_Target]) -> None:
    """Collect (column, value, count) of the distinct values inside the
    brackets (bounded by ``max_exact`` per bracket) and walk the counts."""
    from functools import reduce
    cond = reduce(lambda a, b: a | b, [(F.col("column") == t.column) & (F.col("value") >= F.lit(t.lo))
                                       & (F.col("value") <= F.lit(t.hi)) for t in targets])
    pairs = long.where(cond).groupBy("column", "value").count().collect()
    by_col: dict[str, list] = {}
    for r in pairs:
        by_col.setdefault(r["column"], []).append((r["value"], r["count"]))
    for vals in by_col.values():
        vals.sort()
    for t in targets:
        walk = t.below
        for v, n in by_col.get(t.column, []):
            if v < t.lo or v > t.hi:
                continue
            walk += n
            if walk > t.rank:
                t.value = v
                break


def _order(x: float) -> int:
    """Doubles as integers of the same order."""
    k = struct.unpack("<q", struct.pack("<d", x))[0]
    return k if k >= 0 else -(k & (1 << 63) - 1)


def _middle(t: _Target) -> float:
    """The double in the middle of the doubles of a bracket: at most 64 halvings to one value."""
    k = (_order(t.lo) + _order(t.hi)) // 2
    return struct.unpack("<d", struct.pack("<Q", k if k >= 0 else -k | 1 << 63))[0]


def _narrow(long: DataFrame, spark, targets: list[_Target]) -> None:
    inside = _in_bracket(long, spark, targets).persist()
    aggs = []
    for t in targets:
        rel = t.rank - t.below
        margin = 2.0 * t.inside / _ACCURACY + 1
        qa = max(0.0, (rel - margin) / t.inside)
        qb = min(1.0, (rel + margin) / t.inside)
        aggs.append(F.percentile_approx(F.when(F.col("tid") == t.tid, F.col("value")),
                                        F.array(F.lit(qa), F.lit(qb)), _ACCURACY).alias(f"t{t.tid}"))
    row = inside.agg(*aggs).collect()[0]
    cand = {t.tid: (_middle(t),) * 2 if t.halve else (row[f"t{t.tid}"][0], row[f"t{t.tid}"][1]) for t in targets}

    counts = []
    for t in targets:
        lo, hi = cand[t.tid]
        sel = F.col("tid") == t.tid
        v = F.col("value")
        counts += [F.count_if(sel & (v < lo)).alias(f"a{t.tid}"),
                   F.count_if(sel & (v <= lo)).alias(f"b{t.tid}"),
                   F.count_if(sel & (v < hi)).alias(f"c{t.tid}"),
                   F.count_if(sel & (v <= hi)).alias(f"d{t.tid}"),
                   F.approx_count_distinct(F.when(sel & (v >= lo) & (v <= hi), v)).alias(f"n{t.tid}"),
                   F.approx_count_distinct(F.when(sel & (v >= t.lo) & (v <= lo), v)).alias(f"l{t.tid}"),
                   F.approx_count_distinct(F.when(sel & (v >= hi) & (v <= t.hi), v)).alias(f"h{t.tid}")]
    crow = inside.agg(*counts).collect()[0]
    inside.unpersist()
    for t in targets:
        lo, hi = cand[t.tid]
        lt_lo, le_lo = t.below + crow[f"a{t.tid}"], t.below + crow[f"b{t.tid}"]
        lt_hi, le_hi = t.below + crow[f"c{t.tid}"], t.below + crow[f"d{t.tid}"]
        if lt_lo <= t.rank < le_hi:
            new = (lo, hi, lt_lo, le_hi - lt_lo, crow[f"n{t.tid}"])
        elif t.rank < lt_lo:
            new = (t.lo, lo, t.below, le_lo - t.below, crow[f"l{t.tid}"])
        else:
            new = (hi, t.hi, lt_hi, t.below + t.inside - lt_hi, crow[f"h{t.tid}"])
        if new[0] == new[1]:
            t.value = new[0]                    # the bracket is one (possibly hot) value
            continue
        t.halve = t.halve or new[3] >= t.inside
        t.lo, t.hi, t.below, t.inside, t.ndv = new
