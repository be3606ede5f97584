"""Deterministic splits keyed by a row key (Spark has no row position).

* ``stratified_split`` -- exact class quotas (largest-remainder apportionment
  of the train size, as the common ``train_test_split(stratify=...)``
  does), test rows are the first ``q_c`` of each class in ``(md5(key||seed),
  key)`` order.  A window ``partition by class order by hash`` would sort a
  whole class in one task (a class may hold most rows), so the q_c-th row is
  found by refining on hex prefixes of the hash instead.  The first round,
  a grouped count of ``(class, first 3 hex digits)``, also yields the class
  counts; each later round is one grouped count of ``(class, next 4 hex
  digits)`` among rows still tied on the prefix (at most 65 536 buckets per
  class).  A bucket of at most ``final_rows`` rows is reached within two or
  three rounds even at 10^12 rows; only that bucket is ranked with a window.
  Classes are compared null-safe in their own type (a NULL label is a class),
  and quotas and thresholds stay tables keyed by class, whatever their number.
* ``hash_split`` -- row-local ``md5`` prefix test, stable under repartition.
* ``hash_folds`` -- k folds by hash (no global ordering).
* ``predefined_split`` -- union of a train and a validation frame with a role.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut_lineage

_PREFIX_STEP = 4
_FIRST_STEP = 3          # first level: 4 096 buckets per class (fused with the class counts)
_BROADCAST_CLASSES = 100_000      # class tables of at most this many rows are broadcast, larger ones are joined


def key_hash(key: str, seed: int | str = 42) -> Column:
    """md5 hex of ``cast(key as string) || seed`` (same string in DuckDB)."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed))))


def hash_split(df: DataFrame, key: str, fraction: float = 0.5, seed: int | str = 42,
               column: str = "split", names: tuple[str, str] = ("first", "second")) -> DataFrame:
    """Bernoulli-like split by the first 8 hex digits of the key hash.

    Row goes to ``names[0]`` when ``md5(key||seed)[:8] < hex(fraction * 16^8)``.
    """
    cut = format(int(round(fraction * 16 ** 8)), "08x") if fraction < 1 else "g"
    return df.withColumn(column, F.when(F.substring(key_hash(key, seed), 1, 8) < F.lit(cut),
                                        F.lit(names[0])).otherwise(F.lit(names[1])))


def hash_folds(df: DataFrame, key: str, k: int = 5, seed: int | str = 42, column: str = "fold") -> DataFrame:
    """k folds from the first 8 hex digits of ``md5(key||seed)`` (no global ordering)."""
    h = F.conv(F.substring(key_hash(key, seed), 1, 8), 16, 10).cast("long")
    return df.withColumn(column, F.pmod(h, F.lit(k)).cast("int"))


def predefined_split(train: DataFrame, validation: DataFrame, column: str = "role") -> DataFrame:
    """Train rows get role 'train' (fold -1), validation rows 'val' (fold 0)."""
    return (train.withColumn(column, F.lit("train"))
            .unionByName(validation.withColumn(column, F.lit("val"))))


def largest_remainder(total: int, counts: dict) -> dict:
    """Apportion ``total`` over classes proportionally to ``counts``.

    Floors of ``total * n_c / n`` (exact integer arithmetic), left-over units to
    the largest remainders; ties by class value (deterministic).
    """
    n = sum(counts.values())
    if n == 0:
        return {c: 0 for c in counts}
    base = {c: (total * v) // n for c, v in counts.items()}
    rem = {c: (total * v) % n for c, v in counts.items()}
    need = total - sum(base.values())
    try:                                  # ties by class value in its natural order
        order = sorted(counts, key=lambda c: (-rem[c], c))
    except TypeError:
        order = sorted(counts, key=lambda c: (-rem[c], str(c)))
    for c in order[:need]:
        base[c] += 1
    return base


def stratified_quotas(class_counts: dict, test_fraction: float) -> dict:
    """{class: n_test_c} with n_test = ceil(f*n) and train quotas apportioned first."""
    n = sum(class_counts.values())
    n_test = int(math.ceil(test_fraction * n))
    train = largest_remainder(n - n_test, class_counts)
    return {c: class_counts[c] - train[c] for c in class_counts}


def class_quotas(classes: DataFrame, test_fraction: float) -> DataFrame:
    """``(g, n, q)`` from class counts ``(g, n)``: test rows per class, as ``stratified_quotas``.

    Left-over units go to the first classes in (remainder desc, class) order.
    That rank is the row number inside a range partition of the sorted class
    table plus the sizes of the partitions before it, so no task sees all
    classes; only one count per partition reaches the driver.
    """
    n = classes.agg(F.sum("n")).first()[0] or 0
    if n == 0:
        return classes.select("g", "n", F.lit(0).cast("long").alias("q"))
    total = n - int(math.ceil(test_fraction * n))
    big = lambda c: c.cast("decimal(18,0)")
    share = (big(F.col("n")) * big(F.lit(total))).alias("share")
    c = classes.select("g", "n", share).withColumn("rem", F.col("share") % big(F.lit(n)))
    c = c.withColumn("base", ((F.col("share") - F.col("rem")) / big(F.lit(n))).cast("long"))
    s = cut_lineage(c.orderBy(F.desc("rem"), "g").withColumn("pid", F.spark_partition_id()))
    need, at, before = total - s.agg(F.sum("base")).first()[0], 0, []
    for r in s.groupBy("pid").agg(F.count(F.lit(1)).alias("m")).orderBy("pid").collect():      # one row per partition
        before.append((r["pid"], at))
        at += r["m"]
    offsets = F.broadcast(classes.sparkSession.createDataFrame(before, "pid INT, at LONG"))
    place = F.col("at") + F.row_number().over(Window.partitionBy("pid").orderBy(F.desc("rem"), "g"))
    return (s.join(offsets, "pid").withColumn("place", place)
            .select("g", "n", (F.col("n") - F.col("base") - F.when(F.col("place") <= need, 1).otherwise(0)).alias("q")))


def first_buckets(df: DataFrame, group: str, key: str, seed: int | str = 42) -> DataFrame:
    """(g, b, n): rows per (group, first 3 hex digits of the key hash) -- at most
    4 096 rows per group, whatever the data size."""
    return (df.select(F.col(group).alias("g"), key_hash(key, seed).alias("h"))
            .groupBy("g", F.substring("h", 1, _FIRST_STEP).alias("b")).agg(F.count(F.lit(1)).alias("n")))


def _with_class(df: DataFrame, table: DataFrame, rows: int, how: str = "inner") -> DataFrame:
    """``df(g, ..)`` with the columns of the class table, null-safe on the class; broadcast if it has few rows."""
    t = table.withColumnRenamed("g", "__g")
    return df.join(F.broadcast(t) if rows <= _BROADCAST_CLASSES else t, F.col("g").eqNullSafe(F.col("__g")), how).drop("__g")


def kth_by_hash(df: DataFrame, group: str, key: str, ranks: DataFrame | dict, seed: int | str = 42,
                final_rows: int = 200_000, buckets: DataFrame | None = None) -> DataFrame | dict:
    """``(g, h, k)`` of the row with 0-based rank ``r`` in ``(md5(key||seed), key)``
    order, for each ``(g, r)`` of ``ranks``.  Exact, no full sort.

    ``buckets`` (from ``first_buckets``) saves the first refinement pass.  A
    dict of ranks, for a few classes, gives a dict ``{g: (h, k)}``."""
    if isinstance(ranks, dict):
        table = df.sparkSession.createDataFrame([(g, int(r)) for g, r in ranks.items() if r is not None and r >= 0],
                                                f"g {df.schema[group].dataType.simpleString()}, r LONG")
        return {r["g"]: (r["h"], r["k"]) for r in kth_by_hash(df, group, key, table, seed, final_rows, buckets).collect()}
    base = df.select(F.col(group).alias("g"), F.col(key).alias("k"), key_hash(key, seed).alias("h"))
    # per class: the hash prefix p that holds the wanted row, its rank r among the rows with it, and their number m
    state = cut_lineage(ranks.select("g", "r", F.lit("").alias("p"), F.lit(None).cast("long").alias("m")))
    rows = state.count()
    if buckets is not None and rows:
        state = cut_lineage(_narrow(buckets, state, rows))
    open_ = (F.col("m").isNull() | (F.col("m") > final_rows)) & (F.length("p") < 32)
    while rows and not state.where(open_).isEmpty():
        wide = state.where(open_)
        found = _matching(base, wide, rows).groupBy("g", F.expr(f"substring(h, length(p) + 1, {_PREFIX_STEP})").alias("b")).agg(F.count(F.lit(1)).alias("n"))
        state = cut_lineage(_narrow(found, wide, rows).unionByName(state.where(~open_)))
    w = Window.partitionBy("g").orderBy("h", "k")       # a class has <= final_rows rows here
    return (_matching(base, state, rows).withColumn("rn", F.row_number().over(w) - 1).where("rn = r").select("g", "h", "k"))


def _matching(base: DataFrame, state: DataFrame, rows: int) -> DataFrame:
    return _with_class(base, state.select("g", "p", "r"), rows).where(F.col("h").startswith(F.col("p")))


def _narrow(buckets: DataFrame, state: DataFrame, rows: int) -> DataFrame:
    """The state with the next digits: per class, the bucket that holds the wanted rank (cumulative counts)."""
    # <= 16^4 buckets per class: the cumulative window runs over this small table
    w = Window.partitionBy("g").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = _with_class(buckets.withColumn("cum", F.sum("n").over(w)), state.select("g", "r", "p"), rows)
    before = F.col("cum") - F.col("n")
    return (cum.where((F.col("cum") > F.col("r")) & (before <= F.col("r")))
            .select("g", (F.col("r") - before).alias("r"), F.concat("p", "b").alias("p"), F.col("n").alias("m")))


def stratified_split(df: DataFrame, key: str, label: str, test_fraction: float = 0.2,
                     seed: int | str = 42, column: str = "split",
                     names: tuple[str, str] = ("train", "test")) -> DataFrame:
    """Exact stratified split; adds ``column`` with names[0] (train) / names[1] (test).

    ``key`` must be unique; rows of a NULL label are a class of their own.
    The thresholds are one row per class, joined back with a lexicographic
    ``(hash, key) <= threshold`` test.
    """
    # one pass gives both the class counts and the first-level hash buckets
    buckets = cut_lineage(first_buckets(df, label, key, seed))
    quotas = cut_lineage(class_quotas(buckets.groupBy("g").agg(F.sum("n").alias("n")), test_fraction))
    rows = quotas.count()
    thr = kth_by_hash(df, label, key, quotas.where("q > 0").select("g", (F.col("q") - 1).alias("r")), seed, buckets=buckets)
    thr = cut_lineage(thr).select(F.col("g").alias("__c"), F.col("h").alias("__h"), F.col("k").alias("__k"))
    h = key_hash(key, seed)
    is_test = (h < F.col("__h")) | ((h == F.col("__h")) & (F.col(key) <= F.col("__k")))
    return (df.join(F.broadcast(thr) if rows <= _BROADCAST_CLASSES else thr, F.col(label).eqNullSafe(F.col("__c")), "left")
            .withColumn(column, F.when(F.coalesce(is_test, F.lit(False)), F.lit(names[1])).otherwise(F.lit(names[0])))
            .drop("__c", "__h", "__k"))
