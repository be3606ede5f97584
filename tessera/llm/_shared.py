"""Written tables in the shared folder, plan-friendly helpers and connected components.

Every intermediate that is read twice is written as Parquet below the folder
that ``spark.checkpoint.dir`` names, so a lost executor costs only the tasks
it was running.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import checkpoint_dir


BATCH_ROWS = 1000
#: tables of at most so many narrow rows are broadcast; a task of a table of known length gets so many rows
FEW = 200_000
TASK_ROWS = 25_000
LEAST_TASKS = 8


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH_ROWS`` rows in this session: a task holds whole batches, and rows carry whole texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


class Scratch:
    """Tables of one operator call, in a folder of their own in the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark = spark
        self.base = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.base}/{name}-{self._n}"

    def write(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """Write ``df`` and read it back: one job, no lineage behind the result.  ``rows``: at most so many, not worth more tasks than they need."""
        p = self.path(name)
        if rows is not None:
            df = df.coalesce(tasks(rows))
        df.write.parquet(p)
        out = self.spark.read.schema(df.schema).parquet(p)
        out._scratch_path = p
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a superseded table written by :meth:`write`."""
        self._delete(df._scratch_path)

    def clear(self) -> None:
        """Delete every table of the call, once what is read of them has been written elsewhere."""
        self._delete(self.base)

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def tasks(rows: int) -> int:
    return max(LEAST_TASKS, -(-rows // TASK_ROWS))


def own(df: DataFrame, *wanted: str) -> DataFrame:
    """The wanted columns only, so that extra columns can not clash with an operator's own names."""
    return df.select(*[F.col(f"`{c}`") for c in wanted])


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def components(spark: SparkSession, scratch: Scratch, edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)`` (longs): root is the smallest reachable node.

    Alternating large-star and small-star steps.  Both only take minima and
    rewire edges, so each is one grouped minimum and one join, whatever the
    degree of a node.  Ends when a round changes no edge.  The minima of at most
    ``FEW`` edges (16 bytes each) are broadcast, and no step has more tasks than its edges need.
    """
    e = scratch.write(edges.where("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    rows = e.count()

    def minima(x: DataFrame) -> DataFrame:
        # both directions of an edge at most
        return F.broadcast(x.coalesce(tasks(2 * rows))) if rows <= FEW else x

    before = None
    while True:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        low = minima(low.select("u", F.least("u", "m").alias("m")))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.write(large, "large", rows)
        low = minima(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")
        ).select("x.u", "x.v").where("u > v").distinct()
        new = scratch.write(small, "small", 2 * rows)
        state = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(large)
        scratch.drop(e)
        e, rows = new, state[0]
        if state == before:
            break
        before = state
    stars = e.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return stars.union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
