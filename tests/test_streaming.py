"""Streaming forms of the row-local steps give the same rows as batch."""

import tempfile

from pyspark.sql import functions as F

from tessera.operators import fuzzy, scale
from tessera.streaming.scoring import row_local_chain, running_missing_profile, start_scoring_stream


def _source(spark):
    d = tempfile.mkdtemp(prefix="tessera-stream-src-")
    rows = [(i, float(i % 7), float((i * 3) % 11)) for i in range(200)]
    spark.createDataFrame(rows, "key BIGINT, a DOUBLE, b DOUBLE").repartition(4).write.mode("overwrite").parquet(d)
    return d


def test_row_local_chain_stream_equals_batch(spark):
    src = _source(spark)
    batch = spark.read.parquet(src)
    scaler = {"a": (0.0, 6.0), "b": (0.0, 10.0)}
    kw = dict(zero_missing=["a"], bounds={"b": (0.0, 9.0)}, scaler=scaler, centers=[[0.2, 0.2], [0.8, 0.8]],
              features=["a", "b"])
    expect = sorted(map(tuple, row_local_chain(batch, **kw).toPandas().astype(object).where(lambda x: x.notna(), None)
                        .to_numpy().tolist()), key=repr)
    stream = spark.readStream.schema(batch.schema).parquet(src)
    q = row_local_chain(stream, **kw).writeStream.format("memory").queryName("chain_out").start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("select * from chain_out").toPandas().astype(object)
    got = sorted(map(tuple, got.where(got.notna(), None).to_numpy().tolist()), key=repr)
    assert got == expect


def test_running_missing_profile(spark):
    src = _source(spark)
    schema = spark.read.parquet(src).schema
    stream = spark.readStream.schema(schema).parquet(src)
    z = stream.withColumn("a", F.nullif("a", F.lit(0.0)))
    q = running_missing_profile(z, ["a", "b"]).writeStream.outputMode("complete").format("memory") \
        .queryName("miss_out").start()
    q.processAllAvailable()
    q.stop()
    got = {r["column_name"]: (r["n_rows"], r["missing"]) for r in spark.sql("select * from miss_out").collect()}
    assert got == {"a": (200, 29), "b": (200, 0)}


def test_foreach_batch_scoring(spark):
    src = _source(spark)
    schema = spark.read.parquet(src).schema
    sink, ckpt = tempfile.mkdtemp(prefix="tessera-sink-"), tempfile.mkdtemp(prefix="tessera-ck-")
    st = {"a": (0.0, 6.0), "b": (0.0, 10.0)}

    def score(df):
        return fuzzy.memberships(scale.minmax_transform(df, st, ["a", "b"]), ["a", "b"], [[0, 0], [1, 1]])

    q = start_scoring_stream(spark.readStream.schema(schema).parquet(src), score, sink, ckpt)
    q.awaitTermination(120)
    out = spark.read.parquet(sink)
    assert out.count() == 200 and out.where("abs(u0 + u1 - 1) > 1e-9").count() == 0
