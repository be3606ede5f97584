"""One query per operator, over its whole table, with production parameters, and DuckDB SQL where SQL can say it."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import chat_trees, decontaminate, exact_dedup, language_id, licenses, line_dedup, merkle, mixing, near_dup, quality_fm, spelling, token_counts, warc_index


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    """The vocabulary file: ``TOKENIZER_DIR``, or the installed package of public tokenizers."""
    if d := os.environ.get("TOKENIZER_DIR"):
        return os.path.join(d, name)
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_line_dedup(spark, sf):
    out = line_dedup.drop_lines(table(spark, sf, "pages"))
    return out.select("page_id", "host", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


PROBE = "\\### Assistant: </turn> ok"


def conversation_messages(rows: DataFrame) -> DataFrame:
    """Rows by turn as messages: each answers the row before it in its conversation."""
    from pyspark.sql import Window
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    at = rows.select("conv_id", "turn", "role", "text").withColumn("at", F.row_number().over(w))
    name = lambda k: F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), F.lit(":"), k.cast("string"))
    return at.select(name(F.col("at")).alias("id"), F.when(F.col("at") > 1, name(F.col("at") - 1)).alias("parent"), "conv_id", "role", "text", F.lit(0.0).alias("score"))


def op2_chat_trees(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    out = chat_trees.format_trees(conversation_messages(rows.unionByName(probe)))
    turns, loss = chat_trees.read_turns(F.col("formatted")), chat_trees.read_loss(F.col("formatted"), F.col("loss_spans"))
    out = out.select(F.col("tree").alias("conv_id"), turns.alias("turns"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
                      F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


def op3_quality_fm(spark, sf):
    docs = table(spark, sf, "documents")
    return quality_fm.score(docs, quality_fm.fit(docs, table(spark, sf, "labels")))


def op4_warc_index(spark, sf):
    # the table has no capture time: one second per page
    pages = table(spark, sf, "pages").withColumn("ts", F.timestamp_seconds(F.lit(1_600_000_000) + F.col("page_id")))
    return warc_index.archive_and_index(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_exact_dedup(spark, sf):
    return exact_dedup.resolve(table(spark, sf, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


# the target: whole weights of domains and languages; sources share evenly
MIX_LEVELS = ["domain", "lang", "source"]
MIX_WEIGHTS = [("web", 5), ("news", 3), ("books", 2), *[(f"{d}/{lang}", w) for d in ("web", "news", "books") for lang, w in (("en", 4), ("de", 2), ("fr", 2), ("es", 2))]]
MIX_FRACTION = 0.6
MIX_EPOCHS = 2
MIX_SEED = 17


def with_domain(docs: DataFrame) -> DataFrame:
    """The tables have no domain: sources are dealt to three by their number."""
    k = F.coalesce(F.regexp_extract("source", "([0-9]+)$", 1).try_cast("int"), F.lit(0)) % 3
    return docs.withColumn("domain", F.when(k == 0, "web").when(k == 1, "news").otherwise("books"))


def mixed(spark, docs: DataFrame) -> DataFrame:
    weights = spark.createDataFrame(MIX_WEIGHTS, "path string, weight long")
    return mixing.mix(with_domain(docs), MIX_LEVELS, weights, MIX_FRACTION, max_epochs=MIX_EPOCHS, seed=MIX_SEED)


def op6_mixing(spark, sf):
    return mixed(spark, table(spark, sf, "documents")).select("doc_id", "epoch", "leaf", mixing.tokens_of(F.col("text")).alias("n_tokens"))


def op7_near_dup(spark, sf):
    return near_dup.link(table(spark, sf, "documents"), percent=85).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op8_token_counts(spark, sf):
    return token_counts.count_tokens(table(spark, sf, "documents"), tokenizer_file())


def op9_decontaminate(spark, sf):
    out = decontaminate.scan(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def with_paths(docs: DataFrame) -> DataFrame:
    """The tables have no paths: a tree of folders by source, language and id, with a licence file among every 20 files."""
    i = F.coalesce("doc_id", F.lit(0))
    folder = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")))
    sub = F.concat(F.lit("m"), F.pmod(F.floor(i / 20), F.lit(50)).cast("string"))
    name = F.concat(i.cast("string"), F.lit(".txt"))
    return docs.withColumn("path", F.when(i % 100 == 0, F.concat_ws("/", folder, F.concat(F.lit("LICENSE."), i.cast("string"))))
                           .when(i % 20 == 0, F.concat_ws("/", folder, sub, F.concat(F.lit("LICENSE."), i.cast("string"))))
                           .otherwise(F.concat_ws("/", folder, sub, name)))


def op10_licenses(spark, sf):
    return licenses.scan(with_paths(table(spark, sf, "documents")))


def op11_spelling(spark, sf):
    return spelling.group_variants(table(spark, sf, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


def op12_merkle(spark, sf):
    docs = table(spark, sf, "documents")
    tamper = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    out = merkle.manifest(docs, altered={"n_chars": F.col("n_chars") + 1}, tamper=tamper)
    proof = F.sha2(F.array_join(F.col("proof.digest"), "").cast("binary"), 256)
    return out.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", "verified")


def op13_language_id(spark, sf):
    docs = table(spark, sf, "documents")
    return language_id.predict(docs, language_id.fit(docs, tokenizer_file("piece_bpe_32k.model")))


LLM_QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_chat_trees, op3_quality_fm, op4_warc_index, op5_exact_dedup, op6_mixing, op7_near_dup,
                                       op8_token_counts, op9_decontaminate, op10_licenses, op11_spelling, op12_merkle, op13_language_id)}
