"""The named queries of this subpackage over a folder of tables, and the SQL of those that have it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.llm import decontaminate, language, mixing, near_dedup, negatives, packing, quality, repeats, secrets, shallot, sharding, sql, topk, toxicity

TOKENIZER = "byte_bpe_50k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {
    "op1_near_duplicates": sql.NEAR_DUPLICATES,
    "op2_host_rules": sql.host_rules(quality.RULES, quality.BASE_FAILED),
    "op9_top_k": sql.TOP_K,
    "op11_hard_negatives": sql.HARD_NEGATIVES,
    "op12_clusters": sql.clusters(shallot.CENTROIDS, shallot.ROUNDS),
    "op13_decontaminate": sql.DECONTAMINATE,
}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register
def op1_near_duplicates(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@register
def op2_host_rules(spark, sf_dir):
    out = quality.host_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *quality.MEASURES, "base_failed", "kept")


@register
def op3_language(spark, sf_dir):
    found = language.identify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


@register
def op4_entropy_mix(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mixing.mix(mixing.with_size(docs).drop("text"))
    taken = (F.col("copies") * F.col("size")).alias("taken")
    rows = mixed.select("doc_id", "source", "size", "source_size", "target", taken, F.explode(F.expr("sequence(1, n)")).alias("row"))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


@register
def op5_repeats(spark, sf_dir):
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


@register
def op6_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.toxicity(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


@register
def op7_pack(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


@register
def op8_secrets(spark, sf_dir):
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    count = lambda k: F.expr(f"CAST(size(filter(found, x -> x.kind = '{k}')) AS LONG)").alias(f"n_{k}")
    shown = "concat_ws(',', transform({}, x -> concat_ws(':', x.kind, x.start, x.end)))"
    base = shown.format("filter(found, x -> x.kind != 'markov')")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.expr(f"sha2({base}, 256)").alias("base_sha256"), F.expr(shown.format("found")).alias("spans"))


@register
def op9_top_k(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"))


@register
def op10_shards(spark, sf_dir):
    dealt = sharding.shards(table(spark, sf_dir, "documents").select("doc_id", "text"))
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")))
    return dealt.select("doc_id", "size", crc.alias("text_crc32"), F.lit(sharding.LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@register
def op11_hard_negatives(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors.withColumn("label", shifted))


@register
def op12_clusters(spark, sf_dir):
    return shallot.with_inertia(*shallot.clusters(table(spark, sf_dir, "embeddings")))


@register
def op13_decontaminate(spark, sf_dir):
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register
def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
