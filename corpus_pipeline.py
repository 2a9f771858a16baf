"""From raw documents to packed training sequences, one stage after the other.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; ``run`` writes every
stage's result to the shared folder and reads it again as the next one's documents.

1. toxicity: documents that the classifier rejects go.
2. near duplicates: one document of each group stays, the one with the smallest doc_id.
3. secrets: every secret is replaced by a mark, all documents stay.
4. mix: each document is repeated as often as the mix takes it (not at all included).
5. pack: pieces of fixed windows, as in op7_pack, with their token ids (``packing.sequences`` joins them to padded
   windows).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.llm import mixing, near_dedup, packing, secrets, toxicity
from tickloom.llm.queries import TOKENIZER
from tickloom.llm.staging import staged

#: Bytes of an Arrow batch. Spark's bounds are 10,000 rows and 64 MB, of which every core of an executor holds several
#: copies: vectors that double as they fill, the stream, and the worker's batches in and out.
BATCH_BYTES = 4 << 20
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def bounded(stage: Stage) -> Stage:
    """The session's Arrow batches hold BATCH_BYTES (or one longer row) from here on; what a stage returns runs after it."""
    @wraps(stage)
    def bounded_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        return stage(spark, docs, sf_dir)
    return bounded_stage


@bounded
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.where("predicted = 0").select(*docs.columns)


@bounded
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Only the ids that go are joined to the texts."""
    gone = near_dedup.near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    gone = staged(gone, "gone")
    small = gone.count() <= near_dedup.BROADCAST_IDS
    return docs.join(F.broadcast(gone) if small else gone, "doc_id", "left_anti").select(*docs.columns)


@bounded
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


@bounded
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies are decided on sizes alone and joined to the texts once; the row travels as one struct, whatever its
    columns are called."""
    sized = mixing.with_size(docs.select("doc_id", "source", "text", F.struct("*").alias("row"))).drop("text")
    mixed = mixing.mix(sized.drop("row"))
    takes = mixed.where("copies > 0").select(F.col("doc_id").alias("d"), F.col("source").alias("s"), F.col("size").alias("z"), "copies")
    same = F.col("doc_id").eqNullSafe(F.col("d")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))
    return sized.join(takes, same).select("row", F.explode(F.expr("sequence(1, copies)"))).select("row.*")


@bounded
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mix", mix_sources),
    ("pack", pack),
]

#: A trained classifier and a tokenizer are no SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
