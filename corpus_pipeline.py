"""A corpus pipeline of five stages, each of one operator; every stage works on all that the one before it kept.

Nulls in any column are carried through: a null text is treated as an empty one (and stays null until it is encoded), a null id is an id, a null source a
source of its own. Repeated rows are rows; empty tables give empty results; columns besides those of documents ride along up to the last stage.

Stages that hand rows to Python bound the session's Arrow batches by bytes (``common.bound_batches``), so that a task's memory follows neither the number
of its rows nor the length of their texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm import bpe, linededup, mixing, quality, simhash
from starloom.llm.common import bound_batches, fresh_path

#: Documents scored below are rejected.
LEAST_QUALITY = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that the quality classifier rejects go; labels come from the input's own table. Null and empty texts are scored as empty ones."""
    bound_batches(spark)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(quality.score_column(model) >= LEAST_QUALITY)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: of equal and nearly equal lines the first stays (by id, null last); every document stays, also if its text is empty then."""
    bound_batches(spark)
    return linededup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: of each group of near duplicates (five-word shingles, similarity 0.8 or more) the first by id stays, null last; texts without a word are one group."""
    bound_batches(spark)
    return simhash.keep_one(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: sources are mixed to target weights; a document can be taken twice, rows of one id are taken or left together."""
    return mixing.mix_documents(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: token ids of each document (null and empty texts: none), and the digest of what they decode to."""
    import public_tokenizers

    bound_batches(spark)
    path = public_tokenizers.path("byte_bpe_50k.json")
    out = bpe.encode(docs, path, decoded=True)
    return out.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("quality", quality_stage), ("line_dedup", line_dedup_stage), ("near_dedup", near_dedup_stage), ("mix", mix_stage), ("bpe", bpe_stage)]

#: The classifier, edit join and tokenizer are not SQL; tests compare stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents; what one returns is written as Parquet and read again for the next. An empty table gives an empty result."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = fresh_path(spark, f"pipeline-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
