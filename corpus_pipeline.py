"""Documents to packed training sequences, in four stages.

Each stage takes (spark, docs, sf_dir), where docs is the table the stage
before it wrote, and returns what it keeps; all but the last return the
columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonearm.llm import mixing, neardups, packing, quality
from tonearm.llm.common import discard, ensure_checkpoint_dir, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the line CRF rejects (score below one half).

    A null or empty text is one empty line and has a score like any other; repeated rows go or stay together; without a
    usable label every score is one half, so all stay; null ids and columns of any name pass through."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates (five-word shingles, similarity 0.8): the smallest doc_id, null last.

    Null and empty texts are equal texts, of which one stays, and so does one of rows that are equal in every column; texts
    without words duplicate equal texts alone; columns of any name pass through."""
    return neardups.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents so that source, language and topic meet their target weights.

    Null sources, languages and texts count as empty ones; rows with the same id share a draw; no document is cut, and the
    share that stays is what the targets allow."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every sequence, with their token ids.

    A null or empty text is its end token alone; null ids are kept; repeated rows are packed once each."""
    out = packing.pack(docs)
    return out.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [("quality_filter", quality_filter), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("pack_sequences", pack_sequences)]

#: The CRF and the tokenizer can't be said in SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's are written to a folder of the run's own in the shared one, until the next
    has read them.

    The last stage's stay there, so the caller deletes it (``pipeline-...``) when done with them."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            discard(spark, before)  # only the next stage reads a stage's rows
        before = f"{folder}/{name}"
    return docs
