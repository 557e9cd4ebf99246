"""From raw documents to packed training sequences, in five stages.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next stage's ``docs``. All stages but
the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavespan.llm import linededup, mixing, neardup, packing, quality
from wavespan.llm.tokens import default_path
from wavespan.session import shared_folder


#: Remembered words and bytes of text at a time of a packing worker, whose executor has stages of
#: other kinds behind it.
WORDS, TEXT_BYTES = 100_000, 4 << 20


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base counts and compression bands."""
    return quality.keep(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of recurring templates; those left without a word go.

    Columns that bear the names of the operator's counts are put aside meanwhile.
    """
    aside = {c: f"__in_{c}" for c in ("n_lines", "n_dropped") if c in docs.columns}
    kept = linededup.drop_recurring(docs.withColumnsRenamed(aside))
    left = kept.where((F.col("n_dropped") == 0) | (mixing.words("text") > 0))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col("n_dropped") == 0, F.col("n_chars"))
                               .otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return left.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, 0.8 or more alike.

    Rows that repeat a doc_id and its text are one document too: the first by the other columns
    stays. Rows that repeat an id with another text all stay, or all go, with that id. Rows without
    an id are linked with nothing and stay.
    """
    found = neardup.near_duplicates(docs, width=5, percent=80)
    kept = found.where("kept and doc_id is not null").select(F.col("doc_id").alias("__of")).distinct()
    named = docs.where("doc_id is not null")
    alone = named.join(kept, F.col("doc_id") == F.col("__of")).drop("__of")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    first = Window.partitionBy("doc_id", F.xxhash64("text"), F.hash("text")).orderBy(
        *others, F.lit(0))
    alone = alone.withColumn("__nth", F.row_number().over(first)).where("__nth = 1").drop("__nth")
    return alone.unionByName(docs.where("doc_id is null"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources meet their target weights."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents with their sequence and offset; the first piece of a
    sequence carries its padded ids."""
    return packing.packed_sequences(docs, default_path(), max_words=WORDS, batch_bytes=TEXT_BYTES)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
          ("mix_sources", mix_sources), ("pack_sequences", pack_sequences)]

#: Compression, MinHash and token ids are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/wavespan/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
