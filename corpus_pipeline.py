"""A corpus through five stages: language ID, line dedup, near duplicates,
benchmark decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs; all but the last return the
columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quernstone.llm import bpe, decontam, jaccard, langid, line_dedup
from quernstone.llm.spark_util import discard, settled, table
from quernstone.shipping import shipped


@shipped
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    model = langid.fit_documents(docs)
    return langid.predict(docs, model).where("NOT rejected").select(docs.columns)


@shipped
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without repeated chunks of lines; documents that lose all words go."""
    done = line_dedup.dedup(docs).where((F.col("chunks_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("chunks_removed") > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return done.select(docs.columns)


@shipped
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return jaccard.one_of_each(docs)


@shipped
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontam.find_leaks(docs, table(spark, sf_dir, "benchmark")).where(F.size("leaks") == 0).select(docs.columns)


@shipped
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of the kept documents, and their decoded bytes, as digests."""
    done = bpe.encode(docs, bpe.default_ranks(), decoded=True)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language ID", language),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("byte-level BPE", tokens),
]
ORACLE_SQL = None  # language ID, alignment and BPE are beyond SQL; tests/llm/test_pipeline.py has a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result is written; what the stage needed on its way, and the
    result before, is deleted then."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs = settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        if before is not None:
            discard(spark, before)
        before = docs
    return docs
