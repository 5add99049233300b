"""A training-data pipeline in five stages; part of the subpackage ``lanewise.llm``.

Each stage takes all that the one before it kept. All but the last return the columns of
``documents``, and any others of any name, as they came; between stages the rows are written
as Parquet to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.llm.common import stage, table, unused
from lanewise.llm.decontaminate import decontaminate
from lanewise.llm.jaccard_join import jaccard_join
from lanewise.llm.quality_knn import quality
from lanewise.llm.sentencepiece_scan import digest, encode
from lanewise.llm.suffix_dedup import suffix_dedup
from lanewise.llm.toxicity import bucket


def set_aside(docs: DataFrame, *names: str) -> tuple[DataFrame, list]:
    """``docs`` with columns of these names under others, and what selects all columns as they came."""
    away = {c: unused(docs, f"own_{c}") for c in docs.columns if c.lower() in names}
    return docs.withColumnsRenamed(away), [F.col(f"`{away.get(c, c)}`").alias(c) for c in docs.columns]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score under 0.3) go."""
    score = unused(docs, "score")
    return quality(docs, table(spark, sf_dir, "labels"), bucket(5) != 0, out=score).filter(F.col(score) >= 0.3).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least doc_id stays; rows without an id stay."""
    joined = jaccard_join(docs.select("doc_id", "text"))
    gone = stage(joined.filter("doc_id <> group_id").select("doc_id"), "gone")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated strings of 50 bytes are cut out; half characters at a cut go too. Documents of which nothing is left go."""
    own, columns = set_aside(docs, "kept", "kept_text", "spans")
    cut = suffix_dedup(own)
    text = F.when(F.size("spans") > 0, F.col("kept_text")).otherwise(F.col("text"))
    left = cut.filter((F.size("spans") == 0) | (F.octet_length("kept") > 0)).withColumn("text", text)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return left.select(columns)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    own, columns = set_aside(docs, "n_words", "n_hit", "n_items", "items", "spans")
    return decontaminate(own, table(spark, sf_dir, "benchmark")).filter("n_hit = 0").select(columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encoded documents, with proof that decoding gives their text back."""
    return digest(encode(docs)).select("doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "round_trip")


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark_passages),
    ("SentencePiece encoding", token_ids),
]
#: The classifier and the encoding are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", spread=True)
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
