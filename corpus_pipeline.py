"""The corpus pipeline: language ID, line dedup, n-gram Jaccard join, suffix-array dedup, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm import jaccard_join, language_id, line_dedup, packing, queries, suffix_dedup
from tabulon.llm.common import stored


def _retyped(docs: DataFrame, like: DataFrame) -> DataFrame:
    """Documents with text left, n_chars as their new length, and the columns of like in its order."""
    docs = docs.where(F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]")))
    if "n_chars" in like.columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(like.schema["n_chars"].dataType))
    return docs.select(*like.columns)


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; rejects texts that are null or have no letter. A null lang becomes the one predicted.

    Where no document has a lang, there is nothing to learn from: texts with a letter stay, their lang null.
    """
    samples = language_id.training_sample(docs, 64, 32_768, F.lit(False))
    if not samples:
        return docs.where(F.regexp_like("text", F.lit(r"\p{L}")))
    # the operator's own columns may have the names of extra ones
    held = {c: f"__{k}" for k, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    known = language_id.language_id(docs.withColumnsRenamed(held), samples, keep=("text", *held.values())).where("lang_pred <> 'und'")
    back = [F.coalesce(F.col(held[c]), F.col("lang_pred")).alias(c) if c == "lang" else F.col(held[c]).alias(c) if c in held else F.col(c) for c in docs.columns]
    return known.select(*back)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each class of equal or nearly equal lines stays where it stands first; documents that have nothing else go."""
    return _retyped(line_dedup.without_repeated_lines(docs, line_dedup.line_classes(docs)), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity of 0.8 or more) the document with the smallest doc_id."""
    groups = jaccard_join.jaccard_groups(docs, k=5, percent=80)
    gone = stored(groups.where("doc_id <> component_id").select(F.col("doc_id").alias("__id")).distinct(), "gone")
    small = gone.count() <= jaccard_join.BROADCAST_IDS
    return docs.join(F.broadcast(gone) if small else gone, docs["doc_id"] == F.col("__id"), "left_anti")


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay where they stand first; documents that have nothing else go."""
    return _retyped(suffix_dedup.without_passages(docs, suffix_dedup.repeated_passages(docs)), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in sequences of 1024."""
    return packing.pack(docs, queries.tokenizer_file("byte_bpe_50k.json"), payload="crc32")


STAGES = [
    ("language ID", languages),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", passages),
    ("packing", packed),
]

#: Suffix automata, edit joins and a tokenizer are not SQL's; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, each written as Parquet and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
