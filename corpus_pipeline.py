"""A training-corpus pipeline: five stages over ``documents``, each stored before the next.

Every stage takes ``(spark, docs, sf_dir)``.  All but the last return the columns
of ``documents``; the last returns where each piece of each document is packed.
Null and empty texts have no language and leave in the first stage; an empty
table stays empty; repeated rows pass through together until one of each group
of near copies is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadline.llm import decontam, jaccard, langid, linedup, packing
from threadline.llm.common import materialize
from threadline.llm.queries import RUN_WORDS, SEQUENCE

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOKENIZER = "byte_bpe_50k.json"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter, and those whose best language is improbable."""
    network = langid.train(docs.where(~langid.held_out("doc_id")), "doc_id", "text", "lang")
    return langid.keep_identified(docs, network).select(*COLUMNS)


def dedupe_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete later copies of line runs of 50 or more words; documents of which nothing is left go."""
    cleaned = linedup.dedupe_lines(docs, min_words=RUN_WORDS)
    left = (F.col("removed_lines") == 0) | (F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")) > 0)
    changed = F.when(F.col("removed_lines") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return cleaned.where(left).withColumn("n_chars", changed.cast("long")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group linked by five-word shingles at a similarity of 0.8 keep the lowest id."""
    return jaccard.keep_one_of_each(docs, width=5, percent=80).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold an item of the benchmark."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents' tokens into sequences."""
    import public_tokenizers

    return packing.pack_documents(docs, "doc_id", "text", public_tokenizers.path(TOKENIZER), "attach", 0, SEQUENCE)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedupe_lines),
    ("near_duplicates", drop_near_copies),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: A network, an LSI search and a tokenizer are no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
