"""A training corpus from `documents`: quality, near-duplicates, benchmark passages, personal data, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; run() writes each result as Parquet in the shared folder and reads it again.
Stages 1 to 4 return the columns of their input; the last returns doc_id, n_tokens, ids_sha256, decoded_sha256 and ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm import bpe_automaton, decontaminate, line_crf, pii, simhash
from skerry.llm.common import scratch, table, written
from skerry.llm.queries import tokenizer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line CRF, learned from the labelled ones, does not reject."""
    return line_crf.accepted(docs, line_crf.learned(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each SimHash component."""
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return decontaminate.without_hits(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with entities replaced by their kind and telling terms generalised or removed; n_chars follows the text."""
    out = pii.sanitised(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of all documents, with digests of the ids and of the text decoded from them."""
    return bpe_automaton.round_trip(docs, tokenizer("byte_bpe_50k.json"), with_ids=True)


STAGES = [("quality classifier", quality), ("near duplicates", near_duplicates), ("decontamination", decontamination), ("personal data", personal_data), ("bpe", token_ids)]

#: SimHash components and the fitted classifier are beyond SQL; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, base = table(spark, sf_dir, "documents"), scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"{base}/{k}")
    return docs
