"""A corpus pipeline of five stages, each reading what the one before it wrote.

The stages take (spark, docs, sf_dir) and return a DataFrame; all but the last return the columns of
documents, of any name and type and with their values: operators see doc_id, text and one struct of the rest.
What a stage does with nulls, empty texts, ties and repeated rows stands in its docstring; no rows give no rows."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import common, decontaminate, line_dedup, near_dup, quality_rules, wordpieces


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, trusted texts being those with a label of quality 1.

    Null and empty texts have no words and go. Rows that repeat a doc_id are judged one by one; a null doc_id
    is judged but never trusted. A score equal to the threshold stays."""
    target = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    return quality_rules.filter_documents(docs, target, **quality_rules.PRODUCTION)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document holds; every row stays, if only with an empty text.

    Null texts stay null. The smallest doc_id keeps a line, and null is the smallest; rows that repeat a doc_id
    count as one document and keep what it keeps."""
    return line_dedup.drop_lines(docs)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near-duplicates: an exact similarity of five-word
    shingles of 0.8 or more, among candidates by SimHash links and by min-hashes.

    Texts without words, null ones among them, are near-duplicates of each other. Of rows that repeat the
    smallest doc_id one stays, the least as simhash.keep_one says; rows with a null doc_id all stay."""
    return near_dup.keep_one(docs, shingle=5, least=0.8)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark; those with over half of their words in passages go.

    Null and empty texts stay as they are; repeated rows and null doc_ids are treated like any other. An item
    with a null id is cut out as well, one with a null text is none."""
    return decontaminate.remove_spans(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the text decoded from them, a row for each row of docs.

    Null and empty texts have no ids. Repeated rows each get a row, a null doc_id stays null; other columns go."""
    both = wordpieces.recode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("text", "utf-8"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("simhash near-dedup", near_dup_stage),
    ("benchmark decontamination", benchmark_stage),
    ("bpe encoding and decoding", token_stage),
]

#: Hashes of n-grams, fingerprints and tokens are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; between them rows are written to the shared folder and read again.

    What a stage has read is deleted once its own rows are written; the rows that the returned DataFrame
    reads stay in pipeline-<id> below the shared folder, for the caller to delete when done with it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{common.shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                common.remove_folder(spark, f"{folder}/{k - 1}")
    return docs
