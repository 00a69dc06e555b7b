"""A training corpus from the table ``documents``, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept:

1. quality    drops the documents that the Bradley-Terry classifier rejects;
2. near_dups  keeps one document of each group of texts linked by op1's SimHash (2 bits or fewer, vantage-point tree)
              or, farther apart than fingerprints reach, as near copies (five-word shingles, Jaccard 0.8 or more);
3. leaks      drops documents with passages of the benchmark, also re-parameterised ones;
4. secrets    replaces every secret by a mark of its kind and counts the characters anew;
5. encode     returns the token ids of what is left: doc_id, lang, source, n_tokens, ids.

Nulls in any column are kept as they are (a null text counts as empty); an empty table stays
empty; columns beyond those of ``documents`` pass through all but the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tourweave.llm import byte_bpe, near_copies, quality_bt, secret_scan, template_decontam
from tourweave.llm.common import cut, table

VOCABULARY, PATTERN = "byte_bpe_multi_50k.tiktoken", public_tokenizers.PATTERN


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_bt.keep_good(docs, table(spark, sf_dir, "labels"), quality_bt.admitted())


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.drop_simhash_and_near_copies(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return template_decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = secret_scan.redact(docs)
    if "n_chars" not in docs.columns:
        return cleaned
    length = F.length("text").cast(docs.schema["n_chars"].dataType)
    return cleaned.withColumn("n_chars", F.when(F.col("text").isNull() | F.col("n_chars").isNull(), F.col("n_chars")).otherwise(length))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_columns(docs, public_tokenizers.path(VOCABULARY), PATTERN, carry=("doc_id", "lang", "source"))


STAGES = [("quality", quality), ("near_dups", near_dups), ("leaks", leaks), ("secrets", secrets), ("encode", encode)]

#: SQL can express neither the classifier nor the other stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
