"""From raw documents to token ids: five stages, each written as Parquet and read again by the next.

A stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of
``documents``; the last adds ``token_ids``.

1. quality classifier: documents that it rejects go.
2. n-gram Jaccard join: of each group of linked documents that with the smallest id stays.
3. PII: spans are replaced by their kind in brackets; ``n_chars`` follows the text.
4. mixing to target weights: a document is repeated as often as the mix takes it whole.
5. byte-level BPE: ``token_ids``, and the text as decoded from them.

Null ids, texts and sources, repeated rows and empty tables are treated as the
operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm import bpe, jaccard, mixing, pii, quality
from webloom.llm.common import free, quoted, stored, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.deduplicated(docs)


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    if "n_chars" not in docs.columns:
        return pii.redacted(docs)
    right = free(docs, "n_chars_right")
    out = pii.redacted(docs.withColumn(right, F.col("n_chars") == F.length("text")))
    count = F.when(F.col(right), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", count).select(*(F.col(quoted(c)) for c in docs.columns))


def mixing_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encoded(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", jaccard_join),
    ("PII", pii_redaction),
    ("mixing sources to target weights", mixing_to_targets),
    ("byte-level BPE encoding and decoding", bpe_encoding),
]

#: Regular-expression spans with checksums, a fitted classifier and BPE are beyond SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
