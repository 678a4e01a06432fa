"""Raw documents to token digests: quality filter, line dedup, near-duplicate removal, source mix, BPE.

Every stage reads what the one before it wrote; all but the last return the columns of documents.

Null texts count as empty: they have no lines, no shingles and no tokens, and the classifier scores them as the empty text.
Texts of any length are taken whole. Of repeated rows the line stage keeps one that has lines, the n-gram stage one of each
group, the mix as many as it takes. Ties go by doc_id (null first among lines, last among documents), then by text hash.
An empty table gives an empty result. Extra columns, whatever their names, pass all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewright.llm import bpe, line_dedup, mixing, ngram_join, quality
from tracewright.llm.common import shared_folder, table, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier accepts."""
    return quality.good_documents(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines seen before in the corpus."""
    return line_dedup.without_repeats(docs)


def join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return ngram_join.one_of_each(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source mix takes them."""
    return mixing.mixed(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts."""
    return bpe.digests(docs, bpe.vocabulary())


STAGES = [("quality", quality_stage), ("line_dedup", line_stage), ("ngram_join", join_stage), ("mix", mix_stage), ("bpe", bpe_stage)]

#: SQL cannot express the classifier and the encoder; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), shared_folder(spark, f"pipeline-{name}"))
    return docs
