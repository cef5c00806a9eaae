"""From raw documents to sampled token ids: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stacksift.llm import jaccard, langid, mixing, pieces, quality
from stacksift.llm.common import table, tokenizer_path, written
from stacksift.llm.queries import MIXTURE


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or are depleted of lines go, and shared lines go from the others."""
    return quality.kept_documents(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go."""
    return langid.known_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of linked texts stays."""
    return jaccard.one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Half of the tokens, by the registered weights; a document that is taken in two epochs has two rows."""
    return mixing.mix(docs, share=0.5, max_epochs=2, weights=MIXTURE, seed=7).select(*docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the sampled pieces' ids."""
    return pieces.encode(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [("quality rules", quality_rules), ("language id", language_id), ("near duplicates", near_duplicates), ("mixture", mixture), ("token ids", token_ids)]

#: Sampled pieces and a learned classifier can't be expressed in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
