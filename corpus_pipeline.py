"""The corpus pipeline: documents through five operators, each stage written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import bpe, common, exact_dedup, mixing, near_dedup, toxicity

#: Drawing the mix and training the taggers make it no SQL; tests hold it against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the tagger, trained on the labelled ones among them, predicts to be toxic."""
    common.tidy(spark)
    model = toxicity.fit(docs, toxicity.labels(spark, sf_dir))
    return toxicity.keep_clean(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one row for each text that is equal but for white space: that with the least doc_id."""
    common.tidy(spark)
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one document for each class of near copies: that with the least doc_id."""
    common.tidy(spark)
    return near_dedup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs mixed to the sources' target weights: each row as often (0, 1 or 2 times) as the mix takes it."""
    common.tidy(spark)
    return mixing.mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source and text with n_tokens, and the digests of each text's ids and of what they decode to."""
    common.tidy(spark)
    return bpe.digests(docs, keep=["doc_id", "source", "text"])


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mix sources", mix_sources),
    ("byte-level BPE", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents; each stage's result is a table in the shared folder, and the only one that is left of it."""
    docs, since = common.documents(spark, sf_dir), common.tables_so_far()
    for _, stage in STAGES[:-1]:
        docs = common.only(stage(spark, docs, sf_dir), since)
    return STAGES[-1][1](spark, docs, sf_dir)
