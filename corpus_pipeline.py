"""The training-data pipeline: five stages, each a pass of one operator over all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tributary.llm import bpe, jaccard, mixing, substring_dedup, toxicity
from tributary.llm.common import drop_scratch, scratch_paths, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, fitted to the labelled ones among them, scores below 0.5."""
    net = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.reject_toxic(docs, net)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at a similarity of 0.75."""
    return jaccard.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 20-word passages that an earlier one has; of which nothing is left, go."""
    return substring_dedup.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources emits it."""
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every copy, as digests. Workers keep fewer chunks, and look at less text at once, than for op8 alone: the stages before leave the JVM large."""
    return bpe.encoding_digests(docs, kept=30_000)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", one_of_each),
    ("substring_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Neither the network nor the encoder can be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order. Between two of them the documents are a stored table, and what the earlier one stored for itself goes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        before = set(scratch_paths())
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            between = set(scratch_paths()) - before
            docs = stored(docs, name)
            drop_scratch(list(between))
    return docs
