"""From raw documents to token ids: toxic documents go, of near duplicates one stays, sources are mixed, texts encoded.

Each stage reads what its predecessor wrote, so a lost executor costs a task and a failed run can go on
from the last table. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldtrust.llm import bpe, jaccard, mixing, toxicity
from fieldtrust.llm.common import materialised, table, tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text scores below one half; the model learns from the labelled ones among them."""
    return toxicity.accepted(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that a five-word Jaccard similarity of 0.8 connects, the one with the smallest id."""
    return jaccard.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it, drawn by quality label."""
    return mixing.mixture(docs, table(spark, sf_dir, "labels"))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of ids of each row's text, and the digests of ids and decoded text."""
    return bpe.digests(bpe.encode(docs, tokenizer_path("word_bpe_49k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", one_of_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode_texts),
]

#: A learned lexicon, banding and BPE are beyond SQL; tests/llm/test_pipeline.py holds a plain version against run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialised(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
