"""Documents through five of the operators: toxicity, near duplicates, secrets, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veracity.checkpoints import materialize
from veracity.llm import mixing, ngram_jaccard, packing, secrets, toxicity
from veracity.llm.common import table
from veracity.llm.queries import CATEGORIES, label_columns, tokenizer_path

#: No SQL for trained models and a tokenizer; tests/llm compares the operators that the stages call with plain versions.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain doesn't reject. It is trained on the labelled ones among `docs`."""
    chain = toxicity.train(docs, label_columns(spark, sf_dir), CATEGORIES)
    return toxicity.score(docs, chain).where(~F.col("toxic")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents one row, that with the smallest id (null last)."""
    return ngram_jaccard.one_of_each(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret found replaced by a mark; equal texts are scanned once."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, as often and as far as it takes them."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of tokenised documents with their places in sequences."""
    return packing.pack(packing.pieces(docs, tokenizer_path()))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("secret_scans", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
