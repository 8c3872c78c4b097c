"""From raw documents to token files: five stages, each written and reread by the next.

Null texts count as empty, and rows of null ids go through every stage. Repeated rows, and equal texts,
come down to one in ``near_duplicates``, but for those of null ids. Every stage but the last returns
the columns that it was given, whatever their names; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keyfold.llm import decontamination, mixing, simhash_dedup, token_files, toxicity
from keyfold.llm.common import delete_path, stored, table
from keyfold.llm.queries import END_ID, MIX_SEED, REST, WEIGHTS, tokenizer


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels, doesn't reject."""
    return toxicity.keep_ordinary(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return simhash_dedup.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents so that sources reach their weights, shuffled."""
    return mixing.mix(docs, WEIGHTS, rest=REST, seed=MIX_SEED)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the shuffled order, and their documents as read back."""
    manifest = token_files.write_token_files(docs, token_files.token_folder(spark), tokenizer("word_bpe_49k.json"), end_id=END_ID, ordered=False)
    return token_files.read_token_files(spark, manifest)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("token_files", write_tokens),
]

#: No SQL expresses the classifier, fingerprints or tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's table goes once the next one's is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, path = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        if before:
            delete_path(spark, before)
        before = path
    return docs
