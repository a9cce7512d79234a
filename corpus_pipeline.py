"""A corpus pipeline of five training-data operators; every stage reads what the one before it wrote.

Each stage function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``docs``.  No SQL can express language models, FM-indexes and tokenizers, so ORACLE_SQL is None; tests hold the
pipeline against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logweave.llm.common import saved, table
from logweave.llm.decontamination import drop_contaminated
from logweave.llm.language_id import keep_identified
from logweave.llm.mixing import mix
from logweave.llm.ngram_join import drop_near_copies
from logweave.llm.token_output import tokens_and_digests

ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_identified(docs)


def join_ngrams(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs, words=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokens_and_digests(docs)


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", join_ngrams),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mix_sources),
    ("token-ID output", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name.split()[0].lower()}")
    return STAGES[-1][1](spark, docs, sf_dir)
