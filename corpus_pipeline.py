"""The text pipeline: five stages over ``documents``, each a whole-table operator.

Each stage takes what its predecessor kept. All but the last return the columns
of ``documents``; a stage that changes a text also sets its n_chars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tieout.llm import decontaminate, near, suffixes, toxicity
from tieout.llm.queries import bpe_digests
from tieout.llm.stash import held_out, stash


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model accepts; it learns from the labels outside the held-out third."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), usable=~held_out())
    return toxicity.keep_clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest id."""
    return near.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand earlier in the corpus, cut at whole characters."""
    cut = suffixes.without_repeats(docs, whole_characters=True)
    text = F.col("kept").cast("string")
    new = {"text": text, "n_chars": F.length(text).cast("bigint")}
    return cut.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    blocks = decontaminate.prepare(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return decontaminate.without_leaks(docs, blocks)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes for every document that is left."""
    return bpe_digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("byte_bpe", tokenise),
]

#: SQL cannot express the model, the joins by recursion, the latent space or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stash(docs, name)
    return docs
