"""Cleaning a corpus and packing it for training, stage by stage.

Every stage reads what its predecessor kept. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealgrove.llm import minhash, packing, quality, suffixes, toxicity
from dealgrove.llm.base import stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the tagger, learnt from the labels that are not held out, does not reject."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out())
    return toxicity.filter_toxic(docs, model)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighed votes of the quality rules keep."""
    return quality.filter_kept(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies."""
    return minhash.near_duplicates(docs).where("kept").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that an earlier one holds; n_chars is counted anew."""
    left = suffixes.deduplicate(docs)
    given = {c: F.col("row")[c] for c in docs.columns if c != "text"} | {"text": F.col("text")}
    if "n_chars" in given:
        kind = docs.schema["n_chars"].dataType
        given["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text").cast(kind)).otherwise(given["n_chars"])
    return left.select(*[given[c].alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokenised pieces of what is left and their places in training sequences."""
    return packing.pack(packing.token_pieces(docs, public_tokenizers.path(packing.TOKENIZER)))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", keep_quality),
    ("minhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("best_fit_packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
