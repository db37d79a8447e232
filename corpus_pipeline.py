"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and returns a table; ``run`` writes every stage's
table to the shared folder and gives it, read again, to the next stage; a stage's table makes
way once its successor's is written.

Defined results: null, empty and wordless texts have no language and go in the first stage; a
null id is judged by its text and never a duplicate; rows that repeat an id and text stay
together; extra columns come through all stages but the last; an empty table gives an empty table.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credlake.llm import language, minhash, packing, passages, toxicity
from credlake.llm.common import crc32_mod, dropped, free_name, table, written


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told; those without letters, or as near to two codewords, go."""
    return language.told(docs, language.fit(language.learnable(docs)))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold."""
    labels = table(spark, sf_dir, "labels").where(crc32_mod("doc_id", 4) != 2)
    return toxicity.below(docs, toxicity.learn(docs, labels))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every near-duplicate group (rows that repeat its id are the same document and stay with it).

    Only the ids of what goes travel to the documents; rows without an id stay.
    """
    found = minhash.groups(docs).where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept"))
    gone = free_name({c.lower() for c in docs.columns}, "gone")
    ids = found.where("not kept").select(F.col("doc_id").alias(gone))
    return docs.join(ids, F.col("doc_id") == F.col(gone), "left_anti")


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that other documents hold too."""
    return passages.deduplicated(docs).select(docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    return packing.pack(docs, include_ids=False)


STAGES = [
    ("language identification", known_language),
    ("toxicity", not_toxic),
    ("near duplicates", one_of_each),
    ("substring deduplication", without_repeats),
    ("packing", sequences),
]

#: Trained models, minwise hashes and tokenizers have no SQL form; tests/llm holds a run against its stages one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
        if before is not None:
            dropped(before)
        before = docs
    return docs
