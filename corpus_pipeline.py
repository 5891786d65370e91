"""The corpus pipeline: stages over `documents`, each written as Parquet and read again by the next.

Every stage takes a table with doc_id, text, lang and source, and all but the last give it back with its columns as they
are, others among them, whatever their names: a stage's own columns can clash with none. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import common, decontam, langid, mixing, near_copies, token_store

_OWN = "c_"


def _keep(docs: DataFrame, judge, kept) -> DataFrame:
    """Rows of docs, columns as they are, for which `kept` holds after `judge`, whose new columns can clash with none."""
    out = judge(docs.select(*[F.col(c).alias(_OWN + c) for c in docs.columns])).filter(kept)
    return out.select(*[F.col(_OWN + c).alias(c) for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are near a centroid of some language; those that it rejects, and those without letters, go.

    Null and empty texts have no letters. A null lang teaches nothing; if no row teaches, all rows go. Rows that repeat are
    judged alike; of languages that are as near the first by name counts.
    """
    model = langid.fit(langid.learnt(docs))
    return _keep(docs, lambda d: langid.predict(d, model, text=_OWN + "text"), ~F.col("rejected"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies, that of the smallest doc_id, at a similarity of 0.8 in
    five-word shingles. Texts meet by least hashes of their shingles; SimHash fingerprints of 256 bits, as 64 bits at 3 places
    tell only closer copies apart, are compared bit-sliced where they meet; of what is left the exact similarity decides.

    Null, empty and blank texts are copies of each other. Of rows that are equal one stays; rows that share an id, but not
    their text, are told apart by a hash of it, the least first; null ids come last.
    """
    return near_copies.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of ten words, and no shorter whole item, of the benchmark.

    Null and empty texts hold none and stay, as do all rows if the benchmark is empty; rows that repeat are judged alike.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _keep(docs, lambda d: decontam.decontaminate(d, items, text=_OWN + "text"), ~F.col("contaminated"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    Null and empty texts have size 0, and are taken as often as their source's rate says; a null source is one of its own,
    and one without words gives no rows. Rows that repeat an id are taken as often as each other. Reruns agree.
    """
    return mixing.emit(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The binary blocks of token ids, read back: doc_id, start, n_tokens, ids_crc32.

    Null and empty texts have the end id only. Null ids come first; rows of one id stand in the order of their texts.
    """
    return token_store.round_trip(docs)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("mixing_sources", mix_sources),
    ("token_ids", token_ids),
]

#: Language models, hashes and tokens can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = common.Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if i:
            scratch.drop(STAGES[i - 1][0])
    return docs
