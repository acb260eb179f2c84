"""A training-data pipeline over ``documents``: each stage works on all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dnslens.llm import bpe_automaton, kernel_langid, simhash_anchors, substring_dedup, winnow
from dnslens.llm.common import stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; lang becomes what the text says. Null or letterless texts go."""
    found = kernel_langid.identify(docs, kernel_langid.fit(docs), names=("__lang", "__score")).filter("__lang <> 'und'")
    return found.withColumn("lang", F.col("__lang")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one whose id names the group; of rows that repeat it, one.

    Documents without an id are no copies of anything that could be named and stay.
    """
    groups = simhash_anchors.near_duplicates(docs).filter("doc_id = component_id").select("doc_id").distinct()
    stay = docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).join(groups, "doc_id", "left_semi")
    return stay.union(docs.filter("doc_id IS NULL")).select(*docs.columns)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that another document, or an earlier place, holds too."""
    return substring_dedup.deduplicated(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no span with the benchmark."""
    verdict = winnow.decontaminate(docs, table(spark, sf_dir, "benchmark"), spans=False)
    hit, _ = stored(verdict.filter("n_hit > 0").select(F.col("doc_id").alias("__hit")).distinct(), "contaminated")
    few = hit.limit(winnow.BROADCAST_IDS + 1).count() <= winnow.BROADCAST_IDS
    return docs.join(F.broadcast(hit) if few else hit, F.col("doc_id").eqNullSafe(F.col("__hit")), "left_anti").select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts."""
    return bpe_automaton.round_trip(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language),
    ("simhash_near_dedup", near_duplicates),
    ("substring_dedup", passages),
    ("benchmark_decontamination", benchmark),
    ("bpe_encoding", tokens),
]

#: SQL can express neither the language model nor MinHash paragraphs; the tests hold ``run`` against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, _ = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
