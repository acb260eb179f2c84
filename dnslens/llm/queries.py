"""Registered queries of this subpackage and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dnslens.llm import (
    backoff_automaton,
    bpe_automaton,
    chat_format,
    exact_top_k,
    id_packs,
    kernel_langid,
    phrase_mining,
    shard_packing,
    simhash_anchors,
    substring_dedup,
    token_alignment,
    winnow,
    wrapper_induction,
)
from dnslens.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def _on(name: str, report: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: report(table(spark, sf_dir, name))


QUERIES: dict[str, Query] = {
    "op1_substring_dedup": _on("documents", substring_dedup.report),
    "op2_html_extraction": _on("pages", wrapper_induction.report),
    "op3_chat_formatting": _on("conversations", chat_format.report),
    "op4_simhash_near_dedup": _on("documents", simhash_anchors.report),
    "op5_language_id": _on("documents", kernel_langid.report),
    "op6_exact_top_k": _on("embeddings", exact_top_k.report),
    "op7_decontamination": lambda spark, sf_dir: winnow.report(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    ),
    "op8_bpe_round_trip": _on("documents", bpe_automaton.round_trip),
    "op9_sharding": lambda spark, sf_dir: shard_packing.shard(table(spark, sf_dir, "documents")).drop("tokens"),
    "op10_token_packs": _on("documents", id_packs.write_and_index),
    "op11_token_alignment": _on("documents", token_alignment.report),
    "op12_lm_scoring": _on("documents", backoff_automaton.score),
    "op13_phrase_mining": _on("documents", phrase_mining.mine),
}

ORACLES: dict[str, str] = {
    "op3_chat_formatting": chat_format.ORACLE,
    "op6_exact_top_k": exact_top_k.ORACLE,
    "op7_decontamination": winnow.ORACLE,
    "op13_phrase_mining": phrase_mining.ORACLE,
}
