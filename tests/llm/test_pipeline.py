"""The pipeline and the registered queries."""

from __future__ import annotations

import hashlib

import pytest

import corpus_pipeline
from dnslens.llm.queries import ORACLES, QUERIES


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(ORACLES) <= set(QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language_id", "simhash_near_dedup", "substring_dedup", "benchmark_decontamination", "bpe_encoding",
    ]


def test_stages_against_plain_rules(spark, sf_dir):
    import test_llm_operators as plain
    from tokenizers import Tokenizer

    from dnslens.llm.word_units import tokenizer_text

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = corpus_pipeline.language(spark, docs, sf_dir)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    rows = docs.select("doc_id", "text").collect()
    prints = [plain.plain_fingerprint(r.text) for r in rows]
    home = plain.brute_components(
        [r.doc_id for r in rows],
        [(rows[i].doc_id, rows[j].doc_id) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3],
    )
    out = corpus_pipeline.near_duplicates(spark, docs, sf_dir)
    assert {r.doc_id for r in out.collect()} == set(home.values()) and out.columns == docs.columns
    out = corpus_pipeline.passages(spark, out, sf_dir)
    assert out.columns == docs.columns
    out = corpus_pipeline.benchmark(spark, out, sf_dir)
    texts = {r.doc_id: r.text for r in out.collect()}
    tool = Tokenizer.from_str(tokenizer_text())
    final = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in final} == set(texts)
    for r in final:
        ids = tool.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_stages_take_odd_tables(spark, sf_dir, stage):
    kind = "doc_id long, text string, lang string, source string, n_chars long, lang_pred long"
    for rows in ([], [(None, None, None, None, None, None), (1, None, None, None, None, 1), (1, "a b", "en", "s", 3, 2), (1, "a b", "en", "s", 3, 2)]):
        out = stage(spark, spark.createDataFrame(rows, kind), sf_dir)
        assert out.count() <= len(rows)
        if stage is not corpus_pipeline.tokens:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "lang_pred"]
