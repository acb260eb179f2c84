"""Operators that count over the whole corpus, against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from dnslens.llm import backoff_automaton, phrase_mining, slice_tally, token_alignment
from dnslens.llm.word_units import byte_symbols

DOC = "doc_id long, text string, lang string, slice long, keys string, a0 long, rank int, phrase string"


def odd_rows(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    bits = ["a", "b", "Word", "the", "river", " ", "  ", "\n", " \n", "\t", "é", "日本", "　", "\x85", "\x1c", "'s", "12", ".", "<|endoftext|>",
            "<s>", "</s>", "▁", "...", "😀", "\r\n", "\x0b", "\x00", "  the", "ing", "aaaa"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(600)]
    texts += [None, "", " ", "  ", "\n", "a" * 5_000, "日" * 300, "the river bends " * 4_000, "the river bends " * 3, "the river bends " * 3]
    langs = ["en", "de", None, ""]
    rows = [(i, t, langs[i % 4], i, "k", None, 1, None) for i, t in enumerate(texts)]
    return rows + [rows[-1], (None, "the river", None, *[None] * 5), (None,) * 8, (7, "another text under one id", "en", *[None] * 5)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(5), DOC).repartition(3)


def plain_scores(rows, order):
    """The model by dictionaries and recursion."""
    texts = [(i, [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda x: x[0].lower(), t or "")), None]) for i, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in texts]
    count: Counter[tuple] = Counter()
    for (_, w), out in zip(texts, held, strict=True):
        if not out:
            for k in range(1, order + 1):
                count.update(tuple(w[a : a + k]) for a in range(len(w) - k + 1))
    n, v = sum(c for g, c in count.items() if len(g) == 1), sum(len(g) == 1 for g in count)
    least, kept = backoff_automaton.MIN_COUNT, {}
    for g, c in count.items():
        if len(g) > 1 and c >= least[len(g) - 1]:
            kept.setdefault(g[:-1], []).append(c)

    def p(g):
        if len(g) == 1:
            return (count[g] + 0.5) / (n + 0.5 * (v + 1))
        below, seen = p(g[1:]), count[g[:-1]]
        if not seen:
            return below
        own = kept.get(g[:-1], [])
        out = (seen - sum(own) + backoff_automaton.DISCOUNT * len(own)) / seen * below
        return out + (count[g] - backoff_automaton.DISCOUNT) / seen if count[g] >= least[len(g) - 1] else out

    for (i, w), out in zip(texts, held, strict=True):
        grams = [tuple(w[max(0, a - order + 1) : a + 1]) for a in range(len(w))]
        yield (
            i, out, len(w), sum(count[(x,)] > 0 for x in w), n,
            sum(math.log10(p((x,))) for x in w), sum(math.log10(p(g)) for g in grams),
        )


def same_scores(df, order=3):
    got = sorted(map(tuple, backoff_automaton.score(df, order).collect()), key=repr)
    want = sorted(plain_scores([(r.doc_id, r.text) for r in df.collect()], order), key=repr)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want, strict=True):
        assert a[5:] == pytest.approx(b[5:], rel=1e-10, abs=1e-9)
    return got


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_are_those_of_the_plain_model(odd, order):
    got = same_scores(odd, order)
    if order == 1:
        assert all(r[5] == pytest.approx(r[6]) for r in got)


def test_scores_over_the_given_documents(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(backoff_automaton, "SLICE_BYTES", 1 << 15)
    monkeypatch.setattr(backoff_automaton, "PART_KEYS", 10_000)
    got = same_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    held = [r for r in got if r[1]]
    assert held and sum(r[6] for r in held) > sum(r[5] for r in held)


def test_scores_without_rows_or_training(spark):
    assert backoff_automaton.score(spark.createDataFrame([], DOC)).count() == 0
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    same_scores(spark.createDataFrame([(held, "only held out", None)], "doc_id long, text string, lang string"))
    with pytest.raises(ValueError, match="order"):
        backoff_automaton.score(spark.createDataFrame([], DOC), 4)


def test_packed_numbers_come_back():
    rng = np.random.default_rng(1)
    for x in ([], [0], [2**64 - 1], rng.integers(0, 2**63, 1000).astype(np.uint64)):
        x = np.array(x, np.uint64)
        assert (slice_tally.unpack(slice_tally.pack(x)) == x).all()
        assert (slice_tally.unpack(slice_tally.pack(np.sort(x), True), True) == np.sort(x)).all()
    assert (token_alignment._unmixed(slice_tally.mixed(x)) == x).all()


def plain_phrases(rows, least, top):
    """Contract of the phrase query, by counters."""
    count, size = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda x: x[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            size[lang] += len(w)
            for k in range(1, 5):
                count.setdefault(lang, Counter()).update(tuple(w[a : a + k]) for a in range(len(w) - k + 1))
    out = []
    for lang, f in count.items():
        found = []
        often = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        for g, a in often.items():
            longer = [b for h, b in often.items() if len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h)))]
            if any(100 * b >= 80 * a for b in longer):
                continue
            score, k = min((2_000_000 * a // (f[g[:k]] + f[g[k:]]), k) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        for n, (score, a, phrase, left, right) in enumerate(sorted(found)[:top]):
            out.append((lang, n + 1, phrase.decode(), -a, left, right, size[lang], -score))
    return sorted(out)


@pytest.mark.parametrize(("least", "top"), [(2, 2000), (7, 12), (30, 2000)])
def test_phrases_are_those_of_plain_counting(odd, monkeypatch, least, top):
    monkeypatch.setattr(phrase_mining, "SLICE_BYTES", 1 << 13)
    monkeypatch.setattr(phrase_mining, "PART_KEYS", 1_500)
    want = plain_phrases([(r.lang, r.text) for r in odd.collect()], least, top)
    assert want and sorted(map(tuple, phrase_mining.mine(odd, least, top).collect())) == want


def test_no_phrases(spark):
    assert phrase_mining.mine(spark.createDataFrame([], DOC)).count() == 0
    assert phrase_mining.mine(spark.createDataFrame([(1, None, None), (2, "a b", "en")], "doc_id long, text string, lang string")).count() == 0


def test_frequent_keys_survive_every_merge(monkeypatch):
    monkeypatch.setattr(phrase_mining, "MERGE_KEYS", 40)
    rng = np.random.default_rng(3)
    for _ in range(200):
        keys, counts, total = [], [], Counter()
        for _ in range(rng.integers(1, 12)):
            own = np.unique(rng.zipf(1.3, rng.integers(1, 60)).astype(np.uint64))
            much = rng.integers(1, 9, len(own)).astype(np.uint64)
            keys.append(own)
            counts.append(much)
            total.update(dict(zip(own.tolist(), much.tolist(), strict=True)))
        capacity = sum(total.values()) // 30 + 1
        left = phrase_mining.summary(keys, counts, capacity)
        assert len(left) <= capacity and {k for k, n in total.items() if n >= 30} <= set(left.tolist())


def plain_alignment(rows):
    """Whole texts through both libraries, offsets in sets, links in lists."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    byte, names = {s: i for i, s in enumerate(byte_symbols())}, {i: s for s, i in a.get_vocab().items()}
    found, docs = [], Counter()
    for doc_id, text in rows:
        if not text:
            found.append((doc_id, None))
            continue
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        parts_a = [bytes(byte[c] for c in names[i]) for i in ids_a]
        parts_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not b"".join(parts_a) == b"".join(parts_b) == (" " + text).encode():
            found.append((doc_id, None))
            continue
        ends_a, ends_b = np.cumsum([*map(len, parts_a)]).tolist(), np.cumsum([*map(len, parts_b)]).tolist()
        groups, p, q = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            i, j = ends_a.index(end, p) + 1, ends_b.index(end, q) + 1
            groups.append((ids_a[p:i], ids_b[q:j]))
            p, q = i, j
        links = [(x, y) for g, h in groups for x in g for y in h]
        docs.update(set(links))
        found.append((doc_id, (ids_a, ids_b, groups, links)))
    most = Counter()
    for (x, _), n in docs.items():
        most[x] = max(most[x], n)
    for doc_id, one in found:
        if one is None:
            yield (doc_id, 0, 0, 0, 0, 0, 0, "")
            continue
        ids_a, ids_b, groups, links = one
        shown = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        yield (
            doc_id, len(ids_a), len(ids_b), len(groups), len(links), sum(docs[x] == most[x[0]] for x in links),
            sum(docs[x] for x in links), hashlib.sha256(shown.encode()).hexdigest(),
        )


@pytest.mark.parametrize("large", [4_096, 2])
def test_alignment_is_that_of_whole_texts(odd, monkeypatch, large):
    monkeypatch.setattr(slice_tally, "SLICE_BYTES", 1 << 13)
    monkeypatch.setattr(token_alignment, "PART_KEYS", 500)
    monkeypatch.setattr(token_alignment, "LARGE_GROUP", large)
    monkeypatch.setattr(token_alignment, "CACHED_UNITS", 50)
    want = sorted(plain_alignment([(r.doc_id, r.text) for r in odd.collect()]), key=repr)
    assert sorted(map(tuple, token_alignment.report(odd).collect()), key=repr) == want


def test_alignment_of_the_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = sorted(plain_alignment([(r.doc_id, r.text) for r in docs.collect()]), key=repr)
    assert sorted(map(tuple, token_alignment.report(docs).collect()), key=repr) == want


def test_alignment_without_texts(spark):
    assert token_alignment.report(spark.createDataFrame([], DOC)).count() == 0
    rows = [(1, None), (None, ""), (3, "▁")]
    got = token_alignment.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(i, 0, 0, 0, 0, 0, 0, "") for i, _ in rows], key=repr)


def test_galloping_is_the_intersection():
    rng = np.random.default_rng(4)
    for _ in range(300):
        long = np.unique(rng.integers(0, 400, rng.integers(1, 200)))
        short = np.unique(rng.integers(0, 400, rng.integers(1, 20)))
        start = np.maximum(0, np.searchsorted(long, short) - rng.integers(0, 50, len(short)))
        at, there = token_alignment.common_ends(short, long, start)
        assert short[at].tolist() == np.intersect1d(short, long).tolist() == long[there].tolist()


def test_slices_are_not_shuffled(spark, sf_dir, monkeypatch):
    """Answers come to the bucketed slices; only they are exchanged."""
    monkeypatch.setattr(slice_tally, "BUCKET_BYTES", 1 << 16)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cut, buckets, counts = token_alignment.alignment(spark.read.parquet(f"{sf_dir}/documents.parquet"))
        plan = slice_tally.answered(cut, buckets, counts)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert buckets > 1 and "Bucketed: true" in plan
    assert plan.count("Exchange ") == 1


def test_slices_hold_whole_documents(spark, monkeypatch):
    monkeypatch.setattr(slice_tally, "SLICE_BYTES", 1)
    seen = slice_tally.cut_slices(
        spark.createDataFrame([(str(i) * 9,) for i in range(30)], "text string").coalesce(1),
        lambda number, held: {"slice": number, "n": sum(b.num_rows for b in held)},
        pa.schema([("slice", pa.int64()), ("n", pa.int64())]), "slice long, n long",
    )[0].collect()
    assert sum(r.n for r in seen) == 30 and len({r.slice for r in seen}) == len(seen)


def test_one_row_repeated_is_sharded_evenly_and_packed(spark, tmp_path):
    """Rows of one id and text, and rows without an id, are cut like any other."""
    from dnslens.llm import id_packs, shard_packing

    rows = [(7, "the same words again")] * 800 + [(None, "no id at all")] * 800
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = shard_packing.shard(docs).collect()
    sizes = Counter()
    for r in out:
        sizes[r.shard] += r.size
    assert len(sizes) == 8 and max(sizes.values()) < 1.3 * min(sizes.values())
    for shard in sizes:
        assert sorted(r.slot for r in out if r.shard == shard) == list(range(sum(r.shard == shard for r in out)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        id_packs.write(docs, str(tmp_path / "packs"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    index = sorted(id_packs.index(spark, str(tmp_path / "packs")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in index] == [None] * 800 + [7] * 800
    assert all(b.start == a.start + a.n_tokens for a, b in zip(index, index[1:], strict=False))
    files = spark.read.parquet(str(tmp_path / "packs" / "packs")).select("part").distinct().count()
    assert files > 2


def test_units_encoded_together_have_the_ids_of_each_alone():
    pair = token_alignment.Pair(*token_alignment._tokenizers(None, None))
    rng = random.Random(5)
    pieces = ["a", "Word", "'s", "don't", "12", "3.5", "é", "́", "日本", "🙂", "\n", "\t", "<|endoftext|>", "--", " ", "  ", " ", "_x"]
    units = {"".join(rng.choice(pieces) for _ in range(rng.randrange(1, 6))) for _ in range(600)}
    texts = [" ".join(rng.sample(sorted(units), 5)) for _ in range(200)]
    whole = [" " + u for u in sorted({u for t in texts for u in pair.units(t)})]
    calls = []
    inner = pair.a

    class Counted:
        def encode_batch_fast(self, got, **kw):
            calls.append(len(got))
            return inner.encode_batch_fast(got, **kw)

    pair.a = Counted()
    got = pair.coded_a(whole, [u.encode() for u in whole])
    assert got == [inner.encode(u, add_special_tokens=False).ids for u in whole]
    assert sum(calls) < len(whole) / 2
