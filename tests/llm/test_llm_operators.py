"""The dealt operators against brute force, round trips and odd inputs."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from dnslens.llm import (
    bpe_automaton,
    chat_format,
    exact_top_k,
    id_packs,
    kernel_langid,
    passages,
    shard_packing,
    simhash_anchors,
    substring_dedup,
    winnow,
    wrapper_induction,
)
from dnslens.llm.components import components
from dnslens.llm.html_tree import Page
from dnslens.llm.word_units import tokenizer_text

DOC = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, hit long, of long, unit string"
WORDS = "river stone candle meadow lantern harbour copper willow thunder marble orchard velvet falcon ember".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice("abcdefgh") + str(rng.randrange(50)) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and blank texts, a very long one, repeated rows, clashing extra columns."""
    long = prose(1, 30_000)
    texts = [None, "", " \n\t ", "!!! 123", "Éa", long, long, prose(2, 80), prose(2, 80), "x y z é <|endoftext|> don't"]
    rows = [(i, t, "en" if i % 2 else None, None, None, 7, 3, 9, 4, "u") for i, t in enumerate(texts)]
    rows += [rows[7], (None, "no id", "en", "s", 5, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tool = Tokenizer.from_str(tokenizer_text())
    tool.no_truncation()
    tool.no_padding()
    return tool


def docs_of(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_automaton_is_the_library(library):
    tool, rng = bpe_automaton.Codec(tokenizer_text()), random.Random(3)
    texts = ["aaaaaaaaaaa", "<|endoftext|>x<|startoftext|>", "İ ΣΑΣ ﬁ x́ y\x1cz\x0bq 日本 don't 've", "", " ", "½²×÷ ª 😀", "éÉ é"]
    texts += ["".join(rng.choice("abehinorst é日'1!") for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    for text, expected in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        ids = tool.encode(text)
        assert ids == np.array(expected.ids, "<u4").tobytes(), text
        assert tool.decode(ids).decode() == library.decode(expected.ids, skip_special_tokens=False)


@pytest.mark.parametrize("letters", ["acgt", "a", "日本語漢字", "qzxj'é", "the"])
def test_long_pieces_are_the_library(library, letters):
    tool, rng = bpe_automaton.Codec(tokenizer_text()), random.Random(8)
    for text in ((letters * 10_000)[:10_000], "".join(rng.choice(letters) for _ in range(10_000))):
        assert tool.encode(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_round_trip_rows(spark, odd, empty, library):
    rows = bpe_automaton.round_trip(odd).collect()
    assert len(rows) == odd.count() and bpe_automaton.round_trip(empty).count() == 0
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    for r in (r for r in rows if r.doc_id is not None):
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    coded = bpe_automaton.encode(odd.filter("doc_id = 7"))
    assert bpe_automaton.decode(coded).first().decoded == library.decode(coded.first().ids, skip_special_tokens=False)


def test_id_packs(spark, sf_dir, odd, empty, library, tmp_path):
    assert id_packs.write_and_index(empty).count() == 0
    path = str(tmp_path / "packs")
    id_packs.write(docs_of(spark, sf_dir), path)
    got = {r.doc_id: r for r in id_packs.index(spark, path).collect()}
    start, texts = 0, docs_of(spark, sf_dir).select("doc_id", "text").orderBy("doc_id").collect()
    for r in texts:
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        assert tuple(got[r.doc_id]) == (r.doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    one = id_packs.read(spark, path, doc_id=texts[3].doc_id).collect()
    assert len(one) == 1 and len(one[0].ids) == 4 * got[texts[3].doc_id].n_tokens
    rows = id_packs.write_and_index(odd).collect()
    assert len(rows) == odd.count() and sum(r.n_tokens == 1 for r in rows) >= 3
    spans = sorted((r.start, r.n_tokens) for r in rows)
    assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))


def test_shards(spark, sf_dir, odd, empty):
    assert shard_packing.shard(empty).count() == 0
    for docs in (docs_of(spark, sf_dir), odd):
        rows = shard_packing.shard(docs).collect()
        assert len(rows) == docs.count()
        for s in {r.shard for r in rows}:
            assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    sizes = Counter()
    for r in shard_packing.shard(docs_of(spark, sf_dir)).collect():
        sizes[r.shard] += r.size
    assert len(sizes) == 8 and max(sizes.values()) < 1.1 * min(sizes.values())


def test_shards_keep_groups_and_split_hot_ones(spark):
    rows = [(i, f"text {i % 40} " + "w " * (i % 40)) for i in range(400)] + [(1000 + i, "hot " * 20) for i in range(300)]
    out = shard_packing.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    homes = {}
    for r in out:
        if r.doc_id < 400:
            homes.setdefault(r.doc_id % 40, set()).add(r.shard)
    assert all(len(h) == 1 for h in homes.values())
    sizes = Counter()
    for r in out:
        sizes[r.shard] += r.size
    assert max(sizes.values()) < 1.15 * min(sizes.values())


def test_place_is_greedy_by_dot_product():
    units = np.array([[5, 1, 1], [4, 4, 1], [3, 3, 1], [2, 2, 1], [1, 5, 1]])
    chosen, share = shard_packing.place(units, 2), units / units.sum(axis=0)
    left, expected = np.full((2, 3), 0.5), {}
    for i in sorted(range(5), key=lambda i: (-share[i].max(), i)):
        best = max(range(2), key=lambda s: (left[s] @ share[i], -s))
        expected[i] = best
        left[best] -= share[i]
    assert chosen.tolist() == [expected[i] for i in range(5)]


def brute_components(nodes, linked):
    home = {n: n for n in nodes}

    def root(x):
        while home[x] != x:
            x = home[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        home[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(100, 200 + i) for i in range(80)] + [(7, 7), (300, 301), (301, 300)]
    edges += [(rng.randrange(400, 700), rng.randrange(400, 700)) for _ in range(150)]
    df = spark.createDataFrame([*edges, (None, 3), (3, None)], "a long, b long").repartition(5)
    real = [e for e in edges if e[0] != e[1]]
    expected = brute_components({n for e in real for n in e}, real)
    assert {r.node: r.root for r in components(df).collect()} == expected
    assert components(df.filter("false")).count() == 0


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, sf_dir, odd, empty):
    assert simhash_anchors.report(empty).count() == 0
    for docs in (docs_of(spark, sf_dir), odd):
        rows = docs.select("doc_id", "text").collect()
        prints = [plain_fingerprint(r.text) for r in rows]
        got = simhash_anchors.report(docs).collect()
        assert Counter((r.doc_id, r.fingerprint) for r in got) == Counter((r.doc_id, f"{p:016x}") for r, p in zip(rows, prints))
        ids = range(len(rows))
        links = [(i, j) for i in ids for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
        home = brute_components(ids, links)
        least = {}
        for i in ids:
            if rows[i].doc_id is not None:
                least[home[i]] = min(least.get(home[i], rows[i].doc_id), rows[i].doc_id)
        expected = Counter((rows[i].doc_id, least.get(home[i])) for i in ids)
        assert Counter((r.doc_id, r.component_id) for r in got) == expected


def test_anchors_find_every_pair(spark):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(40)]
    close = [b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(1, 3))) for b in base for _ in range(8)]
    fps = sorted(set(base + close))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = simhash_anchors.links(spark.createDataFrame([(s,) for s in signed], "fp long").repartition(4)).collect()
    pairs = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 3]
    got = [(r.a % (1 << 64), r.b % (1 << 64)) for r in found]
    assert all((a ^ b).bit_count() <= 3 for a, b in got)
    assert brute_components(fps, pairs) == brute_components(fps, got)


def test_crowded_anchors_are_dealt(spark, monkeypatch):
    rng = random.Random(2)
    base = rng.getrandbits(64)
    fps = sorted({base ^ sum(1 << i for i in rng.sample(range(64), rng.randint(1, 6))) for _ in range(400)})
    pairs = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 3]
    distinct = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long").repartition(4)
    sizes = []
    for limit in (simhash_anchors.SPLIT_AT, 10):
        monkeypatch.setattr(simhash_anchors, "SPLIT_AT", limit)
        got = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash_anchors.links(distinct).collect()]
        assert all((a ^ b).bit_count() <= 3 for a, b in got)
        assert brute_components(fps, pairs) == brute_components(fps, got)
        sizes.append(simhash_anchors.groups(distinct).groupBy("anchor").count().agg(F.max("count")).first()[0])
    assert sizes[1] < sizes[0]


def test_top_k(spark, empty):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6).round(1)], 1) for i in range(300)]
    rows[10] = (10, rows[0][1], 1)
    rows += [(900, None, 0), (901, [1.0, None], 0), (902, [float("nan")] * 6, 0), (903, [float("inf")] * 6, 0), (950, [0.0] * 6, 0), (None, [1.0] * 6, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = {}
    for r in exact_top_k.report(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    whole = [(i, np.floor(256 * np.array(v))) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    for q, v in whole:
        if q % 50 == 0:
            best = sorted(((-int(v @ w), i) for i, w in whole if i != q))[:5]
            assert sorted(got.pop(q)) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert not got
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert exact_top_k.report(none).count() == 0
    assert exact_top_k.report(spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")).count() == 0


def test_threshold_stops_and_large_numbers():
    ids, rows = np.arange(500), np.zeros((500, 3))
    rows[:, 0] = np.arange(500)[::-1] * 2.0**40
    a, b = exact_top_k._exact(rows, np.array([[2.0**30, 0, 0]]))
    assert exact_top_k.threshold_top_k(ids, a, np.array([-1]), b, 2) == [(-1, 0, 499 << 70), (-1, 1, 498 << 70)]


@pytest.mark.parametrize("high", [200, 2**20, 2**40])
def test_threshold_meets_all_that_matter(high):
    """Skewed, sparse, tied and repeated rows, as floats, doubles and whole numbers of any size."""
    rng = np.random.default_rng(4)
    rows = np.floor(rng.standard_cauchy((1500, 8)).clip(-50, 50) * high / 50)
    rows[rng.random(rows.shape) < 0.5] = 0
    rows[700:720] = rows[3]
    ids = rng.integers(0, 1400, len(rows))
    queries = np.concatenate([rows[:30], np.eye(8)[:3] * high, np.zeros((1, 8))])
    query_ids = np.concatenate([ids[:30], np.array([-1, -2, -3, ids[40]])])
    held, asked = exact_top_k._exact(rows, queries)
    assert held.dtype == {200: np.float32, 2**20: np.float64, 2**40: object}[high]
    got = exact_top_k.threshold_top_k(ids, held, query_ids, asked, 5)
    want = []
    for q, query in zip(query_ids.tolist(), queries.tolist(), strict=True):
        scores = [sum(int(x) * int(y) for x, y in zip(row, query, strict=True)) for row in rows.tolist()]
        best = sorted((-s, i) for i, s in zip(ids.tolist(), scores, strict=True) if i != q)[:5]
        want += [(q, i, -s) for s, i in best]
    assert got == want


def test_top_k_over_many_blocks(spark, monkeypatch):
    """Blocks of few rows: unequal lengths, ids and rows that come again, a query longer than all vectors of a block."""
    monkeypatch.setattr(exact_top_k, "BLOCK", 8)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-90, 90, rng.integers(0, 7))]) for i in range(200)]
    rows += rows[5:15] + [(50, [1.0, 2.0, 3.0]), (201, [float(2**40)] * 3), (100, [1.0] * 9)]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    got = {}
    for r in exact_top_k.top_k(df, df.filter("vec_id % 25 = 0"), 7).collect():
        got.setdefault(r.query_id, []).append((r.rank, -r.score, r.vec_id))
    want = {}
    for q, v in rows:
        if q % 25 == 0:
            pairs = [(-sum(int(a) * int(b) for a, b in zip(v, w, strict=False)), i) for i, w in rows if i != q]
            want.setdefault(q, []).extend(sorted(pairs)[:7])
    assert exact_top_k.block_count(len(rows), 1) > 20
    assert {q: sorted(x) for q, x in got.items()} == {q: [(n + 1, *x) for n, x in enumerate(sorted(best)[:7])] for q, best in want.items()}


def test_top_k_queries_do_not_pass_the_driver(spark):
    """Queries look small enough to be broadcast, but they are copied once for each block."""
    df = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(300)], "vec_id long, embedding array<float>")
    found = exact_top_k.report(df)
    assert len(found.collect()) == 30
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_blocks_grow_with_the_table():
    """Copies of a query: no more than SPREAD until a block holds all it may; no block holds more."""
    assert [exact_top_k.block_count(n, 64 * n) for n in (0, 500, 10_256, 102_564, 720_000)] == [1, 1, 6, 51, 64]
    assert exact_top_k.block_count(15_000_000, 64 * 15_000_000) == 458


def test_language(spark, sf_dir, odd, empty):
    rows = kernel_langid.report(docs_of(spark, sf_dir)).join(docs_of(spark, sf_dir).select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs_of(spark, sf_dir).count() and {r.held_out for r in rows} == {True, False}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in rows)
    got = Counter((r.doc_id, r.lang_pred) for r in kernel_langid.report(odd).collect())
    assert {i for i, lang in got if lang == "und"} == {0, 1, 2, 3, None} and sum(got.values()) == odd.count()
    assert kernel_langid.report(empty).count() == 0
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in kernel_langid.report(unlabelled).collect()} == {"und"}


def plain_hits(words, items):
    hit, names = set(), set()
    for name, item in items:
        n = min(10, len(item))
        windows = {tuple(item[i : i + n]) for i in range(len(item) - n + 1)} if n else set()
        for i in range(len(words) - n + 1 if n else 0):
            if tuple(words[i : i + n]) in windows:
                hit.update(range(i, i + n))
                names.add(name)
    return len(hit), sorted(names)


def test_winnow(spark, odd, empty):
    passage = prose(30, 40)
    items = [(1, passage, 0), (2, "Short item", 0), (3, prose(31, 10), 0), (10, "one two three four five six seven", 0), (4, None, 0),
             (5, " .. ", 0), (1, passage, 0), (6, "a a a a a a a a a a a a", 0)]
    texts = [passage, "x " + " ".join(passage.split()[5:15]) + " y", " ".join(passage.split()[5:14]), "a SHORT ITEM, short item",
             prose(31, 9), prose(31, 10) + " " + prose(31, 10), "five one two three four five six seven", "a " * 30, "École " * 12, None, ""]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] * 2, "doc_id long, text string, item string")
    bench = spark.createDataFrame(items, "item_id long, text string, doc_id long")

    def cut(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    plain = [(str(i), cut(t)) for i, t, _ in items]
    got = winnow.report(docs, bench).collect()
    assert len(got) == 2 * len(texts)
    for r in got:
        words = cut(texts[r.doc_id])
        n, names = plain_hits(words, plain)
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(words), n, len(names), n > 0), texts[r.doc_id]
        assert r.items_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
    spans = winnow.decontaminate(docs.filter("doc_id = 1").limit(1), bench).first().spans
    assert [(s.item_id, s.first, s.words) for s in spans] == [("1", 1, 10)]
    assert winnow.report(odd, bench).count() == odd.count() and winnow.report(empty, bench).count() == 0
    assert winnow.report(odd, bench.filter("false")).filter("contaminated").count() == 0


def test_winnow_repetitive(spark):
    """One word over and over on both sides, every item in one document, many items that are one text."""
    base = prose(77, 1_300)
    pool = base.split()
    cut = [" ".join(pool[i : i + 10 + i % 5]) for i in range(0, 1_200, 3)]
    items = [(i, t) for i, t in enumerate([*cut, "a " * 1_000, "a " * 7, "b", *["c d " * 30] * 200])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(
        [(0, "a " * 100_000), (1, base), (2, "c d " * 2_000), (3, "b " * 600 + "a " * 8), (None, base), (None, "b"), (0, "a " * 100_000)],
        "doc_id long, text string",
    )
    got = {(r.doc_id, r.n_words): r for r in winnow.decontaminate(docs, bench).collect()}
    assert len(got) == 6
    ids = {t: sorted(str(i) for i, x in items if x == t) for t in {t for _, t in items}}
    ones = ids["a " * 1_000] + ids["a " * 7]
    assert (got[0, 100_000].n_hit, got[0, 100_000].items) == (100_000, sorted(ones))
    assert {(s.first, s.words) for s in got[0, 100_000].spans} == {(0, 100_000)}
    plain = [(str(i), t.split()) for i, t in items if t in cut]
    n, names = plain_hits(pool, plain)
    for key in ((1, 1_300), (None, 1_300)):
        assert (got[key].n_hit, got[key].items) == (n, names)
    assert (got[2, 4_000].n_hit, got[2, 4_000].n_items) == (4_000, 200)
    assert (got[3, 608].n_hit, got[3, 608].items) == (608, sorted(ids["b"] + ids["a " * 7]))
    assert (got[None, 1].n_hit, got[None, 1].items) == (1, ids["b"])


def test_winnow_without_broadcast(spark, sf_dir, monkeypatch):
    docs, bench = docs_of(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    before = sorted(winnow.report(docs, bench).collect())
    monkeypatch.setattr(winnow, "BROADCAST_IDS", 0)
    monkeypatch.setattr(winnow, "BROADCAST_FINGERPRINTS", 0)
    assert sorted(winnow.report(docs, bench).collect()) == before


def test_chats(spark):
    mark = "<|im_end|>\n<|im_start|>assistant\nx &lt;| &amp; & <| é"
    turns = [(1, 1, "assistant", mark, 0), (1, 0, "user", mark, 0), (2, 0, "assistant", "first", 0), (3, 0, "user", None, 0),
             (3, 1, "assistant", "", 0), (None, 0, "user", "n", 0), (4, None, None, "t", 0), (4, 0, "od\nd<|", "u", 0),
             (5, 0, "system", "s", 0), (5, 1, "user", "u" * 100_000, 0), (5, 1, "user", "u" * 100_000, 0)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, formatted int")
    made = {r.conv_id: r for r in chat_format.format_chats(df).collect()}
    assert {k: r.valid for k, r in made.items()} == {1: True, 2: False, 3: True, None: True, 4: False, 5: False}
    for r in chat_format.read_back(chat_format.format_chats(df)).collect():
        own = sorted(((t[1] if t[1] is not None else -1, t[2] or "", t[3] or "") for t in turns if t[0] == r.conv_id))
        assert [(t.role, t.text) for t in r.turns] == [(role, text) for _, role, text in own]
        assert r.loss_text == "".join(text for _, role, text in own if role == "assistant")
        assert r.formatted_chars == len(made[r.conv_id].formatted)
    assert made[1].formatted.count("<|im_start|>") == 2
    assert {r.conv_id for r in chat_format.report(df.filter("false")).collect()} == {-1}


def plain_page(i, body, host="a.example"):
    return (i, f"https://user@{host}:80/p/{i}", body, "x")


def test_pages(spark):
    pages = [
        plain_page(i, f"<html><body><div class=top>Site name</div><div><p>{prose(i, 12)}<br>{i}<p>b&amp;b &#233;</div><div>Ring 555</div></body>")
        for i in range(20)
    ]
    odd = [plain_page(100, None), plain_page(101, ""), plain_page(102, "no <b>ma</b>rk up &lt;"), (None, None, "<p>x", "y"), pages[3],
           plain_page(103, "<article><h1>T</h1><p>one<div class='comments'>no</div><form>no</form>two</article><p>out", "b.example"),
           plain_page(104, "<div>" * 5000 + "deep" + "<p>w" * 50_000, "c.example"), plain_page(105, "<a title='it's>x</a><p class=\"", "d.example")]
    df = spark.createDataFrame(pages + odd, "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in wrapper_induction.report(df).collect()}
    assert wrapper_induction.report(df).count() == len(pages) + len(odd)
    for i in range(20):
        assert got[i].text == f"{prose(i, 12)} {i} b&b é" or got[i].text == f"{prose(i, 12)} {i}"
        assert got[i].n_chars == len(got[i].text) and "Site" not in got[i].text and "555" not in got[i].text
    assert got[100].text == got[101].text == "" and got[102].text == "no mark up <" and got[103].text == "T one two"
    assert got[104].text.startswith("deep w w") and got[104].n_chars == 4 + 2 * 50_000
    assert wrapper_induction.report(df.filter("false")).count() == 0


def test_template_inside_marked_articles(spark):
    def page(i, host, title, text):
        notice = "<div class=box>Read more of this in our archive of old and new stories</div>"
        return plain_page(i, f"<body><div>{prose(i, 5)}</div><article><h1>{title}</h1>{notice}<p>{text}</p><section>Ring 555</section></article>", host)

    near = [prose(300, 80).split() for _ in range(40)]
    for i, words in enumerate(near):
        words[2 * i] = f"changed{i}"
    pages = [page(i, "varied.example", prose(200 + i, 4), prose(i, 20)) for i in range(20)]
    pages += [page(100 + i, "copies.example", "One title", prose(301, 30)) for i in range(20)]
    pages += [page(200 + i, "near.example", "One title", " ".join(words)) for i, words in enumerate(near)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in wrapper_induction.report(df).collect()}
    whole = "One title Read more of this in our archive of old and new stories {} Ring 555"
    assert all(got[i] == f"{prose(200 + i, 4)} {prose(i, 20)}" for i in range(20))
    assert all(got[100 + i] == whole.format(prose(301, 30)) for i in range(20))
    assert all(got[200 + i] == whole.format(" ".join(words)) for i, words in enumerate(near))


def test_class_names_set_no_article_aside(spark):
    text = prose(70, 60)
    open_close = [("<body class='single has-sidebar'><article>", "</article>"), ("<div id='page' class='no-sidebar'><article>", "</article></div><div>other</div>"),
                  ("<article class='post has-comments'>", "</article>"), ("<main class='site-main search'>", "</main>"),
                  ("<div class=related><main>", "</main></div>"), ("<article id='share-prices'>", "</article>"), ("<div class='share-page'><p>", "</div><p>other")]
    inner = "<p>%s</p><div class='comments'><article class='comment'>no</article></div><div class='share'>no</div><nav>no</nav>"
    pages = [plain_page(i, a + inner % text + b, f"{i}.example") for i, (a, b) in enumerate(open_close)]
    pages.append(plain_page(50, f"<div>{text}</div><div class=comments><article class=comment>no</article></div>", "z.example"))
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in wrapper_induction.report(df).collect()}
    assert got == {i: text for i in (0, 1, 2, 3, 4, 5, 50)} | {6: text + " other"}


def test_alignment_matches_most_nodes():
    a, b = "-1:#;0:div;0:p;0:ul;3:li", "-1:#;0:p;0:nav;0:ul;3:li;3:a"
    assert wrapper_induction.align(a, b) == (0, -1, 1, 3, 4)
    assert wrapper_induction.align(a, a) == (0, 1, 2, 3, 4)
    assert [t for _, t in Page("<ul><li>a<li>b</ul><script>if(a<b)'</p>'</script><!-- <p>c -->d<td>e").blocks] == ["a", "b", "d", "e"]


def test_passages_are_cut_alike_anywhere():
    shared = prose(50, 60)
    found = []
    for seed in range(20):
        text = prose(60 + seed, seed * 3) + " " + shared + "\n" + prose(90 + seed, 30)
        rows = passages.paragraphs([b"other text", text.encode()])
        here = {int(c) for c, t in zip(rows["content"], rows["text"]) if t == 1}
        found.append(here)
        for t, s, e, n in zip(rows["text"], rows["start"], rows["end"], rows["n_words"]):
            assert t == 1 and len(text[s:e].split()) == n
    assert set.intersection(*found)


def test_substring_dedup(spark, odd, empty):
    assert substring_dedup.report(empty).count() == 0
    assert {r.doc_id for r in substring_dedup.report(odd).collect()} == {5, 6, 7, 8}
    shared, near = prose(7, 55), prose(8, 60).split()
    texts = [prose(100, 90) + " " + shared + " " + prose(101, 70), "É " + prose(102, 40) + "\n" + shared + "\n" + prose(103, 90), prose(104, 200),
             " ".join(near), " ".join(["other", *near[1:]]), prose(105, 6), prose(105, 6), None]
    df = spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, n_chars int")
    rows = substring_dedup.report(df).collect()
    assert {r.doc_id for r in rows} == {0, 1, 3, 4} and {r.doc_id for r in rows if r.removed} == {1, 4}
    assert all((r.class_doc_id, r.removed) in ((r.doc_id, False), (0, True), (3, True)) for r in rows)
    out = {r.doc_id: r for r in substring_dedup.deduplicated(df).collect()}
    assert all(out[i].text == texts[i] for i in (0, 2, 3, 5, 6, 7))
    kept = out[1].text
    assert len(kept) < len(texts[1]) and kept.startswith("É ") and out[1].n_chars == len(kept)
    assert all(w in kept for w in prose(102, 25).split() + prose(103, 90).split()[20:])


def test_similar_contents_are_linked(spark, monkeypatch):
    rng = random.Random(4)
    base = sorted((rng.getrandbits(63) for _ in range(40)), key=lambda x: x * int(passages._ODD[12]) % (1 << 64))
    # All share the shingle of the band's value, which so parts nothing.
    sets = [np.array(sorted([base[0], *rng.sample(base[1:], rng.randint(33, 39))]), np.uint64) for _ in range(60)]
    sets += [np.array([base[0]], np.uint64)] * 2
    n = len(sets)
    pairs = [(i, j) for i in range(n) for j in range(i) if len(set(sets[i].tolist()) & set(sets[j].tolist())) >= 0.8 * len(set(sets[i].tolist()) | set(sets[j].tolist()))]
    expected = brute_components(range(n), pairs)
    assert brute_components(range(n), substring_dedup.tree_edges(list(enumerate(sets)))) == expected
    band = int((sets[0] * passages._ODD[12]).min().view(np.int64))
    assert all(int((s * passages._ODD[12]).min().view(np.int64)) == band for s in sets)
    met = spark.createDataFrame([(i, band) for i in range(n)], "content long, band long")
    shingles = spark.createDataFrame([(i, s.astype("<u8").tobytes()) for i, s in enumerate(sets)], "content long, shingles binary")
    for limit in (substring_dedup.SPLIT_AT, 5):
        monkeypatch.setattr(substring_dedup, "SPLIT_AT", limit)
        assert brute_components(range(n), [tuple(r) for r in substring_dedup.similar(met, shingles).collect()]) == expected


def test_linked_contents_need_few_scans(monkeypatch):
    common = list(range(10, 20))
    members = [(i, np.array([*common, 100 + i], np.uint64)) for i in range(3000)]
    scans, plain = [], np.bincount
    monkeypatch.setattr(substring_dedup.np, "bincount", lambda *a, **k: scans.append(1) or plain(*a, **k))
    edges = substring_dedup.tree_edges(members)
    assert len(edges) == 2999 and len(set(brute_components(range(3000), edges).values())) == 1 and len(scans) < 5


def test_parts_of_one_leading_shingle_are_cut_into_blocks(spark, monkeypatch):
    # Variants of one sentence: ten shingles of eleven are equal, so all fall into the same parts.
    sets = [np.array([*range(10, 20), 100 + i], np.uint64) for i in range(400)]
    sets += [np.array([*range(10, 14), *range(1000 + 10 * i, 1007 + 10 * i)], np.uint64) for i in range(200)]
    n = len(sets)
    met = spark.createDataFrame([(i, 5) for i in range(n)], "content long, band long")
    shingles = spark.createDataFrame([(i, s.astype("<u8").tobytes()) for i, s in enumerate(sets)], "content long, shingles binary")
    monkeypatch.setattr(substring_dedup, "SPLIT_AT", 50)
    made = substring_dedup.groups(met, shingles)
    assert made.groupBy("band", "part", "low", "high").count().agg(F.max("count")).first()[0] <= 200
    home = brute_components(range(n), [tuple(r) for r in substring_dedup.similar(met, shingles).collect()])
    assert home == {i: 0 if i < 400 else i for i in range(n)}
