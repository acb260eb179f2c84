"""Operator 13: collocations by Misra-Gries summaries per part of the hash space, and a second pass that counts exactly.

The corpus is cut into slices (``slice_tally``). Every slice sends its distinct n-grams with their counts, by hash; a
part of the hash space merges what the slices sent into one summary. The mass of a part is known, so its summary has a
capacity above mass / ``LEAST``: merged summaries then underestimate by less than ``LEAST``, and every n-gram with at
least ``LEAST`` occurrences survives. Words and pairs come first; triples and quadruples are sent only where all their
pairs survived. The second pass counts the survivors exactly and gives those with ``LEAST`` occurrences their words.

What is left are tables of frequent phrases, and the scores, cuts and containments are joins and aggregations on them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dnslens.llm.common import stored
from dnslens.llm.passages import Words
from dnslens.llm.slice_tally import (
    PARCEL,
    PART_KEYS,
    answered,
    chained,
    cut_slices,
    levels,
    mixed,
    pack,
    parcels,
    rows_of,
    sent,
    tally,
    unpack,
)

LONGEST, LEAST, TOP, SCALE, CONTAINED = 4, 30, 2_000, 2_000_000, 80
#: Groups into which the candidates of one language are dealt before the best of all are taken.
DEALT = 256
#: Keys that a summary takes up at a time, beside its capacity.
MERGE_KEYS = 500_000
#: Text of a slice; its n-grams of all orders and the answers to them are held at once.
SLICE_BYTES = 4 << 20

_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_PARTS = _BREAK.copy()
_PARTS[[9, 32]] = True

_SLICE = (
    "slice long, langs array<string>, lang_n array<long>, words binary, strings array<string>, word_lang binary, "
    "tokens binary, left binary, n_tokens long"
)
_SLICE_SCHEMA = pa.schema([
    ("slice", pa.int64()), ("langs", pa.list_(pa.string())), ("lang_n", pa.list_(pa.int64())), ("words", pa.binary()),
    ("strings", pa.list_(pa.string())), ("word_lang", pa.binary()), ("tokens", pa.binary()), ("left", pa.binary()),
    ("n_tokens", pa.int64()),
])
_FREQUENT = "lang string, size int, phrase string, f long"


def _slice(number: int, batches: list[pa.RecordBatch]) -> dict:
    """One slice: its words, each told apart by language, and how many words of its piece stand before each token."""
    langs: dict[str, int] = {}
    hashes, codes, before, spans = [], [], [], []
    data = []
    for batch in batches:
        texts = [t or b"" for t in batch.column(0).cast(pa.binary()).to_pylist()]
        words = Words(texts, _PARTS)
        raw = b"\n".join(texts) + b"\n"
        n = len(words.hash)
        code = np.array([langs.setdefault(x, len(langs)) for x in batch.column(1).to_pylist()], np.int64)[words.text]
        seed = np.array(batch.column(2).to_pylist(), np.int64).view(np.uint64)[words.text]
        breaks = np.concatenate([[0], np.cumsum(_BREAK[np.frombuffer(raw, np.uint8)])])
        fresh = np.ones(n, bool)
        fresh[1:] = breaks[words.start[1:]] != breaks[words.end[:-1]]
        run = np.cumsum(fresh) - 1
        before.append(np.minimum(np.arange(n) - np.flatnonzero(fresh)[run], LONGEST - 1) if n else np.empty(0, np.int64))
        hashes.append(mixed(words.hash + mixed(seed)))
        codes.append(code)
        spans.append(np.stack([np.full(n, len(data)), words.start, words.end], axis=1).reshape(-1, 3))
        data.append(raw)
    flat, code, span = np.concatenate(hashes), np.concatenate(codes), np.concatenate(spans)
    words, sample, tokens = np.unique(flat, return_index=True, return_inverse=True)
    strings = [data[d][a:b].lower().decode() for d, a, b in span[sample].tolist()]
    return {
        "slice": number, "langs": list(langs), "lang_n": np.bincount(code, minlength=len(langs)).tolist(),
        "words": pack(words, rising=True), "strings": strings, "word_lang": pack(code[sample]),
        "tokens": pack(tokens), "left": pack(np.concatenate(before)), "n_tokens": len(flat),
    }


class Phrases:
    """The n-grams of a slice inside its pieces; level by level, some of them."""

    def __init__(self, row: dict) -> None:
        self.words, token = unpack(row["words"], rising=True), unpack(row["tokens"]).astype(np.int64)
        self.left = unpack(row["left"])
        self.hashes = self.words[token]
        self.keys: list[np.ndarray] = [np.empty(0, np.uint64), self.words]
        self.at: list[np.ndarray] = [np.empty(0, np.int64), token]

    def add(self, wanted: np.ndarray) -> None:
        """The next level: of the n-grams that end at the ``wanted`` tokens the distinct ones."""
        level = len(self.keys)
        where = np.flatnonzero(wanted & (self.left >= level - 1))
        distinct, at = np.unique(chained(*(self.hashes[where - back] for back in reversed(range(level)))), return_inverse=True)
        whole = np.full(len(self.left), -1, np.int64)
        whole[where] = at
        self.keys.append(distinct)
        self.at.append(whole)

    def counts(self, level: int) -> np.ndarray:
        """Occurrences of each key in the slice."""
        at = self.at[level]
        return np.bincount(at[at >= 0], minlength=len(self.keys[level])).astype(np.uint64)

    def grow(self, pairs: np.ndarray) -> None:
        """Longer n-grams all of whose pairs are among the surviving ones."""
        at = self.at[2]
        good = np.zeros(len(at), bool)
        good[at >= 0] = pairs[at[at >= 0]] > 0
        run = good
        for _ in range(3, LONGEST + 1):
            run = good & np.concatenate([[False], run[:-1]])[: len(run)]
            self.add(run)


def summary(keys: list[np.ndarray], counts: list[np.ndarray], capacity: int) -> np.ndarray:
    """The keys that survive in the Misra-Gries summary of all that is merged, in order.

    What comes in is merged in turn; where more than ``capacity`` counters are left, the largest count behind them is
    taken from all and counters without a rest go. No count is lowered by more than mass / (capacity + 1) in all.
    """
    held, rest = np.empty(0, np.uint64), np.empty(0, np.int64)
    at = 0
    while at < len(keys):
        some, size = [held], 0
        more = [rest]
        while at < len(keys) and (not size or size + len(keys[at]) <= MERGE_KEYS):
            some.append(keys[at])
            more.append(counts[at].astype(np.int64))
            size += len(keys[at])
            at += 1
        held, own = np.unique(np.concatenate(some), return_inverse=True)
        rest = np.bincount(own, np.concatenate(more), len(held)).astype(np.int64)
        if len(held) > capacity:
            rest = rest - np.partition(rest, len(rest) - capacity - 1)[len(rest) - capacity - 1]
            held, rest = held[rest > 0], rest[rest > 0]
    return held


def _surviving(least: int):
    def merge(keys: list[np.ndarray], counts: list[list[np.ndarray]]) -> tuple[list[int], list[list[np.ndarray]]]:
        mass = sum(int(c[0].sum()) for c in counts)
        kept = summary(keys, [c[0] for c in counts], mass // least + 1)
        marks = [np.isin(k, kept, assume_unique=True).astype(np.uint64) for k in keys]
        return [0] * len(keys), [[m] for m in marks]

    return merge


def _post_short(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for row in rows_of(batches):
                grams = Phrases(row)
                grams.add(np.ones(len(grams.left), bool))
                for level in (1, 2):
                    yield from parcels(level, row["slice"], grams.keys[level], [grams.counts(level)], parts)

        return sent(rows())

    return run


def _marks(got: dict, level: int, size: int) -> np.ndarray:
    return got[level][0] if level in got else np.zeros(size, np.uint64)


def _rebuilt(row: dict, got: dict) -> Phrases:
    grams = Phrases(row)
    grams.add(np.ones(len(grams.left), bool))
    grams.grow(_marks(got, 2, len(grams.keys[2])))
    return grams


def _post_long(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for row in rows_of(batches):
                grams = _rebuilt(row, levels(row, 1))
                for level in range(3, LONGEST + 1):
                    yield from parcels(level, row["slice"], grams.keys[level], [grams.counts(level)], parts)

        return sent(rows())

    return run


def _post_survivors(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for row in rows_of(batches):
                got = levels(row, 2)
                grams = _rebuilt(row, got)
                for level in range(1, LONGEST + 1):
                    alive = _marks(got, level, len(grams.keys[level])) > 0
                    yield from parcels(level, row["slice"], grams.keys[level][alive], [grams.counts(level)[alive]], parts)

        return sent(rows())

    return run


def _frequent(least: int):
    """Each frequent phrase once: from the slice that is the first to hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            marks = {k: v for k, v in levels({"a0": row["a0"], "a1": row["a1"]}, 2).items()}
            exact = levels({"a0": row["a2"]}, 1)
            grams = _rebuilt(row, marks)
            token, strings, langs = grams.at[1], row["strings"], row["langs"]
            word_lang = unpack(row["word_lang"]).astype(np.int64)
            for level in range(1, LONGEST + 1):
                alive = np.flatnonzero(_marks(marks, level, len(grams.keys[level])))
                if not len(alive):
                    continue
                total, first = exact[level]
                mine = np.flatnonzero((first > 0) & (total >= least))
                ends = np.zeros(len(grams.keys[level]), np.int64)
                here = np.flatnonzero(grams.at[level] >= 0)
                ends[grams.at[level][here]] = here
                last = ends[alive[mine]]
                columns = [token[last - back].tolist() for back in reversed(range(level))]
                phrases = [" ".join([strings[w] for w in words]) for words in zip(*columns, strict=True)]
                whose = [langs[k] for k in word_lang[token[last]].tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(whose, pa.string()), pa.array([level] * len(mine), pa.int32()), pa.array(phrases, pa.string()),
                     pa.array(total[mine].astype(np.int64))], ["lang", "size", "phrase", "f"],
                )

    return run


def frequent(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, size, phrase, f) of every phrase of 1 to ``LONGEST`` words with ``least`` occurrences, and (lang, n)."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    rows = docs.select(F.col("text").cast("string").alias("text"), lang.alias("lang"), F.xxhash64(lang).alias("seed"))
    cut, buckets = cut_slices(rows, _slice, _SLICE_SCHEMA, _SLICE, most=SLICE_BYTES)
    parts = math.ceil((cut.agg(F.sum("n_tokens")).first()[0] or 1) / PART_KEYS)
    needed = cut.select("slice", "words", "tokens", "left")
    merge = _surviving(least)
    short = tally(needed.mapInArrow(_post_short(parts), PARCEL), merge)
    long = tally(answered(needed, buckets, short).mapInArrow(_post_long(parts), PARCEL), merge)
    exact = tally(answered(needed, buckets, short, long).mapInArrow(_post_survivors(parts), PARCEL))
    words = answered(cut.drop("lang_n", "n_tokens"), buckets, short, long, exact).mapInArrow(_frequent(least), _FREQUENT)
    sizes = cut.select(F.explode(F.arrays_zip("langs", "lang_n")).alias("x")).groupBy(F.col("x.langs").alias("lang"))
    return stored(words, "phrases")[0], sizes.agg(F.sum("x.lang_n").alias("n"))


def _best(rows: DataFrame, top: int) -> DataFrame:
    """The first rows of each language; within the groups of a deal before within the language."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    deal = F.pmod(F.xxhash64("phrase"), F.lit(DEALT))
    rows = rows.withColumn("deal", deal).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "deal").orderBy(*order)))
    rows = rows.filter(F.col("rank") <= top)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)


def mine(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Null texts are empty, null languages are ``und``; ids do not matter, repeated rows count as often as they occur;
    texts without words, or without a phrase that is frequent enough, give no rows, as an empty table does. Other
    columns are not carried.
    """
    every, sizes = frequent(docs, least)
    every = every.withColumn("w", F.split("phrase", " "))
    cuts = every.filter("size > 1").select(
        "lang", "size", "phrase", "f", F.explode(F.expr("sequence(1, size - 1)")).alias("k"),
        F.expr("w").alias("w"),
    )
    cuts = cuts.withColumn("head", F.expr("array_join(slice(w, 1, k), ' ')")).withColumn(
        "tail", F.expr("array_join(slice(w, k + 1, size - k), ' ')")
    )
    head = every.select(F.col("lang").alias("hl"), F.col("phrase").alias("hp"), F.col("f").alias("l"))
    tail = every.select(F.col("lang").alias("tl"), F.col("phrase").alias("tp"), F.col("f").alias("r"))
    scored = (
        cuts.join(head, (F.col("lang") == F.col("hl")) & (F.col("head") == F.col("hp")))
        .join(tail, (F.col("lang") == F.col("tl")) & (F.col("tail") == F.col("tp")))
        .withColumn("score", F.expr(f"(cast({SCALE} as decimal(10,0)) * cast(f as decimal(20,0))) div cast(l + r as decimal(20,0))"))
        .groupBy("lang", "phrase", "size", F.col("f").alias("a"))
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    )
    inside = (
        every.filter("size > 2")
        .select("lang", "f", F.explode(F.expr(
            "filter(flatten(transform(sequence(2, size - 1), s -> transform(sequence(1, size - s + 1), "
            "p -> array_join(slice(w, p, s), ' ')))), x -> x <> phrase)"
        )).alias("phrase"))
        .groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    )
    wide = "cast({} as decimal(20,0)) * {}"
    left = scored.join(inside, ["lang", "phrase"], "left").filter(
        F.col("longer").isNull() | F.expr(f"{wide.format('longer', 100)} < {wide.format('a', CONTAINED)}")
    )
    best = _best(left.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"), top)
    return best.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def oracle(least: int = LEAST, top: int = TOP) -> str:
    """SQL for ``mine``."""
    return rf"""
WITH p AS (
  SELECT lang, row_number() OVER () AS id, piece FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (
  SELECT lang, size, phrase, count(*) AS f FROM (
    SELECT lang, size, array_to_string(ws[i : i + size - 1], ' ') AS phrase FROM (
      SELECT lang, ws, size, unnest(generate_series(1, len(ws) - size + 1)) AS i FROM w, generate_series(1, {LONGEST}) AS s(size)
      WHERE len(ws) >= size)) GROUP BY ALL HAVING count(*) >= {least}),
x AS (SELECT *, string_split(phrase, ' ') AS ws FROM g),
c AS (
  SELECT x.lang, x.phrase, x.f AS a, k, h.f AS l, t.f AS r,
    (({SCALE}::HUGEINT * x.f::HUGEINT) // (h.f + t.f)::HUGEINT)::BIGINT AS score
  FROM (SELECT *, unnest(generate_series(1, size - 1)) AS k FROM x WHERE size > 1) AS x
  JOIN g AS h ON h.lang = x.lang AND h.phrase = array_to_string(x.ws[1 : k], ' ')
  JOIN g AS t ON t.lang = x.lang AND t.phrase = array_to_string(x.ws[k + 1 :], ' ')),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (
  SELECT lang, array_to_string(ws[i : i + s - 1], ' ') AS phrase, max(f) AS longer FROM (
    SELECT lang, ws, f, s, unnest(generate_series(1, len(ws) - s + 1)) AS i
    FROM x, generate_series(2, {LONGEST - 1}) AS q(s) WHERE s < size) GROUP BY ALL),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
k AS (
  SELECT b.lang, b.phrase, a, l, r, score, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank
  FROM b LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase
  WHERE o.longer IS NULL OR 100 * o.longer::HUGEINT < {CONTAINED} * a::HUGEINT)
SELECT k.lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n, score FROM k JOIN n ON n.lang = k.lang WHERE rank <= {top}
"""


ORACLE = oracle()
