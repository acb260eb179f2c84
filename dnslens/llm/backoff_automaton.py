"""Operator 12: texts scored by a smoothed n-gram model, as a weighted automaton with failure arcs.

The model learns from every token of every training document. Its lowest order is the add-half unigram model with one
class for all unknown words; the orders above subtract ``DISCOUNT`` from each count and give what that frees to the
order below (interpolated absolute discounting), so the probabilities of each context sum to one. N-grams of two words
are all kept, those of three from two occurrences on (``MIN_COUNT``).

As an automaton: a state is a context that training saw (the last two words, the last word, or nothing), an arc of a
state is an n-gram that is kept, with the logarithm of its interpolated probability, and a state's failure arc leads to
the state of one word less with the logarithm of the freed mass. A text is read once from left to right: the state is
carried from word to word, and where a state has no arc for the word, its failure arc is taken and paid for.

The automaton of a large corpus fits no machine. Each slice of the corpus (``slice_tally``) gets just the states and
arcs that its own texts can reach: it sends its n-grams, gets back their counts over all training documents, and builds
its part of the automaton from them. What travels are counts per slice, whatever a document's or a word's frequency.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dnslens.llm.passages import Words
from dnslens.llm.slice_tally import (
    PARCEL,
    PART_KEYS,
    answered,
    chained,
    cut_slices,
    levels,
    pack,
    parcels,
    rows_of,
    sent,
    tally,
    unpack,
)

ORDER, DISCOUNT, MIN_COUNT = 3, 0.75, (1, 1, 2)
#: Documents whose crc32 leaves this remainder by this divisor are held out.
FOLDS, HELD_OUT = 5, 1
#: Text of a slice; its n-grams of all orders are held at once.
SLICE_BYTES = 4 << 20
END = np.uint64(0x5E0FEED0C0FFEE01)
#: Contexts travel beside n-grams, on levels of their own.
CONTEXT = 10

_SLICE = "slice long, doc_ids array<long>, held array<boolean>, lens binary, words binary, tokens binary, n_train long, n_tokens long"
_SLICE_SCHEMA = pa.schema([
    ("slice", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("lens", pa.binary()),
    ("words", pa.binary()), ("tokens", pa.binary()), ("n_train", pa.int64()), ("n_tokens", pa.int64()),
])
_SCORE = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)


def _slice(number: int, batches: list[pa.RecordBatch]) -> dict:
    """One slice: the words of its documents, each followed by an end."""
    ids, held, lens, hashes = [], [], [], []
    for batch in batches:
        words = Words([t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()])
        many = np.bincount(words.text, minlength=batch.num_rows)
        out = np.full(len(words.hash) + batch.num_rows, END, np.uint64)
        out[np.arange(len(words.hash)) + words.text] = words.hash
        hashes.append(out)
        lens.append(many + 1)
        ids += batch.column(0).to_pylist()
        held += batch.column(2).to_pylist()
    size = np.concatenate(lens)
    words, tokens = np.unique(np.concatenate(hashes), return_inverse=True)
    return {
        "slice": number, "doc_ids": ids, "held": held, "lens": pack(size), "words": pack(words, rising=True),
        "tokens": pack(tokens), "n_train": int(size[~np.array(held, bool)].sum()), "n_tokens": int(size.sum()),
    }


class Grams:
    """The n-grams of a slice: for each level its distinct keys, and at each token which of them ends there."""

    def __init__(self, row: dict, order: int) -> None:
        self.lens = unpack(row["lens"]).astype(np.int64)
        self.words, token = unpack(row["words"], rising=True), unpack(row["tokens"]).astype(np.int64)
        self.starts = np.cumsum(self.lens) - self.lens
        place = np.arange(len(token)) - np.repeat(self.starts, self.lens)
        self.train = np.repeat(~np.array(row["held"], bool), self.lens)
        self.has = [None, np.ones(len(token), bool), *(place >= k for k in range(1, order))]
        self.keys: list[np.ndarray] = [np.empty(0, np.uint64), self.words]
        self.at: list[np.ndarray] = [np.empty(0, np.int64), token]
        hashes = self.words[token]
        for level in range(2, order + 1):
            where = np.flatnonzero(self.has[level])
            flat = chained(*(hashes[where - back] for back in reversed(range(level))))
            distinct, at = np.unique(flat, return_inverse=True)
            whole = np.full(len(token), -1, np.int64)
            whole[where] = at
            self.keys.append(distinct)
            self.at.append(whole)

    def counts(self, level: int) -> np.ndarray:
        """How often each key occurs in the slice's training documents."""
        seen = self.at[level][self.train & self.has[level]]
        return np.bincount(seen, minlength=len(self.keys[level])).astype(np.uint64)

    def contexts(self, level: int) -> np.ndarray:
        """For each key of ``level``, the key of the level below that is its context."""
        out = np.zeros(len(self.keys[level]), np.int64)
        where = np.flatnonzero(self.has[level])
        out[self.at[level][where]] = self.at[level - 1][where - 1]
        return out

    def tails(self, level: int) -> np.ndarray:
        """For each key of ``level``, the key of the level below that is the rest behind its first word."""
        out = np.zeros(len(self.keys[level]), np.int64)
        where = np.flatnonzero(self.has[level])
        out[self.at[level][where]] = self.at[level - 1][where]
        return out

    def possible(self, level: int, total: np.ndarray) -> np.ndarray:
        """Keys of ``level`` both of whose parts of a word less occur often enough for the key to be kept."""
        often = total >= MIN_COUNT[level - 1]
        return often[self.contexts(level)] & often[self.tails(level)]


def _spread(values: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    out = np.zeros(len(chosen), values.dtype)
    out[chosen] = values
    return out


def _known(grams: Grams, got: dict[int, list[np.ndarray]], order: int) -> tuple[list, list]:
    """Counts of each level over the corpus, and marks of the keys that this slice adds to their context."""
    total, first = [None, got[1][0]], [None, got[1][1]]
    for level in range(2, order + 1):
        keys = grams.keys[level]
        chosen = np.ones(len(keys), bool) if MIN_COUNT[level - 1] < 2 else grams.possible(level, total[level - 1])
        count, mark = got.get(level, (np.empty(0, np.uint64),) * 2)[:2]
        total.append(_spread(count, chosen))
        first.append(_spread(mark, chosen))
    return total, first


def _mass(grams: Grams, level: int, total: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """For each context below ``level``: kept n-grams that this slice adds, and the sum of their counts."""
    kept = (first > 0) & (total >= MIN_COUNT[level - 1])
    context = grams.contexts(level)[kept]
    size = len(grams.keys[level - 1])
    return [np.bincount(context, minlength=size).astype(np.uint64), np.bincount(context, total[kept], size).astype(np.uint64)]


def _first_round(order: int, parts: int):
    """Words and, since all are kept, pairs of words; higher orders follow when pairs are counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for row in rows_of(batches):
                grams = Grams(row, min(order, 2))
                for level in range(1, min(order, 2) + 1):
                    yield from parcels(level, row["slice"], grams.keys[level], [grams.counts(level)], parts)

        return sent(rows())

    return run


def _next_round(level: int, order: int, parts: int):
    """The contexts below ``level``, whose n-grams have been counted, and the n-grams above that may be kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for row in rows_of(batches):
                grams = Grams(row, min(order, level + 1))
                total, first = _known(grams, levels(row, level - 1), level)
                own = _mass(grams, level, total[level], first[level])
                yield from parcels(CONTEXT + level - 1, row["slice"], grams.keys[level - 1], own, parts)
                if level < order:
                    chosen = grams.possible(level + 1, total[level])
                    yield from parcels(level + 1, row["slice"], grams.keys[level + 1][chosen], [grams.counts(level + 1)[chosen]], parts)

        return sent(rows())

    return run


class Automaton:
    """States, arcs and failure arcs that the texts of a slice can reach, with logarithms to base 10 as weights."""

    def __init__(self, grams: Grams, got: dict[int, list[np.ndarray]], order: int, tokens: int, distinct: int) -> None:
        total, _ = _known(grams, got, order)
        below = (total[1] + 0.5) / (tokens + 0.5 * (distinct + 1))
        self.base = np.log10(below)
        # Arcs by n-gram, with NaN where a state has none; failure arcs by state, with 0 where the context is unknown.
        self.arcs: list[np.ndarray] = [self.base]
        self.fails: list[np.ndarray] = []
        for level in range(2, order + 1):
            own = got.get(CONTEXT + level - 1, [np.empty(0, np.uint64)] * 2)
            kept, kept_sum = (x.astype(np.float64) for x in own[:2])
            seen = total[level - 1].astype(np.float64)
            freed = np.divide(seen - (kept_sum - DISCOUNT * kept), seen, out=np.ones(len(seen)), where=seen > 0)
            context, tail = grams.contexts(level), grams.tails(level)
            arc = total[level] >= MIN_COUNT[level - 1]
            own = np.divide(total[level] - DISCOUNT, seen[context], out=np.zeros(len(arc)), where=arc)
            # The tail of a kept n-gram occurs as often, so it is an arc too and its probability is at hand.
            below = np.where(arc, own + freed[context] * below[tail], np.nan)
            self.arcs.append(np.log10(below, out=np.full(len(arc), np.nan), where=arc))
            self.fails.append(np.log10(freed))

    def read(self, grams: Grams) -> np.ndarray:
        """The weight of every token.

        The state before a token depends on the last words alone, so all texts of the slice are read in step: level by
        level from the longest context, tokens without an arc there take the failure arc and go on below.
        """
        weight = np.zeros(len(grams.at[1]))
        todo = np.arange(len(weight))
        for level in range(len(self.arcs), 1, -1):
            at = grams.at[level][todo]
            inside = at >= 0
            here = np.full(len(todo), np.nan)
            here[inside] = self.arcs[level - 1][at[inside]]
            failed = np.isnan(here)
            weight[todo[~failed]] += here[~failed]
            paying = failed & inside
            weight[todo[paying]] += self.fails[level - 2][grams.at[level - 1][todo[paying] - 1]]
            todo = todo[failed]
        weight[todo] += self.base[grams.at[1][todo]]
        return weight


def score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from rows whose crc32 of doc_id (as text) leaves another remainder than ``HELD_OUT`` by ``FOLDS``;
    rows without an id are learned from. Null and empty texts have the end as their only token; repeated rows are
    learned from and scored as often as they occur; without training rows all words are unknown. An empty table gives
    an empty result, other columns are not carried. ``order`` is the longest n-gram, 1 to 3.
    """
    if not 1 <= order <= len(MIN_COUNT):
        raise ValueError(f"order must be 1 to {len(MIN_COUNT)}")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held.alias("held"))
    cut, buckets = cut_slices(rows, _slice, _SLICE_SCHEMA, _SLICE, most=SLICE_BYTES)
    tokens, trained = cut.agg(F.sum("n_tokens"), F.sum("n_train")).first()
    parts, trained = math.ceil((tokens or 1) / PART_KEYS), trained or 0
    needed = ["slice", "held", "lens", "words", "tokens"]
    first = tally(cut.select(*needed).mapInArrow(_first_round(order, parts), PARCEL))
    distinct = first.filter("level = 1").agg(F.sum("fresh")).first()[0] or 0
    rounds = [first]
    for level in range(2, order + 1):
        posted = answered(cut.select(*needed), buckets, *rounds).drop("n_train").mapInArrow(_next_round(level, order, parts), PARCEL)
        rounds.append(tally(posted))
    n_rounds = len(rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            grams = Grams(row, order)
            got = levels(row, n_rounds)
            automaton = Automaton(grams, got, order, trained, distinct)
            known = np.add.reduceat((got[1][0][grams.at[1]] > 0).astype(np.int64), grams.starts)
            base = np.add.reduceat(automaton.base[grams.at[1]], grams.starts)
            full = np.add.reduceat(automaton.read(grams), grams.starts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["doc_ids"], pa.int64()), pa.array(row["held"]), pa.array(grams.lens), pa.array(known),
                 pa.array(np.full(len(known), trained, np.int64)), pa.array(base), pa.array(full)],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return answered(cut.drop("n_train", "n_tokens"), buckets, *rounds).mapInArrow(run, _SCORE)
