"""Operator 11: alignment of two tokenizers over the same bytes, and how many documents hold each pair of linked ids.

Both tokenizations of a text end tokens at byte offsets, two rising lists. Their intersection is found by galloping: the
shorter list drives, and each of its offsets is sought in the longer one by steps that double, then by bisection between
the last two. Offsets in both lists cut the tokens into groups, the differences of the ranks at two such offsets say
which tokens of either side a group has, and each token of one side in it is linked with each of the other.

Neither tokenizer has a token that goes on across a blank behind a word, so a text is cut there into *units* that recur
and are encoded and aligned once. Slices of the corpus (``slice_tally``) keep for each document which units it has, send
their pairs of ids with the number of documents that hold them, and get the counts over all documents back.
"""

from __future__ import annotations

import hashlib
import math
import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dnslens.llm.slice_tally import (
    PARCEL,
    PART_KEYS,
    answered,
    cut_slices,
    levels,
    mixed,
    pack,
    parcels,
    rows_of,
    runs,
    sent,
    tally,
    unpack,
)
from dnslens.llm.word_units import byte_symbols

#: Units whose alignment a task keeps (twice as many, young and old), and the length from which none is kept.
CACHED_UNITS, LONG_UNIT = 120_000, 64
#: Units whose documents' pairs are sorted at a time.
STEP_UNITS = 150_000
#: Units that tokenizer A is given as one text.
JOINED_UNITS = 64
#: Links of a group up to which each is written down.
LARGE_GROUP = 4_096

_BLANK = " "
#: Behind these the next blank may not start a unit.
_MIXED = re.compile(r"\s\s|^\s|\s$")
_CUT = re.compile(r"(?<=\S)(?= )")

Unit = tuple[int, int, int, int, bytes, bytes, bytes]
_SLICE = (
    "slice long, doc_ids array<long>, figures binary, digests array<string>, sizes binary, units binary, "
    "unit_pairs binary, pairs binary, times binary, keys binary, docs binary"
)
_SLICE_SCHEMA = pa.schema([
    ("slice", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("figures", pa.binary()), ("digests", pa.list_(pa.string())),
    *[(n, pa.binary()) for n in ("sizes", "units", "unit_pairs", "pairs", "times", "keys", "docs")],
])


def common_ends(short: np.ndarray, long: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``short`` and in ``long`` of the offsets that both rising lists have; ``short`` drives.

    All its offsets gallop in step, each from its ``start``, a place in ``long`` that is not behind the one sought: the
    steps double while they end before the offset, and the last one is searched by bisection.
    """
    size = len(long)
    low, high, step = start.copy(), start.copy(), 1
    going = np.arange(len(short))
    while len(going):
        going = going[(high[going] < size) & (long[np.minimum(high[going], size - 1)] < short[going])]
        low[going] = high[going] + 1
        high[going] += step
        step *= 2
    high = np.minimum(high, size)
    going = np.flatnonzero(low < high)
    while len(going):
        middle = (low[going] + high[going]) // 2
        below = long[middle] < short[going]
        low[going[below]] = middle[below] + 1
        high[going[~below]] = middle[~below]
        going = going[low[going] < high[going]]
    met = np.flatnonzero((low < size) & (long[np.minimum(low, size - 1)] == short))
    return met, low[met]


def groups(ends_a: np.ndarray, ends_b: np.ndarray, start_a: np.ndarray, start_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many A and B tokens each group has; ``start_b`` says for each A offset where its search in B starts."""
    if len(ends_a) <= len(ends_b):
        in_a, in_b = common_ends(ends_a, ends_b, start_b)
    else:
        in_b, in_a = common_ends(ends_b, ends_a, start_a)
    return np.diff(in_a, prepend=-1), np.diff(in_b, prepend=-1)


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(sizes.sum())), sizes


def _summed(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.add.at(out, owner, values)
    return out


class Pair:
    """Both tokenizers, and the alignments of the units met so far."""

    def __init__(self, json_a: str, model_b: bytes) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        # A task has one core: threads of the library would only wait for each other.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_str(json_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model_b)
        byte_of = {s: i for i, s in enumerate(byte_symbols())}
        names = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(names.values()) + 1)
        for token, number in names.items():
            self.bytes_a[number] = bytes([byte_of[c] for c in token]) if all(c in byte_of for c in token) else token.encode()
        self.bytes_b = []
        for number in range(self.b.vocab_size()):
            piece = self.b.id_to_piece(number)
            own = bytes([int(piece[3:5], 16)]) if self.b.is_byte(number) else piece.replace("▁", _BLANK).encode()
            self.bytes_b.append(own)
        self.size_a, self.size_b = (np.array([len(x) for x in names], np.int64) for names in (self.bytes_a, self.bytes_b))
        self.shown_a, self.shown_b = (
            np.array([[b"%d%s" % (x, sign) for x in range(len(names))] for sign in (b",", close)], object)
            for names, close in ((self.bytes_a, b"|"), (self.bytes_b, b";"))
        )
        self.blank = self.b.piece_to_id("▁")
        self._young: dict[str, Unit | None] = {}
        self._old: dict[str, Unit | None] = {}

    def aligned(self, ids_a: list[list[int]], ids_b: list[list[int]], raws: list[bytes]) -> list[Unit | None]:
        """Of each unit: token, group and link counts, its groups as text, linked pairs and how often each.

        None where the tokens don't give back the bytes.
        """
        out: list[Unit | None] = [None] * len(raws)
        whole = b"".join(raws)
        if any(b"".join([names[x] for x in chain.from_iterable(ids)]) != whole for names, ids in ((self.bytes_a, ids_a), (self.bytes_b, ids_b))):
            good = [
                k for k, raw in enumerate(raws)
                if raw == b"".join([self.bytes_a[x] for x in ids_a[k]]) == b"".join([self.bytes_b[x] for x in ids_b[k]])
            ]
            if len(good) < len(raws):
                for k, one in zip(good, self.aligned(*([x[k] for k in good] for x in (ids_a, ids_b, raws))), strict=True):
                    out[k] = one
                return out
        if not raws:
            return out
        # Each unit ends where both sides have an end, so the units one after another are one text.
        (flat_a, many_a), (flat_b, many_b) = _flat(ids_a), _flat(ids_b)
        first_a, first_b = np.cumsum(many_a) - many_a, np.cumsum(many_b) - many_b
        size_a, size_b = groups(
            np.cumsum(self.size_a[flat_a]), np.cumsum(self.size_b[flat_b]), np.repeat(first_a, many_b), np.repeat(first_b, many_a)
        )
        low_a, low_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
        unit = np.searchsorted(first_a, low_a, "right") - 1
        n_groups = np.bincount(unit, minlength=len(raws))
        product = size_a * size_b
        n_links = _summed(product, unit, len(raws))
        # The groups as text: of each group the A tokens, then the B tokens, each with the sign that follows it.
        shown = np.empty(len(flat_a) + len(flat_b), object)
        last_a, last_b = np.zeros(len(flat_a), np.int64), np.zeros(len(flat_b), np.int64)
        last_a[low_a + size_a - 1] = 1
        last_b[low_b + size_b - 1] = 1
        shown[np.arange(len(flat_a)) + np.repeat(low_b, size_a)] = self.shown_a[last_a, flat_a]
        shown[np.arange(len(flat_b)) + np.repeat(low_a + size_a, size_b)] = self.shown_b[last_b, flat_b]
        text, starts = shown.tolist(), (first_a + first_b).tolist()
        # Links of small groups one by one, of large ones by distinct ids.
        small = np.flatnonzero(product <= LARGE_GROUP)
        owner, place = runs(product[small])
        of = small[owner]
        keys = (flat_a[low_a[of] + place // size_b[of]] << 32 | flat_b[low_b[of] + place % size_b[of]]).astype(np.uint64)
        ends = np.cumsum(np.bincount(unit[of], minlength=len(raws))).tolist()
        figures = zip(many_a.tolist(), many_b.tolist(), n_groups.tolist(), n_links.tolist(), strict=True)
        low = 0
        for k, (figure, begin, end, high) in enumerate(zip(figures, starts, [*starts[1:], len(text)], ends, strict=True)):
            out[k] = (*figure, b"".join(text[begin:end])[:-1], keys[low:high].tobytes(), b"\1\0\0\0" * (high - low))
            low = high
        for g in np.flatnonzero(product > LARGE_GROUP).tolist():
            left = Counter(flat_a[low_a[g] : low_a[g] + size_a[g]].tolist())
            right = Counter(flat_b[low_b[g] : low_b[g] + size_b[g]].tolist())
            links = {x << 32 | y: n * m for x, n in left.items() for y, m in right.items()}
            *figure, text_of, had, times = out[unit[g]]
            had += np.fromiter(links.keys(), np.uint64, len(links)).tobytes()
            out[unit[g]] = (*figure, text_of, had, times + np.fromiter(links.values(), np.uint32, len(links)).tobytes())
        return out

    def units(self, text: str) -> list[str]:
        """The units of a text, each without the one blank before it."""
        if _MIXED.search(text) is None:
            return text.split(_BLANK)
        return [unit[1:] for unit in _CUT.split(_BLANK + text)]

    def coded_a(self, whole: list[str], raws: list[bytes]) -> list[list[int]]:
        """The ids of tokenizer A for each unit with its blank.

        Units that end in a word are encoded one behind the other as one text, which is cut again where they end; where
        no token ends there, or bytes are not given back, each is encoded on its own.
        """
        out: list[list[int]] = [[]] * len(whole)
        size = np.fromiter(map(len, raws), np.int64, len(raws))
        alone = [k for k, u in enumerate(whole) if u[-1].isspace()]
        fit = [k for k, u in enumerate(whole) if not u[-1].isspace()]
        parts = [fit[low : low + JOINED_UNITS] for low in range(0, len(fit), JOINED_UNITS)]
        texts = ["".join([whole[k] for k in part]) for part in parts]
        for part, text, coded in zip(parts, texts, self.a.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = coded.ids
            ends, want = np.cumsum(self.size_a[ids]), np.cumsum(size[part])
            at = np.searchsorted(ends, want)
            if len(ids) == 0 or ends[-1] != want[-1] or (ends[at] != want).any() or b"".join([self.bytes_a[x] for x in ids]) != text.encode():
                alone += part
                continue
            low = 0
            for k, high in zip(part, (at + 1).tolist(), strict=True):
                out[k] = ids[low:high]
                low = high
        if alone:
            for k, coded in zip(alone, self.a.encode_batch_fast([whole[k] for k in alone], add_special_tokens=False), strict=True):
                out[k] = coded.ids
        return out

    def learn(self, units: set[str], got: dict[str, Unit | None]) -> None:
        """Fill ``got`` with the alignment of every unit; those not met before are encoded in one call."""
        young, old = self._young, self._old
        seen = units & young.keys()
        again = (units - seen) & old.keys()
        young.update([(u, old[u]) for u in again])
        got.update([(u, young[u]) for u in seen | again])
        fresh = list(units - seen - again)
        whole = [_BLANK + unit for unit in fresh]
        raws = [u.encode() for u in whole]
        coded_a = self.coded_a(whole, raws)
        coded_b = self.b.encode(fresh, num_threads=1)
        if "" in fresh:
            coded_b[fresh.index("")] = [self.blank]
        made = self.aligned(coded_a, coded_b, raws)
        got.update(zip(fresh, made, strict=True))
        self._young.update([(u, one) for u, one in zip(fresh, made, strict=True) if len(u) < LONG_UNIT])
        if len(self._young) > CACHED_UNITS:
            self._young, self._old = {}, self._young


@lru_cache(maxsize=1)
def _pair(json_a: str, model_b: bytes) -> Pair:
    return Pair(json_a, model_b)


def _slice_builder(files):
    def build(number: int, batches: list[pa.RecordBatch]) -> dict:
        tool = _pair(*files.value)
        ids, figures, digests, sizes, rows = [], [], [], [], []
        place: dict[str, int] = {}
        known: list[Unit] = []
        shown: list[bytes] = []
        for batch in batches:
            texts = batch.column(1).to_pylist()
            cut = [tool.units(t) if t else [] for t in texts]
            ids += batch.column(0).to_pylist()
            got: dict[str, Unit | None] = {}
            tool.learn(set().union(*cut).difference(place), got)
            broken = {u for u, one in got.items() if one is None}
            fresh = [(u, one) for u, one in got.items() if one is not None] if broken else list(got.items())
            place.update(zip([u for u, _ in fresh], range(len(known), len(known) + len(fresh)), strict=True))
            known += [one for _, one in fresh]
            shown += [one[4] for _, one in fresh]
            for units in cut:
                if broken and not broken.isdisjoint(units):
                    units = []
                at = list(map(place.__getitem__, units))
                rows.append(np.fromiter(at, np.int64, len(at)))
                sizes.append(len(at))
                digests.append(hashlib.sha256(b";".join(map(shown.__getitem__, at))).hexdigest() if at else "")
        unit = np.concatenate([np.empty(0, np.int64), *rows])
        size = np.array(sizes, np.int64)
        doc, _ = runs(size)
        own = np.array([u[:4] for u in known], np.int64).reshape(-1, 4)
        for column in range(4):
            figures.append(np.bincount(doc, own[unit, column], len(size)))
        raw = np.frombuffer(b"".join([u[5] for u in known]), np.uint64)
        times = np.frombuffer(b"".join([u[6] for u in known]), np.uint32)
        many = np.array([len(u[5]) // 8 for u in known], np.int64)
        keys, pair = np.unique(mixed(raw), return_inverse=True)
        docs, first = np.zeros(len(keys), np.int64), np.cumsum(many) - many
        # A document counts a pair once: its distinct units, then their distinct pairs, some documents at a time.
        steps = np.searchsorted(np.cumsum(size), np.arange(0, len(unit) + STEP_UNITS, STEP_UNITS), "left")
        ends = np.unique(np.concatenate([steps, [len(size)]]))
        starts = np.concatenate([[0], np.cumsum(size)])
        low = 0
        for high in ends.tolist():
            here = slice(int(starts[low]), int(starts[high]))
            if here.start < here.stop:
                both = np.unique(doc[here] * len(known) + unit[here])
                whose, which = both // len(known), both % len(known)
                owner, step = runs(many[which])
                held = np.unique(whose[owner] * len(keys) + pair[first[which][owner] + step])
                docs += np.bincount(held % len(keys), minlength=len(keys))
            low = high
        return {
            "slice": number, "doc_ids": ids, "figures": pack(np.concatenate(figures)), "digests": digests, "sizes": pack(size),
            "units": pack(unit), "unit_pairs": pack(many), "pairs": pack(pair), "times": pack(times),
            "keys": pack(keys, rising=True), "docs": pack(docs),
        }

    return build


def _unmixed(x: np.ndarray) -> np.ndarray:
    """The numbers that ``mixed`` was given."""

    def unshift(y: np.ndarray, by: int) -> np.ndarray:
        out = y
        for _ in range(64 // by):
            out = y ^ (out >> np.uint64(by))
        return out

    x = unshift(x, 31) * np.uint64(pow(0x94D049BB133111EB, -1, 1 << 64))
    x = unshift(x, 27) * np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return unshift(x, 30)


def _tokenizers(path_a: str | None, path_b: str | None) -> tuple[str, bytes]:
    if path_a is None or path_b is None:
        import public_tokenizers

        path_a = path_a or public_tokenizers.path("byte_bpe_50k.json")
        path_b = path_b or public_tokenizers.path("piece_bpe_32k.model")
    with open(path_a, encoding="utf-8") as a, open(path_b, "rb") as b:
        return a.read(), b.read()


def alignment(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> tuple[DataFrame, int, DataFrame]:
    """(slices, buckets, answers): the aligned corpus, and the number of documents that hold each of its pairs of ids."""
    files = docs.sparkSession.sparkContext.broadcast(_tokenizers(path_a, path_b))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cut, buckets = cut_slices(rows, _slice_builder(files), _SLICE_SCHEMA, _SLICE)

    def n_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            yield pa.RecordBatch.from_arrays([pa.array([len(unpack(row["docs"]))], pa.int64())], ["n"])

    parts = math.ceil((cut.select("docs").mapInArrow(n_keys, "n long").agg(F.sum("n")).first()[0] or 1) / PART_KEYS)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parcels_() -> Iterator[dict]:
            for row in rows_of(batches):
                yield from parcels(1, row["slice"], unpack(row["keys"], rising=True), [unpack(row["docs"])], parts)

        return sent(parcels_())

    return cut, buckets, tally(cut.select("slice", "keys", "docs").mapInArrow(post, PARCEL))


def link_counts(cut: DataFrame, buckets: int, counts: DataFrame) -> DataFrame:
    """(a, b, docs): every pair of linked ids with the number of documents that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            got = levels(row, 1)
            if 1 not in got:
                continue
            total, first = got[1]
            mine = first > 0
            pair = _unmixed(unpack(row["keys"], rising=True)[mine])
            columns = [pair >> np.uint64(32), pair & np.uint64(0xFFFFFFFF), total[mine]]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["a", "b", "docs"])

    return answered(cut.select("slice", "keys"), buckets, counts).mapInArrow(run, "a long, b long, docs long")


def report(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Null and empty texts, and texts whose tokens do not give back their bytes, have zeros and an empty digest. Every row
    is a document, whether its id or text recurs or is null. An empty table gives an empty result; other columns are not
    carried.
    """
    cut, buckets, counts = alignment(docs, path_a, path_b)
    # One row for each id of tokenizer A at most.
    highest = link_counts(cut, buckets, counts).groupBy("a").agg(F.max("docs").alias("most")).collect()
    most = np.zeros(max([r.a for r in highest], default=0) + 1, np.int64)
    for r in highest:
        most[r.a] = r.most
    most_of = docs.sparkSession.sparkContext.broadcast(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            got = levels(row, 1)
            total = got[1][0].astype(np.int64) if 1 in got else np.empty(0, np.int64)
            pair, times = unpack(row["pairs"]).astype(np.int64), unpack(row["times"]).astype(np.int64)
            best = total == most_of.value[(_unmixed(unpack(row["keys"], rising=True)) >> np.uint64(32)).astype(np.int64)]
            many, size = unpack(row["unit_pairs"]).astype(np.int64), unpack(row["sizes"]).astype(np.int64)
            unit, doc = unpack(row["units"]).astype(np.int64), runs(size)[0]
            owner = runs(many)[0]

            def summed(by_pair: np.ndarray) -> np.ndarray:
                by_unit = np.zeros(len(many), np.int64)
                np.add.at(by_unit, owner, by_pair[pair] * times)
                by_doc = np.zeros(len(size), np.int64)
                np.add.at(by_doc, doc, by_unit[unit])
                return by_doc

            figures = unpack(row["figures"]).astype(np.int64).reshape(4, -1)
            columns = [pa.array(row["doc_ids"], pa.int64()), *(pa.array(f) for f in figures)]
            columns += [pa.array(summed(best.astype(np.int64))), pa.array(summed(total)), pa.array(row["digests"], pa.string())]
            yield pa.RecordBatch.from_arrays(
                columns, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
            )

    fields = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return answered(cut.drop("docs"), buckets, counts).mapInArrow(run, fields)
