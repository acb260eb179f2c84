"""Corpus-wide counts for texts that stay where they are.

Texts are read once and kept as *slices*: some megabytes of documents each, with their words numbered inside the slice,
in a table bucketed by slice. To count something over the corpus, every slice sends its distinct keys (64-bit hashes in
order) with its own counts, cut into *parts* of the hash space; a part is the group of a task, which adds up what the
slices sent and answers each of them with the totals of its keys, in the order in which they came. The answers are
joined to the slices by bucket, so the texts themselves are never shuffled, and a later round may build on them.

A key comes once from each slice that holds it, so a word that makes up a third of the corpus weighs no more in its part
than any other; a part has about ``PART_KEYS`` keys at every size, because the number of parts follows the corpus.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dnslens.llm.common import give_back, slices, stored
from dnslens.session import scratch_path

#: Text of a slice, and keys of a part: what one task holds at a time.
SLICE_BYTES, PART_KEYS = 8 << 20, 2_000_000
#: Text behind one bucket of the slice table, and the most buckets that Spark takes.
BUCKET_BYTES, MAX_BUCKETS = 32 << 20, 100_000
_ODD = np.random.default_rng(7).integers(1, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

PARCEL = "level int, part long, slice long, keys binary, counts array<binary>"
ANSWER = "level int, part long, slice long, fresh long, totals array<binary>"
Merge = Callable[[list[np.ndarray], list[list[np.ndarray]]], tuple[list[int], list[list[np.ndarray]]]]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread unsigned 64-bit integers over their range."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chained(*hashes: np.ndarray) -> np.ndarray:
    """One hash for each sequence of hashes."""
    total = np.full(len(hashes[0]), len(hashes), np.uint64)
    for place, one in enumerate(hashes):
        total += one * _ODD[place]
    return mixed(total)


def pack(numbers: np.ndarray, rising: bool = False) -> bytes:
    """Unsigned integers as compressed byte planes; ``rising`` ones by their differences."""
    x = np.ascontiguousarray(numbers, np.uint64)
    if rising:
        x = np.diff(x, prepend=np.uint64(0))
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(packed: bytes, rising: bool = False) -> np.ndarray:
    """What ``pack`` was given."""
    width = packed[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed[1:]), np.uint8).reshape(width, -1)
    wide = np.zeros((planes.shape[1], 8), np.uint8)
    wide[:, :width] = planes.T
    x = wide.view("<u8").ravel()
    return np.cumsum(x, dtype=np.uint64) if rising else x


def runs(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For consecutive runs of these sizes: whose run each element is of, and its place in it."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def cut_slices(docs: DataFrame, build: Callable[[int, list[pa.RecordBatch]], dict], schema: pa.Schema, fields: str, text: str = "text", most: int | None = None) -> tuple[DataFrame, int]:
    """The table of slices, stored and bucketed by ``slice``, and the number of its buckets.

    ``build`` takes a slice's number and its rows in batches of about a megabyte and gives one row of ``schema``; a slice
    is closed when it has ``most`` bytes of text.
    """
    spark, most = docs.sparkSession, most or SLICE_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in slices(batches, text):
            held.append(batch)
            size += batch.column(batch.schema.get_field_index(text)).nbytes
            if size >= most:
                yield pa.RecordBatch.from_pylist([build(number, held)], schema)
                number, held, size = number + 1, [], 0
        if held:
            yield pa.RecordBatch.from_pylist([build(number, held)], schema)
        del held
        give_back()

    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = min(MAX_BUCKETS, math.ceil((total + 1) / min(BUCKET_BYTES, 2 * most)))
    # An external table: the files are in the shared folder, the catalogue only knows that they are bucketed.
    name = f"slices_{uuid.uuid4().hex}"
    made = docs.mapInArrow(run, fields).write.format("parquet").bucketBy(buckets, "slice")
    made.option("path", scratch_path(spark, "slices")).option("compression", "zstd").saveAsTable(name)
    return spark.table(name), buckets


def parcels(level: int, number: int, keys: np.ndarray, counts: list[np.ndarray], parts: int) -> Iterator[dict]:
    """What slice ``number`` sends: its distinct keys in order, cut into the parts of the hash space."""
    part = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(keys) else np.empty(0, np.int64)
    for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield {
            "level": level, "part": int(part[low]), "slice": number, "keys": pack(keys[low:high], rising=True),
            "counts": [pack(c[low:high]) for c in counts],
        }


_PARCEL = pa.schema([
    ("level", pa.int32()), ("part", pa.int64()), ("slice", pa.int64()), ("keys", pa.binary()), ("counts", pa.list_(pa.binary())),
])
_ANSWER = pa.schema([
    ("level", pa.int32()), ("part", pa.int64()), ("slice", pa.int64()), ("fresh", pa.int64()), ("totals", pa.list_(pa.binary())),
])


def sent(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    """Parcels as Arrow batches of some dozens."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= 64:
            yield pa.RecordBatch.from_pylist(held, _PARCEL)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, _PARCEL)


def added_up(keys: list[np.ndarray], counts: list[list[np.ndarray]]) -> tuple[list[int], list[list[np.ndarray]]]:
    """Per parcel: how many of its keys are *first*, and the totals of all counts and the mark of the first ones.

    Of the slices that sent a key with a first count above zero, one is the first: what a key adds once is added there.
    """
    flat = np.concatenate(keys)
    distinct, at = np.unique(flat, return_inverse=True)
    width = len(counts[0])
    both = [np.concatenate([c[k] for c in counts]) for k in range(width)]
    # Sums in doubles are exact up to 2 ** 53.
    totals = [np.bincount(at, one, len(distinct)).astype(np.uint64) for one in both]
    first = np.zeros(len(flat), np.uint64)
    counted = np.flatnonzero(both[0])
    first[counted[np.unique(at[counted], return_index=True)[1]]] = 1
    fresh, out, low = [], [], 0
    for one in keys:
        mine = slice(low, low + len(one))
        fresh.append(int(first[mine].sum()))
        out.append([*(t[at[mine]] for t in totals), first[mine]])
        low += len(one)
    return fresh, out


def tally(posted: DataFrame, merge: Merge = added_up, label: str = "answers") -> DataFrame:
    """The stored answers to parcels: level, part, slice, fresh, totals."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("slice")
        keys = [unpack(k, rising=True) for k in table.column("keys").to_pylist()]
        counts = [[unpack(c) for c in row] for row in table.column("counts").to_pylist()]
        fresh, totals = merge(keys, counts)
        return pa.table(
            [table.column("level"), table.column("part"), table.column("slice"), pa.array(fresh, pa.int64()),
             pa.array([[pack(t) for t in row] for row in totals], pa.list_(pa.binary()))], schema=_ANSWER,
        )

    return stored(posted.groupBy("level", "part").applyInArrow(run, ANSWER), label)[0]


def answered(cut: DataFrame, buckets: int, *answers: DataFrame) -> DataFrame:
    """Slices with one more column ``a0``, ``a1``, ... for each round of answers, which are dealt as the slices are."""
    for n, round_ in enumerate(answers):
        mine = round_.repartition(buckets, "slice").groupBy("slice").agg(F.sort_array(F.collect_list(F.struct("level", "part", "totals"))).alias(f"a{n}"))
        cut = cut.join(mine, "slice", "left")
    return cut


def levels(row: dict, rounds: int) -> dict[int, list[np.ndarray]]:
    """The answers that came to a slice: for each level, the arrays of totals in the order of the keys it sent."""
    found: dict[int, list[list[np.ndarray]]] = {}
    for n in range(rounds):
        for parcel in row[f"a{n}"] or []:
            found.setdefault(parcel["level"], []).append([unpack(t) for t in parcel["totals"]])
    return {k: [np.concatenate(x) for x in zip(*v, strict=True)] for k, v in found.items()}


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The slices of a task, one at a time."""
    batch = None
    for batch in batches:
        for at in range(batch.num_rows):
            yield {n: batch.column(k)[at].as_py() for k, n in enumerate(batch.schema.names)}
    del batch
    give_back()
