"""Operator 4: SimHash near-duplicates found at the anchor points of a covering code.

Two fingerprints that differ in at most ``BITS`` = 3 of 64 bits differ in at most one bit of one of their halves. A
half's anchors are the codewords of the [31, 26] Hamming code with a free 32nd bit: each 32-bit word is within the
covering radius 1 of one of them, its home. A fingerprint is sent to its home and to every other anchor that is the
home of a word within the threshold of the half, 1: these are all anchors within covering radius plus threshold that
can matter, 16 or 17 of 2^27 for each half. So linked fingerprints meet at an anchor, and are compared there in full.

An anchor that many fingerprints meet at is dealt before it is compared: linked fingerprints agree in one of the four
bytes of the other half, so each is sent to four smaller groups, and no anchor is one task's burden.

Equal fingerprints count once. In a group, fingerprints are searched breadth-first, so a group of copies costs edges
of a tree, not of all its pairs, and no link between different fingerprints is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dnslens.llm.common import bounded, slices, stored
from dnslens.llm.components import components

BITS = 3
SHINGLE, SEED = 3, 42
#: Fingerprints at one anchor from which they are dealt by the bytes of the other half.
SPLIT_AT = 20_000
#: Anchors of that size up to which they are broadcast; beyond it they are shuffled.
BROADCAST_ANCHORS = 1_000_000

_POSITIONS = np.arange(1, 32, dtype=np.uint32)
_PARITY = [np.uint32(sum(1 << (p - 1) for p in range(1, 32) if p >> j & 1)) for j in range(5)]


def fingerprint(text: bytes) -> int:
    """SimHash of the 3-word shingles of a text in UTF-8, as an unsigned number."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-SHINGLE]]).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist(), strict=True)]
    bits = np.zeros(64, np.int64)
    values = np.array(hashes, "<u8")
    for at in range(0, len(values), 1 << 14):
        part = values[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(values), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row; a text that is null or has no words has fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            values = np.array([fingerprint(t or b"") for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def anchors(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For 32-bit words: (row number, anchor) of every anchor that is the home of a word within distance 1."""
    low = words & np.uint32(0x7FFFFFFF)
    syndrome = np.zeros(len(words), np.uint32)
    for j, mask in enumerate(_PARITY):
        syndrome |= (np.bitwise_count(low & mask).astype(np.uint32) & 1) << np.uint32(j)
    bit = np.uint32(1) << (np.maximum(syndrome, 1) - np.uint32(1))
    home = np.where(syndrome > 0, words ^ bit, words)
    rows = np.arange(len(words))
    other = syndrome[:, None] ^ _POSITIONS[None, :]
    pair = (syndrome[:, None] > 0) & (other > _POSITIONS[None, :])
    flipped = words[:, None] ^ (np.uint32(1) << (_POSITIONS - np.uint32(1)))[None, :]
    near = flipped ^ (np.uint32(1) << (np.maximum(other, 1) - np.uint32(1)))
    at, _ = np.nonzero(pair)
    return np.concatenate([rows, rows, at]), np.concatenate([home, home ^ np.uint32(1 << 31), near[pair]])


def _to_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for cut in range(0, batch.num_rows, 8192):
            fps = batch.column(0).slice(cut, 8192).to_numpy(zero_copy_only=False).view(np.uint64)
            keys, values = [], []
            for half in (0, 1):
                rows, anchor = anchors((fps >> np.uint64(32 * half)).astype(np.uint32))
                keys.append(anchor.astype(np.int64) | np.int64(half << 32))
                values.append(fps[rows].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(values))], ["anchor", "fp"])


def tree_links(fps: np.ndarray, bits: int = BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges of a spanning forest of the links among distinct fingerprints."""
    out, left = [], fps
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            one = todo.pop()
            near = np.bitwise_count(left ^ one) <= bits
            if near.any():
                found, left = left[near], left[~near]
                out.append((np.full(len(found), one), found))
                todo.extend(found)
    return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges among the fingerprints of each group; the input is sorted by group and fingerprint."""

    def linked(keys: np.ndarray, fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.concatenate([first, [len(keys)]]))
        two = first[sizes == 2]
        close = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= BITS]
        out = [(fps[close], fps[close + 1])]
        for at, n in zip(first[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            out += tree_links(fps[at : at + n])
        return out

    def rows(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        sides = [np.concatenate([f[k] for f in found]).view(np.int64) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array(s) for s in sides], ["a", "b"])

    held: list[tuple[np.ndarray, np.ndarray]] = []  # rows of the group that the next batch may go on with
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        fps = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        if keys[0] == keys[-1] and (not held or held[0][0][0] == keys[0]):
            held.append((keys.copy(), fps.copy()))
            continue
        keys, fps = np.concatenate([*(h[0] for h in held), keys]), np.concatenate([*(h[1] for h in held), fps])
        cut = int(np.searchsorted(keys, keys[-1]))
        held = [(keys[cut:].copy(), fps[cut:].copy())]
        yield rows(linked(keys[:cut], fps[:cut]))
    if held:
        yield rows(linked(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])))


def groups(distinct: DataFrame) -> DataFrame:
    """(anchor, fp) of all that is to be compared; the numbers of dealt anchors carry the byte above bit 33."""
    met = distinct.select("fp").mapInArrow(_to_anchors, "anchor long, fp long")
    crowded = met.groupBy("anchor").count().filter(F.col("count") > SPLIT_AT).select("anchor", F.lit(True).alias("crowded"))
    crowded, _ = stored(crowded, "crowded")
    first = f"IF(anchor < {1 << 32}L, 32, 0)"
    bytes_of = ", ".join(f"{1 + 256 * k}L + (shiftrightunsigned(fp, {first} + {8 * k}) & 255L)" for k in range(4))
    return met.join(bounded(crowded, BROADCAST_ANCHORS), "anchor", "left").select(
        "anchor", "fp", F.explode(F.expr(f"IF(crowded, array({bytes_of}), array(0L))")).alias("part")
    ).select(F.expr("anchor | shiftleft(part, 34)").alias("anchor"), "fp")


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): links between different fingerprints (column fp, distinct), enough to connect all that are linked."""
    dealt = groups(distinct).repartition("anchor").sortWithinPartitions("anchor", "fp")
    return dealt.mapInArrow(_compare, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, fp, component_id (the smallest doc_id that links reach, its own included).

    Texts that are null or without words have fingerprint zero and are linked like others. Repeated rows stay. Null
    doc_ids take part but never name a component unless it has no other. An empty table gives an empty result; other
    columns of the input are not carried.
    """
    rows, _ = stored(fingerprints(docs), "fingerprints")
    distinct, _ = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    member = components(links(distinct)).withColumnRenamed("node", "fp")
    member, _ = stored(member.join(distinct, "fp"), "members")
    named = member.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = member.join(named, "root").select("fp", "component_id")
    classes = distinct.join(classes, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return rows.join(classes, "fp").select("doc_id", "fp", "component_id")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint in 16 hexadecimal digits, component_id."""
    return near_duplicates(docs).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
