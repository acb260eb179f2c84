"""Operator 10: token ids in packs of separately compressed documents that share one zstandard dictionary.

File format: a Parquet dataset without outer compression whose rows are *packs*, in ascending document id over the
files (``part``) and within a file (``pack``). A pack holds up to ``PACK_DOCS`` documents:

``doc_ids``   their ids; ``counts`` the number of token ids of each
``offsets``   where each document's frame starts in ``blob``, and the end of the last one
``blob``      the frames one after another; a frame decompresses, with the dictionary, to ids of ``width`` bytes
``base``      token ids in the same file before this pack; ``dictionary`` the SHA-256 of the dictionary

A sibling dataset holds the dictionary itself. One document is read by its pack's offset index, without touching the
frames beside it. Spark's writers commit the files, so a lost executor costs the tasks it ran and nothing else.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dnslens.llm.common import discard, slices, stored, texts_of
from dnslens.llm.word_units import splitter, tokenizer_text, units
from dnslens.session import scratch_path

#: Documents whose ids train the dictionary, and ids used of each. The bound of what the driver gathers.
SAMPLE_DOCS, SAMPLE_IDS = 1_500, 2_048
DICTIONARY_BYTES = 64 << 10
PACK_DOCS = 256
MAX_WORDS = 400_000
LEVEL = 1

_PACK = (
    "part int, pack int, dictionary string, width int, base long, first_id long, last_id long, "
    "n_tokens long, doc_ids array<long>, counts array<int>, offsets array<long>, blob binary"
)


class LibraryEncoder:
    """Whole texts through the tokenizers library; units that recur are looked up."""

    def __init__(self, tokenizer_json: str) -> None:
        self._split = splitter(tokenizer_json)
        self._model = self._split.tokenizer.model
        self._units: dict[str, bytes] = {}
        self._words: dict[str, bytes] = {}

    def _unit(self, unit: str) -> bytes:
        out = []
        for piece in self._split.pieces(unit):
            if isinstance(piece, int):
                out.append(piece.to_bytes(4, "little"))
                continue
            ids = self._words.get(piece)
            if ids is None:
                ids = b"".join([t.id.to_bytes(4, "little") for t in self._model.tokenize(piece)])
                if len(self._words) < MAX_WORDS and len(piece) < 64:
                    self._words[piece] = ids
            out.append(ids)
        ids = b"".join(out)
        if len(self._units) < MAX_WORDS and len(unit) < 64:
            self._units[unit] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        known, unit = self._units.get, self._unit
        return b"".join([known(u) or unit(u) for u in units(text) if u])


@lru_cache(maxsize=2)
def encoder(tokenizer_json: str) -> LibraryEncoder:
    """One encoder per worker and tokenizer file."""
    return LibraryEncoder(tokenizer_json)


def dictionary_from(samples: list[bytes]) -> bytes:
    """A dictionary trained on serialized id arrays; their plain contents where they are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:DICTIONARY_BYTES]


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def train(docs: DataFrame, file, end_id: int, width: int) -> bytes:
    """Train on the ids of about ``SAMPLE_DOCS`` documents drawn by a hash of the document id from all of them."""
    total = max(1, docs.count())
    keep = F.pmod(F.xxhash64("doc_id", F.lit("dictionary")), F.lit(1 << 40)) < int((1 << 40) * min(1.0, SAMPLE_DOCS / total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, kind = encoder(file.value), f"<u{width}"
        for batch in slices(batches):
            ids = [tool.encode(t)[: 4 * SAMPLE_IDS] + end_id.to_bytes(4, "little") for t in texts_of(batch.column(0))]
            packed = [np.frombuffer(x, "<u4").astype(kind).tobytes() for x in ids]
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary())], ["ids"])

    # Repeated document ids could all be drawn at once; the limit holds the bound then.
    sample = docs.filter(keep).select("text").mapInArrow(run, "ids binary").limit(4 * SAMPLE_DOCS).collect()
    return dictionary_from(sorted(bytes(r.ids) for r in sample))


def write(docs: DataFrame, path: str, tokenizer_path: str | None = None, end_id: int = 2) -> None:
    """Encode every whole text, append ``end_id`` and write packs and dictionary below ``path``.

    Null texts are empty (only the end id is kept); null document ids come first; rows of one id follow
    each other in the order of a hash of their frames, and repeated rows stay. Other columns are ignored. An empty table gives an
    empty dataset.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    source = tokenizer_text(tokenizer_path)
    width = 2 if max(splitter(source).tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    file = spark.sparkContext.broadcast(source)
    raw = train(docs, file, end_id, width)
    name = hashlib.sha256(raw).hexdigest()
    spark.createDataFrame([(name, bytearray(raw))], "dictionary string, content binary").coalesce(1).write.parquet(
        f"{path}/dictionary"
    )

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, kind, last = encoder(file.value), f"<u{width}", end_id.to_bytes(4, "little")
        squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(raw), write_checksum=True).compress
        for batch in slices(batches):
            counts, frames = [], []
            for text in texts_of(batch.column(1)):
                ids = np.frombuffer(tool.encode(text) + last, "<u4").astype(kind)
                counts.append(len(ids))
                frames.append(squeeze(ids.tobytes()))
            columns = [batch.column(0), pa.array(counts, pa.int32()), pa.array(frames, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "frame"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, base = TaskContext.get().partitionId(), 0, 0
        schema = pa.schema([
            ("part", pa.int32()), ("pack", pa.int32()), ("dictionary", pa.string()), ("width", pa.int32()),
            ("base", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("n_tokens", pa.int64()),
            ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())),
            ("offsets", pa.list_(pa.int64())), ("blob", pa.binary()),
        ])
        for batch in batches:
            for at in range(0, batch.num_rows, PACK_DOCS):
                rows = batch.slice(at, PACK_DOCS)
                ids, counts, frames = (c.to_pylist() for c in rows.columns)
                ends = np.cumsum([0, *map(len, frames)]).tolist()
                row = [part, number, name, width, base, ids[0], ids[-1], sum(counts), ids, counts, ends, b"".join(frames)]
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)
                number, base = number + 1, base + sum(counts)

    coded = docs.mapInArrow(compress, "doc_id long, n int, frame binary")
    # Rows of one id are ranged too: by their frames' hash, and equal ones by a number that is stored with them.
    coded, scratch = stored(coded.withColumn("row", F.monotonically_increasing_id()), "ids", compression="none")
    order = ["doc_id", F.xxhash64("frame"), "row"]
    ranged = coded.repartitionByRange(*order).sortWithinPartitions(*order)
    packs = ranged.select("doc_id", "n", "frame").mapInArrow(pack, _PACK)
    packs.write.option("compression", "none").parquet(f"{path}/packs")
    discard(spark, scratch)


def _stored_dictionary(spark: SparkSession, path: str) -> tuple[str, bytes]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    if row is None or hashlib.sha256(bytes(row.content)).hexdigest() != row.dictionary:
        raise ValueError(f"the dictionary of {path} is missing or damaged")
    return row.dictionary, bytes(row.content)


def read(spark: SparkSession, path: str, doc_id: int | None = None) -> DataFrame:
    """(part, base, doc_id, n_tokens, ids binary) of all documents, or of one: only its packs and frames are read.

    ``base`` counts the ids of the same file before the document; ``ids`` are little-endian unsigned 32-bit integers.
    """
    name, raw = _stored_dictionary(spark, path)
    packs = spark.read.schema(_PACK).parquet(f"{path}/packs")
    if doc_id is not None:
        packs = packs.filter((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(raw)).decompress
        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: batch.column(j)[i] for j, k in enumerate(batch.schema.names)}
                if row["dictionary"].as_py() != name:
                    raise ValueError(f"a pack of {path} needs another dictionary")
                kind, blob = f"<u{row['width'].as_py()}", memoryview(row["blob"].as_buffer())
                counts, ends, ids = row["counts"].as_py(), row["offsets"].as_py(), row["doc_ids"].as_py()
                starts = np.cumsum([row["base"].as_py(), *counts[:-1]]).tolist()
                wanted = [k for k, x in enumerate(ids) if doc_id is None or x == doc_id]
                flat = [np.frombuffer(unpack(blob[ends[k] : ends[k + 1]]), kind).astype("<u4").tobytes() for k in wanted]
                columns = [
                    pa.array([row["part"].as_py()] * len(wanted), pa.int32()),
                    pa.array([starts[k] for k in wanted], pa.int64()),
                    pa.array([ids[k] for k in wanted], pa.int64()),
                    pa.array([len(x) // 4 for x in flat], pa.int64()),
                    pa.array(flat, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["part", "base", "doc_id", "n_tokens", "ids"])

    fields = "part int, base long, doc_id long, n_tokens long, ids binary"
    return packs.select("part", "dictionary", "width", "base", "doc_ids", "counts", "offsets", "blob").mapInArrow(run, fields)


def file_starts(spark: SparkSession, path: str) -> DataFrame:
    """(part, file_start): ids in the files before each file; one row per file."""
    sizes = spark.read.schema(_PACK).parquet(f"{path}/packs").groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("file_start"))


def index(spark: SparkSession, path: str) -> DataFrame:
    """Per document, read back from the files: doc_id, start, n_tokens, crc32 of its ids."""
    # One row per file is broadcast: as many as the writing stage had tasks.
    rows = read(spark, path).select("part", "base", "doc_id", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return rows.join(F.broadcast(file_starts(spark, path)), "part").select(
        "doc_id", (F.col("base") + F.col("file_start")).alias("start"), "n_tokens", "ids_crc32"
    )


def write_and_index(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Write ``docs`` to a fresh place below the shared folder and return ``index`` of it."""
    path = scratch_path(docs.sparkSession, "id-packs")
    write(docs, path, tokenizer_path)
    return index(docs.sparkSession, path)


