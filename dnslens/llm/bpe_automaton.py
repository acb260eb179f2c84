"""Operator 8: BPE by a deterministic automaton over tokens, compiled from the merge list gadget by gadget.

Every token ``t`` owns one state: the one reached behind it. An arc ``t -> x`` says that ``x`` may follow ``t``.
The automaton of the bare alphabet has all arcs. The merge ``(u, v) -> uv`` puts a gadget into it: the state of
``uv`` starts as a copy of that of ``v``; the arc ``u -> v`` goes; wherever ``u`` may follow, ``uv`` may too. Dealt
with in merge order, the gadgets leave exactly the token sequences that BPE produces, one for each string, and every
prefix of such a sequence is one as well. So the token that ends at a position is decided by table steps alone: walk
the trie of reversed tokens back from there and take the one token whose arc from the token that ends before it
exists. There is no search, no priority queue and no re-merging.

Copies are kept as differences (the gadget that made a row or column and the arc it took away), since a full table
of 49,000 x 49,000 arcs would be mostly copies; an arc is resolved through the gadgets once and then kept in the
transition table of the task, which is emptied when it reaches a fixed size.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dnslens.llm.common import give_back, slices, texts_of
from dnslens.llm.word_units import UnitSplitter, tokenizer_text, units

_END = 0x400  # added to the last symbol of a word
#: Entries of the transition table and of each word cache of a task; all goes when the task ends.
MAX_ARCS = 200_000
MAX_WORDS = 100_000


class MergeAutomaton:
    """The compiled automaton of a word-level BPE file."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], suffix: str) -> None:
        size = max(vocabulary.values()) + 1
        self.label = [""] * size
        for token, i in vocabulary.items():
            self.label[i] = token
        self._suffix = suffix
        self._rank, self._left, self._right = [-1] * size, [-1] * size, [-1] * size
        self._gadget: dict[int, int] = {}
        self._arcs: dict[int, bool] = {}
        self._alive = [True] * size
        for rank, (a, b) in enumerate(merges):
            u, v, uv = vocabulary[a], vocabulary[b], vocabulary[a + b]
            self._add_gadget(rank, u, v, uv)
        self._trie: list[dict[str, int]] = [{}]
        self._ends = [-1]
        for token, i in vocabulary.items():
            if self._alive[i]:
                self._add_word(self._spelled(token), i)

    def _spelled(self, token: str) -> str:
        if self._suffix and token.endswith(self._suffix):
            token = token[: -len(self._suffix)]
            return token[:-1] + chr(ord(token[-1]) + _END) if token else ""
        return token

    def _add_gadget(self, rank: int, u: int, v: int, uv: int) -> None:
        self._rank[uv], self._left[uv], self._right[uv] = rank, u, v
        # Without the arc u -> v the gadget changes nothing and uv is never reached.
        self._alive[uv] = self._alive[u] and self._alive[v] and self._resolve(u, v, rank)
        self._gadget[u << 32 | v] = rank

    def _add_word(self, spelled: str, token: int) -> None:
        node = 0
        for symbol in reversed(spelled):
            step = self._trie[node].get(symbol)
            if step is None:
                step = self._trie[node][symbol] = len(self._trie)
                self._trie.append({})
                self._ends.append(-1)
            node = step
        self._ends[node] = token

    def _resolve(self, before: int, after: int, time: int) -> bool:
        """Whether the arc exists once all gadgets of a rank below ``time`` are in place."""
        rank, left, right, gadget = self._rank, self._left, self._right, self._gadget
        while True:
            removed = gadget.get(before << 32 | after)
            if removed is not None and removed < time:
                return False
            made, named = rank[before], rank[after]
            if made < 0 and named < 0:
                return True
            if before == after:
                before, after, time = right[before], left[after], made
            elif made > named:
                before, time = right[before], made
            else:
                # The arc u -> v is gone before uv is offered wherever u is.
                after, time = left[after], named + 1

    def has_arc(self, before: int, after: int) -> bool:
        """The entry of the transition table."""
        key = before << 32 | after
        found = self._arcs.get(key)
        if found is None:
            if len(self._arcs) >= MAX_ARCS:
                self._arcs.clear()
            found = self._arcs[key] = self._resolve(before, after, 1 << 40)
        return found

    def encode(self, piece: str) -> list[int]:
        """Token ids of one word given as byte symbols."""
        if not piece:
            return []
        word = piece[:-1] + chr(ord(piece[-1]) + _END) if self._suffix else piece
        known: dict[int, tuple[int, int]] = {}
        self._ending(word, len(word), known)
        out, i = [], len(word)
        while i:
            token, i = known[i]
            out.append(token)
        out.reverse()
        return out

    def _ending(self, word: str, i: int, known: dict[int, tuple[int, int]]) -> None:
        """Put the token that ends at ``i`` and its start into ``known``. Only positions that matter are visited."""
        arcs = self._arcs
        todo = [(i, self._candidates(word, i))]
        while todo:
            end, left = todo[-1]
            if not left:
                raise ValueError(f"symbol {word[end - 1]!r} is not in the vocabulary")
            token, j = left[-1]
            if j:
                if j not in known:
                    todo.append((j, self._candidates(word, j)))
                    continue
                before = known[j][0]
                arc = arcs.get(before << 32 | token)
                if not (arc or arc is None and self.has_arc(before, token)):
                    left.pop()
                    continue
            known[end] = left[-1]
            todo.pop()

    def _candidates(self, word: str, i: int) -> list[tuple[int, int]]:
        """The tokens spelled like what ends at ``i``, with their starts; the longest comes last."""
        trie, ends = self._trie, self._ends
        node, j, found = 0, i, []
        while j:
            node = trie[node].get(word[j - 1])
            if node is None:
                break
            j -= 1
            token = ends[node]
            if token >= 0:
                found.append((token, j))
        return found


class Codec:
    """Encoder and decoder of whole texts; words that recur are looked up.

    Compiled anew by each task (0.7 s), so that workers hold nothing of it between tasks.
    """

    def __init__(self, tokenizer_json: str) -> None:
        spec = json.loads(tokenizer_json)
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self._split = UnitSplitter(tokenizer_json)
        self.automaton = MergeAutomaton(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        labels = dict(enumerate(self.automaton.label))
        labels.update({i: s for s, i in self._split.special.items()})
        self._labels = [labels.get(i, "").encode() for i in range(max(labels) + 1)]
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
                ids = np.array(self.automaton.encode(piece), "<u4").tobytes()
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

    def decode(self, ids: bytes) -> bytes:
        """The labels of the arcs passed, joined by blanks, as the tokenizer file without a decoder has it."""
        return b" ".join(map(self._labels.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(docs: DataFrame, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every whole text.

    A null or blank text has an empty array; other columns of the input are not carried; repeated rows stay.
    """
    file = docs.sparkSession.sparkContext.broadcast(tokenizer_text(tokenizer_path))
    schema = docs.select(F.col(id_col).alias("doc_id")).schema["doc_id"].simpleString().split(":", 1)[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Codec(file.value)
        for batch in slices(batches, max_bytes=2 << 20):
            ids = [np.frombuffer(tool.encode(t), "<u4").astype("<i4") for t in texts_of(batch.column(1))]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            flat = pa.array(np.concatenate([np.empty(0, "<i4"), *ids]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, flat)], ["doc_id", "ids"])
        del tool
        give_back()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {schema}, ids array<int>")


def decode(encoded: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """(doc_id, decoded) of arrays of ids; null counts as empty."""
    file = encoded.sparkSession.sparkContext.broadcast(tokenizer_text(tokenizer_path))
    schema = encoded.select("doc_id").schema["doc_id"].simpleString().split(":", 1)[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Codec(file.value)
        for batch in batches:
            texts = [tool.decode(np.array(x or [], "<u4").tobytes()).decode() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "decoded"])
        del tool
        give_back()

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {schema}, decoded string")


def round_trip(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Per document: doc_id, n_tokens, sha256 of its ids and of the text decoded from them.

    Encoding, decoding and hashing happen where the text is read: nothing is shuffled and no text leaves its task.
    A null text counts as empty; each input row gives one row.
    """
    file = docs.sparkSession.sparkContext.broadcast(tokenizer_text(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, digest = Codec(file.value), hashlib.sha256
        for batch in slices(batches):
            counts, coded, decoded = [], [], []
            for text in texts_of(batch.column(1)):
                ids = tool.encode(text)
                counts.append(len(ids) // 4)
                coded.append(digest(ids).hexdigest())
                decoded.append(digest(tool.decode(ids)).hexdigest())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(coded), pa.array(decoded)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        del tool
        give_back()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
