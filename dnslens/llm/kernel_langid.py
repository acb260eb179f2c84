"""Operator 5: language identification by string kernels.

The kernel of two texts is the normalized number of n-grams (lengths 1 to ``MAX_N`` together: the blended spectrum)
that occur in both, however often. Landmark texts give the Nyström map: a text's kernel values to the landmarks, times
the inverse root of the landmarks' own kernel matrix. One ridge regression for each language, against the rest, is
fitted on that map. Scoring is presence matrix times landmark matrix times weights for a batch of texts.

N-grams are taken over bytes of the lower-cased text in which every character that is no letter is a blank; of a
text only which n-grams occur is kept, so a text of any length takes the same space.

The model is fitted on about ``FIT_ROWS`` rows for each label, drawn by a hash of the document id from all labelled
rows: the documented bound of training. Everything else covers all rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dnslens.llm.common import slices

FIT_ROWS, LANDMARKS = 300, 48
MAX_N = 3
RIDGE = 1e-2
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_CLASSES = 64


def letters(text: str) -> bytes:
    """The lower-cased letters of a text, other characters turned into blanks, with a blank at both ends."""
    return (" " + _NOT_LETTERS.sub(" ", text.lower()) + " ").encode("utf-8", "replace")


class Alphabet:
    """Byte classes: 0 for the blank, one for each of the most frequent bytes of the landmarks, the last for others."""

    def __init__(self, texts: list[bytes]) -> None:
        counts = np.bincount(np.frombuffer(b"".join(texts), np.uint8), minlength=256)
        counts[32] = 0
        frequent = [int(b) for b in np.lexsort((np.arange(256), -counts))[: _CLASSES - 2] if counts[b]]
        self.table = np.full(256, _CLASSES - 1, np.int32)
        self.table[32] = 0
        for i, b in enumerate(sorted(frequent)):
            self.table[b] = i + 1
        self.size = sum(_CLASSES**n for n in range(1, MAX_N + 1))

    def grams(self, text: bytes) -> np.ndarray:
        """The distinct n-grams of a text as numbers."""
        seen = np.zeros(self.size, bool)
        codes = self.table[np.frombuffer(text, np.uint8)]
        code, base = codes, 0
        seen[code] = True
        for n in range(2, MAX_N + 1):
            base += _CLASSES ** (n - 1)
            if len(codes) < n:
                break
            code = code[:-1] * _CLASSES + codes[n - 1 :]
            seen[code + base] = True
        return np.flatnonzero(seen)


@dataclass
class Model:
    """The fitted classifier; small and of fixed size, so it travels with the tasks."""

    labels: list[str]
    alphabet: Alphabet
    column: np.ndarray  # n-gram number -> column of the landmark matrix, or -1
    landmarks: np.ndarray  # columns x landmarks, 1 where the landmark has the n-gram
    root_sizes: np.ndarray
    nystroem: np.ndarray
    weights: np.ndarray

    def kernel(self, grams: list[np.ndarray]) -> np.ndarray:
        """Kernel values of texts, given by their n-grams, with the landmarks."""
        present = np.zeros((len(grams), len(self.landmarks)), np.float32)
        for i, g in enumerate(grams):
            at = self.column[g]
            present[i, at[at >= 0]] = 1
        sizes = np.sqrt([max(1, len(g)) for g in grams])
        return (present @ self.landmarks) / (sizes[:, None] * self.root_sizes[None, :])

    def scores(self, grams: list[np.ndarray]) -> np.ndarray:
        """One regression value per text and label, about 1 for the label's own texts and -1 for others."""
        mapped = self.kernel(grams) @ self.nystroem
        return np.hstack([mapped, np.ones((len(grams), 1))]) @ self.weights


def train(texts: list[bytes], labels: list[str], landmarks: int = LANDMARKS) -> Model:
    """Fit on texts as ``letters`` gives them; the first ``landmarks`` of each label are its landmarks."""
    names = sorted(set(labels))
    chosen, taken = [], dict.fromkeys(names, 0)
    for i, label in enumerate(labels):
        if taken[label] < landmarks:
            taken[label] += 1
            chosen.append(i)
    alphabet = Alphabet([texts[i] for i in chosen])
    grams = [alphabet.grams(t) for t in texts]
    known = np.unique(np.concatenate([grams[i] for i in chosen])) if chosen else np.empty(0, int)
    column = np.full(alphabet.size, -1, np.int32)
    column[known] = np.arange(len(known))
    matrix = np.zeros((len(known), len(chosen)), np.float32)
    for j, i in enumerate(chosen):
        matrix[column[grams[i]], j] = 1
    sizes = np.sqrt([max(1, len(grams[i])) for i in chosen])
    model = Model(names, alphabet, column, matrix, sizes, np.empty(0), np.empty(0))
    values, vectors = np.linalg.eigh(model.kernel([grams[i] for i in chosen]).astype(np.float64))
    good = values > 1e-6 * values.max(initial=1)
    model.nystroem = vectors[:, good] / np.sqrt(values[good])
    mapped = np.vstack([model.kernel(grams[a : a + 256]) @ model.nystroem for a in range(0, len(grams), 256)])
    mapped = np.hstack([mapped, np.ones((len(grams), 1))])
    target = np.where(np.array(labels)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    # Every label weighs the same, however many rows it has.
    weight = np.array([1 / labels.count(x) for x in names])[np.searchsorted(names, labels)] * len(labels) / len(names)
    penalty = RIDGE * len(labels) * np.eye(mapped.shape[1]) / len(names)
    penalty[-1, -1] = 0
    model.weights = np.linalg.solve(mapped.T @ (mapped * weight[:, None]) + penalty, mapped.T @ (target * weight[:, None]))
    return model


def held_out(id_col: str = "doc_id") -> F.Column:
    """True where the checksum of the document id, written as text, leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, rows_per_label: int = FIT_ROWS) -> Model | None:
    """Train on labelled rows that are not held out; None if there are none."""
    rows = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.filter(~held_out("id") & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    draw = F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(1 << 40))
    keep = F.lit(False)
    for lang, n in sorted(counts.items()):
        keep = keep | ((F.col("lang") == lang) & (draw < int((1 << 40) * min(1.0, rows_per_label / n))))

    def shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [letters(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()), batch.column(2)], ["lang", "text", "draw"])

    drawn = rows.filter(keep).select("lang", "text", draw.alias("draw")).mapInArrow(shortened, "lang string, text binary, draw long")
    # Repeated ids share their draw, hence the limit; it is far above what a draw by hash gives.
    sample = sorted(drawn.limit(4 * rows_per_label * len(counts)).collect(), key=lambda r: (r.draw, r.lang, bytes(r.text)))
    return train([bytes(r.text) for r in sample], [r.lang for r in sample])


def identify(docs: DataFrame, model: Model | None, names: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """The columns of ``docs`` and, as ``names``, the predicted language and its score for every whole text.

    ``und`` with score 0 stands for texts that are null or without a letter, and for all if there is no model.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [f.name for f in docs.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        for batch in slices(batches):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            labels, scores = ["und"] * len(texts), np.zeros(len(texts))
            kept = [] if found is None else [(i, x) for i, x in ((i, letters(t)) for i, t in enumerate(texts) if t) if x.strip()]
            for at in range(0, len(kept), 128):
                part = kept[at : at + 128]
                values = found.scores([found.alphabet.grams(x) for _, x in part])
                best = values.argmax(axis=1)
                for (i, _), b, v in zip(part, best, values, strict=True):
                    labels[i], scores[i] = found.labels[b], min(1.0, max(0.0, (1 + v[b]) / 2))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(labels), pa.array(scores)], [*fields, *names])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{ddl}, {names[0]} string, {names[1]} double")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; labels, source and document id are no input of a prediction."""
    model = fit(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return identify(rows, model).select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))
