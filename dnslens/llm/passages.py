"""Paragraphs cut by content, their MinHash values and word shingles, for many texts at once in array operations.

A paragraph starts at a word whose two-word hash is the least of ``REACH`` words on either side, so equal passages are
cut equally wherever they stand, and paragraphs have more than ``REACH`` words but at the ends of a text. Words are
parted by white space and compared with A-Z in lower case.
"""

from __future__ import annotations

import numpy as np

REACH, SHINGLE, BANDS, MIN_WORDS = 7, 5, 3, 8
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_ODD = np.random.default_rng(42).integers(1, 1 << 63, 32, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse; the tables of the largest size so far are kept."""
    have = _powers.get(0)
    if have is None or len(have[0]) < size:
        one = np.ones(1, np.uint64)
        have = tuple(np.concatenate([one, np.cumprod(np.full(size, b, np.uint64))]) for b in (_BASE, _INVERSE))
        _powers[0] = have
    return have


class Words:
    """Word starts, ends (bytes), hashes and text numbers of a list of texts joined by line ends.

    ``space`` says which bytes part words; a line end has to be one of them.
    """

    def __init__(self, texts: list[bytes], space: np.ndarray = _SPACE) -> None:
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.text_start = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
        space = space[data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(space) and not space[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[0::2], edge[1::2]
        power, inverse = _power_tables(len(data))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * power[: len(data)])])
        self.hash = _mixed((sums[self.end] - sums[self.start]) * inverse[self.start])
        self.text = np.searchsorted(self.text_start, self.start, side="right") - 1
        self.points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])

    def shingles(self) -> np.ndarray:
        """Hash of the ``SHINGLE`` words from each word on, whatever text they are of; the last few are absent."""
        n = max(0, len(self.hash) - SHINGLE + 1)
        total = np.zeros(n, np.uint64)
        for k in range(SHINGLE):
            total += self.hash[k : k + n] * _ODD[k]
        return _mixed(total)


def _cuts(words: Words, texts: int) -> np.ndarray:
    """Where paragraphs start, as word numbers."""
    n = len(words.hash)
    if not n:
        return np.empty(0, np.int64)
    value = words.hash * _ODD[10]
    value[:-1] += words.hash[1:] * _ODD[11]
    value = _mixed(value) >> np.uint64(1)
    # Texts are kept apart by REACH places of the largest value; the last word's pair would reach into the next text.
    last = np.concatenate([words.text[1:] != words.text[:-1], [True]])
    value[last] = _MAX
    at = np.arange(n) + (words.text + 1) * REACH
    wide = np.full(n + (texts + 2) * REACH + 1, _MAX)
    wide[at] = value
    two = np.minimum(wide[:-1], wide[1:])
    four = np.minimum(two[:-2], two[2:])
    seven = np.minimum(four[:-3], four[3:])
    low = (value < seven[at - REACH]) & (value <= seven[at + 1]) & ~last
    low |= np.concatenate([[True], words.text[1:] != words.text[:-1]])
    return np.flatnonzero(low)


def paragraphs(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Columns text, no, start, end (code points), n_words, content and the ``BANDS`` MinHash values of each paragraph.

    Paragraphs of fewer than ``MIN_WORDS`` words are left out, their numbers are not reused.
    """
    words = Words(texts)
    cuts = _cuts(words, len(texts))
    names = ["text", "no", "start", "end", "n_words", "content", *(f"k{b}" for b in range(BANDS))]
    if not len(cuts):
        return {c: np.empty(0, np.int64) for c in names}
    n = len(words.hash)
    sizes = np.diff(np.concatenate([cuts, [n]]))
    text = words.text[cuts]
    fresh = np.concatenate([[True], text[1:] != text[:-1]])
    no = np.arange(len(cuts)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    shingle = np.concatenate([words.shingles(), np.zeros(min(n, SHINGLE - 1), np.uint64)])
    owner = np.repeat(np.arange(len(cuts)), sizes)
    inside = np.zeros(n, bool)
    inside[: n - SHINGLE + 1] = owner[SHINGLE - 1 :] == owner[: n - SHINGLE + 1] if n >= SHINGLE else False
    content = np.add.reduceat(np.where(inside, _mixed(shingle ^ _ODD[20]), np.uint64(0)), cuts)
    content = _mixed(content + sizes.astype(np.uint64) * _ODD[21])
    keep = sizes >= MIN_WORDS
    out = {
        "text": text[keep],
        "no": no[keep],
        "start": (words.points[words.start[cuts]] - words.points[words.text_start[text]])[keep],
        "end": (words.points[words.end[np.concatenate([cuts[1:], [n]]) - 1]] - words.points[words.text_start[text]])[keep],
        "n_words": sizes[keep],
        "content": content[keep].view(np.int64),
    }
    for b in range(BANDS):
        out[f"k{b}"] = np.minimum.reduceat(np.where(inside, shingle * _ODD[12 + b], _MAX), cuts)[keep].view(np.int64)
    return out


def shingle_set(text: bytes) -> np.ndarray:
    """The distinct shingles of one paragraph, sorted."""
    return np.unique(Words([text]).shingles())


def band_last(shingles: np.ndarray, band: int) -> np.ndarray:
    """The shingles in their order, but that one last whose MinHash value is ``band``."""
    own = np.zeros(len(shingles), bool)
    for b in range(BANDS):
        own |= (shingles * _ODD[12 + b]).view(np.int64) == band
    return np.concatenate([shingles[~own], shingles[own]])
