"""Words of a text as a word-level BPE tokenizer file sees them, cut so that each can be encoded on its own.

The tokenizer's normalizer and splitting pattern never join what a blank, tab or line end separates, so a text is
first cut there; the resulting *units* recur often and are what callers cache. A unit made of ASCII and Latin-1
letters is normalized and split here by the same rules; any other one by the tokenizer's own components.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

from tokenizers import Tokenizer

_BLANKS = str.maketrans("\t\n\r", "   ")
_PLAIN = re.compile(r"[!-~¡-ÿ]*")
# The pattern of the tokenizer file, over lower-cased plain characters. Fixed values.
_PIECES = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|[^\sa-z0-9ªµºß-öø-ÿ²³¹¼-¾]+"
)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shown = dict.fromkeys(printable)
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


SYMBOLS = byte_symbols()
_TO_SYMBOLS = {i: s for i, s in enumerate(SYMBOLS)}


def units(text: str) -> list[str]:
    """The blank-separated units of a text; empty ones may occur."""
    return text.translate(_BLANKS).split(" ") if "\t" in text or "\r" in text else text.replace("\n", " ").split(" ")


class UnitSplitter:
    """Splits a unit into special-token ids and byte-level pieces."""

    def __init__(self, tokenizer_json: str) -> None:
        spec = json.loads(tokenizer_json)
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._marks = re.compile("(" + "|".join(re.escape(s) for s in self.special) + ")") if self.special else None

    def pieces(self, unit: str) -> list[str | int]:
        """Ids of special tokens and pieces (strings of byte symbols) in order."""
        if self._marks is not None and "<|" in unit:
            out: list[str | int] = []
            for part in self._marks.split(unit):
                if part in self.special:
                    out.append(self.special[part])
                elif part:
                    out.extend(self._split(part))
            return out
        return self._split(unit)

    def _split(self, part: str) -> list[str]:
        if _PLAIN.fullmatch(part):
            found = _PIECES.findall(part.lower())
            return found if part.isascii() else [p.encode().decode("latin-1").translate(_TO_SYMBOLS) for p in found]
        normal = self.tokenizer.normalizer.normalize_str(part)
        return [piece for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]


@lru_cache(maxsize=2)
def splitter(tokenizer_json: str) -> UnitSplitter:
    """One splitter per worker and tokenizer file."""
    return UnitSplitter(tokenizer_json)


def tokenizer_text(path: str | None = None) -> str:
    """The content of a tokenizer file, to be broadcast (a fixed file of a few MB)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as file:
        return file.read()
