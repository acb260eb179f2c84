"""A small HTML reader: the tree of block-level elements, their texts, and the tree's skeleton.

Only what text extraction needs: raw-text elements, comments, void elements, implied ends of paragraphs, list items and
table cells, unclosed elements, character references. Inline elements are transparent; a line break is white space.
"""

from __future__ import annotations

import html as entities
import re

# Names that the HTML standard fixes.
RAW = frozenset("script style textarea title noscript iframe noembed noframes template xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby rb rp rt rtc s samp "
    "small span strike strong sub sup time tt u var".split()
)
_CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"}, "body": {"head"},
}
_SCOPES = frozenset("ul ol dl table select article section main body html div nav aside".split())

#: Elements and words in class, id or role that mark what is not the article.
ASIDE_TAGS = frozenset("nav header footer aside form head button select menu dialog svg object".split()) | RAW
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored banner promo promotion cookie cookies consent notice "
    "notices alert popup modal menu nav navbar navigation breadcrumb breadcrumbs sidebar footer header masthead comment "
    "comments disqus share sharing social related newsletter subscribe widget toolbar search complementary contentinfo".split()
)
BODY_TAGS = frozenset(("article", "main"))
#: Never set aside for a class name.
WHOLE_TAGS = BODY_TAGS | {"html", "body"}

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAMES = re.compile(r"[^a-z0-9]+")


class Page:
    """Elements in page order (``label``, ``parent``, ``aside``, ``body``) and ``blocks``: (element, text).

    ``aside`` says what elements of ``ASIDE_TAGS`` hold. ``named`` is the innermost element at or above one that has a
    word of ``ASIDE_WORDS``, or -1; elements of ``WHOLE_TAGS`` and those around an article have none.
    """

    def __init__(self, source: str) -> None:
        self.label, self.parent, self.aside, self.body, self.named = ["#"], [-1], [False], [False], [-1]
        self._words: list[bool | None] = [None]
        self.blocks: list[tuple[int, str]] = []
        self._tags, self._open, self._text = ["#"], [0], []
        self._read(source)
        self._flush()
        self._name()

    def _flush(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                self.blocks.append((self._open[-1], text))
            self._text = []

    def _name(self) -> None:
        around: dict[int, bool] = {}  # elements around an article; whether one of them is ``main``
        for e, tag in enumerate(self._tags):
            main, up = tag == "main", self.parent[e]
            if tag in BODY_TAGS and not self.aside[e]:
                while up >= 0 and (up not in around or main and not around[up]):
                    around[up] = main
                    up = self.parent[up]
        for e in range(1, len(self._tags)):
            plain = self._words[e]
            mine = plain is not None and self._tags[e] not in WHOLE_TAGS and (e not in around or plain and not around[e])
            self.named.append(e if mine else self.named[self.parent[e]])

    def _push(self, tag: str, attributes: str) -> None:
        words: set[str] = set()
        tokens: set[str] = set()
        name = tag
        if attributes and "=" in attributes:
            for kind, *values in _ATTRIBUTE.findall(attributes):
                value = "".join(values).lower()
                words.update(_NAMES.split(value))
                tokens.update(value.split())
                if kind.lower() == "class":
                    name += "." + ".".join(sorted(value.split()))
        top = self._open[-1]
        aside = self.aside[top] or tag in ASIDE_TAGS
        # Around an article a word counts only as a whole name: "comments" may hold articles, "has-comments" says little.
        self._words.append(None if words.isdisjoint(ASIDE_WORDS) else not tokens.isdisjoint(ASIDE_WORDS))
        self.label.append(re.sub(r"[;:\s]", "_", name))
        self._tags.append(tag)
        self.parent.append(top)
        self.aside.append(aside)
        self.body.append(self.body[top] or tag in BODY_TAGS)
        self._open.append(len(self.label) - 1)

    def _close(self, tags: set[str] | frozenset[str], stop: frozenset[str] = frozenset()) -> None:
        """Close up to the innermost open element of ``tags``, unless one of ``stop`` is met before."""
        for depth in range(len(self._open) - 1, 0, -1):
            tag = self._tags[self._open[depth]]
            if tag in tags:
                del self._open[depth:]
                return
            if tag in stop:
                return

    def _read(self, source: str) -> None:
        at, size = 0, len(source)
        while at < size:
            found = _TAG.search(source, at)
            if found is None:
                self._text.append(entities.unescape(source[at:]))
                return
            if found.start() > at:
                piece = source[at : found.start()]
                self._text.append(entities.unescape(piece) if "&" in piece else piece)
            at = found.end()
            name = found[2] or found[5]
            if name is None:
                continue
            tag, ends, attributes = name.lower(), found[1] or found[4], found[3] or found[6] or ""
            if tag in INLINE:
                if tag == "a" or not attributes:
                    continue
                continue
            if tag in VOID:
                if tag in ("br", "wbr", "img", "input"):
                    self._text.append(" " if tag != "wbr" else "")
                else:
                    self._flush()
                continue
            self._flush()
            if ends:
                self._close({tag}, frozenset() if tag in _SCOPES else frozenset(("table", "article", "body")))
                continue
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(source, at)
                at = end.end() if end else size
                continue
            self._close({"p"}, _SCOPES | {"li", "td", "th", "dd"})
            if tag in _CLOSES:
                self._close(_CLOSES[tag], _SCOPES if tag != "body" else frozenset())
            if attributes.rstrip().endswith("/") and tag == "svg":
                continue
            self._push(tag, attributes)

    def skeleton(self) -> tuple[str, list[int]]:
        """The tree with runs of siblings of one shape drawn together, as text, and the node of each element."""
        size = len(self.label)
        children: list[list[int]] = [[] for _ in range(size)]
        shapes: dict[tuple, int] = {}
        shape = [0] * size
        for e in range(size - 1, -1, -1):
            below = children[e]
            below.reverse()
            ids = [shape[c] for i, c in enumerate(below) if not i or shape[c] != shape[below[i - 1]]]
            shape[e] = shapes.setdefault((self.label[e], *ids), len(shapes))
            if e:
                children[self.parent[e]].append(e)
        node, made, parts = [0] * size, {}, ["-1:#"]
        group, last = [-1] * size, [-1] * size
        for e in range(1, size):
            p = self.parent[e]
            if shape[e] != last[p]:
                group[p], last[p] = group[p] + 1, shape[e]
            key = (node[p], group[p])
            if key not in made:
                made[key] = len(parts)
                parts.append(f"{node[p]}:{self.label[e]}")
            node[e] = made[key]
        return ";".join(parts), node
