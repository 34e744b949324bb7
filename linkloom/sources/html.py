"""Cut the raw pieces out of HTML.

HTML needs a tokenizer, which Spark does not have; this is the only place where
page text leaves the JVM. The helper returns pieces (strings, hrefs) and takes
no decisions: which title wins, white space, hashes and URLs are Column
expressions in ``operators.extract``.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from html import unescape
from io import StringIO
from itertools import accumulate, islice

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# Executors get this helper with the task; nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LISTS = ("headings", "hrefs")
FIELDS = [
    "og_title",
    "title",
    "h1",
    "og_description",
    "meta_description",
    "paragraph",
    "headings",
    "body_text",
    "hrefs",
    "canonical_href",
]
PIECES_DDL = "struct<" + ",".join(f"{f}:{'array<string>' if f in LISTS else 'string'}" for f in FIELDS) + ">"
PIECES_ARROW = pa.struct([(f, pa.list_(pa.string()) if f in LISTS else pa.string()) for f in FIELDS])

# Tags taken out before text and links are read, tags that give
# text chunks, and the limits on headings and on a paragraph used as description.
REMOVED = {"script", "style", "noscript", "template", "svg"}
CHUNKS = {"h1", "h2", "h3", "p", "li", "pre", "code", "td"}
HEADINGS = {"h1", "h2", "h3"}
MIN_PARAGRAPH = 50

#: Characters of pieces, and those a value counts for besides its text, that a task puts together
#: before it hands them on.
HELD_CHARS = 2_000_000
VALUE_CHARS = 100

# Tags whose text never belongs to a surrounding element.
MUTE = {"script", "style", "template"}
VOID = set("area base br col embed hr img input link meta source track wbr".split())
HEAD_ONLY = set("html head title meta link script style base noscript template".split())
# A new one of these ends an open paragraph.
ENDS_PARAGRAPH = set(
    "p h1 h2 h3 h4 h5 h6 div ul ol dl dt dd li table caption tbody thead tfoot tr td th pre hr blockquote"
    " address center".split()
)
# A new key ends an open value, up to the nearest boundary.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
INLINE = set("a abbr b big cite code em font i kbd mark q s small span strike strong sub sup tt u var".split())
INLINE_OR_P = INLINE | {"p"}
CLOSED_ALONG = INLINE_OR_P | {"h1", "h2", "h3", "h4", "h5", "h6"}

# Comments and declarations; raw-text elements with their content; tags.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>"
    r"|<(?P<raw>script|style)\b[^<>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?>[^<>\"']+|\"[^\"]*\"|'[^']*')*+)>",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"""([^\s/=>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
# An ampersand that starts no reference is plain text.
BARE_AMPERSAND = re.compile(r"&(?!#[0-9]|#[xX][0-9a-fA-F]|[A-Za-z][A-Za-z0-9]*;)")


def _decode(text: str) -> str:
    return unescape(BARE_AMPERSAND.sub("&amp;", text)) if "&" in text else text


def _attributes(text: str) -> dict[str, str]:
    values: dict[str, str] = {}
    for name, double, single, bare in ATTRIBUTE.findall(text):
        values.setdefault(name.lower(), _decode(double or single or bare))
    return values


class _Pieces:
    """One pass over a page. Strings are held once, and an element's text is the interval of
    those between its begin and its end, so nested elements share them."""

    def __init__(self) -> None:
        self.seen: list[str] = []  # every string but those of MUTE tags
        self.kept: list[str] = []  # those outside REMOVED tags
        self.open: list[tuple[str, dict]] = []
        self.count: Counter[str] = Counter()  # open elements by tag
        self.removed = self.mute = self.in_head = 0  # and by kind
        self.elements: list[dict] = []
        self.meta: dict[str, str] = {}
        self.roots: dict[str, dict] = {}
        self.hrefs: list[str] = []
        self.canonical: str | None = None
        self.has_canonical = False

    def read(self, html: str) -> None:
        at = 0
        for token in TOKEN.finditer(html):
            if token.start() > at:
                self._text(html[at : token.start()])
            at = token.end()
            tag = token["tag"]
            if tag is None:
                continue
            if token["end"]:
                self._end(tag.lower())
            else:
                self._start(tag.lower(), token["attrs"])
        self._text(html[at:])
        self._close_down_to(0)

    def _text(self, raw: str) -> None:
        text = _decode(raw).strip()
        if text and not self.mute:
            self.seen.append(text)
            if not self.removed:
                self._imply_body("#text")
                self.kept.append(text)

    def _imply_body(self, tag: str) -> None:
        if "body" not in self.roots and tag not in HEAD_ONLY and not self.in_head:
            self.roots["body"] = self._mark(tag)

    def _mark(self, tag: str) -> dict:
        return {"tag": tag, "seen": len(self.seen), "kept": len(self.kept), "from": len(self.elements)}

    def _note(self, tag: str, step: int) -> None:
        self.count[tag] += step
        self.removed += step * (tag in REMOVED)
        self.mute += step * (tag in MUTE)
        self.in_head += step * (tag in ("head", "title"))

    def _close_down_to(self, depth: int) -> None:
        while len(self.open) > depth:
            tag, element = self.open.pop()
            self._note(tag, -1)
            element.update(seen_end=len(self.seen), kept_end=len(self.kept), to=len(self.elements))

    def _close_before(self, tag: str) -> None:
        if tag in ENDS_PARAGRAPH and self.count["p"]:
            for depth in range(len(self.open) - 1, -1, -1):
                if self.open[depth][0] == "p":
                    self._close_down_to(depth)
                    break
                if self.open[depth][0] not in INLINE:
                    break
        closes, boundary = SIBLINGS.get(tag, ((), ()))
        if any(self.count[c] for c in closes):
            lowest = None
            for depth in range(len(self.open) - 1, -1, -1):
                at = self.open[depth][0]
                if at in closes:
                    lowest = depth
                elif at in boundary or at not in CLOSED_ALONG:
                    break
            if lowest is not None:
                self._close_down_to(lowest)

    def _start(self, tag: str, attrs: str) -> None:
        self._close_before(tag)
        removed = tag in REMOVED or self.removed > 0
        wanted = tag in ("meta", "a", "link") or "role" in attrs.lower()
        values = _attributes(attrs) if wanted else {}
        if tag == "meta":
            for name, known in (("property", "og:title"), ("property", "og:description"), ("name", "description")):
                if values.get(name) == known:
                    self.meta.setdefault(known, values.get("content", ""))
        if not removed:
            if tag == "a" and "href" in values:
                self.hrefs.append(values["href"])
            if tag == "link" and not self.has_canonical and "canonical" in values.get("rel", ""):
                self.has_canonical, self.canonical = True, values.get("href")
            self._imply_body(tag)
        if tag in VOID:
            return
        element = {**self._mark(tag), "removed": removed}
        if tag in CHUNKS or tag == "title":
            self.elements.append(element)
        if not removed:
            if tag in ("main", "article"):
                self.roots.setdefault(tag, element)
            if values.get("role") == "main":
                self.roots.setdefault("role", element)
        element["from"] = len(self.elements)
        self.open.append((tag, element))
        self._note(tag, 1)

    def _end(self, tag: str) -> None:
        if not self.count[tag]:
            return
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth][0] == tag:
                self._close_down_to(depth)
                return
            if tag in INLINE and self.open[depth][0] not in INLINE_OR_P:
                return

    def _body_text(self, text_chars: int | None) -> str:
        """Texts of the chunks below the root, one after the other; nested ones come at each level.

        With a limit, chunks are taken until ``text_chars`` characters are there whatever
        becomes of white space and letter case.
        """
        root = next((self.roots[k] for k in ("main", "article", "role", "body") if k in self.roots), None)
        root = root or {"kept": 0, "from": 0}
        inside = self.elements[root["from"] : root.get("to")]
        spans = [(e["kept"], e["kept_end"]) for e in inside if e["tag"] in CHUNKS and not e["removed"] and e["kept_end"] > e["kept"]]
        kept = self.kept
        if not spans:
            return " ".join(kept[root["kept"] : root.get("kept_end")])
        text = " ".join(kept)
        begin = list(accumulate((len(k) + 1 for k in kept), initial=0))
        if text_chars is not None:
            size = list(accumulate((len(" ".join(k.split()).lower()) + 1 for k in kept), initial=0))
            have = accumulate(size[end] - size[at] for at, end in spans)
            spans = spans[: next((i for i, n in enumerate(have, 1) if n > text_chars), len(spans))]
        out = StringIO()
        for i, (at, end) in enumerate(spans):
            out.write(" " if i else "")
            out.write(text[begin[at] : begin[end] - 1])
        return out.getvalue()

    def result(self, text_chars: int | None = None, max_headings: int | None = None) -> dict:
        text = "".join(self.seen)
        begin = list(accumulate(map(len, self.seen), initial=0))

        def said(tags: set[str]) -> Iterator[str]:
            return (text[begin[e["seen"]] : begin[e["seen_end"]]] for e in self.elements if e["tag"] in tags)

        return {
            "og_title": self.meta.get("og:title"),
            "title": next(said({"title"}), None),
            "h1": next(said({"h1"}), None),
            "og_description": self.meta.get("og:description"),
            "meta_description": self.meta.get("description"),
            "paragraph": next((p for p in said({"p"}) if len(p) >= MIN_PARAGRAPH), None),
            "headings": list(islice((h for h in said(HEADINGS) if h), max_headings)),
            "body_text": self._body_text(text_chars),
            "hrefs": self.hrefs,
            "canonical_href": self.canonical,
        }


def cut_page(html: str | None, text_chars: int | None = None, max_headings: int | None = None) -> dict:
    page = _Pieces()
    page.read(html or "")
    return page.result(text_chars, max_headings)


def _chars(piece: dict) -> int:
    texts = (len(v) if isinstance(v, str) else sum(len(t) + VALUE_CHARS for t in v or ()) for v in piece.values())
    return sum(texts) + VALUE_CHARS * len(piece)


def cut_batch(batch: pa.Array, text_chars: int | None = None, max_headings: int | None = None) -> Iterator[pa.Array]:
    """Pieces of the pages of a batch, in order, in arrays of about ``HELD_CHARS`` characters."""
    held, chars = [], 0
    for page in batch:
        piece = cut_page(page.as_py(), text_chars, max_headings)
        held.append(piece)
        chars += _chars(piece)
        if chars >= HELD_CHARS:
            yield pa.array(held, type=PIECES_ARROW)
            held, chars = [], 0
    if held:
        yield pa.array(held, type=PIECES_ARROW)


def html_pieces(html: Column, text_chars: int | None = None, max_headings: int | None = None) -> Column:
    """Struct of the raw pieces of a page; only ``html`` travels to Python.

    A page of nested lists repeats its text at every level. Under limits no more of that is
    put together than they need. A batch of pages is handed back in several small ones, so a task
    holds the pieces of few pages, however many a batch has.
    """
    # Declared here: an Arrow UDF needs the running session's configuration.
    @F.arrow_udf(PIECES_DDL)
    def pieces(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield from cut_batch(batch, text_chars, max_headings)

    return pieces(html)
