"""One pass over a page's HTML: its title, its text in two forms, and the elements that rules ask about.

The pages themselves stay in Spark; a task parses one page at a time and gives back arrays, on
which everything else is a Column expression.

Open elements end as the HTML standard has it: a list item ends the one before it, a block ends an open paragraph, an end tag reaches no further than
its table's cell. A formatting element or link ends with the block that it was opened in, and isn't opened again in the next one. Elements' texts are
places in one buffer, so what is given back grows with the page, however its elements are nested.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contactloom.dims import SETTINGS_ATTRIBUTES
from contactloom.functions.text import EASTERN_DIGITS
from contactloom.functions.urls import canonical

_SILENT = {"script", "style", "template", "noscript"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Tags whose elements are kept, and attributes that make any element kept.
_TAGS = {"a", "button", "address", "footer", "meta"}
_MARKS = ("data-", "aria-label", "role", "onclick", "id", "class")
#: Elements whose texts rules read, by tag, role, or a name or value among their attributes. Theirs are whole; other kept elements have none.
_READ_TAGS = {"a", "button", "address", "footer"}
_READ = re.compile("contact|phone|mobile|number|email|whats|joinchat|wa\\.me|wa-number|data-settings", re.I)
#: Tags, and words in ids and classes, of contact sections.
SECTION_TAGS, SECTION_WORDS = ("address", "footer"), "(?i)contact|phone|email|whatsapp"
_SECTION = re.compile(SECTION_WORDS)
_DIGIT = re.compile(f"[0-9{EASTERN_DIGITS}]")

# Fixed values of the HTML standard: how open elements end. Tags before which an open paragraph ends;
_ENDS_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li dd dt listing main menu nav ol p plaintext pre search section summary table ul xmp".split())
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: tags that end tags and implied ends don't reach across;
_WALLS = set("applet caption html table td th marquee object template select svg math".split())
#: those that a list item's or a paragraph's own end doesn't reach across either;
_LISTS, _P_WALLS = {"ol", "ul", "menu"}, {"button"}
#: tags with rules of their own: an end tag without such rules ends none of them, and a list item's start doesn't reach across most.
_SPECIAL = _ENDS_P | _WALLS | _VOID | set("base basefont bgsound body button colgroup frame frameset head iframe input keygen noembed noframes noscript param script style tbody textarea tfoot thead title tr xmp".split())
_SOFT = {"address", "div", "p", "li", "dd", "dt"}
#: the kinds of each tag: those above, and special tags that aren't soft.
_KINDS = {tag: tuple(kind for kind, tags in (("wall", _WALLS), ("list", _LISTS), ("special", _SPECIAL), ("hard", _SPECIAL - _SOFT)) if tag in tags) for tag in _WALLS | _LISTS | _SPECIAL}
#: tags whose end leaves open what began inside them;
_FORMATTING = set("a b big code em font i nobr s small strike strong tt u".split())
#: tags that begin and end on a line of their own;
_LINES = _ENDS_P | {"tr", "caption", "tbody", "thead", "tfoot", "body", "option", "br", "legend"}
#: what a table's parts end when they begin.
_TABLE_STARTS = {"td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), **dict.fromkeys(("tbody", "thead", "tfoot", "caption", "colgroup"), ("tbody", "thead", "tfoot", "caption", "colgroup", "tr", "td", "th"))}

_STRING = T.StringType()
SETTING = T.StructType().add("key", _STRING).add("value", _STRING)
#: ``start`` and ``end``: an element's text in the page's ``buffer``, in characters; ``digits``: how many are in it.
#: ``within``: it is a contact section in another one, and its text is whole lines of that one's.
ELEMENT = T.StructType().add("tag", _STRING).add("attributes", T.MapType(_STRING, _STRING)).add("start", T.IntegerType()).add("end", T.IntegerType()).add("digits", T.IntegerType()).add("within", T.BooleanType()).add("url", _STRING).add("settings", T.ArrayType(SETTING))
#: ``title_source``: what stands between the first title's tags, with its references as they are written; empty if that isn't plain text or never ends.
PAGE = T.StructType().add("title", _STRING).add("text", _STRING).add("lines", _STRING).add("buffer", _STRING).add("elements", T.ArrayType(ELEMENT)).add("jsonld", T.ArrayType(_STRING)).add("title_source", _STRING)
#: Characters of HTML whose pages are handed back at once (a longer page alone).
_SLICE = 1 << 18
_SETTINGS = pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())]))
_ELEMENT = pa.struct([("tag", pa.string()), ("attributes", pa.map_(pa.string(), pa.string())), ("start", pa.int32()), ("end", pa.int32()), ("digits", pa.int32()), ("within", pa.bool_()), ("url", pa.string()), ("settings", _SETTINGS)])
_ARROW = pa.struct([("title", pa.string()), ("text", pa.string()), ("lines", pa.string()), ("buffer", pa.string()), ("elements", pa.list_(_ELEMENT)), ("jsonld", pa.list_(pa.string())), ("title_source", pa.string())])


def settings_of(value: str) -> list[dict] | None:
    """The scalars of a widget's JSON settings with the key that each stands under (lists pass theirs on); null if it is no JSON."""
    try:
        left = [("", json.loads(value, parse_float=str))]
    except (ValueError, RecursionError):
        return None
    found = []
    while left:
        key, x = left.pop()
        if isinstance(x, dict):
            left += reversed(x.items())
        elif isinstance(x, list):
            left += [(key, y) for y in reversed(x)]
        elif x is not None:
            found.append({"key": key, "value": str(x).lower() if isinstance(x, bool) else str(x)})
    return found


class _Reader(HTMLParser):
    """Open elements are a stack, with each tag's places in it; so every start and end costs the same, however deep it is."""

    def __init__(self, base: str, source: str):
        super().__init__(convert_charrefs=True)
        self.source, self.title_at, self.title_source = source, None, None
        self.base, self.silent, self.in_title, self.in_jsonld = base, [], False, False
        self.title, self.words, self.jsonld = [], [], []
        self.elements: list[dict] = []
        self.open: list[tuple[str, dict | None] | None] = []  # None: ended before what began inside it
        self.places: dict[str, list[int]] = {}
        self.kinds: dict[str, list[int]] = {"wall": [], "list": [], "hard": [], "special": []}
        # one text of all elements, without blanks at the ends, with one blank between words or one line's end between blocks; each element has its start and end in it
        self.pieces, self.at, self.gap, self.spans = [], 0, "", []

    # --- the stack ---

    def _last(self, *tags: str) -> int:
        last, places = -1, self.places
        for t in tags:
            own = places.get(t)
            if own and own[-1] > last:
                last = own[-1]
        return last

    def _top(self, kind: str) -> int:
        return self.kinds[kind][-1] if self.kinds[kind] else -1

    def _push(self, tag: str, element: dict | None) -> None:
        for kind in _KINDS.get(tag, ()):
            self.kinds[kind].append(len(self.open))
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, element))

    def _apart(self, tag: str) -> None:
        """What comes next stands behind a blank, or on another line."""
        self.gap = "\n" if tag in _LINES else self.gap or " "

    def _ended(self, tag: str, element: dict | None) -> None:
        if element is not None:
            element["end"] = self.at
        self._apart(tag)

    def _pop_to(self, k: int) -> None:
        while len(self.open) > k:
            entry = self.open.pop()
            if entry is not None:
                tag, element = entry
                self.places[tag].pop()
                for kind in _KINDS.get(tag, ()):
                    self.kinds[kind].pop()
                self._ended(tag, element)

    def _end_within(self, k: int, wall: int) -> None:
        if k >= 0 and k >= wall:
            self._pop_to(k)

    def _end_formatting(self, tag: str) -> None:
        k = self._last(tag)
        if k < 0 or k < self._top("wall"):
            return
        if self._top("special") < k:
            self._pop_to(k)
        else:
            self._ended(*self.open[k])
            self.open[k] = None
            self.places[tag].pop()

    def _implied(self, tag: str) -> None:
        """What the start of this tag ends."""
        wall = self._top("wall")
        if tag == "li":
            self._end_within(self._last("li"), max(self._top("hard"), self._last("dd", "dt")) + 1)
        elif tag in ("dd", "dt"):
            self._end_within(self._last("dd", "dt"), max(self._top("hard"), self._last("li")) + 1)
        elif tag in _TABLE_STARTS:
            own = [k for k in (self._last(t) for t in _TABLE_STARTS[tag]) if k > self._last("table")]
            if own:
                self._pop_to(min(own))
        elif tag == "a" or tag == "nobr":
            self._end_formatting(tag)
        elif tag == "button":
            self._end_within(self._last("button"), wall)
        elif tag in ("option", "optgroup"):
            self._end_within(self._last("option"), self._last("select", "datalist", "optgroup"))
            if tag == "optgroup":
                self._end_within(self._last("optgroup"), self._last("select"))
        elif tag in ("rt", "rp"):
            self._end_within(self._last("rt", "rp"), self._last("ruby") + 1)
        if tag in _ENDS_P:
            self._end_within(self._last("p"), max(wall, self._last(*_P_WALLS)))
        if tag in _HEADINGS and self.open and self.open[-1] is not None and self.open[-1][0] in _HEADINGS:
            self._pop_to(len(self.open) - 1)

    def _place(self) -> int:
        """Where the tag that is being read begins in the page."""
        line, column = self.getpos()
        at = 0
        for _ in range(line - 1):
            at = self.source.find("\n", at) + 1
        return at + column

    def _foreign(self) -> bool:
        return self._last("svg", "math") > -1

    # --- the parser's calls ---

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._start(tag, attrs, False)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self._start(tag, attrs, True)

    def _start(self, tag: str, attrs: list, closed: bool) -> None:
        found = {k: v or "" for k, v in attrs}
        foreign = self._foreign()
        self.words.append("\n")
        if tag in _SILENT and not (foreign and closed):
            self.silent.append(tag)
            self.in_jsonld = tag == "script" and found.get("type", "").lower() == "application/ld+json"
            if self.in_jsonld:
                self.jsonld.append("")
        self.in_title = tag == "title" and not foreign or self.in_title and tag != "body"
        if tag == "title" and self.title_at is None and not foreign:
            self.title_at = self._place() + len(self.get_starttag_text())
        if not foreign:
            self._implied(tag)
        if tag in _SPECIAL:
            self._apart(tag)
        element = None
        if tag in _TAGS or any(k.startswith(_MARKS[0]) or k in _MARKS[1:] for k in found):
            url = canonical(self.base, found["href"]) if found.get("href") else None
            settings = [settings_of(found[k]) for k in SETTINGS_ATTRIBUTES if found.get(k)]
            element = {"tag": tag, "attributes": list(found.items()), "start": self.at, "end": self.at, "digits": 0, "within": False, "url": url, "settings": sum(filter(None, settings), []) if any(x is not None for x in settings) else None}
            self.elements.append(element)
            if tag in _READ_TAGS or any(_READ.search(x) or (k, x.lower()) == ("role", "button") for k, v in found.items() for x in (k, v)):
                self.spans.append(element)
        # a slash ends only void elements and those of drawings and formulas
        if tag not in _VOID and not (foreign and closed):
            self._push(tag, element)

    def handle_endtag(self, tag: str) -> None:
        self.words.append("\n")
        self._apart(tag)
        if tag in self.silent:
            self.silent, self.in_jsonld = [], False
        if tag == "title":
            self.in_title = False
            if self.title_at is not None and self.title_source is None:
                self.title_source = self.source[self.title_at : self._place()]
        k, wall = self._last(tag), self._top("wall")
        if self._foreign() and tag not in ("svg", "math"):
            self._end_within(k, self._last("svg", "math") + 1)
        elif tag in _HEADINGS:
            self._end_within(self._last(*_HEADINGS), wall)
        elif tag in ("html", "body") or k < 0:
            pass
        elif tag == "p":
            self._end_within(k, max(wall, self._last(*_P_WALLS)))
        elif tag == "li":
            self._end_within(k, max(wall, self._top("list")))
        elif tag in _FORMATTING:
            self._end_formatting(tag)
        elif tag == "table":
            self._end_within(k, self._last("template"))
        elif tag in _TABLE_STARTS:
            self._end_within(k, self._last("table") + 1)
        elif tag in _SPECIAL or tag in ("svg", "math"):
            self._end_within(k, wall)
        else:
            self._end_within(k, self._top("special"))

    def handle_data(self, data: str) -> None:
        if self.in_jsonld:
            self.jsonld[-1] += data
        if self.silent:
            return
        if self.in_title:
            self.title.append(data)
        self.words.append(data)
        words = " ".join(data.split())
        if words:
            if (self.gap or data[0].isspace()) and self.at:
                words = (self.gap or " ") + words
            self.pieces.append(words)
            self.at += len(words)
            self.gap = ""
        if data[-1:].isspace():
            self._apart("")

    def result(self) -> dict:
        self._pop_to(0)
        buffer = "".join(self.pieces)
        digits = [m.start() for m in _DIGIT.finditer(buffer)]
        for element in self.elements:
            element["start"] += buffer[element["start"] : element["start"] + 1] in (" ", "\n")
            element["end"] = max(element["start"], element["end"])
        own = set(map(id, self.spans))
        for element in self.elements:
            if id(element) in own:
                element["digits"] = bisect_left(digits, element["end"]) - bisect_left(digits, element["start"])
            else:
                element["end"] = element["start"]
        self._nested(buffer)
        whole = "".join(self.words)
        lines = "\n".join(x for x in (" ".join(y.split()) for y in whole.split("\n")) if x)
        return {"title": " ".join("".join(self.title).split()), "text": " ".join(whole.split()), "lines": lines, "buffer": buffer, "elements": self.elements, "jsonld": self.jsonld, "title_source": "" if "<" in (self.title_source or "") else self.title_source or ""}


    def _nested(self, buffer: str) -> None:
        """Marks the sections whose lines an enclosing one has as well."""
        ends = lambda k: k == len(buffer) or buffer[k] == "\n"
        around: list[dict] = []
        for e in self.elements:
            found = dict(e["attributes"])
            if e["tag"] not in SECTION_TAGS and not _SECTION.search(f"{found.get('id', '')} {found.get('class', '')}"):
                continue
            while around and not around[-1]["start"] <= e["start"] <= e["end"] <= around[-1]["end"]:
                around.pop()
            begins = e["start"] == 0 or buffer[e["start"] - 1] == "\n"
            if around and begins and ends(e["end"]):
                e["within"] = True
            else:
                around.append(e)


def element_text(page: Column, element: Column) -> Column:
    """An element's text, cut out of its page's buffer where a rule reads it."""
    return F.substring(page["buffer"], element["start"] + 1, element["end"] - element["start"])


def read_page(page: str | None, url: str | None) -> dict:
    reader = _Reader(url or "", page or "")
    reader.feed(page or "")
    reader.close()
    return reader.result()


@F.arrow_udf(PAGE)
def parsed(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """(html, url) -> the page; a null page is an empty one. What a task holds of read pages is a slice, however many come at once."""
    for pages, urls in columns:
        read, size = [], 0
        for p, u in zip(pages, urls):
            page = p.as_py() or ""
            read.append(read_page(page, u.as_py()))
            size += len(page)
            if size >= _SLICE:
                yield pa.array(read, _ARROW)
                read, size = [], 0
        if read:
            yield pa.array(read, _ARROW)
