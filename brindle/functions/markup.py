"""Pages as trees: elements with attributes, ancestors and spans of text, read in one pass with a stack of open elements."""

from __future__ import annotations

import html as _html
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions import clean

#: Fixed values of HTML: elements without content, those whose content isn't markup, and of these the ones that aren't text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW, HIDDEN = frozenset("script style textarea title noscript".split()), frozenset("script style noscript".split())
#: Fixed values of HTML: what an opening tag closes before it, and the elements that this doesn't reach over.
_CELLS, _ROWS = ("td", "th"), ("tr", "td", "th")
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "td": _CELLS, "th": _CELLS, "tr": _ROWS, "tbody": ("tbody", "thead", "tfoot", *_ROWS), "tfoot": ("tbody", "thead", *_ROWS), "thead": ("caption", "colgroup")}
WITHIN = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "option": ("select",)}
BLOCKS = frozenset("address article aside blockquote body caption center dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section table tbody td tfoot th thead title tr ul".split())
_PARAGRAPH_ENDS = BLOCKS - frozenset("body head html caption dd dt li tbody td tfoot th thead title tr".split())
_TABLE = frozenset("table tbody thead tfoot tr td th caption".split())
_BARRIER = frozenset("table td th caption".split())
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
#: What most of a page is: text up to a closing tag, or up to an opening one with all attributes in double quotes. The rest is read sign by sign.
_TOKEN = re.compile(r"""([^<]*+)(?:</([A-Za-z][^\s/>]*+)[^>]*+>|<([A-Za-z][^\s/>]*+)((?:\s++[^\s=>/"']++="[^"]*+")*+)\s*+>)""")
_PAIR = re.compile(r"""\s([^\s=>/"']+)="([^"]*)\"""")
_ATTR = re.compile(r"""[\s/]*([^\s=>/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']*)))?""")
_PLAIN = re.compile(r"""[\s/]*([^\s=>/]+)(?:\s*=\s*([^\s>]*))?""")
#: Ancestors that a path names, at most, from the inside out.
PATH = 24
_NODE = pa.struct([("node", pa.int32()), ("parent", pa.int32()), ("depth", pa.int32()), ("tag", pa.string()), ("path", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("begin", pa.int32()), ("end", pa.int32())])
_TREE = pa.struct([("text", pa.string()), ("nodes", pa.list_(_NODE))])
_INT, _STRING = T.IntegerType(), T.StringType()
TREE = T.StructType([T.StructField("text", _STRING), T.StructField("nodes", T.ArrayType(T.StructType([T.StructField(f.name, T.MapType(_STRING, _STRING) if f.name == "attrs" else _STRING if f.type == pa.string() else _INT) for f in _NODE])))])


#: What an opening tag does, by name: ends a paragraph, closes others, breaks a line, has no content, is a barrier, has content that isn't markup.
_KNOWN = {t: (t in _PARAGRAPH_ENDS, t in CLOSES, t in BLOCKS or t == "br", t in VOID, t in _BARRIER, t in RAW) for t in {*BLOCKS, *CLOSES, *VOID, *_BARRIER, *RAW}}
_OTHER = (False,) * 6


class _Pages:
    """Pages as columns: their texts, and the fields of their elements one page after the other.

    wanted: tags, and names of attributes. Elements with neither are left out, and the paths of all; numbers stay.
    """

    def __init__(self, wanted: tuple[frozenset[str], frozenset[str]] | None = None):
        self.wanted = wanted
        self.texts: list[str | None] = []
        self.ends = [0]
        self.columns: dict[str, list] = {f.name: [] for f in _NODE if f.name != "attrs"}
        self.keys: list[str] = []
        self.values: list[str] = []
        self.attrs = [0]

    def add(self, raw: str | None) -> None:
        self.texts.append(raw if raw is None else _Page(self).read(raw))
        self.ends.append(len(self.attrs) - 1)

    def nodes(self) -> list[dict]:
        """All elements, each as a dict."""
        pairs = [list(zip(self.keys[i:j], self.values[i:j])) for i, j in zip(self.attrs, self.attrs[1:])]
        return [dict(zip((*self.columns, "attrs"), r)) for r in zip(*self.columns.values(), pairs)]

    def arrow(self) -> pa.Array:
        attrs = pa.MapArray.from_arrays(pa.array(self.attrs, pa.int32()), pa.array(self.keys, pa.string()), pa.array(self.values, pa.string()))
        nodes = pa.StructArray.from_arrays([attrs if f.name == "attrs" else pa.array(self.columns[f.name], f.type) for f in _NODE], fields=list(_NODE))
        return pa.StructArray.from_arrays([pa.array(self.texts, pa.string()), pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), nodes)], fields=list(_TREE), mask=pa.array([t is None for t in self.texts]))


class _Page:
    """The elements that are open while a page is read, with the places of each name in the stack."""

    def __init__(self, pages: _Pages):
        self.pages, self.count = pages, 0
        #: Where open elements are in the columns, -1 for those left out, and their numbers.
        self.stack: list[int] = []
        self.numbers: list[int] = []
        self.names: list[str] = []
        self.places: dict[str, list[int]] = {}
        self.barriers: list[int] = []
        self.parts: list[str] = []
        self.length = 0

    def add(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)

    def last(self, name: str) -> int:
        """The place of the innermost open element of a name; -1 if there is none."""
        p = self.places.get(name)
        return p[-1] if p else -1

    def barrier(self) -> int:
        """The place of the innermost open element of _BARRIER."""
        return self.barriers[-1] if self.barriers else -1

    def close(self, place: int) -> None:
        ends, stack, names = self.pages.columns["end"], self.stack, self.names
        while len(stack) > place:
            tag = names.pop()
            self.places[tag].pop()
            if tag in _BARRIER:
                self.barriers.pop()
            self.numbers.pop()
            if (at := stack.pop()) >= 0:
                ends[at] = self.length
            if tag in BLOCKS:
                self.parts.append("\n")
                self.length += 1

    def open(self, tag: str, attrs: dict[str, str]) -> bool:
        """Whether what follows isn't markup."""
        ends_paragraph, closes, breaks, void, barrier, raw = _KNOWN.get(tag, _OTHER)
        if ends_paragraph and (p := self.places.get("p")) and p[-1] > self.barrier():
            self.close(p[-1])
        if closes:
            places, first = self.places, -1
            floor = self.last("table") if tag in _TABLE else self.barrier()
            for n in WITHIN.get(tag, ()):
                if (p := places.get(n)) and p[-1] > floor:
                    floor = p[-1]
            for n in CLOSES[tag]:
                # places rise, so those above the floor are the last ones
                if (p := places.get(n)) and p[-1] > floor and ((at := p[bisect_right(p, floor)]) < first or first < 0):
                    first = at
            if first >= 0:
                self.close(first)
        if breaks:
            self.parts.append("\n")
            self.length += 1
        pages, depth, length, at = self.pages, len(self.stack), self.length, -1
        if not (wanted := pages.wanted) or tag in wanted[0] or not wanted[1].isdisjoint(attrs):
            node, parent, depths, tags, paths, begins, ends = pages.columns.values()
            path = None if wanted else tag
            if depth and not wanted:
                path = f"{paths[self.stack[-1]]}/{tag}" if depth <= PATH else "/".join([*self.names[-PATH:], tag])
            at = len(node)
            node.append(self.count)
            parent.append(self.numbers[-1] if depth else -1)
            depths.append(depth)
            tags.append(tag)
            paths.append(path)
            begins.append(length)
            ends.append(length)
            if attrs:
                pages.keys.extend(attrs)
                pages.values.extend(attrs.values())
            pages.attrs.append(len(pages.keys))
        if not void:
            self.places.setdefault(tag, []).append(depth)
            if barrier:
                self.barriers.append(depth)
            self.stack.append(at)
            self.numbers.append(self.count)
            self.names.append(tag)
        self.count += 1
        return raw

    def end(self, tag: str) -> None:
        p = self.places.get(tag)
        if p and (tag in _TABLE or p[-1] > self.barrier()):
            self.close(p[-1])

    def read(self, raw: str) -> str:
        """The text of a page, whose elements go to the columns. Time is linear in its length."""
        at, quotes, token = 0, max(raw.rfind('"'), raw.rfind("'")), _TOKEN.match
        while at < len(raw):
            if m := token(raw, at):
                text, closing, tag, pairs = m.groups()
                at = m.end()
                if text:
                    self.add(_html.unescape(text) if "&" in text else text)
                if closing:
                    self.end(closing.lower())
                    continue
                tag, attrs = tag.lower(), {}
                for name, value in _PAIR.findall(pairs) if pairs else ():
                    attrs.setdefault(name.lower(), _html.unescape(value) if "&" in value else value)
            else:
                sign = raw.find("<", at)
                if sign < 0:
                    sign = len(raw)
                if sign > at:
                    self.add(_html.unescape(raw[at:sign]))
                at = sign
                if at >= len(raw):
                    break
                if raw.startswith("<!--", at):
                    close = raw.find("-->", at + 4)
                    at = len(raw) if close < 0 else close + 3
                    continue
                if raw.startswith(("<!", "<?"), at):
                    close = raw.find(">", at)
                    at = len(raw) if close < 0 else close + 1
                    continue
                if raw.startswith("</", at) and (m := _NAME.match(raw, at + 2)):  # without an end
                    at = len(raw)
                    self.end(m[0].lower())
                    continue
                if not (m := _NAME.match(raw, at + 1)):
                    self.add("<")
                    at += 1
                    continue
                tag = m[0].lower()
                attrs, at = _attributes(raw, m.end(), quotes)
            if self.open(tag, attrs):
                m = re.compile(f"</{re.escape(tag)}[\\s/>]", re.I).search(raw, at)
                close = m.start() if m else len(raw)
                if tag not in HIDDEN:
                    self.add(_html.unescape(raw[at:close]))
                at = close
        self.close(0)
        return "".join(self.parts)


def _attributes(raw: str, at: int, quotes: int) -> tuple[dict[str, str], int]:
    """The attributes from a place on, the first of each name, and the place behind the tag."""
    found: dict[str, str] = {}
    while at < len(raw):
        m = (_ATTR if at < quotes else _PLAIN).match(raw, at)
        if m is None:
            close = raw.find(">", at)
            gap = raw[at : close if close >= 0 else len(raw)]
            if close < 0 or not gap.strip("/ \t\r\n\f\"'"):
                return found, len(raw) if close < 0 else close + 1
            at += 1
            continue
        value = next((g for g in m.groups()[1:] if g is not None), "")
        found.setdefault(m[1].lower(), _html.unescape(value) if "&" in value else value)
        at = m.end()
    return found, at


def read(raw: str) -> tuple[str, list[dict]]:
    """The text and the elements of a page."""
    pages = _Pages()
    pages.add(raw)
    return pages.texts[0], pages.nodes()


#: Characters of pages that are trees in memory at a time, and pages at most.
SLICE_CHARS, SLICE_PAGES = 1 << 18, 256


def slices(pages: Iterable[str | None], chars: int = SLICE_CHARS, most: int = SLICE_PAGES) -> Iterator[list[str | None]]:
    """Pages in order, a few at a time: a slice ends with the page that fills it."""
    held, n = [], 0
    for raw in pages:
        held.append(raw)
        n += len(raw or "")
        if n >= chars or len(held) >= most:
            yield held
            held, n = [], 0
    if held:
        yield held


def _trees(pages: Iterable[str | None], wanted: tuple[frozenset[str], frozenset[str]] | None = None) -> pa.Array:
    read_ = _Pages(wanted)
    for raw in pages:
        read_.add(raw)
    return read_.arrow()


def _tree(wanted: tuple[frozenset[str], frozenset[str]] | None = None):
    def run(html: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in html:
            for part in slices(raw.as_py() for raw in batch):
                yield _trees(part, wanted)

    run.__annotations__ = {"html": Iterator[pa.Array], "return": Iterator[pa.Array]}
    # as one that isn't deterministic, so that filters on what is read from a tree don't make it a second time
    return F.arrow_udf(run, TREE).asNondeterministic()


#: A page as (text, nodes): its elements in order with parent, depth, path, attributes and span of the text.
#: Trees leave in slices of their own, so that memory follows a page and not how many Spark sends at once.
tree = _tree()


def tree_of(tags: Iterable[str], attrs: Iterable[str]):
    """A tree() of the elements with one of some tags or attributes, without their paths; what is left out takes no time later."""
    return _tree((frozenset(tags), frozenset(attrs)))


def lines(text: Column) -> Column:
    """A text with single blanks, trimmed lines and no empty ones."""
    t = F.regexp_replace(text, r"[ \t\r\f\x{00a0}]+", " ")
    return F.btrim(F.regexp_replace(F.regexp_replace(t, r" ?\n ?", "\n"), r"\n\n+", "\n"), F.lit(" \n"))


def inner_text(page: Column, node: Column) -> Column:
    """The text of an element, with a line for each block in it."""
    return lines(F.substring(page["text"], node["begin"] + 1, node["end"] - node["begin"]))


def page_text(page: Column) -> Column:
    """The text of a whole page."""
    return lines(page["text"])


def attr(node: Column, name: str) -> Column:
    return node["attrs"][name]


def has_class(node: Column, name: str) -> Column:
    return F.coalesce(F.array_contains(F.split(attr(node, "class"), r"\s+"), name), F.lit(False))


def pick(page: Column, condition) -> Column:
    """The elements that meet a condition, in order."""
    return F.filter(page["nodes"], condition)


def within(nodes: Column, outer: Column) -> Column:
    """Those of some elements that begin within another one's span of text, itself excluded."""
    return F.filter(nodes, lambda n: (n["begin"] >= outer["begin"]) & (n["end"] <= outer["end"]) & (n["node"] > outer["node"]) & (n["depth"] > outer["depth"]))
