"""Reading of list pages and posts, of fields in texts, and of boards. Native but for decoding of bytes; patterns and labels are the caller's."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions import clean, markup


def _let(value: Column, f) -> Column:
    """f(value) with the value computed once, as a lambda's variable."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _some(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def first_of(items: Column, key: str) -> Column:
    """An array of structs with the first of each key only; arrays are those of one page or text."""
    return _let(items, lambda xs: _let(F.transform(xs, lambda x: x[key]), lambda keys: F.filter(xs, lambda x, i: F.array_position(keys, x[key]) == i + 1)))


@F.pandas_udf(T.StringType())
def decoded(content: pd.Series) -> pd.Series:
    """Bytes as text: UTF-8 with or without a mark, else GBK, else Latin-1, which always fits."""

    def one(raw: bytes) -> str:
        for name in ("utf-8-sig", "gbk"):
            try:
                return raw.decode(name)
            except UnicodeDecodeError:
                continue
        return raw.decode("latin-1")

    return content.map(one, na_action="ignore")


def list_rows(html: Column, normal: str = "normalthread_", sticky: str = "stickthread_", skip_sticky: bool = False) -> Column:
    """The rows of a list page as an array of (tid, sticky, url, title, posted), the first of each number.

    A row is a `tbody` whose id has one of two marks and a number; its first link to a thread gives address and title.
    """
    parts = F.regexp_extract_all(html, F.lit(rf'(?is)(<tbody[^<>]*\sid="(?:{normal}|{sticky})\d+".*?</tbody>)'), F.lit(1))

    def row(p: Column) -> Column:
        link = r'(?is)<a\b[^<>]*href="([^"]*(?:thread-|mod=viewthread)[^"]*)"[^<>]*>(.*?)</a>'
        return F.struct(
            F.regexp_extract(p, rf'id="(?:{normal}|{sticky})(\d+)"', 1).try_cast("bigint").alias("tid"),
            p.rlike(rf'(?i)^<tbody[^<>]*id="{sticky}').alias("sticky"),
            F.replace(F.regexp_extract(p, link, 1), F.lit("&amp;"), F.lit("&")).alias("url"),
            clean.html_text(F.regexp_extract(p, link, 2)).alias("title"),
            _some(F.regexp_extract(p, r"(?is)<em[^<>]*>\s*(\d{4}-\d{1,2}-\d{1,2})", 1)).alias("posted"),
        )

    rows = F.filter(F.transform(parts, row), lambda x: (x["title"] != "") & (~x["sticky"] if skip_sticky else F.lit(True)))
    return first_of(rows, "tid")


def anchor_rows(html: Column, page: str = "read.php", skip: tuple[str, ...] = ()) -> Column:
    """The links of a list page to some page with a `tid=`: an array of (tid, url, title), the first of each number; short and listed titles go."""
    parts = F.regexp_extract_all(html, F.lit(rf'(?is)(<a\b[^<>]*href="[^"]*{page}[^"]*[?&](?:amp;)?tid=\d+[^"]*"[^<>]*>.*?</a>)'), F.lit(1))

    def row(p: Column) -> Column:
        url = F.replace(F.regexp_extract(p, r'(?is)href="([^"#]*)', 1), F.lit("&amp;"), F.lit("&"))
        return F.struct(F.regexp_extract(url, r"[?&]tid=(\d+)", 1).try_cast("bigint").alias("tid"), url.alias("url"), clean.html_text(F.regexp_extract(p, r"(?is)>(.*)</a>$", 1)).alias("title"))

    rows = F.filter(F.transform(parts, row), lambda x: (F.length(x["title"]) >= 2) & ~x["title"].isin(*skip) if skip else F.length(x["title"]) >= 2)
    return first_of(rows, "tid")


#: How the markup of a thread page names its parts.
SUBJECT_ID, POST_ID, MESSAGE_ID, AUTHOR_CLASS, CODE_CLASS = "thread_subject", r"^post_\d+$", r"^postmessage_(\d+)$", "xi2", "blockcode"
#: Trees of what the functions below look at in thread pages, and of what posts() does.
thread_tree, post_tree = markup.tree_of(("title", "td", "th", "a", "img"), ("id", "class", "href")), markup.tree_of((), ("id", "class"))


def _first(nodes: Column) -> Column:
    return F.get(nodes, F.lit(0))


def thread_title(page: Column) -> Column:
    """The text of the element with the id of a subject, else of `<title>` up to its first ` - `."""
    text = lambda condition: _let(_first(markup.pick(page, condition)), lambda n: markup.inner_text(page, n))
    subject, title = text(lambda n: markup.attr(n, "id") == SUBJECT_ID), text(lambda n: n["tag"] == "title")
    return F.coalesce(_let(subject, _some), F.split_part(title, F.lit(" - "), F.lit(1)))


def messages(page: Column) -> Column:
    """The elements that hold what was said."""
    return markup.pick(page, lambda n: markup.attr(n, "id").rlike(MESSAGE_ID))


def posts(page: Column, most: int | None = None) -> Column:
    """The posts of a thread page as an array of (pid, floor, author, content, begin, end); posts without text are none.

    A post is an element with its own message and author somewhere in it, whatever tables or lists these hold. begin
    and end are places in the page's text. most cuts contents.
    """

    def parts(inside: Column) -> Column:
        message = _first(F.filter(inside, lambda n: markup.attr(n, "id").rlike(MESSAGE_ID)))
        return F.struct(message.alias("message"), _first(F.filter(inside, lambda n: markup.has_class(n, AUTHOR_CLASS))).alias("author"))

    def said(x: Column) -> Column:
        text, m = markup.inner_text(page, x["message"]), x["message"]
        return F.struct(F.regexp_extract(markup.attr(m, "id"), MESSAGE_ID, 1).alias("pid"), F.coalesce(markup.inner_text(page, x["author"]), F.lit("")).alias("author"), (F.left(text, F.lit(most)) if most else text).alias("content"), m["begin"].alias("begin"), m["end"].alias("end"))

    # only these elements matter below, so that each post looks through few
    marked = F.filter(page["nodes"], lambda n: F.coalesce(markup.attr(n, "id").rlike(rf"{POST_ID}|{MESSAGE_ID}"), F.lit(False)) | markup.has_class(n, AUTHOR_CLASS))
    post = lambda nodes: F.transform(F.filter(nodes, lambda n: markup.attr(n, "id").rlike(POST_ID)), lambda head: _let(markup.within(nodes, head), parts))
    found = F.transform(_let(marked, post), said)
    filled = F.filter(found, lambda x: x["content"] != "")
    return F.transform(filled, lambda x, i: F.struct(x["pid"].alias("pid"), (i + 1).alias("floor"), x["author"].alias("author"), x["content"].alias("content"), x["begin"].alias("begin"), x["end"].alias("end")))


def author_posts(found: Column, most: int | None = None) -> Column:
    """Of posts() those by the author of the first: all, or at most so many."""
    own = _let(found, lambda ps: F.filter(ps, lambda p: p["author"] == F.get(ps, F.lit(0))["author"]))
    return own if most is None else F.slice(own, 1, most)


def corpus(bodies: Column, attached: Column, link: str) -> Column:
    """The text in which links are looked for: attachments if any has a link, else bodies and attachments, a line each."""
    has = F.exists(attached, lambda a: a.rlike(link))
    return F.array_join(F.when(has, attached).otherwise(F.concat(bodies, attached)), "\n")


def code_blocks(page: Column, mark: str = CODE_CLASS) -> Column:
    """The texts of code blocks of a page."""
    return F.filter(F.transform(markup.pick(page, lambda n: markup.has_class(n, mark)), lambda n: markup.inner_text(page, n)), lambda t: t != "")


def table_fields(page: Column) -> Column:
    """The rows of tables that begin with a heading as an array of (label, value), in order."""
    def pairs(cells: Column) -> Column:
        def behind(h: Column, i: Column) -> Column:
            """The first cell of the row behind a heading: mostly the next one; others are looked for."""
            after, others = F.get(cells, i + 1), F.filter(cells, lambda c: (c["tag"] == "td") & (c["parent"] == h["parent"]) & (c["node"] > h["node"]))
            return _let(after, lambda c: F.when((c["tag"] == "td") & (c["parent"] == h["parent"]), c).otherwise(_first(others)))

        pair = lambda h, i: F.when(h["tag"] == "th", F.struct(markup.inner_text(page, h).alias("label"), _let(behind(h, i), lambda c: markup.inner_text(page, c)).alias("value")))
        return F.transform(cells, pair)

    return F.filter(_let(markup.pick(page, lambda n: n["tag"].isin("th", "td")), pairs), lambda x: (x["label"] != "") & (x["value"] != ""))


def attachments(page: Column, wanted: str | None = None, unwanted: str | None = None) -> Column:
    """Links to attachments as an array of (aid, name), the first of each number; names may have to match one expression and not another."""
    found = markup.pick(page, lambda n: (n["tag"] == "a") & markup.attr(n, "href").rlike(r"aid=\w+"))
    named = F.transform(found, lambda n: F.struct(F.regexp_extract(markup.attr(n, "href"), r"aid=(\w+)", 1).alias("aid"), markup.inner_text(page, n).alias("name")))
    ok = lambda x: (x["name"].rlike(wanted) if wanted else F.lit(True)) & (~x["name"].rlike(unwanted) if unwanted else F.lit(True))
    return first_of(F.filter(named, ok), "aid")


def absolute(url: Column, base: Column) -> Column:
    """An address as seen from another: with its scheme, from its root, or beside it."""
    root, beside = F.regexp_extract(base, r"^([a-z]+://[^/?#]+)", 1), F.regexp_extract(base, r"^([a-z]+://[^/?#]+(?:/[^?#]*/|/)?)", 1)
    here = F.when(beside.endswith("/"), beside).otherwise(F.concat(beside, F.lit("/")))
    return _let(url, lambda url: F.when(url.rlike(r"^[a-z][a-z0-9+.-]*:"), url).when(url.startswith("//"), F.concat(F.regexp_extract(base, r"^([a-z]+:)", 1), url)).when(url.startswith("/"), F.concat(root, url)).otherwise(F.concat(here, F.regexp_replace(url, r"^(\./)+", ""))))


def images(page: Column, base: Column, sources: tuple[str, ...] = ("zoomfile", "file", "data-original", "src"), noise: str | None = None, most: int = 6) -> Column:
    """Addresses of images, each once: those within messages first, then others, in order; at most so many.

    The first filled attribute of sources counts; addresses that match noise go.
    """
    def seen(said: Column) -> Column:
        one = lambda n: F.struct(
            (~F.exists(said, lambda m: (n["begin"] >= m["begin"]) & (n["end"] <= m["end"]) & (n["depth"] > m["depth"]))).alias("outside"), n["node"].alias("node"), absolute(F.btrim(F.coalesce(*[_some(markup.attr(n, a)) for a in sources], F.lit(""))), base).alias("url")
        )
        return F.transform(markup.pick(page, lambda n: (n["tag"] == "img") & F.coalesce(*[_some(markup.attr(n, a)) for a in sources]).isNotNull()), one)

    found = F.array_sort(_let(F.transform(messages(page), lambda m: F.struct(m["begin"].alias("begin"), m["end"].alias("end"), m["depth"].alias("depth"))), seen))
    clear = F.filter(found, lambda x: ~x["url"].rlike(noise)) if noise else found
    return F.slice(F.array_distinct(F.transform(clear, lambda x: x["url"])), 1, most)


def query_ids(page: Column, name: str) -> Column:
    """The numbers that links of a page give for a name, as in `fid=7` or `typeid=3`, in order."""
    links = markup.pick(page, lambda n: markup.attr(n, "href").rlike(rf"(?:^|[?&;]){name}[=-]\d+"))
    return F.transform(links, lambda n: F.regexp_extract(markup.attr(n, "href"), rf"(?:^|[?&;]){name}[=-](\d+)", 1))


def board_meta(page: Column, preferred: tuple[str, ...], fallback: Column) -> Column:
    """(board, type) of a page: the first preferred board that it links to, else its first one, else a fallback; and the first type."""
    boards, kinds = query_ids(page, "fid"), query_ids(page, "(?:filter=typeid&)?typeid")
    board = _let(boards, lambda xs: F.coalesce(_first(F.filter(xs, lambda x: x.isin(*preferred))), _first(xs)))
    return F.struct(F.coalesce(board, fallback).alias("board"), _first(kinds).alias("type"))


def posted_at(html: Column, labels: tuple[str, ...] = ("发表于", "posted at")) -> Column:
    """The date and time behind a label, in a text or in the title of what follows it."""
    found = F.regexp_extract(html, "(?is)(?:" + "|".join(labels) + r')\s*(?:<span[^<>]*title=")?(\d{4}-\d{1,2}-\d{1,2}(?:\s+\d{1,2}:\d{2}(?::\d{2})?)?)', 1)
    return F.coalesce(F.try_to_timestamp(found, F.lit("y-M-d H:m:s")), F.try_to_timestamp(found, F.lit("y-M-d H:m")), F.try_to_timestamp(found, F.lit("y-M-d")))


def board_id(html: Column, preferred: tuple[str, ...], fallback: Column) -> Column:
    """The number of a page's board: the first in it that is preferred, else its first, else a fallback."""
    found = F.regexp_extract_all(html, F.lit(r"\bfid[=-](\d+)"), F.lit(1))
    listed = F.filter(found, lambda x: x.isin(*preferred))
    return F.coalesce(F.get(listed, F.lit(0)), F.get(found, F.lit(0)), fallback)


#: The pairs of brackets around labels.
BRACKETS = ("【】", "［］", "[]", "〖〗", "『』", "「」")


def cards(text: Column, longest: int = 12) -> Column:
    """The labelled fields of a text as an array of (label, value), in order, repeated ones too.

    A label stands in any of BRACKETS at the beginning of a line and has at most so many characters; its value goes
    on to the next label, over several lines.
    """
    heads = "|".join(rf"\{a}[^\{a}\{b}\n]{{1,{longest}}}\{b}" for a, b in BRACKETS)
    parts = F.regexp_extract_all(F.concat(F.lit("\n"), text), F.lit(rf"(?s)\n\s*((?:{heads})(?:(?!\n\s*(?:{heads})).)*+)"), F.lit(1))

    def card(p: Column) -> Column:
        value = F.regexp_replace(F.regexp_replace(p, rf"^(?:{heads})\s*[:：]?", ""), r"[ \t]*\n\s*", "\n")
        return F.struct(clean.join_spaced_han(F.btrim(F.regexp_extract(p, rf"^.([^\n]{{1,{longest}}}?)[】］\]〗』」]", 1))).alias("label"), F.regexp_replace(value, r"^\s+|\s+$", "").alias("value"))

    return F.transform(parts, card)


def metadata(found: Column, aliases: dict[str, str], exclusive: tuple[tuple[str, ...], ...] = (), most: int = 200) -> Column:
    """cards() as a map: labels by their aliases, the first filled value of each, cut to so many characters.

    Of an exclusive group of labels only the first that is there, in the order of the group, is kept.
    """
    alias = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]) if aliases else None
    named = F.transform(found, lambda x: F.struct((F.coalesce(alias[x["label"]], x["label"]) if aliases else x["label"]).alias("label"), F.left(x["value"], F.lit(most)).alias("value")))
    once = first_of(F.filter(named, lambda x: x["value"] != ""), "label")

    def without(items: Column, labels: Column, group: tuple[str, ...], i: int) -> Column:
        earlier = F.arrays_overlap(labels, F.array(*[F.lit(g) for g in group[:i]]))
        return F.filter(items, lambda x: ~((x["label"] == group[i]) & earlier))

    def kept(items: Column) -> Column:
        labels, out = F.transform(items, lambda x: x["label"]), items
        for group in exclusive:
            for i in range(1, len(group)):
                out = without(out, labels, group, i)
        return out

    return F.map_from_entries(_let(once, kept))


def password(text: Column, patterns: list[str], most: int = 40) -> Column:
    """What the first pattern of a list that matches gives as its group, trimmed and cut; null if none does."""
    return F.coalesce(*[F.left(_some(F.btrim(F.regexp_extract(text, p, 1))), F.lit(most)) for p in patterns])


def share_links(text: Column, hosts: tuple[str, ...], code: str, before: int = 80, after: int = 200) -> Column:
    """Links to shared folders as an array of (host, id, password), the first of each; without one in the link, the code near it, else any.

    code: an expression whose group is an access code.
    """
    host = "|".join(h.replace(".", r"\.") for h in hosts)
    link = rf"https?://(?:www\.)?(?:{host})/s/\w+(?:\?[\w=&-]*)?"
    found = F.regexp_extract_all(text, F.lit(rf"(?is)((?:.{{0,{before}}}?){link}(?=(.{{0,{after}}})))"), F.lit(1))
    near = F.regexp_extract_all(text, F.lit(rf"(?is)(?:.{{0,{before}}}?){link}(?=(.{{0,{after}}}))"), F.lit(1))

    def share(p: Column, i: Column) -> Column:
        here = F.regexp_extract(p, rf"(?is)({link})$", 1)
        own = F.regexp_extract(here, r"(?i)[?&](?:password|pwd|passwd)=([^&]+)", 1)
        around = F.concat(p, F.lit(" "), F.get(near, i))
        secret = F.coalesce(_some(own), _some(F.regexp_extract(around, code, 1)), _some(F.regexp_extract(text, code, 1)), F.lit(""))
        return F.struct(F.lower(F.regexp_extract(here, rf"(?i)({host})/s/", 1)).alias("host"), F.regexp_extract(here, r"/s/(\w+)", 1).alias("id"), secret.alias("password"))

    return first_of(F.transform(found, share), "id")


def link_counts(text: Column, link: str) -> tuple[Column, Column]:
    """How many links a text has, and how many different ones, whatever their case."""
    found = F.regexp_extract_all(text, F.lit(f"({link})"), F.lit(1))
    return F.size(found), F.size(F.array_distinct(F.transform(found, lambda x: F.lower(x))))
