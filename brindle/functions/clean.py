"""Cleaning and reading of texts: markup, names, labelled fields, dates, sizes, scripts, ordered rules."""

from __future__ import annotations

import html as _html
from collections.abc import Iterable
from functools import reduce
from html import entities as _entities

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions.text import let


@F.pandas_udf(T.StringType())
def unescape(text: pd.Series) -> pd.Series:
    """Named and numbered entities as characters, which no built-in function knows."""
    return text.map(_html.unescape, na_action="ignore")


def unescape_named(text: Column, names: Iterable[str]) -> Column:
    """Some named entities as characters, one after the other; others, and those without their semicolon, stay."""
    return reduce(lambda t, n: F.replace(t, F.lit(f"&{n};"), F.lit(_entities.html5[f"{n};"])), names, text)


@F.pandas_udf(T.StringType())
def decode_email(code: pd.Series) -> pd.Series:
    """An address hidden as hex, each byte combined with the first by exclusive or; null if it isn't one."""

    def one(h: str) -> str | None:
        try:
            b = bytes.fromhex(h)
            return bytes(x ^ b[0] for x in b[1:]).decode() if len(b) > 1 else None
        except ValueError:
            return None

    return code.map(one, na_action="ignore")


@F.pandas_udf(T.DoubleType())
def word_similarity(query: pd.Series, text: pd.Series) -> pd.Series:
    """The best share of common trigrams of a query and any run of a text's trigrams; 0 if there are none.

    A run of e distinct trigrams shares at most the query's q of them, so that its share is at most q / e: runs from a
    place end where that no longer beats what was found. A best run starts at a common trigram.
    """
    import re

    word, asked = re.compile(r"[^\W_]+"), {}

    def grams(s: str) -> list[str]:
        return [p[i : i + 3] for w in word.findall(s.lower()) for p in ["  " + w + " "] for i in range(len(p) - 2)]

    def one(q: str | None, t: str | None) -> float | None:
        if q is None or t is None:
            return None
        if q not in asked:
            asked[q] = set(grams(q))
        wanted, seq, best = asked[q], grams(t), 0.0
        size, at = len(wanted), [i for i, g in enumerate(seq) if g in wanted]
        for n, i in enumerate(at):
            if best >= 1:
                break
            if n and at[n - 1] == i - 1 and seq[i] == seq[i - 1]:
                continue
            seen, hit, last, most = set(), 0, i, size / best if best else float("inf")
            for j in at[n:]:
                seen.update(seq[last : j + 1])
                last = j + 1
                if len(seen) >= most:
                    break
                hit = len(seen & wanted)
                share = hit / (size + len(seen) - hit)
                if share > best:
                    best, most = share, size / share
                if hit == size:
                    break  # longer runs only add other trigrams
        return best

    return pd.Series([one(q, t) for q, t in zip(query, text)], dtype="float64")


def html_text(html: Column) -> Column:
    """Text of a page: no scripts and styles, a line for each block, single spaces, no blank lines; entities stay."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?i)<(?:br|hr|/?(?:p|div|li|ul|ol|tr|table|h[1-6]|article|section|header|footer|nav|title|head|body))\b[^>]*>", "\n")
    t = F.regexp_replace(F.regexp_replace(t, r"<[^>]+>", " "), r"[ \t\r\f]+", " ")
    return F.btrim(F.regexp_replace(F.regexp_replace(t, r" ?\n ?", "\n"), r"\n\n+", "\n"), F.lit(" \n"))


def name_key(name: Column) -> Column:
    """A name for comparing: no tags, variation selectors and white space, full-width signs as plain ones, lower case."""
    t = F.regexp_replace(F.regexp_replace(name, r"<[^>]+>", ""), r"[\x{FE00}-\x{FE0F}]", "")
    return F.lower(F.regexp_replace(F.translate(t, "：＆　", ":& "), r"\s+", ""))


def join_spaced_han(text: Column) -> Column:
    """Han characters set apart by up to 64 blanks or dots come together."""
    return F.regexp_replace(text, r"(?<=\p{IsHan})[\s·.…]{1,64}(?=\p{IsHan})", "")


def code(text: Column) -> Column:
    """A code in upper case with single dashes for blanks and underlines."""
    return F.regexp_replace(F.upper(F.btrim(text)), r"[\s_-]+", "-")


def highlight(text: Column, words: list[str], before: str = "<b>", after: str = "</b>") -> Column:
    """A text with each of some words between marks, whatever its case."""
    import re

    found = "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True) if w)
    return F.regexp_replace(text, f"(?i)({found})", f"{before}$1{after}") if found else text


def first_rule(text: Column, rules: list[tuple[str, str]], default: Column) -> Column:
    """The name of the first (regular expression, name) that a text matches: outcomes, levels, titles, roles, labels."""
    out = F
    for pattern, name in rules:
        out = out.when(text.rlike(pattern), name)
    return out.otherwise(default) if rules else default


#: Scripts in the order in which they decide; fixed values are the names of Unicode scripts.
SCRIPTS = [("han", r"\p{IsHan}"), ("kana", r"[\p{IsHiragana}\p{IsKatakana}]"), ("hangul", r"\p{IsHangul}"), ("latin", r"[A-Za-z]")]


def script(text: Column) -> Column:
    """kana before han, as Japanese texts hold both."""
    return first_rule(text, [(p, n) for n, p in (SCRIPTS[1], SCRIPTS[0], *SCRIPTS[2:])], F.lit("other"))


def fields(text: Column) -> Column:
    """Lines `【label】value` of a text as an array of (label, value), the first of each label, in order."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.btrim(x)), lambda x: x.rlike(r"^【[^】]{1,12}】"))
    found = F.transform(lines, lambda x: F.struct(F.btrim(F.regexp_extract(x, r"^【([^】]+)】", 1)).alias("label"), F.btrim(F.regexp_replace(x, r"^【[^】]+】[:：]?", "")).alias("value")))
    return _first_labels(found)


def _first_labels(found: Column) -> Column:
    """Fields with the first of each label only."""
    return let(found, lambda fs: let(F.transform(fs, lambda x: x["label"]), lambda labels: F.filter(fs, lambda x, i: F.array_position(labels, x["label"]) == i + 1)))


def ordered_fields(found: Column, aliases: dict[str, str], preferred: list[str]) -> Column:
    """Fields with aliases of labels resolved, preferred labels first, others in their order; the first of each label."""
    named = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]) if aliases else None
    clear = F.transform(found, lambda x: F.struct(F.coalesce(named[x["label"]], x["label"]).alias("label") if aliases else x["label"].alias("label"), x["value"].alias("value")))
    once = _first_labels(clear)
    place = lambda x: F.array_position(F.array(*[F.lit(p) for p in preferred]).cast("array<string>"), x["label"])
    ranked = F.array_sort(F.transform(once, lambda x, i: F.struct(F.when(place(x) > 0, place(x)).otherwise(10**6).alias("p"), i.alias("i"), x.alias("x"))))
    return F.transform(ranked, lambda x: x["x"])


def _rounded(size: Column, unit: int, digits: int, even: bool) -> Column:
    """A whole number of bytes over a unit with some digits after the point, in whole numbers; halves go to even digits or up.

    Bytes count as what a double holds of them, which is all of them below 2^53.
    """
    n, scale = F.abs(size.cast("double").cast("long")), 10**digits
    div = lambda a, b: F.call_function("div", a, F.lit(b))
    rest = n % unit * scale
    cut, over = div(rest, unit), rest % unit * 2
    up = (over > unit) | ((over == unit) & ((cut % 2 == 1) if even else F.lit(True)))
    parts = div(n, unit) * scale + cut + up.cast("long")
    whole, tail = div(parts, scale).cast("string"), F.lpad((parts % scale).cast("string"), digits, "0")
    return F.concat(F.when(size < 0, "-").otherwise(""), whole, F.lit("."), tail)


def format_bytes(size: Column, largest: str = "TB") -> Column:
    """Two digits after the point in the largest unit that fits, up to `largest`; halves go to even digits."""
    units = ("B", "KB", "MB", "GB", "TB")
    out = F.when(F.coalesce(size, F.lit(0)) <= 0, "0 B")
    for i, unit in reversed(list(enumerate(units[: units.index(largest) + 1]))):
        out = out.when(size >= 1024**i, F.concat(_rounded(size, 1024**i, 2, True) if i else size.cast("string"), F.lit(f" {unit}")))
    return out


def trusted_size(size: Column, link_size: Column) -> Column:
    """A stated size unless it is 0, over 32 TiB, or over 8 times and 2 GiB more than the link's own."""
    off = (F.coalesce(size, F.lit(0)) <= 0) | (size > 32 * 1024**4) | ((link_size > 0) & (size > 8 * link_size) & (size > link_size + 2 * 1024**3))
    return F.when(off, link_size).otherwise(size)


def count_matches(found: Column, expected: Column) -> Column:
    """As many as expected, or from 20 on short by at most the greater of 2 and 5 %."""
    return (found >= expected) | ((expected >= 20) & (expected - found <= F.greatest(F.lit(2.0), expected * 0.05)))


def greatest_count(text: Column, mark: str, least: int, most: int) -> Column:
    """The greatest number before a mark within limits, thousands set off by commas or not; null if there is none."""
    found = F.transform(F.regexp_extract_all(text, F.lit(rf"(?i)(?<![A-Za-z0-9.-])(\d{{1,3}}(?:,\d{{3}})+|\d+)\s*{mark}(?![A-Za-z0-9])"), F.lit(1)), lambda x: F.regexp_replace(x, ",", "").try_cast("bigint"))
    return F.array_max(F.filter(found, lambda x: x.between(least, most)))


def listed_at(text: Column, now: Column) -> Column:
    """A time written as minutes, hours or days ago, yesterday, the day before, or a date; null if unreadable."""
    t = F.btrim(text)
    clock = F.coalesce(F.nullif(F.regexp_extract(t, r"(\d{1,2}:\d{2})$", 1), F.lit("")), F.lit("00:00"))
    at = lambda back: F.try_to_timestamp(F.concat(F.date_format(F.date_sub(F.to_date(now), back), "yyyy-MM-dd "), F.lpad(clock, 5, "0")), F.lit("yyyy-MM-dd HH:mm"))
    n = F.regexp_extract(t, r"^(\d+)", 1).try_cast("int")
    ago = F.when(t.rlike(r"^\d+\s*(分钟前|min)"), now - F.make_dt_interval(mins=n)).when(t.rlike(r"^\d+\s*(小时前|hour)"), now - F.make_dt_interval(hours=n)).when(t.rlike(r"^\d+\s*(天前|day)"), now - F.make_dt_interval(days=n))
    day = F.when(t.rlike("^(刚刚|just now)"), now).when(t.rlike("^(今天|today)"), at(0)).when(t.rlike("^(昨天|yesterday)"), at(1)).when(t.rlike("^前天"), at(2))
    return F.coalesce(ago, day, F.try_to_timestamp(F.regexp_extract(t, r"(\d{4}-\d{1,2}-\d{1,2})", 1), F.lit("y-M-d")))


def search_string(parts: list[Column]) -> Column:
    """The distinct filled parts in order, as one text."""
    trimmed = F.transform(F.array(*parts), lambda x: F.btrim(x))
    return F.array_join(F.array_distinct(F.filter(trimmed, lambda x: x.isNotNull() & (x != ""))), " ")


def joined_line(parts: list[Column], separator: str = " · ") -> Column:
    """The filled parts in order with separators between them."""
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), separator)


def tier(value: Column, limits: list[tuple[float, str]], last: str) -> Column:
    """The name of the first limit that a value is below."""
    out = F
    for limit, name in limits:
        out = out.when(value < limit, name)
    return out.otherwise(last)


def old_enough_on(posted: Column, days: int) -> Column:
    """The day from which an item is so many days old."""
    return F.date_add(F.to_date(posted), days)


def parse_seconds(size: Column, links: Column, base: int, per: int, each: int, least: int, most: int) -> Column:
    """Seconds for reading a page: a base, one for so many characters, some for each link, within limits."""
    return F.least(F.lit(most), F.greatest(F.lit(least), F.lit(base) + F.floor(size / per) + links * each)).cast("long")


def is_heavy(size: Column, links: Column, most_chars: int, most_links: int) -> Column:
    return (size > most_chars) | (links > most_links)


def match_score(titles: Column, wanted: Column, popularity: Column, equal: int = 1000, within: int = 300) -> Column:
    """popularity, and for the best of some titles more if it and the wanted one are equal, or one is in the other, but for case and blanks."""
    plain = lambda c: F.regexp_replace(F.lower(c), r"\s+", "")
    w = plain(wanted)

    def bonus(t: Column) -> Column:
        p = plain(t)
        return F.when((p == "") | (w == ""), 0).when(p == w, equal).when(p.contains(w) | w.contains(p), within).otherwise(0)

    return popularity + F.coalesce(F.array_max(F.transform(titles, bonus)), F.lit(0))


def soft_cut(text: Column, most: int, separators: str = " ") -> Column:
    """A text of at most so many characters, cut at the last separator within them, if there is one."""
    head = F.left(text, F.lit(most))
    at = F.regexp_extract(head, f"(?s)^(.*)[{separators}]", 1)
    return F.when(F.length(text) <= most, text).otherwise(F.rtrim(F.when(at != "", at).otherwise(head)))


def repaired(text: Column, rules: list[tuple[str, str]]) -> Column:
    """A text after some replacements (regular expression, replacement), one after the other, trimmed."""
    for pattern, to in rules:
        text = F.regexp_replace(text, pattern, to)
    return F.btrim(text)


def spans(text: Column, label: str) -> Column:
    """The places of a plain label in a text as an array of (start, end), from 0."""
    parts = F.split(text, _quoted(label))
    ends = F.slice(parts, F.lit(1), F.size(parts) - 1)
    lengths = F.transform(ends, lambda p: F.length(p))
    starts = F.transform(lengths, lambda n, i: F.aggregate(F.slice(lengths, F.lit(1), i + 1), F.lit(0), lambda s, x: s + x) + i * len(label))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), (s + len(label)).alias("end")))


def _quoted(label: str) -> str:
    import re

    return re.escape(label)


def short_bytes(size: Column, largest: str = "GB") -> Column:
    """One digit after the point in the largest unit that fits, from KB to `largest`; halves go up."""
    units = ("KB", "MB", "GB")
    shown = lambda i: F.concat(_rounded(size, 1024 ** (i + 1), 1, False), F.lit(f" {units[i]}"))
    out = F
    for i in range(units.index(largest), 0, -1):
        out = out.when(size >= 1024 ** (i + 1), shown(i))
    return out.otherwise(shown(0)) if out is not F else shown(0)


def size_aligned(total: Column, told: Column, share: float) -> Column:
    """Whether a sum of sizes is off what is told by at most a share of it."""
    return F.abs(total - told) <= told * share


def size_echoes(size: Column, told: Column, share: float, least: float) -> Column:
    """Whether a single size is that of the whole, within a share or a least amount."""
    return F.abs(size - told) <= F.greatest(told * share, F.lit(float(least)))
