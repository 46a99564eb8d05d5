"""Native text functions: similarity, capacity, addresses, classification."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value computed once a row, as a lambda's variable, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def trigrams(text: Column) -> Column:
    """The distinct 3-grams of lower-cased words of letters and digits of any script, padded by two spaces before and one behind."""
    # a word said again has no new ones, and long texts say most words many times
    words = F.transform(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substr(w, i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams; 0 if there are none."""
    x, y = trigrams(a), trigrams(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(0.0))


def contains_all(text: Column, keywords: list[str]) -> Column:
    """Whether a text holds all keywords, whatever their case; their signs stand for themselves."""
    return reduce(lambda p, q: p & q, [text.ilike(f"%{like_escape(k)}%") for k in keywords])


def contains_any(columns: list[str], part: str) -> Column:
    return reduce(lambda p, q: p | q, [F.coalesce(F.col(c).cast("string"), F.lit("")).ilike(f"%{like_escape(part)}%") for c in columns])


def all_of(parts: list[Column | None]) -> Column:
    """All of some conditions; those that are None aren't asked for."""
    return reduce(lambda p, q: p & q, [p for p in parts if p is not None], F.lit(True))


def in_board(fid: Column, name: Column, fids: list[str] = (), names: list[str] = (), parents: list[str] = (), mark: str = " · ") -> Column:
    """Whether a row is of one of some boards: by id, by name (a dash counts as the mark), or below one of some parents."""
    spelled = [n.replace("-", mark) for n in names]
    return reduce(lambda p, q: p | q, [name.startswith(p + mark) | (name == p) for p in parents], fid.isin(*fids) | name.isin(*spelled))


def like_escape(part: str) -> str:
    """A text as a LIKE pattern that matches only itself."""
    return "".join("\\" + c if c in "\\%_" else c for c in part)


def code_numbers(code: Column) -> tuple[Column, Column]:
    """The first and the second number in a code, null where there is none; codes sort by these and then by text."""
    numbers = F.regexp_extract_all(code, F.lit("([0-9]+)"), F.lit(1))
    return F.get(numbers, F.lit(0)).try_cast("long"), F.get(numbers, F.lit(1)).try_cast("long")


def size_buckets(size: Column, edges: list[tuple[str, float | None, float | None]]) -> list[Column]:
    """A boolean for each (name, low, high): between both ends, or strictly beyond a single one."""
    out = []
    for name, low, high in edges:
        c = size.between(low, high) if low is not None and high is not None else size < high if low is None else size > low
        out.append(c.alias(name))
    return out


#: Labels of a size field, numbers before a K that name a resolution, and kinds of files that a plain size may follow.
SIZE_LABELS = ("影片大小", "影片容量", "资源大小", "資源大小", "文件大小", "檔案大小", "档案大小")
RESOLUTIONS = (1, 2, 4, 8, 10, 12, 16)
FILE_KINDS = ("MP4", "MKV", "AVI", "WMV", "MOV", "FLV", "TS", "ISO")
#: Powers of 1024 by unit: each letter alone, with B and with IB.
UNITS = {letter + end: i for i, letter in enumerate("KMGT", 1) for end in ("", "B", "IB")}



def _none() -> Column:
    return F.lit(0).cast("long")


def measures(text: Column) -> Column:
    """Numbers of a text with the letters right behind each, as an array of (number, unit); the unit is in upper case.

    Words are runs of letters, digits and dots; a blank between a digit and a letter doesn't part them. A word that begins
    with a letter has no measures, one that begins with a digit may have several, as in `2V300m`.
    """
    words = F.regexp_extract_all(F.regexp_replace(text, r"(?<=[0-9])[ \t]+(?=[A-Za-z])", ""), F.lit(r"([A-Za-z0-9.]+)"), F.lit(1))
    pieces = F.flatten(F.transform(F.filter(words, lambda w: w.rlike("^[0-9]")), lambda w: F.regexp_extract_all(w, F.lit(r"([0-9]+(?:\.[0-9]+)?[A-Za-z]*)"), F.lit(1))))
    return F.transform(pieces, lambda p: F.struct(F.regexp_extract(p, "^([0-9.]+)", 1).cast("double").alias("number"), F.upper(F.regexp_extract(p, "([A-Za-z]*)$", 1)).alias("unit")))


def _bytes(m: Column) -> Column:
    """A measure in whole bytes; 0 for other units and for resolutions."""
    power = F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv])[m["unit"]]
    named = (m["unit"] == "K") & m["number"].isin(*map(float, RESOLUTIONS))
    return F.when(power.isNull() | named, 0).otherwise(F.floor(m["number"] * F.pow(F.lit(1024.0), power))).cast("long")


def largest_size(text: Column) -> Column:
    """The largest size that a text tells, in whole bytes; 0 if none."""
    return F.coalesce(F.array_max(F.transform(measures(text), _bytes)), _none())


def _gigabytes(number: Column) -> Column:
    """A text that is a number and nothing else as gigabytes, if there are 0.05 to 50 of them; else 0."""
    n = F.btrim(number).try_cast("double")
    return F.when(F.btrim(number).rlike(r"^[0-9.]+$") & n.between(0.05, 50.0), F.floor(n * 1024.0**3)).otherwise(0).cast("long")


def labelled_values(text: Column, labels: tuple[str, ...]) -> Column:
    """What stands behind `【label】` for any of some labels, without signs and blanks before it.

    A value ends with its line or at the next bracket; where nothing is before that bracket, its content is the value.
    """
    pieces = F.split(text, "[【\n]")
    label = lambda p: F.btrim(F.split_part(p, F.lit("】"), F.lit(1)))
    behind = lambda p: F.regexp_replace(F.substr(p, F.locate("】", p) + 1), r"^[\s\p{P}\p{S}]+", "")
    value = lambda p, i: F.when(behind(p) != "", behind(p)).otherwise(F.coalesce(F.split_part(F.get(pieces, i + 1), F.lit("】"), F.lit(1)), F.lit("")))
    marked = F.transform(pieces, lambda p, i: F.when(p.contains("】") & label(p).isin(*labels), value(p, i)))
    return F.filter(marked, lambda v: v.isNotNull())


def capacity_bytes(text: Column, labels: tuple[str, ...] = SIZE_LABELS, kinds: tuple[str, ...] = FILE_KINDS) -> Column:
    """The size that a text tells, in whole bytes; 0 if none.

    The first field of one of the labels decides if its value has a size, or is a plain number, which counts as gigabytes;
    then the largest size anywhere; then a plain number behind a kind of file, as in `[MP4/1.59]`.
    """
    value = F.coalesce(F.get(labelled_values(text, labels), F.lit(0)), F.lit(""))
    boxes = F.transform(F.regexp_extract_all(text, F.lit(r"\[([^\[\]]*)\]"), F.lit(1)), lambda b: F.split(b, "/"))
    typed = F.filter(boxes, lambda b: (F.size(b) == 2) & F.upper(F.btrim(F.get(b, F.lit(0)))).isin(*kinds))
    ways = [largest_size(value), _gigabytes(value), largest_size(text), F.coalesce(F.array_max(F.transform(typed, lambda b: _gigabytes(F.get(b, F.lit(1))))), _none())]
    return F.coalesce(*[F.nullif(w, _none()) for w in ways], _none())


def host(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^[a-z]+://([^/?#]+)", 1)), F.lit(""))


def canonical_url(url: Column) -> Column:
    """Without a mobile host prefix, query and fragment, over https."""
    return F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^https?://(m\.)?", "https://")


def is_mobile(url: Column) -> Column:
    return url.rlike(r"^https?://m\.")


def thread_id(url: Column) -> Column:
    """The first number that ends a path part of an address."""
    return F.nullif(F.regexp_extract(url, r"/([0-9]+)(?:[./?#]|$)", 1), F.lit("")).try_cast("bigint")


def short_hash(text: Column, length: int = 32) -> Column:
    return F.upper(F.substring(F.sha2(text, 256), 1, length))
