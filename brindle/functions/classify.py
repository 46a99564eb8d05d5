"""Classification of texts by rules that the caller supplies as tables, and tests of names and titles. Native."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.functions import text as texts


def _any(parts: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts, F.lit(False))


@dataclass
class Rule:
    """A class and when a text is of it: it begins with, holds, equals or matches something; also holds and lacks others."""

    name: str
    starts: tuple[str, ...] = ()
    has: tuple[str, ...] = ()
    equals: tuple[str, ...] = ()
    matches: str | None = None
    also: tuple[str, ...] = ()
    unless: tuple[str, ...] = ()
    fold: bool = False

    def holds(self, value: Column) -> Column:
        fold = (lambda s: s.lower()) if self.fold else (lambda s: s)
        v = F.lower(value) if self.fold else value
        hit = [v.startswith(fold(s)) for s in self.starts] + [v.contains(fold(s)) for s in self.has] + [v == fold(s) for s in self.equals]
        hit += [value.rlike(self.matches)] if self.matches else []
        out = _any(hit)
        if self.also:
            out = out & _any(v.contains(fold(s)) for s in self.also)
        return out & ~_any(v.contains(fold(s)) for s in self.unless) if self.unless else out


def by_rules(value: Column, rules: list[Rule], default: Column) -> Column:
    """The name of the first rule that holds of a trimmed text, else default. A null text is empty."""
    v, out = F.btrim(F.coalesce(value, F.lit(""))), F
    for r in rules:
        out = out.when(r.holds(v), F.lit(r.name))
    return out.otherwise(default) if rules else default


def without_mark(value: Column, mark: str) -> Column:
    """A text without a mark before it."""
    v = F.coalesce(value, F.lit(""))
    return F.when(v.startswith(mark), F.btrim(F.substr(v, F.lit(len(mark) + 1)))).otherwise(v)


def outcome_kind(outcome: Column, heads: list[Rule], families: list[Rule], default: str, reviewed: str, reason_marks: tuple[str, ...] = ()) -> Column:
    """The kind of an outcome: by what it begins with, else by words of its reason in the order of families, else default.

    A mark of review before it doesn't count. The reason is what follows the first of some marks, or the whole. An
    empty outcome has no kind.
    """
    plain = F.btrim(without_mark(F.btrim(F.coalesce(outcome, F.lit(""))), reviewed))
    reason = reduce(lambda rest, m: F.when(plain.contains(m), F.substr(plain, F.locate(m, plain) + len(m))).otherwise(rest), reversed(reason_marks), plain)
    return F.when(plain == "", "").otherwise(by_rules(plain, heads, by_rules(reason, families, F.lit(default))))


def outcome_head(outcome: Column, heads: list[Rule], reviewed: str, separator: str = " · ") -> Column:
    """The short twin of outcome_kind: by what it begins with, else its first part."""
    plain = without_mark(outcome, reviewed)
    return by_rules(plain, heads, F.split_part(plain, F.lit(separator), F.lit(1)))


def only_family(value: Column, families: dict[str, str], unless: str) -> Column:
    """The one family (name: regular expression) that a text matches, if it matches no other and not `unless`; else null."""
    v = F.coalesce(value, F.lit(""))
    found = F.filter(F.array(*[F.when(v.rlike(p), n) for n, p in families.items()]), lambda x: x.isNotNull())
    return F.when((F.size(found) == 1) & ~v.rlike(unless), F.get(found, F.lit(0)))


def display_name(id_: Column, names: dict[str, str], description: Column, marks: tuple[str, ...]) -> Column:
    """A name for an id: from a table, else the id itself, else the rest of the line behind one of some marks, else empty."""
    key, known = F.btrim(F.coalesce(id_, F.lit(""))), F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    marked = F.regexp_extract(F.coalesce(description, F.lit("")), "(?:" + "|".join(marks) + r")[ \t]*([^\n]*)", 1)
    return F.coalesce(known[key], F.nullif(key, F.lit("")), F.nullif(F.btrim(marked), F.lit("")), F.lit(""))


# punctuation, symbols (with emoji) and what joins or varies them
_SIGNS = r"^[\s\p{P}\p{S}\p{M}\p{Cf}]+$"


def is_missing_name(name: Column, hash_: Column) -> Column:
    """Empty, or the hash or its first eight signs."""
    n, h = F.btrim(F.coalesce(name, F.lit(""))), F.upper(F.btrim(F.coalesce(hash_, F.lit(""))))
    return (n == "") | ((h != "") & (F.upper(n) == h)) | ((F.length(h) >= 8) & (F.upper(n) == F.left(h, F.lit(8))))


def is_decoration(name: Column) -> Column:
    """Whether a name has signs but no letter, digit or Han character; an empty one counts."""
    n = F.btrim(F.coalesce(name, F.lit("")))
    return (n == "") | n.rlike(_SIGNS)


def is_weak_name(name: Column, title: Column, hash_: Column) -> Column:
    """Missing, the title itself but for blanks, decoration, or too short: under four characters that are neither Han nor a code.

    A code this short is a letter with letters or digits behind it.
    """
    n, t = F.btrim(F.coalesce(name, F.lit(""))), F.btrim(F.coalesce(title, F.lit("")))
    blank = lambda c: F.regexp_replace(c, r"\s+", "")
    short = (F.length(n) < 4) & ~n.rlike(r"\p{IsHan}|^[A-Za-z][A-Za-z0-9]+$")
    return is_missing_name(n, hash_) | ((t != "") & (blank(n) == blank(t))) | is_decoration(n) | short


#: Brackets of titles, what a count at the end of a title is written with, and full-width letters of units.
OPENING, CLOSING = "【［[", "】］]"
COUNT_UNITS, COUNT_WORDS = ("V", "P"), ("配额", "配額")


def open_brackets(text: Column) -> Column:
    """The brackets of a text that nothing closes, in order, by a fold over its characters."""

    def step(left: Column, c: Column) -> Column:
        return F.when(F.instr(F.lit(OPENING), c) > 0, F.concat(left, c)).when(F.instr(F.lit(CLOSING), c) > 0, F.left(left, F.length(left) - 1)).otherwise(left)

    return F.aggregate(F.split(text, ""), F.lit(""), lambda left, c: F.when(c == "", left).otherwise(step(left, c)))


def close_bracket(title: Column) -> Column:
    """A title with its last bracket closed, if that is open and ends in a size or count."""
    t = F.rtrim(F.regexp_replace(F.coalesce(title, F.lit("")), r"\s+$", ""))
    last = F.right(open_brackets(t), F.lit(1))
    inner = F.translate(F.call_function("substring_index", t, last, F.lit(-1)), "ＧｇＢｂＰＶ", "GgBbPV")
    told = F.element_at(texts.measures(F.when(last != "", inner).otherwise("0")), -1)
    behind = inner.rlike(r"[0-9]\s*[A-Za-z]*$") & (told["unit"].isin(*texts.UNITS, *COUNT_UNITS))
    ends = (last != "") & (_any(inner.endswith(w) for w in COUNT_WORDS) | F.coalesce(behind, F.lit(False)))
    return F.when(ends, F.concat(t, F.translate(last, OPENING, CLOSING))).otherwise(t)


def is_truncated_title(title: Column) -> Column:
    """Whether a title was cut: dots at its end or before a bracket, or an open bracket at its end."""
    return close_bracket(title).rlike(r"(?:\.{3}|…)\s*$|(?:\.{3}|…)【|[【［\[（(]$")


def is_title(title: Column, generic: tuple[str, ...], advertising: tuple[str, ...] = ()) -> Column:
    """Whether a title says something: two signs at least, not one of some generic ones or begun by one, no advertising."""
    t = F.btrim(F.coalesce(title, F.lit("")))
    return (F.length(t) >= 2) & ~_any(t.startswith(g) for g in generic) & ~_any(t.contains(a) for a in advertising)


def first_title(titles: list[Column], generic: tuple[str, ...], advertising: tuple[str, ...] = ()) -> Column:
    """The first title that says something, its bracket closed; else empty."""
    return F.coalesce(*[F.when(is_title(t, generic, advertising), close_bracket(F.btrim(t))) for t in titles], F.lit(""))


def capacity_class(text: Column, unknown: tuple[str, ...] = ("容量不详", "容量不明")) -> Column:
    """D2 if the size is said to be unknown, D1 if it is told, else D3."""
    t = F.coalesce(text, F.lit(""))
    return F.when(_any(t.contains(u) for u in unknown), "D2").when(texts.capacity_bytes(t) > 0, "D1").otherwise("D3")


def group_kind(groups: Column) -> Column:
    return F.when(groups <= 0, "no_link").when(groups == 1, "single").otherwise("multi")


def group_shape(groups: Column, merged: Column) -> Column:
    """F without groups, C for one that was merged from cut names, A for one, B for more."""
    return F.when(groups == 0, "F").when(merged & (groups == 1), "C").when(groups == 1, "A").otherwise("B")


def has_odd_hash(link: Column) -> Column:
    """Whether a link names a hash of a length that none has."""
    found = F.regexp_extract(link, r"(?i)(?:btih:|\|)([0-9a-z]+)(?:[&|\s]|$)", 1)
    return (found != "") & ~F.length(found).isin(32, 40)


def archive_name(name: Column) -> Column:
    """Whether a name is that of an archive."""
    return F.coalesce(name, F.lit("")).rlike(r"(?i)\.(zip|rar|7z|tar|gz|bz2|xz|iso)(\.\d{3}|\.part\d+)?$|\.part\d+\.rar$")


def verdict(gates: list[tuple[str, str, Column]], outcome: str, reason: str) -> Column:
    """(outcome, reason) of the first (outcome, reason, condition) whose condition holds, else the given ones."""
    out = F
    for o, r, c in gates:
        out = out.when(c, F.struct(F.lit(o).alias("outcome"), F.lit(r).alias("reason")))
    return out.otherwise(F.struct(F.lit(outcome).alias("outcome"), F.lit(reason).alias("reason")))


def resolved_name(names: list[Column], hash_: Column, technical: str, title: Column | None = None) -> Column:
    """The first name that is neither weak nor made by a device, else the beginning of the hash."""
    none = F.lit("") if title is None else title
    return F.coalesce(*[F.when(n.isNotNull() & ~is_weak_name(n, none, hash_) & ~n.rlike(technical), F.btrim(n)) for n in names], F.left(hash_, F.lit(8)))
