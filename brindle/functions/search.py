"""Keyword search: what is looked for, which rows match, and how well. Native but for word similarity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import clean, text
from brindle.operators import segment

#: What separates keywords, and words that are never keywords.
SEPARATORS = r"""[.,!?;—()\[\]{}<>@#%^&*~`"'|\-，。！？；“”‘’「」『』《》、【】…（）·　\s]"""
STOP_WORDS = ("的", "了", "和", "与", "之", "在", "是", "the", "a", "an", "of", "and", "or")
#: Least similarities of a fuzzy match, and the weights of a score.
WORD_SIMILARITY, SIMILARITY = 0.25, 0.15
FIRST, REQUIRED, OTHER, EXACT, PREFIX, BY_WORD, BY_ALL = 10, 3, 1, 100, 40, 60, 40
HASH = r"(?i)^[a-f0-9]{32}([a-f0-9]{8})?$"


def _item(keyword: Column, required: Column) -> Column:
    return F.struct(keyword.alias("keyword"), required.alias("required"))


def plain(query: Column) -> Column:
    """A query without its quoted phrases."""
    return F.btrim(F.regexp_replace(query, '"[^"]+"', ""))


#: Tags of words that a search requires.
REQUIRED_TAGS = ("n", "nr", "ns", "nt", "nz", "vn", "x")


def cut_items(words: Column) -> Column:
    """Words (word, tag) of segment() as keywords; tags of names and things make them required."""
    return F.transform(words, lambda w: _item(w["word"], F.coalesce(w["tag"].isin(*REQUIRED_TAGS), F.lit(False))))


def keywords(query: Column, mode: str = "smart", cut: Column | None = None) -> Column:
    """The keywords of a query as an array of (keyword, required), in order. mode: exact, smart or fuzzy.

    Quoted phrases are required, others are words between SEPARATORS: required in exact mode, and in smart mode, if
    nothing else is, the longest third. Fuzzy mode adds what plain(query) is cut into and pairs of neighbouring Han
    characters, smart mode the words of a single long one. cut: those words, as cut_items() has them; without it the whole
    is the only one. Stop words and, but for fuzzy mode, single characters go. A
    keyword said twice stays in its first place with its last flag. Smart mode puts the whole query first.
    """
    # each step is named once: an expression that is named twice is computed twice, and within a lambda once an element
    return text.let(plain(query), lambda rest: text.let(_kept(query, rest, mode, cut), lambda kept: text.let(F.array_distinct(F.transform(kept, lambda x: x["keyword"])), lambda names: text.let(F.transform(names, lambda n: _item(n, F.element_at(F.filter(kept, lambda x: x["keyword"] == n), -1)["required"])), lambda once: _chosen(query, rest, names, once, mode)))))


def _kept(query: Column, rest_of: Column, mode: str, cut: Column | None) -> Column:
    """What a query is cut into, without stop words and words that are too short."""
    no, yes = F.lit(False), F.lit(True)
    quoted = F.transform(F.regexp_extract_all(query, F.lit('"([^"]+)"'), F.lit(1)), lambda k: _item(k, yes))
    words = F.transform(F.filter(F.split(rest_of, SEPARATORS), lambda k: k != ""), lambda k: _item(k, F.lit(mode == "exact")))
    items, none = F.concat(quoted, words), F.array().cast("array<struct<keyword:string,required:boolean>>")
    whole = F.array(_item(rest_of, no)) if cut is None else F.coalesce(cut, none)
    if mode == "fuzzy":
        han = F.regexp_extract_all(rest_of, F.lit("([\\x{4e00}-\\x{9fff}])"), F.lit(1))
        pairs = text.let(han, lambda h: F.transform(F.slice(h, 1, F.greatest(F.size(h) - 1, F.lit(0))), lambda c, i: _item(F.concat(c, F.get(h, i + 1)), no)))
        items = F.concat(items, F.when(F.length(rest_of) >= 2, whole).otherwise(none), F.when(F.length(rest_of) >= 4, pairs).otherwise(none))
    elif mode == "smart":
        items = text.let(items, lambda xs: F.concat(xs, F.when((F.size(xs) == 1) & (F.length(rest_of) >= 4), whole).otherwise(none)))
    trimmed = F.transform(items, lambda x: _item(F.btrim(x["keyword"]), x["required"]))
    return F.filter(trimmed, lambda x: (F.length(x["keyword"]) >= (1 if mode == "fuzzy" else 2)) & ~F.lower(x["keyword"]).isin(*STOP_WORDS))


def _chosen(query: Column, rest_of: Column, names: Column, once: Column, mode: str) -> Column:
    """Keywords with what is required of them in a mode."""
    rest = F.coalesce(F.nullif(rest_of, F.lit("")), query)
    if mode != "smart":
        flag = F.lit(mode == "exact")
        return F.when(F.size(once) > 0, F.transform(once, lambda x: _item(x["keyword"], flag)) if mode == "exact" else once).otherwise(F.array(_item(rest, flag)))
    by_length = F.array_sort(F.transform(once, lambda x, i: F.struct((-F.length(x["keyword"])).alias("n"), i.alias("i"))))
    longest = F.transform(F.slice(by_length, F.lit(1), F.ceil(F.size(once) / 3).cast("int")), lambda x: x["i"])
    by_rank = text.let(longest, lambda at: F.transform(once, lambda x, i: _item(x["keyword"], F.array_contains(at, i))))
    chosen = F.when(F.exists(once, lambda x: x["required"]), once).otherwise(by_rank)
    full = F.replace(query, F.lit('"'), F.lit(""))
    return text.let(chosen, lambda c: F.when(F.array_contains(names, full), c).otherwise(F.concat(F.array(_item(full, F.lit(False))), c)))


def plan(spark: SparkSession, query: str, mode: str = "smart", lexicon: DataFrame | None = None) -> list[tuple[str, bool]]:
    """keywords() of one query, as plan-time values; lexicon: words, frequencies and tags that cut unspaced ones."""
    one = spark.range(1).select(F.lit(query).alias("q"), plain(F.lit(query)).alias("plain"))
    cut = None
    if lexicon is not None:
        one, cut = segment.segment(one, "plain", lexicon), cut_items(F.col("words"))
    return [tuple(x) for x in one.select(keywords(F.col("q"), mode, cut)).first()[0]]


def has(name: Column, keyword: str) -> Column:
    """Whether a name holds a keyword, whatever its case; its signs stand for themselves."""
    return name.ilike(f"%{text.like_escape(keyword)}%")


def search_name(filename: Column, title: Column) -> Column:
    """What is searched: name and title on a line each, where a missing one is empty."""
    return F.concat(F.coalesce(filename, F.lit("")), F.lit("\n"), F.coalesce(title, F.lit("")))


def matches(name: Column, found: list[tuple[str, bool]], mode: str) -> Column:
    """Whether a name matches keywords of plan().

    exact: all of them. smart: the required ones; others never decide. fuzzy: half of them; names that are merely
    similar are those of grams.fuzzy(). No keywords match nothing.
    """
    if not found:
        return F.lit(False)
    if mode == "exact":
        return reduce(lambda a, b: a & b, [has(name, k) for k, _ in found])
    if mode == "smart":
        return reduce(lambda a, b: a & b, [has(name, k) for k, required in found if required], F.lit(True))
    hits = reduce(lambda a, b: a + b, [has(name, k).cast("int") for k, _ in found])
    return hits >= max(1, -(-len(found) // 2))


def keyword_score(name: Column, found: list[tuple[str, bool]], query: str) -> Column:
    """The part of a score that keywords have: their weights, and a bonus for the whole query and for beginning so."""
    parts = [F.when(has(name, k), FIRST if i == 0 else REQUIRED if required else OTHER).otherwise(0) for i, (k, required) in enumerate(found)]
    low, whole = F.lower(name), F.lower(F.lit(query))
    parts += [F.when(low == whole, EXACT).otherwise(0), F.when(low.startswith(whole), PREFIX).otherwise(0)]
    return reduce(lambda a, b: a + b, parts)


def score(name: Column, found: list[tuple[str, bool]], query: str) -> Column:
    """How well a name matches: its keywords, and similarity. grams.best() has the rows of the best scores."""
    by_word, by_all = clean.word_similarity(F.lit(query), name), text.similarity(name, F.lit(query))
    return keyword_score(name, found, query) + F.coalesce(by_all, F.lit(0.0)) * BY_ALL + F.coalesce(by_word, F.lit(0.0)) * BY_WORD


def order(kind: str, relevance: Column, size: str, created: str, tie: str) -> list[Column]:
    """The order of results by relevance, size or (any other kind) date, newest first."""
    kinds = {"relevance": [relevance.desc(), F.desc(size)], "size": [F.desc(size)]}
    return [*kinds.get(kind, []), F.desc(created), F.col(tie)]


def route(query: str) -> str:
    """What a query asks for, at plan time: none if it is shorter than two characters, hash if it is one, else search."""
    import re

    q = query.strip()
    return "none" if len(q) < 2 else "hash" if re.match(HASH, q) else "search"


def preferred(columns: list[Column], any_of: list[str], none_of: list[str] = (), regex: str | None = None) -> Column:
    """Whether any column matches one of some LIKE patterns or a regular expression, and none one of others; nulls are empty."""
    filled = [F.coalesce(c, F.lit("")) for c in columns]
    hit = reduce(lambda a, b: a | b, [c.ilike(p) for c in filled for p in any_of] + ([c.rlike(regex) for c in filled] if regex else []), F.lit(False))
    return hit & ~reduce(lambda a, b: a | b, [c.ilike(p) for c in filled for p in none_of], F.lit(False))


def preferences(chosen: dict[str, Column], query: str, unless: dict[str, str] | None = None) -> Column:
    """All of some preferences at once; one whose `unless` expression matches the query doesn't count."""
    import re

    on = [c for name, c in chosen.items() if not (name in (unless or {}) and re.search(unless[name], query.strip()))]
    return reduce(lambda a, b: a & b, on, F.lit(True))
