"""Removes lines that repeat, exactly or within a few edits, across documents. Native."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.names import unused
from brindle.session import Scratch

#: Edits within which two lines are the same.
EDITS = 2
#: Shorter lines, in code points, only match exactly.
NEAR_CHARS = 20
#: Letters whose counts are compared before texts are; any choice gives the same result.
LETTERS = "etaonrhsidlucmpw"
#: Rows of a list of line ids that are broadcast; longer lists are joined by a shuffle.
BROADCAST_ROWS = 250_000


def _segment(length: Column, i: int, k: int) -> tuple[Column, Column]:
    """Start (from 1) and length of segment i of k: the last length % k segments are one longer."""
    base, short = (length / k).cast("int"), k - length % k
    return (base * (i - 1) + 1 + F.greatest(F.lit(0), F.lit(i - 1) - short)).cast("int"), (base + F.when(F.lit(i) > short, 1).otherwise(0)).cast("int")


def segment_keys(line: Column, length: Column, edits: int = EDITS) -> Column:
    """What a line is found by: each of its edits + 1 segments, with its number and the line's length."""
    k = edits + 1
    parts = [(i, *_segment(length, i, k)) for i in range(1, k + 1)]
    return F.array(*[F.xxhash64(F.lit(i), length, F.substr(line, start, size)) for i, start, size in parts])


def probe_keys(line: Column, length: Column, edits: int = EDITS) -> Column:
    """The substrings by which a line finds others of its length or up to `edits` less.

    A line within `edits` of it has a segment that occurs here unchanged. Of the segments equal to
    a substring, the first has at most i - 1 edits before it and the last at most edits + 1 - i
    after it, which leaves a few starts for each segment and length.
    """
    k, out = edits + 1, []
    for less in range(edits + 1):
        other = length - less
        for i in range(1, k + 1):
            start, size = _segment(other, i, k)
            low, high = max(1 - i, less - (k - i)), min(i - 1, less + (k - i))
            out += [F.xxhash64(F.lit(i), other, F.substr(line, start + d, size)) for d in range(low, high + 1)]
    return F.array(*out)


def letter_counts(line: Column) -> Column:
    """How often each of LETTERS occurs, modulo 16, as the half bytes of a long."""
    counts = [((F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c), F.lit("")))) % 16).cast("long") for c in LETTERS]
    return reduce(lambda x, y: x.bitwiseOR(y), [F.shiftleft(c, 4 * i) for i, c in enumerate(counts)])


def counts_apart(x: Column, y: Column) -> Column:
    """At most the sum of differences of two letter_counts, which an edit changes by two at most."""

    def half(z: Column, i: int) -> Column:
        return F.shiftright(z, 4 * i).bitwiseAND(F.lit(15)).cast("int")

    gaps = [F.abs(half(x, i) - half(y, i)) for i in range(len(LETTERS))]
    return reduce(lambda a, b: a + b, [F.least(g, 16 - g) for g in gaps])


def _let(value: Column, f) -> Column:
    """f(value) with the value computed once, as a lambda's variable."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _long(c: Column) -> Column:
    return F.coalesce(c, F.lit(0).cast("long"))


def _ones_from(place: Column) -> Column:
    """A word whose bits are set from a place on, which may lie before or behind the word."""
    return F.when(place <= 0, F.lit(-1).cast("long")).when(place >= 64, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(-1).cast("long"), place))


def pack(line: Column, length: Column) -> Column:
    """The bits of a line's code points: one array of longs for each bit, from the lowest.

    Bit i of word w of plane p is bit p of the character at 64 * w + i. There are as many planes as the greatest
    code point needs, and a word for each 64 characters begun. A line is packed once for all its pairs.
    """
    last = F.greatest(F.lit(0), F.floor((length - 1) / 64).cast("int"))

    def word(part: Column, p: Column) -> Column:
        return F.aggregate(part, F.lit(0).cast("long"), lambda s, c: F.shiftleft(s, 1).bitwiseOR(F.call_function("shiftright", c, p).bitwiseAND(F.lit(1)).cast("long")))

    def planes(codes: Column) -> Column:
        top = F.length(F.bin(F.coalesce(F.array_max(codes), F.lit(0)).cast("long"))) - 1
        parts = F.transform(F.sequence(F.lit(0), last), lambda w: F.reverse(F.slice(codes, w * 64 + 1, F.lit(64))))
        return _let(parts, lambda cut: F.transform(F.sequence(F.lit(0), top), lambda p: F.transform(cut, lambda part: word(part, p))))

    return _let(F.transform(F.split(line, ""), lambda c: F.ascii(c)), planes)


def _lane(a: Column, b: Column, na: Column, nb: Column, d: int) -> Column:
    """Words in which bit i is set where character i of a isn't character i + d of b, and from the end of either on.

    a, b: packed lines. A word of b is put together from two neighbours for the shift by d.
    """
    end, shift = F.least(na, nb - d), abs(d)

    def differ(p: Column, w: Column) -> Column:
        plane = F.get(b, p)
        here = _long(F.get(plane, w))
        if d > 0:
            here = F.shiftrightunsigned(here, shift).bitwiseOR(F.shiftleft(_long(F.get(plane, w + 1)), 64 - shift))
        elif d < 0:
            here = F.shiftleft(here, shift).bitwiseOR(F.shiftrightunsigned(_long(F.get(plane, w - 1)), 64 - shift))
        return _long(F.get(F.get(a, p), w)).bitwiseXOR(here)

    def word(w: Column) -> Column:
        planes = F.sequence(F.lit(0), F.greatest(F.size(a), F.size(b)) - 1)
        return F.aggregate(planes, _ones_from(end - w * 64), lambda s, p: s.bitwiseOR(differ(p, w)))

    return F.transform(F.sequence(F.lit(0), F.floor(na / 64).cast("int")), word)


def _run(lane: Column, start: Column) -> Column:
    """The first place from start on that is set in a lane: where the run of equal characters from start ends."""

    def first(x: Column, w: Column) -> Column:
        # the zeros below the lowest set bit, counted
        low = lambda y: F.when(y != 0, w * 64 + F.coalesce(F.bit_count(F.bitwise_not(y).bitwiseAND(F.try_subtract(y, F.lit(1).cast("long")))), F.lit(63)))
        return _let(x.bitwiseAND(_ones_from(start - w * 64)), low)

    return F.array_min(F.transform(lane, first)).cast("int")


def within(pa: Column, na: Column, pb: Column, nb: Column, edits: int = EDITS) -> Column:
    """Whether two packed lines (of lengths na and nb) are within `edits` of each other.

    Bit-parallel over a diagonal band: each of the 2 * edits + 1 diagonals around the main one is a lane of words
    that hold 64 comparisons of characters each. With one edit more, a lane is reached furthest from its own
    place (a character replaced) or from a neighbour's (a character more or less), and then along the run
    of equal characters there, whose end is the lowest bit set behind it. Lines match if the lane on which
    both end is reached to its end.
    """
    k, none = edits, F.lit(None).cast("int")

    def further(lanes: Column, reach: Column, e: int) -> Column:
        out = []
        for d in range(-k, k + 1):
            own, left, right = (F.get(reach, F.lit(x + k)) if abs(x) <= k else none for x in (d, d - 1, d + 1))
            start = F.least(F.greatest(own + 1, left, right + 1), na, nb - d)
            reached = F.coalesce(own, left, right).isNotNull() & (start >= 0)
            out.append(F.when(reached, _run(F.get(lanes, F.lit(d + k)), start)) if abs(d) <= e else none)
        return F.array(*out)

    def walk(lanes: Column, reach: Column, e: int) -> Column:
        if e > k:
            return F.coalesce(F.get(reach, nb - na + k) >= na, F.lit(False))
        return _let(further(lanes, reach, e), lambda r: walk(lanes, r, e + 1))

    def begin(lanes: Column) -> Column:
        first = F.array(*[_run(F.get(lanes, F.lit(k)), F.lit(0)) if d == 0 else none for d in range(-k, k + 1)])
        return _let(first, lambda r: walk(lanes, r, 1))

    lanes = F.array(*[_lane(pa, pb, na, nb, d) for d in range(-k, k + 1)])
    return F.when(F.abs(na - nb) <= k, _let(lanes, begin)).otherwise(False)


def _bounded(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _ends(pairs: DataFrame) -> DataFrame:
    """The ids that pairs (a, b) name, once each."""
    return pairs.select(F.col("a").alias("id")).distinct().union(pairs.select(F.col("b").alias("id")).distinct()).distinct()


def _explode_lines(docs: DataFrame) -> DataFrame:
    """(doc, th, pos, line, h, g) for each line with a character other than white space."""
    lines = docs.select("doc", "th", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.col("line").rlike(r"\S"))
    return lines.withColumns({"h": F.xxhash64("line"), "g": F.hash("line")})


def near_pairs(classes: DataFrame, scratch: Scratch, edits: int = EDITS) -> DataFrame:
    """(a, b) with a < b: ids of distinct lines within `edits` of each other. classes: id, len, c (letter_counts), line."""
    long_enough = classes.where(F.col("len") >= NEAR_CHARS)
    index = long_enough.select(F.explode(segment_keys(F.col("line"), F.col("len"), edits)).alias("key"), F.col("id").alias("a"), F.col("c").alias("ca"))
    probes = long_enough.select(F.explode(probe_keys(F.col("line"), F.col("len"), edits)).alias("key"), F.col("id").alias("b"), F.col("c").alias("cb"))
    # pairs whose letters rule them out end in the join, so a common segment doesn't bring out all pairs of its lines;
    # Spark sizes keys as the lines that they are cut from, so they are merged at every size, never broadcast
    met = index.hint("merge").join(probes, "key").where((F.col("a") != F.col("b")) & (counts_apart(F.col("ca"), F.col("cb")) <= 2 * edits))
    pairs = scratch.save(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    ends = scratch.save(_ends(pairs))
    texts = scratch.save(long_enough.join(_bounded(ends), "id", "left_semi").select("id", "len", pack(F.col("line"), F.col("len")).alias("bits")))
    left = texts.select(F.col("id").alias("a"), F.col("len").alias("na"), F.col("bits").alias("pa"))
    right = texts.select(F.col("id").alias("b"), F.col("len").alias("nb"), F.col("bits").alias("pb"))
    near = pairs.join(left, "a").join(right, "b").where(within(F.col("pa"), F.col("na"), F.col("pb"), F.col("nb"), edits))
    out = scratch.save(near.select("a", "b"))
    for t in (pairs, ends, texts):
        scratch.drop(t)
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, counts: str | None = None) -> DataFrame:
    """docs with text_col rewritten and, if counts names it, a struct column (lines, exact, near) added.

    A line goes if the same line occurs earlier, or if a different line within `edits` does (both of
    NEAR_CHARS code points at least). Earlier is by id (null first), then by a hash of the text, then
    by place in the text; for near lines the first places of both lines count. Blank lines stay.
    counts has the number of lines that aren't blank, and how many of these went as exact and as near
    repeats. Null texts stay null, empty ones empty. Rows of equal id and text are one document, so that
    all of them lose the same lines. An empty table gives no rows. Other columns come back as they are,
    whatever their names; counts must be a name that docs doesn't have.
    """
    if counts and unused(counts, docs.columns) != counts:
        raise ValueError(f"docs has a column {counts}")
    scratch = Scratch(docs.sparkSession, "lines")
    keyed = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).cast("string").alias("text"))
    lines = _explode_lines(keyed)
    first = lines.groupBy("h", "g").agg(F.min(F.struct("doc", "th", "pos")).alias("first"), F.count("*").alias("n"), F.first("line").alias("line"))
    classes = scratch.save(first.select(F.monotonically_increasing_id().alias("id"), "h", "g", "first", "n", F.length("line").alias("len"), letter_counts(F.col("line")).alias("c"), "line"))
    pairs = near_pairs(classes.select("id", "len", "c", "line"), scratch, edits)
    ends = scratch.save(_ends(pairs))
    places = scratch.save(classes.join(_bounded(ends), "id", "left_semi").select("id", "first"))
    ordered = pairs.join(places.select(F.col("id").alias("a"), F.col("first").alias("fa")), "a").join(places.select(F.col("id").alias("b"), F.col("first").alias("fb")), "b")
    near = scratch.save(ordered.select(F.when(F.col("fa") < F.col("fb"), F.col("b")).otherwise(F.col("a")).alias("id")).distinct())
    decided = scratch.save(classes.select("id", "h", "g", "first", "n").join(_bounded(near).withColumn("near", F.lit(True)), "id", "left").where("n > 1 or near").select("h", "g", "first", F.coalesce("near", F.lit(False)).alias("near")))
    for t in (classes, pairs, ends, places, near):
        scratch.drop(t)
    # what goes is found by hash; only lines that go are gathered by document
    here = lines.select("doc", "th", "pos", "h", "g").join(_bounded(decided), ["h", "g"])
    repeat = ~F.struct("doc", "th", "pos").eqNullSafe(F.col("first"))
    gone = here.select("doc", "th", "pos", repeat.alias("exact"), "near").where("exact or near").distinct()
    gone = gone.groupBy("doc", "th").agg(F.collect_set("pos").alias("pos"), F.count_if("exact").alias("exact"), F.count_if(~F.col("exact")).alias("near"))
    # all other names are set aside, so that no column of docs can clash with one made here
    own = docs.select(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row"), F.col(id_col).cast("long").alias("own_doc"), F.xxhash64(F.col(text_col)).alias("own_th"))
    joined = own.join(gone, F.col("own_doc").eqNullSafe(F.col("doc")) & (F.col("own_th") == F.col("th")), "left")
    text = F.col(f"row.c{docs.columns.index(text_col)}")

    def without(parts: Column) -> Column:
        """The lines that stay: their places by one set difference, so that the work is linear in a document."""
        places = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("pos"))
        return F.array_join(F.transform(places, lambda i: F.get(parts, i)), "\n")

    rewritten = F.when(F.col("pos").isNull(), text).otherwise(_let(F.split(text, "\n"), without))
    back = [(rewritten if c == text_col else F.col(f"row.c{i}")).alias(c) for i, c in enumerate(docs.columns)]
    if counts:
        n = F.coalesce(F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"\S"))), F.lit(0))
        back.append(F.struct(n.alias("lines"), F.coalesce("exact", F.lit(0)).alias("exact"), F.coalesce("near", F.lit(0)).alias("near")).alias(counts))
    return joined.select(*back)
