"""Words of unspaced texts: a word graph over a frequency table, and its best path by a dynamic programme."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Costs of words are natural logarithms in steps of 1 / COST, so that sums are exact and ties are ties.
COST = 1 << 20
#: Runs that are cut into words; what is between them stands alone. And runs that are never cut, which count as one word.
RUNS, WHOLE = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]+|[\p{L}\p{N}]+", r"^[A-Za-z0-9]+$"


def _spans(runs: DataFrame, longest: int) -> DataFrame:
    """(run, start, end, word) of all parts of runs of up to `longest` characters."""
    n = F.length("run")
    at = runs.select("run", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("start"))
    ends = at.select("run", "start", F.explode(F.sequence(F.col("start") + 1, F.least(F.col("n"), F.col("start") + longest))).alias("end"))
    return ends.withColumn("word", F.substring(F.col("run"), F.col("start") + 1, F.col("end") - F.col("start")))


def _best_path(edges: Column, n: Column) -> Column:
    """The (start, end, tag) of the cheapest path from 0 to n over edges (start, end, cost, tag).

    Of equal costs the path of fewer words is best, then the one whose last word is longer, and so on from the end.
    """
    node = "struct<cost:bigint,words:int,start:int,tag:string>"

    def reach(done: Column, end: Column) -> Column:
        ways = F.transform(
            F.filter(edges, lambda e: e["end"] == end),
            lambda e: F.struct((F.get(done, e["start"])["cost"] + e["cost"]).alias("cost"), (F.get(done, e["start"])["words"] + 1).alias("words"), e["start"].alias("start"), e["tag"].alias("tag")),
        )
        return F.concat(done, F.array(F.array_min(ways).cast(node)))

    begin = F.array(F.struct(F.lit(0).cast("long").alias("cost"), F.lit(0).alias("words"), F.lit(-1).alias("start"), F.lit(None).cast("string").alias("tag")).cast(node))
    nodes = F.aggregate(F.sequence(F.lit(1), n), begin, reach)
    step = "struct<at:int,path:array<struct<start:int,end:int,tag:string>>>"

    def back(state: Column, _: Column) -> Column:
        here = F.get(state["nodes"], state["at"])
        part = F.struct(here["start"].alias("start"), state["at"].alias("end"), here["tag"].alias("tag"))
        return F.when(state["at"] > 0, F.struct(here["start"].alias("at"), F.concat(F.array(part), state["path"]).alias("path"), state["nodes"].alias("nodes"))).otherwise(state)

    first = F.struct(n.alias("at"), F.array().cast("array<struct<start:int,end:int,tag:string>>").alias("path"), nodes.alias("nodes"))
    return F.aggregate(F.sequence(F.lit(1), n), first.cast(step[:-1] + f",nodes:array<{node}>>"), back, lambda s: s["path"])


def words_of(runs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(run, words) for distinct runs of characters: their words (word, tag) in order, by the best path.

    lexicon: word, freq and tag, one row a word. A word costs -ln(freq / all); a single character that is no word costs
    what a word of frequency 1 does and has no tag. Edges are found by a join with the lexicon, however large it is.
    """
    told = lexicon.agg(F.sum("freq").alias("total"), F.max(F.length("word")).alias("longest")).first()
    total, longest = max(1, told["total"] or 0), max(1, told["longest"] or 0)
    known = lexicon.where((F.col("freq") > 0) & (F.col("word") != "")).select("word", F.round(-F.log(F.col("freq") / total) * COST).cast("long").alias("cost"), "tag")
    unknown = round(math.log(total) * COST)
    found = _spans(runs, longest).join(known, "word", "left").where(F.col("cost").isNotNull() | (F.col("end") == F.col("start") + 1))
    edge = F.struct("start", "end", F.coalesce("cost", F.lit(unknown).cast("long")).alias("cost"), "tag")
    graph = found.groupBy("run").agg(F.collect_list(edge).alias("edges"))
    path = _best_path(F.col("edges"), F.length("run"))
    return graph.select("run", F.transform(path, lambda p: F.struct(F.substring(F.col("run"), p["start"] + 1, p["end"] - p["start"]).alias("word"), p["tag"].alias("tag"))).alias("words"))


def segment(df: DataFrame, text: str, lexicon: DataFrame, out: str = "words", runs: str = RUNS, whole: str | None = WHOLE) -> DataFrame:
    """df with the words (word, tag) of a text in order: runs of letters are cut by the lexicon, signs and blanks go.

    runs matches what is cut; those that `whole` matches stay whole, with the tag that the lexicon has. Equal runs are cut
    once. A null text has null, a text without letters no words.
    """
    keyed = df.withColumn("brindle_row", F.monotonically_increasing_id())
    pieces = keyed.select("brindle_row", F.posexplode(F.regexp_extract_all(F.col(text), F.lit(f"({runs})"), F.lit(1))).alias("place", "run"))
    distinct = pieces.select("run").distinct()
    stays = F.col("run").rlike(whole) if whole else F.lit(False)
    kept = distinct.where(stays).join(lexicon.select(F.col("word").alias("run"), "tag"), "run", "left").select("run", F.array(F.struct(F.col("run").alias("word"), "tag")).alias("words"))
    cut = words_of(distinct.where(~stays), lexicon).unionByName(kept)
    joined = pieces.join(cut, "run").groupBy("brindle_row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "words"))), lambda x: x["words"])).alias(out))
    none = F.when(F.col(text).isNotNull(), F.array().cast("array<struct<word:string,tag:string>>"))
    return keyed.join(joined, "brindle_row", "left").withColumn(out, F.coalesce(out, none)).drop("brindle_row")
