"""Trees as tables of nodes with their parents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.session import Scratch


def ancestors(nodes: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    """(id, ancestor, up): each node with all nodes above it and how far up they are, nearest first in a cycle.

    Parents that aren't nodes are none. Pairs are joined with themselves, so that their reach doubles in each round
    and rounds are as many as the logarithm of the depth. A node of a cycle has every node of it above it but itself.
    """
    scratch = Scratch(nodes.sparkSession, "ancestors")
    ids = nodes.select(F.col(id_col).alias("ancestor")).distinct()
    pairs = nodes.select(F.col(id_col).alias("id"), F.col(parent_col).alias("ancestor")).where("ancestor is not null and id <> ancestor").distinct().join(ids, "ancestor", "left_semi")
    known = scratch.save(pairs.select("id", "ancestor", F.lit(1).cast("long").alias("up")))
    size = known.count()
    while True:
        further = known.alias("a").join(known.alias("b"), F.col("a.ancestor") == F.col("b.id")).where("a.id <> b.ancestor").select("a.id", "b.ancestor", (F.col("a.up") + F.col("b.up")).alias("up"))
        wider = scratch.save(known.unionByName(further).groupBy("id", "ancestor").agg(F.min("up").alias("up")))
        scratch.drop(known)
        known, before, size = wider, size, wider.count()
        if size == before:
            return known


def descendants(nodes: DataFrame, id_col: str, parent_col: str, roots: DataFrame) -> DataFrame:
    """(root, id, down): all nodes below each of some roots (a column named as the id) and how far; itself at 0. Cycles end.

    One join a level, and each level is written; a level only has nodes that weren't found before.
    """
    scratch = Scratch(nodes.sparkSession, "descendants")
    edges = nodes.select(F.col(id_col).alias("id"), F.col(parent_col).alias("parent")).where("parent is not null")
    level = scratch.save(roots.select(F.col(id_col).alias("root")).distinct().join(nodes.select(F.col(id_col).alias("root")).distinct(), "root", "left_semi").select("root", F.col("root").alias("id"), F.lit(0).alias("down")))
    known = level
    while not level.isEmpty():
        below = level.join(edges, level["id"] == edges["parent"]).select("root", edges["id"], (F.col("down") + 1).alias("down")).distinct()
        level = scratch.save(below.join(known.select("root", "id"), ["root", "id"], "left_anti"))
        known = scratch.save(known.unionByName(level))
    return known


def without_subtree(nodes: DataFrame, id_col: str, parent_col: str, roots: DataFrame) -> DataFrame:
    """Nodes but for some roots and all below them."""
    gone = descendants(nodes, id_col, parent_col, roots).select(F.col("id").alias(id_col)).distinct()
    return nodes.join(gone, id_col, "left_anti")


def import_nodes(nodes: DataFrame, id_col: str, parent_col: str, order: list[str]) -> DataFrame:
    """Nodes as a tree may hold them: of equal ids the first in an order, and no parents that aren't there or are the node itself."""
    rest = [c for c in nodes.columns if c != id_col]
    once = nodes.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("n")).select(id_col, "n.*")
    there = once.select(F.col(id_col).alias("brindle_there"))
    parent = F.when(F.col("brindle_there").isNotNull() & (F.col(parent_col) != F.col(id_col)), F.col(parent_col))
    return once.join(there, F.col(parent_col) == F.col("brindle_there"), "left").withColumn(parent_col, parent).select(*nodes.columns)


def reorder(nodes: DataFrame, id_col: str, parent_col: str, place_col: str, wanted: DataFrame) -> DataFrame:
    """Nodes with new places among their siblings: those of `wanted` (id, place) first, the others behind in their order."""
    told = wanted.select(F.col(id_col), F.col("place").alias("brindle_place"))
    joined = nodes.join(told, id_col, "left")
    among = Window.partitionBy(parent_col).orderBy(F.col("brindle_place").asc_nulls_last(), place_col, id_col)
    return joined.withColumn(place_col, F.row_number().over(among) - 1).select(*nodes.columns)


def from_json(texts: DataFrame, text: str, fields: dict[str, tuple[str, str]], rest: str | None = None) -> DataFrame:
    """The objects of JSON arrays as rows: fields are column: (path, type), null where a value is of another type.

    texts that aren't arrays have no rows. rest: a column for the whole object as a variant, whatever else it has.
    """
    found = texts.withColumn("brindle_list", F.try_variant_get(F.try_parse_json(text), "$", "array<variant>"))
    each = found.select(*[c for c in texts.columns if c != text], F.explode("brindle_list").alias("brindle_node"))
    value: dict[str, Column] = {c: F.try_variant_get("brindle_node", path, kind) for c, (path, kind) in fields.items()}
    return each.select(*[c for c in texts.columns if c != text], *[v.alias(c) for c, v in value.items()], *([F.col("brindle_node").alias(rest)] if rest else []))


def sibling_order(place: str, name: str, language: str | None = None) -> list[Column]:
    """The order of siblings: by place, those without one last, then by name as a language sorts it (Chinese by sound: zh), then by its bytes."""
    return [F.col(place).asc_nulls_last(), *([F.collate(F.col(name), language)] if language else []), F.col(name)]
