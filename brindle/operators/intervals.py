"""Spans within spans of a text: which is the innermost one around a place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def innermost(points: DataFrame, spans: DataFrame, key: str, at: str, begin: str, end: str, span: str, tasks: int | None = None) -> DataFrame:
    """points with the span of their key that holds them and begins last (null if none does), in a column named as `span`.

    A span holds begin <= at < end. Spans of a key lie within each other or apart. Then the depth of a place is the number of
    spans begun less those ended, and the one around it is the last begun at that depth: two passes of a window over
    what a key has, linear in it, and no pairs of spans and places. Equal spans lie within each other by their names. tasks: among how many
    tasks the keys are dealt out; else as many as Spark makes of it, which may be few with much memory each.
    """
    cols = [c for c in points.columns if c not in (key, at)]
    event = lambda df, pos, kind, step: df.select(F.col(key).alias("k"), F.col(pos).cast("long").alias("p"), F.lit(kind).alias("kind"), F.lit(step).alias("step"), F.col(span).alias("s"), (F.col(end) - F.col(begin)).alias("size"), F.lit(None).alias("row"))
    used = spans.where(F.col(begin) < F.col(end))
    row = F.struct(*[F.col(c) for c in (at, *cols)]) if cols else F.struct(F.col(at))
    rows = points.select(F.col(key).alias("k"), F.col(at).cast("long").alias("p"), F.lit(2).alias("kind"), F.lit(0).alias("step"), F.lit(None).cast(spans.schema[span].dataType).alias("s"), F.lit(None).cast("long").alias("size"), row.alias("row"))
    events = rows.unionByName(event(used, end, 0, -1).withColumn("row", F.lit(None).cast(rows.schema["row"].dataType))).unionByName(event(used, begin, 1, 1).withColumn("row", F.lit(None).cast(rows.schema["row"].dataType)))
    events = events.repartition(tasks, "k") if tasks else events
    # at one place ends come first, then beginnings from the longest span on, then points
    order = Window.partitionBy("k").orderBy("p", "kind", F.desc("size"), "s")
    deep = events.withColumn("depth", F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("kind > 0")
    level = Window.partitionBy("k", "depth").orderBy("p", "kind", F.desc("size"), "s").rowsBetween(Window.unboundedPreceding, 0)
    found = deep.withColumn("found", F.when(F.col("depth") > 0, F.last(F.when(F.col("kind") == 1, F.col("s")), True).over(level))).where("kind = 2")
    return found.select(F.col("k").alias(key), *[F.col(f"row.{c}").alias(c) for c in (at, *cols)], F.col("found").alias(span))


def cards_of(blocks: DataFrame, cards: DataFrame, key: str, labels: dict[str, str], tasks: int | None = None) -> DataFrame:
    """blocks with the fields that stand in them: for each role the first value of its label in the block, null if none.

    blocks: key, block, begin, end. cards: key, at, label, value. labels: roles by label. A card in a block within a block
    is the inner one's; one outside of all is nobody's. tasks: as for innermost().
    """
    roles = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    held = innermost(cards.withColumn("role", roles[F.col("label")]).where("role is not null and value <> ''"), blocks, key, "at", "begin", "end", "block", tasks).where("block is not null")
    first = lambda role: F.min(F.when(F.col("role") == role, F.struct("at", "value")))["value"].alias(role)
    own = held.groupBy(key, "block").agg(*[first(r) for r in dict.fromkeys(labels.values())])
    dealt = lambda df: df.repartition(tasks, key, "block") if tasks else df
    return dealt(blocks).join(dealt(own), [key, "block"], "left")
