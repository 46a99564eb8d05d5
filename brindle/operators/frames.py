"""What a thread gives of each of its named things, checked by rules: rows filled, slots, errors, tags and a verdict. And names for links by place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import clean

#: Fixed value: links from which on a text without names is a pack with one shared name.
PACK = 48


def fill(assets: DataFrame, thread: str, name: str, link: str, size: str, image: str, stated: str, least_size: int = 0, images: int = 6, tasks: int | None = None) -> DataFrame:
    """One row a thread and name: links, n_links, images, n_images, size, slots (which of name, links and size are filled).

    The size is the stated one if that is larger than a placeholder, else the sum of the sizes of different links.
    Links and images count once each; their lists are cut after so many images. tasks: among how many tasks the threads are
    dealt out, once for all that follows; else each count is dealt out anew, and Spark may make few tasks with much memory each.
    """
    assets = assets.repartition(tasks, thread) if tasks else assets
    once = assets.groupBy(thread, name, link).agg(F.max(size).alias("brindle_size"), F.max(stated).alias("brindle_stated"), F.array_distinct(F.array_sort(F.collect_set(image))).alias("brindle_images"))
    per = once.groupBy(thread, name).agg(F.count(F.nullif(link, F.lit(""))).alias("n_links"), F.sum("brindle_size").alias("brindle_sum"), F.max("brindle_stated").alias("brindle_stated"), F.array_distinct(F.array_sort(F.flatten(F.collect_list("brindle_images")))).alias("brindle_images"))
    told = F.when(F.col("brindle_stated") > least_size, F.col("brindle_stated"))
    summed = F.when(F.col("brindle_sum") > least_size, F.col("brindle_sum"))
    out = per.select(thread, name, "n_links", F.slice("brindle_images", 1, images).alias("images"), F.size("brindle_images").alias("n_images"), F.coalesce(told, summed, F.lit(0)).alias("size"))
    slots = F.array_compact(F.array(F.when(F.coalesce(F.btrim(name), F.lit("")) != "", "name"), F.when(F.col("n_links") > 0, "links"), F.when(F.col("size") > 0, "size")))
    return out.withColumn("slots", slots)


def validate(filled: DataFrame, threads: DataFrame, thread: str, name: str, title: str, expected: str, total: str, links: str) -> DataFrame:
    """One row a thread: kind, n, hard and soft errors, tags and status.

    threads: thread, title, expected (things the title counts, null if none), total (size told for all, 0 if none), links
    (links seen in the text). Hard: no links, unnamed, names that repeat but for case and blanks, the title as a name among
    several, fewer things than told (with clean.count_matches), fewer links than seen. Soft: sizes missing, a sum of
    sizes more than 15 % off the total, one row that repeats the total. status: structure_fail, content_gap or ok.
    """
    key = lambda c: F.lower(F.regexp_replace(c, r"\s+", ""))
    known = filled.join(threads.select(thread, key(F.col(title)).alias("brindle_title")), thread)
    k = key(F.coalesce(F.col(name), F.lit("")))
    per = known.groupBy(thread).agg(
        F.count("*").alias("n"), F.sum("n_links").alias("n_links"), F.count_if(k == "").alias("unnamed"), F.countDistinct(k).alias("names"),
        F.count_if(k == F.col("brindle_title")).alias("as_title"), F.count_if(F.col("size") == 0).alias("unsized"), F.sum("size").alias("sum_size"), F.max("size").alias("max_size"),
        F.countDistinct(F.array_join("images", " ")).alias("image_sets"), F.min("n_images").alias("least_images"),
    )
    all_ = threads.select(thread, F.col(expected).alias("brindle_expected"), F.col(total).alias("brindle_total"), F.col(links).alias("brindle_links")).join(per, thread, "left")
    n, told = F.coalesce("n", F.lit(0)), F.coalesce("brindle_total", F.lit(0))
    some = F.col("n").isNotNull()
    hard = F.array_compact(F.array(
        F.when(n == 0, "no_link"), F.when(F.col("unnamed") > 0, "unnamed"), F.when(F.col("names") < F.col("n"), "repeated_name"), F.when((F.col("as_title") > 0) & (n > 1), "title_as_name"),
        F.when(some & F.col("brindle_expected").isNotNull() & ~clean.count_matches(n, F.col("brindle_expected")), "too_few"), F.when(some & (F.col("n_links") < F.col("brindle_links")), "links_missing"),
    ))
    aligned = F.abs(F.col("sum_size") - told) <= told * 0.15
    soft = F.array_compact(F.array(F.when(F.col("unsized") > 0, "unsized"), F.when((told > 0) & (F.col("unsized") == 0) & ~aligned, "sum_off"), F.when((told > 0) & (n > 1) & (F.col("max_size") == told), "echo")))
    tags = F.array_compact(F.array(F.when((n > 1) & (F.col("image_sets") == 1) & (F.col("least_images") > 0), "shared_images"), F.when(F.col("least_images") == 0, "no_images")))
    kind = F.when(n == 0, "no_link").when(n == 1, "single").otherwise("multi")
    status = F.when(F.size(hard) > 0, "structure_fail").when(F.size(soft) > 0, "content_gap").otherwise("ok")
    return all_.select(thread, kind.alias("kind"), n.alias("n"), hard.alias("hard"), soft.alias("soft"), tags.alias("tags"), status.alias("status"))


def outcome(frame_kind: Column, status: Column, hard: Column, soft: Column) -> Column:
    """A frame's verdict as one line: status, kind and the first reason."""
    return F.concat_ws(" · ", status, F.concat(F.lit("kind:"), frame_kind), F.concat(F.lit("why:"), F.get(F.concat(hard, soft), F.lit(0))))


def named_links(names: DataFrame, links: DataFrame, scope: str, place: str, name: str, sizes: DataFrame | None = None) -> DataFrame:
    """links with the name that each belongs to, and the layout of its scope.

    Layouts: without names size_then_link if there are two labels of sizes at least, no_name_pack from PACK links on, else
    no_name; names_then_links if all of several names come before the first link (the n-th link is of the n-th name, what
    is over of the last); link_then_name if a link comes before the first name (links are of the name that follows, the
    last ones of the last name); else name_then_link (of the name before). Names and links are dealt out once, by scope, and
    numbered by windows over a scope; then each link stands behind the name of its number. No pairs are formed.
    """
    row, told = F.struct(*links.columns), F.struct(F.col(name).alias("name"))
    part = lambda df, kind, of, said: df.select(F.col(scope).alias("brindle_scope"), F.col(place).alias("brindle_place"), F.lit(kind).alias("brindle_kind"), of.alias("brindle_row"), said.alias("brindle_name"))
    no_row, no_name = F.lit(None).cast(links.select(row).schema[0].dataType), F.lit(None).cast(names.select(told).schema[0].dataType)
    both = part(links, 0, row, no_name).union(part(names, 1, no_row, told))
    if sizes is not None:
        both = both.union(sizes.select(scope, F.lit(None), F.lit(2), no_row, no_name))
    scopes, kind = Window.partitionBy("brindle_scope"), F.col("brindle_kind")
    order = scopes.orderBy("brindle_place", F.desc("brindle_kind")).rowsBetween(Window.unboundedPreceding, 0)
    at = lambda k: F.when(kind == k, F.col("brindle_place"))
    counted = both.where("brindle_scope is not null").withColumns({"brindle_before": F.count_if(kind == 1).over(order), "brindle_nth": F.count_if(kind == 0).over(order)})
    known = counted.withColumns({
        "brindle_names": F.count_if(kind == 1).over(scopes), "brindle_links": F.count_if(kind == 0).over(scopes), "brindle_sizes": F.count_if(kind == 2).over(scopes),
        "brindle_first": F.min(at(1)).over(scopes), "brindle_last": F.max(at(1)).over(scopes), "brindle_link": F.min(at(0)).over(scopes),
    }).where("brindle_kind < 2 and brindle_links > 0")
    n, link = F.col("brindle_names"), F.col("brindle_link")
    layout = F.when((n == 0) & (F.col("brindle_sizes") >= 2), "size_then_link").when((n == 0) & (F.col("brindle_links") >= PACK), "no_name_pack").when(n == 0, "no_name")
    layout = layout.when((n > 1) & (F.col("brindle_last") < link), "names_then_links").when(link < F.col("brindle_first"), "link_then_name").otherwise("name_then_link")
    laid = known.withColumn("layout", layout)
    k = F.when((kind == 1) | (F.col("layout") == "name_then_link"), F.col("brindle_before")).when(F.col("layout") == "names_then_links", F.least("brindle_nth", n)).otherwise(F.least(F.col("brindle_before") + 1, n))
    numbered = scopes.orderBy("brindle_k", F.desc("brindle_kind")).rowsBetween(Window.unboundedPreceding, 0)
    named = laid.withColumn("brindle_k", k).withColumn("brindle_name", F.last("brindle_name", True).over(numbered)).where("brindle_kind = 0")
    return named.select("brindle_row.*", "layout", F.col("brindle_name.name").alias(name))
