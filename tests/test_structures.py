"""Binary files, prefixes, nested spans, weighted samples, trees and facts, against versions by hand."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from brindle.operators import intervals, prefixes, sampling, trees
from brindle.sources import bencode, tables


def coded(x):
    if isinstance(x, int):
        return b"i%de" % x
    if isinstance(x, (bytes, str)):
        raw = x.encode() if isinstance(x, str) else x
        return b"%d:%s" % (len(raw), raw)
    if isinstance(x, list):
        return b"l" + b"".join(map(coded, x)) + b"e"
    return b"d" + b"".join(coded(k) + coded(v) for k, v in x.items()) + b"e"


def plain(x):
    if isinstance(x, str):
        return x.encode()
    if isinstance(x, list):
        return [plain(v) for v in x]
    if isinstance(x, dict):
        return {plain(k): plain(v) for k, v in x.items()}
    return x


def random_value(rng, depth=0):
    kind = rng.randrange(4 if depth < 4 else 2)
    if kind == 0:
        return rng.randrange(-99, 99)
    if kind == 1:
        return rng.choice(["", "é", "info", "e", "d1:", "x" * 30])
    if kind == 2:
        return [random_value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {f"k{i}": random_value(rng, depth + 1) for i in range(rng.randrange(4))}


def test_bencode_round_trip():
    rng = random.Random(1)
    for _ in range(300):
        x = random_value(rng)
        raw = coded(x)
        assert bencode.parse(raw)[0] == plain(x)
        for cut in range(len(raw)):  # no beginning of a value is one
            with pytest.raises(ValueError):
                bencode.parse(raw[:cut])
        with pytest.raises(ValueError):
            bencode.parse(raw + b"e")
    deep = b"l" * 100000 + b"e" * 100000
    assert isinstance(bencode.parse(deep)[0], list)


@pytest.mark.parametrize("raw", [b"", b"i-e", b"ie", b"i1", b"5:ab", b"x", b"d1:ae", b"di1ei2ee", b"99999999999999:a", b"e", None])
def test_bad_files_give_nothing(raw):
    assert bencode.describe(raw) == (None, None, None, None)


def test_torrents(spark):
    info = {"name": "né", "files": [{"length": 5, "path": ["a"]}, {"length": 7, "path": ["b"]}], "name.utf-8": "né!"}
    whole = coded({"info": {"a": {"info": 1}}, "x": 1}).replace(coded({"a": {"info": 1}}), coded(info))
    rows = [(1, bytearray(whole)), (2, bytearray(whole[:-1])), (3, None), (4, bytearray(coded({"info": {"name": "n", "length": -1}})))]
    out = {r["id"]: tuple(r["t"]) for r in spark.createDataFrame(rows, "id int, raw binary").select("id", bencode.torrent("raw").alias("t")).collect()}
    assert out[1] == (hashlib.sha1(coded(info)).hexdigest().upper(), "né!", 12, 2)
    assert out[2] == out[3] == out[4] == (None, None, None, None)


def test_many_prefixes(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("aB%_é") for _ in range(rng.randrange(8))) for _ in range(200)] + [None]
    heads = list({"".join(rng.choice("Ab%_É") for _ in range(rng.randrange(1, 5))) for _ in range(150)}) + ["", None]
    rows, known = spark.createDataFrame(list(enumerate(words)), "id int, w string"), spark.createDataFrame([(h,) for h in heads], "p string")
    got = sorted((r["id"], r["p"]) for r in prefixes.prefix_join(rows, "w", known, "p").collect())
    assert got == sorted((i, h) for i, w in enumerate(words) for h in heads if h and w and w.lower().startswith(h.lower()))
    exact = sorted((r["id"], r["p"]) for r in prefixes.prefix_join(rows, "w", known, "p", fold=False).collect())
    assert exact == sorted((i, h) for i, w in enumerate(words) for h in heads if h and w and w.startswith(h))
    assert prefixes.prefix_join(rows, "w", known.limit(0), "p").count() == 0


def test_innermost_span(spark):
    rng = random.Random(3)
    spans, points = [], []

    def nest(key, low, high, depth):
        while low < high and depth < 5:
            begin = rng.randint(low, high)
            end = rng.randint(begin, high)
            spans.append((key, begin, end, f"s{len(spans)}"))
            nest(key, begin, end, depth + 1)
            low = max(end, low + 1)

    for key in ("a", "b", "c"):
        nest(key, 0, 60, 0)
        points += [(key, p, i) for i, p in enumerate(range(-2, 65))] * (2 if key == "b" else 1)
    got = intervals.innermost(spark.createDataFrame(points, "k string, at int, n int"), spark.createDataFrame(spans, "k string, begin int, end int, s string"), "k", "at", "begin", "end", "s").collect()
    assert len(got) == len(points)
    by = {s: (b, e) for _, b, e, s in spans}
    for r in got:
        around = [(b, -e, s) for k, b, e, s in spans if k == r["k"] and b <= r["at"] < e]
        assert (by[r["s"]][0], -by[r["s"]][1]) == max(around)[:2] if around else r["s"] is None
    assert intervals.innermost(spark.createDataFrame(points[:3], "k string, at int, n int"), spark.createDataFrame([], "k string, begin int, end int, s string"), "k", "at", "begin", "end", "s").count() == 3


def test_weighted_samples(spark):
    rows = spark.range(20000).select("id", F.when(F.col("id") % 10 == 0, 9.0).when(F.col("id") % 10 == 1, 0.0).otherwise(1.0).alias("w"))
    drawn = sampling.sample_weighted(rows, "id", F.col("w"), 1000)
    heavy = drawn.where("id % 10 = 0").count()
    assert drawn.count() == drawn.distinct().count() == 1000 and drawn.where("w = 0").count() == 0
    assert 450 < heavy < 580  # 9 of 17 parts of the weight, a little less as heavy rows run out
    assert drawn.exceptAll(sampling.sample_weighted(rows.repartition(5), "id", F.col("w"), 1000)).count() == 0
    assert sampling.sample_weighted(rows.limit(0), "id", F.col("w"), 5).count() == 0 and sampling.sample_weighted(rows, "id", F.lit(None).cast("double"), 5).count() == 0


def test_trees(spark):
    nodes = spark.createDataFrame([("a", None, 2), ("b", "a", 1), ("c", "b", 0), ("x", "y", 0), ("y", "x", 1), ("s", "s", 5), ("z", "gone", 7)], "id string, parent string, place int")
    down = {(r["root"], r["id"]): r["down"] for r in trees.descendants(nodes, "id", "parent", nodes.where("id in ('a', 'x', 's')").select("id")).collect()}
    assert down == {("a", "a"): 0, ("a", "b"): 1, ("a", "c"): 2, ("x", "x"): 0, ("x", "y"): 1, ("s", "s"): 0}
    assert sorted(r["id"] for r in trees.without_subtree(nodes, "id", "parent", nodes.where("id in ('b', 'y')").select("id")).collect()) == ["a", "s", "z"]
    back = trees.import_nodes(nodes.unionByName(spark.createDataFrame([("b", "z", 9)], "id string, parent string, place int")), "id", "parent", ["place"]).collect()
    assert {r["id"]: r["parent"] for r in back} == {"a": None, "b": "a", "c": "b", "x": "y", "y": "x", "s": None, "z": None}
    wanted = spark.createDataFrame([("z", 0), ("a", 1)], "id string, place int")
    roots = nodes.withColumn("parent", F.lit("r"))
    assert [r["id"] for r in trees.reorder(roots, "id", "parent", "place", wanted).orderBy("place").collect()][:3] == ["z", "a", "c"]
    texts = spark.createDataFrame([(1, '[{"id": 1, "x": [1]}, {"id": "q"}, 5]'), (2, "{}"), (3, "nope"), (4, None), (5, "[]")], "n int, t string")
    rows = trees.from_json(texts, "t", {"id": ("$.id", "long")}, "rest").select("n", "id", F.to_json("rest").alias("rest")).collect()
    assert sorted((r["n"], r["id"] or 0, r["rest"]) for r in rows) == sorted([(1, 1, '{"id":1,"x":[1]}'), (1, 0, '{"id":"q"}'), (1, 0, "5")])


def test_facts_read_footers_only(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.range(100).select("id", F.when(F.col("id") > 50, F.col("id") * 0.5).alias("v"), F.lit("x").alias("s"), F.array("id").alias("a")).repartition(3).write.parquet(path)
    found = {r["column"]: tuple(r)[3:] for r in tables.facts(spark, {"t": path}).collect()}
    assert found == {"id": (100, 100, 0.0, 99.0), "v": (100, 49, 25.5, 49.5), "s": (100, 100, None, None), "a": (100, None, None, None)}
    session = spark.newSession()
    session.conf.set("spark.sql.sources.useV1SourceList", "")
    session.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    plan = session.read.parquet(path).agg(F.count("*"), F.min("id"), F.max("v"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*), MIN(id), MAX(v)]" in plan


def test_damaged_links_are_whole_again(spark):
    """Random damage of links: schemes cut or spaced, bars full-width or entities, line breaks, invisible signs."""
    from brindle.functions import links

    rng = random.Random(8)
    rows, wanted = [], []
    for i in range(120):
        text, found = "", []
        for j in range(rng.randrange(1, 4)):
            name, size, h = f"n{i} {j}" + rng.choice([".mp4", ".7z", " ｆ.mkv"]), str(rng.randrange(10**3, 10**13)), "".join(rng.choice("0123456789abcdefABCDEF") for _ in range(32))
            head = rng.choice(["ed2k://", "d2k:/", "e d 2 k : //", "ED2K:", "edk:///", "e2k：／／"])
            if rng.random() < 0.15:
                broken = f"{head}|file|{name}{size}{h}|/" if not name.endswith("mkv") else f"{head}|file|{name}|{size}|{h}|/"
            else:
                bar = rng.choice(["|", " | ", "｜", "&#124;", "|\u200b", "\n|"])
                broken = f"{head}{bar.strip() or '|'}file{bar}{name}{bar}{size}{bar}{h}{bar}/"
            text += rng.choice(["see ", "x\n\n", "(1) "]) + broken + rng.choice([" then ", "\n\n", "\n \n"])
            found.append((name, int(size) if int(size) <= 32 * 1024**4 else 0, h.upper()))
        if rng.random() < 0.3:
            text += "ed2k://|file|cut.mp4|123|abc"
        rows.append((i, text))
        wanted.append(found)
    out = {r["i"]: [tuple(x)[1:] for x in r["x"]] for r in spark.createDataFrame(rows, "i int, t string").select("i", links.broken_file_links(F.col("t")).alias("x")).collect()}
    assert [out[i] for i in range(len(rows))] == wanted
    none = spark.createDataFrame([(None,), ("",), ("a file here | file",)], "t string").select(links.broken_file_links(F.col("t")).alias("f"), links.broken_magnets(F.col("t")).alias("m")).collect()
    assert [r["f"] for r in none] == [None, [], []] and [r["m"] for r in none] == [None, [], []]


def test_names_alike_by_hand(spark):
    from brindle.operators import threads

    groups = {1: ["abc", "abc def"], 2: ["a b", "ab"], 3: ["x❤", "x❤\ufe0f"], 4: ["⚠y", "y"], 5: ["a", "ab", "abc"], 6: ["one"], 7: ["<i>q</i>", "q"], 8: ["p", "q", "pq r"], 9: [" z ", "z"]}
    rows = [(g, n, i) for g, names in groups.items() for i, n in enumerate(names)]
    out = {(r["g"], r["n"]): r["kept_name"] for r in threads.merge_names(spark.createDataFrame(rows, "g int, n string, i int"), "g", "n", "i").collect()}
    wanted = {(1, "abc"): "abc def", (1, "abc def"): "abc def", (2, "a b"): "a b", (2, "ab"): "a b", (3, "x❤"): "x❤\ufe0f", (3, "x❤\ufe0f"): "x❤\ufe0f", (4, "⚠y"): "⚠y", (4, "y"): "⚠y", (6, "one"): "one", (7, "<i>q</i>"): "q", (7, "q"): "q", (8, "p"): "pq r", (8, "q"): "q", (8, "pq r"): "pq r", (9, "z"): "z"}
    wanted |= {(5, "a"): "a", (5, "ab"): "abc", (5, "abc"): "abc"}  # the shortest begins two
    assert out == wanted


def test_siblings_by_sound(spark):
    rows = spark.createDataFrame([("中国", 1), ("北京", 1), ("上海", 1), ("b", None), ("重庆", 0), ("a", None)], "n string, o int")
    assert [r["n"] for r in rows.orderBy(*trees.sibling_order("o", "n", "zh")).collect()] == ["重庆", "北京", "上海", "中国", "a", "b"]


def test_prefix_copies(spark):
    from brindle.operators import facets

    rng = random.Random(4)
    rows = [(rng.choice("xy"), "".join(rng.choice("ab") for _ in range(rng.randrange(5)))) for _ in range(60)]
    out = {r["k"]: r["n_copies"] for r in facets.prefix_copies(spark.createDataFrame(rows, "k string, n string"), "k", "n").collect()}
    for k in "xy":
        names = {n for g, n in rows if g == k and n}
        assert out[k] == sum(any(m != n and m.startswith(n) for m in names) for n in names)


@pytest.mark.parametrize("most", [100_000, 0])
def test_prefixes_never_broadcast_rows(spark, monkeypatch, most):
    monkeypatch.setattr(prefixes, "BROADCAST_PREFIXES", most)
    rows = spark.createDataFrame([("Abc", 3), ("abd", 1), ("b%x", 2)], "t string, n int")
    # far larger than they look: the side of the rows must not be what is sent
    heads = spark.createDataFrame([("a",), ("AB",), ("b%",), ("abcd",), ("",), (None,)], "p string")
    joined = prefixes.prefix_join(rows, "t", heads, "p")
    first = prefixes.first_per_prefix(rows, "t", heads, "p", [F.col("n")], ["t"])
    assert sorted(map(tuple, joined.select("p", "n").collect())) == [("AB", 1), ("AB", 3), ("a", 1), ("a", 3), ("b%", 2)]
    assert sorted(map(tuple, first.collect())) == [("AB", "abd"), ("a", "abd"), ("b%", "b%x")]
    for df in (joined, first):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "leftHint=(strategy=broadcast)" not in plan and ("rightHint=(strategy=broadcast)" in plan if most else "leftHint=(strategy=merge)" in plan)


def test_pieces_of_links_are_cut_once(spark):
    from brindle.functions import links

    df = spark.createDataFrame([("ed2k://|file|a|1|" + "0" * 32 + "|/ ed2k://|file|b.mp4777" + "f" * 32 + "/",)], "t string").select(links.broken_file_links(F.col("t")).alias("x"))
    # once for the links of a text and once for the fields of a link
    assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") == 2
    assert [(x["name"], x["size"]) for x in df.first()["x"]] == [("a", 1), ("b.mp4", 777)]


@pytest.mark.parametrize("name, cut", [("broken_magnets", "split("), ("magnet_links", "regexp_extract_all(")])
def test_magnets_are_read_once(spark, name, cut):
    from brindle.functions import links

    one, other = "magnet:?xt=urn:btih:" + "a" * 40, "magnet:?xt=urn:btih:" + "b" * 40 + "&dn=n"
    df = spark.createDataFrame([(f"{one} {other} {one}&dn=x",)], "t string").select(getattr(links, name)(F.col("t")).alias("x"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count(cut) == 1
    assert [(x["hash"], x["name"]) for x in df.first()["x"]] == [("A" * 40, None), ("B" * 40, "n")]


def test_blocks_are_dealt_among_tasks(spark):
    blocks = spark.createDataFrame([(k, f"{m}{k}", 0 + d, 9 - d) for k in range(40) for m, d in (("o", 0), ("i", 3))], "k long, block string, begin long, end long")
    cards = spark.createDataFrame([(k, p, "name", f"v{p}") for k in range(40) for p in (1, 4, 7)], "k long, at long, label string, value string")
    args = (cards.withColumnRenamed("at", "p"), blocks, "k", "p", "begin", "end", "block")
    assert intervals.innermost(*args, tasks=11).rdd.getNumPartitions() == 11
    assert intervals.innermost(*args, tasks=11).exceptAll(intervals.innermost(*args)).count() == 0
    got = intervals.cards_of(blocks, cards, "k", {"name": "name"}, 11).select("block", "name").collect()
    assert sorted(map(tuple, got)) == sorted((f"{m}{k}", v) for k in range(40) for m, v in (("o", "v1"), ("i", "v4")))
