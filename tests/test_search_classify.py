import pytest
from pyspark.sql import functions as F

from brindle.functions import classify, markup, pages, search
from brindle.functions.classify import Rule
from brindle.operators import boards, queue, ranking, records, trees


def one(spark, column, *values):
    return spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values)))).select(column).first()[0]


@pytest.mark.parametrize("query, mode, want", [
    ('"big cat" dog', "smart", [('big cat dog', False), ("big cat", True), ("dog", False)]),
    ("alpha be c", "smart", [("alpha be c", False), ("alpha", True), ("be", False)]),
    ("alpha", "smart", [("alpha", True)]),
    ("the of", "smart", [("the of", False)]),
    ("a1 b2 a1", "exact", [("a1", True), ("b2", True)]),
    ("the", "exact", [("the", True)]),
    ("影片名称 x", "fuzzy", [("影片名称", False), ("x", False), ("影片名称 x", False), ("影片", False), ("片名", False), ("名称", False)]),
    ('x "x"', "fuzzy", [("x", False)]),
    ("", "fuzzy", [("", False)]),
])
def test_keywords(spark, query, mode, want):
    assert search.plan(spark, query, mode) == want


def test_routes():
    assert [search.route(q) for q in ("x", " ", "ab", "A" * 32, "f" * 40, "f" * 39)] == ["none", "none", "search", "hash", "hash", "search"]


def test_matches_and_scores(spark):
    name = F.col("c0")
    assert not one(spark, search.matches(name, [], "exact"), "x")
    assert one(spark, search.matches(name, [("50%", True)], "exact"), "50% off") and not one(spark, search.matches(name, [("5_%", True)], "exact"), "50% off")
    assert one(spark, search.score(name, [("red", False)], "red"), "red") == pytest.approx(10 + 100 + 40 + 60 + 40)
    assert one(spark, search.score(name, [("red", False)], "red"), "") == 0


HEADS = [Rule(k, starts=(k,)) for k in ("不合格：资源名", "不合格：链接", "不合格：预览", "不合格：容量")] + [Rule("不合格：待核", starts=("不合格：待核", "待核：", "待核:"))]
FAMILIES = [Rule("不合格：预览", has=("预览", "配图")), Rule("不合格：链接", has=("链数不合规", "漏链", "链形态不一致", "定型为")), Rule("不合格：资源名", has=("资源名", "未切开", "等于帖标题", "标题写×")), Rule("不合格：容量", has=("容量", "大小为0"))]


@pytest.mark.parametrize("outcome, kind", [
    ("不合格：链接 · 形态:单资源多链接", "不合格：链接"),
    ("不合格：预览 · 原因:共享", "不合格：预览"),
    ("不合格：待核 · 原因:配额", "不合格：待核"),
    ("待核：正文含目标链接 · 原因:x", "不合格：待核"),
    ("人工已审 · 不合格：容量 · 原因:写出了大小", "不合格：容量"),
    ("不合格：结构 · 形态:多资源单链接 · 原因:【识别错误】多资源预览图完全相同", "不合格：预览"),
    ("不合格：结构 · 形态:单资源单链接 · 原因:【识别错误】标题写×3，实际入库1", "不合格：资源名"),
    ("【识别错误】定型为单资源单链接，但填出多条链（链形态不一致）", "不合格：链接"),
    ("【识别错误】容量不合规：帖子写14.80GB，入库写0.0MB", "不合格：容量"),
    ("", ""),
])
def test_outcome_kinds(spark, outcome, kind):
    assert one(spark, classify.outcome_kind(F.col("c0"), HEADS, FAMILIES, "不合格：资源名", "人工已审 · ", ("原因:", "原因：")), outcome) == kind


@pytest.mark.parametrize("title, closed, cut", [("a【5V/2.49GB/5配额", "a【5V/2.49GB/5配额】", False), ("a【abc", "a【abc", False), ("a【x】", "a【x】", False), ("a…", "a…", True), ("a...【5V", "a...【5V】", True), ("a【", "a【", True), ("one…two", "one…two", False), ("[12P", "[12P]", False), ("", "", False)])
def test_titles(spark, title, closed, cut):
    assert one(spark, classify.close_bracket(F.col("c0")), title) == closed
    assert one(spark, classify.is_truncated_title(F.col("c0")), title) is cut


@pytest.mark.parametrize("name, weak", [("", True), ("❤️", True), ("★??", True), ("甲", False), ("OM1", False), ("A", True), ("a title", True), ("real name", False), (None, True)])
def test_weak_names(spark, name, weak):
    df = spark.createDataFrame([(name, "a  title", "ab12")], "n string, t string, h string")
    assert df.select(classify.is_weak_name(F.col("n"), F.col("t"), F.col("h"))).first()[0] is weak


def test_cards_and_metadata(spark):
    text = "intro\n【影 片名称】：some 【inner】 name\n[大小]: 5GB\n  more\n【空】\n【大小】9GB"
    found = [tuple(x) for x in one(spark, pages.cards(F.col("c0")), text)]
    assert found == [("影片名称", "some 【inner】 name"), ("大小", "5GB\nmore"), ("空", ""), ("大小", "9GB")]
    assert one(spark, pages.metadata(pages.cards(F.col("c0")), {"大小": "size"}), text) == {"影片名称": "some 【inner】 name", "size": "5GB\nmore"}
    assert one(spark, pages.cards(F.col("c0")), "no fields") == []


def test_posts_and_lists(spark):
    page = '<div id="post_1"><a class="xi2">ann</a><td id="postmessage_1">one<br>two</td></div><div id="post_2"><a class="xi2">bob</a><td id="postmessage_2"> </td></div><div id="post_3"><a class="xi2">ann</a><td id="postmessage_3">three</td></div>'
    read = lambda html: spark.createDataFrame([(html,)], "html string").withColumn("page", markup.tree("html")).select(pages.posts(F.col("page"))).first()[0]
    assert [tuple(p)[:4] for p in read(page)] == [("1", 1, "ann", "one\ntwo"), ("3", 2, "ann", "three")]
    assert read("") == [] and one(spark, pages.list_rows(F.col("c0")), "<p>") == []
    sticky = '<tbody id="stickthread_5"><a href="thread-5-1-1.html">up</a></tbody>'
    assert len(one(spark, pages.list_rows(F.col("c0")), sticky)) == 1 and one(spark, pages.list_rows(F.col("c0"), skip_sticky=True), sticky) == []


def test_ancestors_with_a_cycle(spark):
    nodes = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("z", "gone"), ("s", "s")], "id string, parent string")
    got = {(r["id"], r["ancestor"]): r["up"] for r in trees.ancestors(nodes, "id", "parent").collect()}
    assert got == {("b", "a"): 1, ("c", "b"): 1, ("c", "a"): 2, ("x", "y"): 1, ("y", "x"): 1}
    assert trees.ancestors(nodes.limit(0), "id", "parent").count() == 0


def test_spread_plan(spark):
    df = spark.createDataFrame([(100000 + 2000 * i,) for i in range(51)], "v long")
    assert ranking.spread_plan(df, "v", [0.1, 0.9], 30, (0.0, 1.0), 0.5) == (70000.0, 230000.0)
    assert ranking.spread_plan(df.limit(2), "v", [0.1, 0.9], 30, (0.0, 1.0), 0.5) == (0.0, 1.0)


def test_requeue_and_stubs(spark):
    q = spark.createDataFrame([("a", "failed", "e", 2), ("b", "done", None, 0)], "url string, status string, last_error string, fail_count int")
    assert sorted(map(tuple, records.requeue(q, F.col("status") == "failed").collect()), key=str) == [("a", "pending", None, 0), ("b", "done", None, 0)]
    stored = spark.createDataFrame([("a", False), ("b", True)], "url string, stub boolean")
    new = spark.createDataFrame([("a", True), ("b", True), ("c", True)], "url string, stub boolean")
    assert sorted(map(tuple, records.add_stubs(stored, new, "url", F.col("stub")).collect())) == [("a", False), ("b", True), ("c", True)]
    assert sorted(map(tuple, records.add_stubs(stored, new, "url", F.col("stub"), force=True).collect())) == [("a", False), ("a", True), ("b", True), ("c", True)]
    with pytest.raises(ValueError):
        records.purge(stored, ["hash"])


def test_delays(spark):
    df = spark.createDataFrame([("k", i, r) for i, r in enumerate([0.0, 0.5, 0.0, 0.0])], "k string, i int, rate double")
    assert [round(r["delay"], 4) for r in queue.delays(df, "k", "i", "rate", 2.0, 1.0, 20.0).orderBy("i").collect()] == [1.8, 8.0, 7.2, 6.48]


def test_board_heads(spark):
    df = spark.createDataFrame([("1:2",), ("1:3",), ("2:7",), ("3",), ("",), (None,)], "board string")
    assert sorted(tuple(r)[:2] for r in boards.scan_heads(df).collect()) == [("1", "1"), ("2", "2:7"), ("3", "3")]
    assert sorted(r[0] for r in boards.queue_keys(df).collect()) == ["1", "1:2", "1:3", "2", "2:7", "3"]


def test_skip_reason_of_rows_without_value(spark, tmp_path):
    from brindle.plans import classification

    rows = [(1, "click", 0.0), (2, "click", None), (3, "click", 2.0), (4, "error", 0.0), (6, "view", 0.0)]
    spark.createDataFrame(rows, "event_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {tuple(r) for r in classification.x22_skip_reason(spark, str(tmp_path)).collect()}
    assert got == {("CLICK", 1), ("click", 1), ("kept", 1), ("skipped", 1), ("view", 1)}


@pytest.mark.parametrize("mode", ["exact", "smart", "fuzzy"])
def test_keywords_name_each_step_once(spark, mode):
    df = spark.createDataFrame([('"a b" word',)], "q string").select(search.keywords(F.col("q"), mode))
    # the query itself is cut at its quotes and separators, not once more for each keyword
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") <= 4


def test_small_files_with_much_work_are_spread(spark):
    from brindle.plans.catalogue import spread

    cores = spark.sparkContext.defaultParallelism
    one, many = spark.range(100).coalesce(1), spark.range(100, numPartitions=3 * cores)
    assert spread(one).rdd.getNumPartitions() >= cores and sorted(r[0] for r in spread(one).collect()) == list(range(100))
    assert spread(many).rdd.getNumPartitions() == 3 * cores


def test_named_links_are_dealt_out_once(spark):
    from brindle.operators import frames

    names = spark.createDataFrame([(1, 1, "a"), (1, 3, None), (2, 9, "z"), (None, 1, "x")], "t long, at int, name string")
    found = spark.createDataFrame([(1, 0, "h"), (1, 2, "i"), (1, 4, "j"), (2, 9, "k"), (3, 1, "l"), (None, 2, "m")], "t long, at int, hash string")
    out = frames.named_links(names, found, "t", "at", "name", names.limit(0).select("t", "at"))
    assert sorted(out.collect(), key=str) == sorted([(1, 0, "h", "link_then_name", "a"), (1, 2, "i", "link_then_name", None), (1, 4, "j", "link_then_name", None), (2, 9, "k", "name_then_link", "z"), (3, 1, "l", "no_name", None)], key=str)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1
