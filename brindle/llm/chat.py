"""Reply trees to conversations, and conversations to training text with a loss mask. Native."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.session import Scratch

TURN, SEP, END = "<|turn|>", "<|sep|>", "<|end|>"
#: Strings that must not occur in the text of a turn: the template's own, and those of other common templates.
CONTROL = (TURN, SEP, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")


def escape(text: Column) -> Column:
    """Doubles backslashes and puts one behind the first character of each control string."""
    starts = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL)
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"(?:{starts})", "$0\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def reply_paths(messages: DataFrame, scratch: Scratch, branches: int = 1) -> DataFrame:
    """The best root-to-leaf paths of reply trees: tree, leaf, rank, node, depth (0 at the leaf).

    messages: tree, id, parent, score; ids are unique in a tree. A message whose parent is null or
    missing is a root. Self-joins double the reach of a table of ancestors until no message has
    one so far up; each row also has the scores passed on the way. Leaves climb by these tables, widest
    first, to their root and the sum of their path, one row a leaf, and are ranked by it; then only the paths of
    those that are kept are listed, each ancestor once. So joins are logarithmic in the depth, and rows are
    those of messages and of kept paths. A path's score is the sum of its messages' scores (null: 0); ties go to
    the smaller leaf. The first `branches` paths of each root are kept. Branches that run into a cycle have no
    root and go.
    """
    nodes = messages.select("tree", "id", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    jumps = [scratch.save(nodes.select("tree", "id", F.col("parent").alias("up"), "score").join(nodes.select("tree", F.col("id").alias("up")), ["tree", "up"]).select("tree", "id", "up", "score"))]
    total = nodes.count()
    while True:
        near = jumps[-1]
        far = near.select("tree", F.col("id").alias("up"), F.col("up").alias("top"), F.col("score").alias("more"))
        wider = scratch.save(near.join(far, ["tree", "up"]).select("tree", "id", F.col("top").alias("up"), (F.col("score") + F.col("more")).alias("score")))
        if wider.isEmpty():
            endless = None
            break
        jumps.append(wider)
        if 1 << (len(jumps) - 1) > total:  # further than there are messages: a cycle
            endless = wider.select("tree", F.col("id").alias("leaf"))
            break
    leaves = nodes.select("tree", "id").join(jumps[0].select("tree", F.col("up").alias("id")), ["tree", "id"], "left_anti").select("tree", F.col("id").alias("leaf"))
    if endless is not None:
        leaves = leaves.join(endless, ["tree", "leaf"], "left_anti")
    at = leaves.select("tree", "leaf", F.col("leaf").alias("node"), F.lit(0.0).alias("sum"))
    for table in reversed(jumps):
        up = table.select("tree", F.col("id").alias("node"), "up", "score")
        at = at.join(up, ["tree", "node"], "left").select("tree", "leaf", F.coalesce("up", "node").alias("node"), (F.col("sum") + F.coalesce("score", F.lit(0.0))).alias("sum"))
    rooted = at.join(nodes.select("tree", F.col("id").alias("node"), "score"), ["tree", "node"]).select("tree", "leaf", F.col("node").alias("root"), (F.col("sum") + F.col("score")).alias("score"))
    order = Window.partitionBy("tree", "root").orderBy(F.desc("score"), "leaf")
    best = scratch.save(rooted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= branches).select("tree", "leaf", "rank"))
    path = best.select("tree", "leaf", "rank", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("depth"))
    for k in reversed(range(len(jumps))):
        up = jumps[k].select("tree", F.col("id").alias("node"), "up")
        step = F.array(F.struct("node", "depth"), F.struct(F.col("up").alias("node"), (F.col("depth") + (1 << k)).alias("depth")))
        path = path.join(up, ["tree", "node"], "left").select("tree", "leaf", "rank", F.explode(step).alias("s")).where("s.node is not null").select("tree", "leaf", "rank", "s.node", "s.depth")
    return scratch.save(path)


def format_paths(paths: DataFrame, messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per path: tree, leaf, rank, formatted, spans.

    spans has a struct per turn, in order: turn_start, and loss_start and loss_end where the turn
    is under the loss mask (else null), all as code points from the start of formatted.
    messages: tree, id, role, text (null: empty).
    """
    said = messages.select("tree", F.col("id").alias("node"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = paths.join(said, ["tree", "node"])
    turns = turns.select("tree", "leaf", "rank", "depth", "role", F.concat(F.lit(TURN), escape(F.col("role")), F.lit(SEP)).alias("head"), escape(F.col("text")).alias("body"))
    turns = turns.select("tree", "leaf", "rank", "depth", "role", F.length("head").alias("h"), F.length("body").alias("b"), F.concat("head", "body", F.lit(END)).alias("piece"))
    before = Window.partitionBy("tree", "leaf", "rank").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("at", F.coalesce(F.sum(F.length("piece").cast("long")).over(before), F.lit(0).cast("long")))
    masked = F.col("role") == loss_role
    span = F.struct(F.col("at").alias("turn_start"), F.when(masked, F.col("at") + F.col("h")).alias("loss_start"), F.when(masked, F.col("at") + F.col("h") + F.col("b")).alias("loss_end"))
    grouped = turns.groupBy("tree", "leaf", "rank").agg(F.sort_array(F.collect_list(F.struct(F.col("at"), "piece", span.alias("span")))).alias("turns"))
    return grouped.select("tree", "leaf", "rank", F.array_join(F.col("turns.piece"), "").alias("formatted"), F.col("turns.span").alias("spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds what is read from formatted and spans: turns (role, text) and loss (an array of texts)."""
    pieces = F.slice(F.split("formatted", re.escape(TURN)), 2, 2147483647)

    def turn(p: Column) -> Column:
        body = F.substring_index(p, SEP, -1)
        return F.struct(unescape(F.substring_index(p, SEP, 1)).alias("role"), unescape(F.substring_index(body, END, 1)).alias("text"))

    def under(x: Column) -> Column:
        first = (x["s"]["loss_start"] - x["s"]["turn_start"] - len(TURN) + 1).cast("int")
        return unescape(F.substr(x["p"], first, (x["s"]["loss_end"] - x["s"]["loss_start"]).cast("int")))

    both = F.arrays_zip(F.col("pieces").alias("p"), F.col("spans").alias("s"))
    out = formatted.withColumn("pieces", pieces)
    loss = F.transform(F.filter(both, lambda x: x["s"]["loss_start"].isNotNull()), under)
    return out.withColumns({"turns": F.transform("pieces", turn), "loss": loss}).drop("pieces")


def format_conversations(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Linear conversations (conv_id, turn, role, text) as formatted texts with their loss spans.

    Each row replies to the one before it by turn (then role, text; nulls first), so a conversation
    is a tree with one branch. Returns conv_id, formatted, spans, turns and loss, the last two read
    back from the first two. Null texts and roles are empty; rows of equal turn all stay, and so do
    repeated rows; rows without a conv_id make up one conversation whose id is null. Other columns
    are ignored. An empty table gives no rows. A conversation is one row of the result, so its
    turns meet in one task.
    """
    scratch = Scratch(conversations.sparkSession, "chat")
    rows = conversations.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("tree"), F.col("turn"), F.col("role").cast("string"), F.col("text").cast("string"))
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    messages = scratch.save(rows.withColumn("id", F.row_number().over(order).cast("long")).select("tree", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text"))
    out = read_back(format_paths(reply_paths(messages, scratch), messages, loss_role))
    return out.select(F.when(F.col("tree") != "", F.col("tree").cast("long")).alias("conv_id"), "formatted", "spans", "turns", "loss")
