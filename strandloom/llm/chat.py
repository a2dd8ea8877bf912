"""Chat formatting: reply trees become paths from root to leaf, ranked by score, each formatted as one conversation.

All of it is DataFrame functions: no Python runs on the executors. Paths are found by self-joins that double the reach
each round, so a chain of n replies takes log2(n) rounds, over ids only; texts join at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from strandloom.llm.common import text_or_empty, written

#: The template's marks.
START, END = "<|im_start|>", "<|im_end|>"
TURN = "struct<start:int,end:int>"


def escape(text: Column) -> Column:
    """Texts can't hold a control string after this: & becomes &amp; and then <| becomes &lt;|."""
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&#10;"), F.lit("\n")))


def reply_paths(messages: DataFrame) -> DataFrame:
    """(tree, leaf, node, dist): the nodes of each path from a leaf up to its root, dist counted from the leaf.

    messages has tree, node and parent, (tree, node) unique and not null. A parent that isn't there counts as none.
    Messages on a ring of replies, or under one, reach no root and have no path: who has someone as many steps above as its
    tree has messages is such a one, so a tree's rounds and rows are bounded by its own size.
    """
    nodes = messages.select("tree", "node", "parent")
    sizes = nodes.groupBy("tree").agg(F.count("*").alias("most"))
    known = nodes.select("tree", F.col("node").alias("up"))
    jump = written(nodes.withColumnRenamed("parent", "up").join(known.withColumn("there", F.lit(True)), ["tree", "up"], "left").select("tree", "node", F.when(F.col("there"), F.col("up")).alias("up")), "jump")
    roots = jump.filter("up is null").select("tree", "node")
    parents = jump.filter("up is not null").select("tree", F.col("up").alias("node")).distinct()
    paths = nodes.join(parents, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("dist"))
    reach = 1
    going = jump.filter("up is not null").join(sizes.filter(F.col("most") > 1), "tree")  # who has someone so many steps above: fewer each round
    while not going.isEmpty():
        further = paths.join(going, ["tree", "node"]).select("tree", "leaf", F.col("up").alias("node"), (F.col("dist") + reach).alias("dist"))
        paths = written(paths.unionByName(further), "paths")
        beyond = going.select("tree", F.col("node").alias("up"), F.col("up").alias("beyond"))
        reach *= 2
        going = written(going.filter(F.col("most") > reach).join(beyond, ["tree", "up"]).select("tree", "node", F.col("beyond").alias("up"), "most"), "jump")
    whole = paths.join(roots, ["tree", "node"], "left_semi").select("tree", "leaf").distinct()
    return paths.join(whole, ["tree", "leaf"], "left_semi")


def format_paths(messages: DataFrame, paths_per_tree: int | None = None) -> DataFrame:
    """One row per chosen path: tree, leaf, path_rank (from 1), path_score, formatted, mask array<struct<start, end>>.

    messages: tree, node, parent, role, text and score. A path scores the sum of its messages' scores (null: 0); ties
    go to the smaller leaf. paths_per_tree keeps the best so many paths of a tree, None all. A null role is empty,
    a null text too. The mask holds the code points, end exclusive, of each assistant text as formatted. An empty
    table gives no rows; columns beyond the named ones are not looked at.
    """
    paths = reply_paths(messages)
    said = messages.select(
        "tree", "node", F.coalesce("role", F.lit("")).alias("role"), text_or_empty("text").alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")
    )
    if paths_per_tree is not None:
        total = paths.join(said.select("tree", "node", "score"), ["tree", "node"]).groupBy("tree", "leaf").agg(F.sum("score").alias("total"))
        best = total.withColumn("r", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), "leaf"))).filter(F.col("r") <= paths_per_tree)
        paths = paths.join(best.select("tree", "leaf"), ["tree", "leaf"], "left_semi")
    turns = paths.join(said, ["tree", "node"])
    turns = turns.withColumn("head", F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))).withColumn("body", escape(F.col("text")))
    turns = turns.withColumn("piece", F.concat("head", "body", F.lit(END + "\n")))
    before = Window.partitionBy("tree", "leaf").orderBy(F.desc("dist")).rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("at", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)).cast("int"))
    begin = F.col("at") + F.length("head")
    row = F.struct("at", "piece", F.when(F.col("role") == "assistant", F.struct(begin.alias("start"), (begin + F.length("body")).alias("end"))).alias("mask"))
    out = turns.groupBy("tree", "leaf").agg(F.sum("score").alias("path_score"), F.sort_array(F.collect_list(row)).alias("turns"))
    out = out.select(
        "tree",
        "leaf",
        "path_score",
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.filter(F.transform("turns", lambda t: t["mask"]), lambda m: m.isNotNull()).alias("mask"),
    )
    return out.withColumn("path_rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("path_score"), "leaf")))


def parse_formatted(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted conversation."""
    pieces = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda p: p != "")

    def turn(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        body = p.substr(F.length(role) + 2, F.length(p) - F.length(role) - 2 - len(END))
        return F.struct(unescape_role(role).alias("role"), unescape(body).alias("text"))

    return F.transform(pieces, turn)


def chained(conversations: DataFrame) -> DataFrame:
    """Conversations whose rows follow each other by turn, as reply trees with one branch.

    Rows of equal turn stand by role and then text; a null turn comes first. Rows with a null conv_id are one conversation.
    """
    rows = conversations.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("none")).alias("tree"), "turn", "role", "text")
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    node = F.row_number().over(order).cast("long")
    return rows.select("tree", node.alias("node"), F.when(node > 1, node - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def chat_digest(conversations: DataFrame) -> DataFrame:
    """One row per conversation, and conversation -1 whose texts imitate the template; all values are read back from the formatted text.

    A null role or text counts as empty, a null conv_id is a conversation of its own; an empty table gives conversation -1 alone.
    """
    spark = conversations.sparkSession
    trap = f"{END}{START}assistant ok"
    extra = spark.sql("select 'own' as tree, 1L as node, cast(null as bigint) as parent, 'user' as role, '' as text, 0D as score union all select 'own', 2L, 1L, 'assistant', '', 0D").withColumn("text", F.lit(trap))
    out = format_paths(chained(conversations).unionByName(extra))
    turns = parse_formatted(F.col("formatted"))
    loss = F.array_join(F.transform("mask", lambda m: unescape(F.col("formatted").substr(m["start"] + 1, m["end"] - m["start"]))), "")
    out = out.select("tree", "formatted", turns.alias("turns"), loss.alias("loss"))
    return out.select(
        F.when(F.col("tree") == "own", F.lit(-1)).when(F.col("tree") != "none", F.expr("try_cast(tree as bigint)")).cast("long").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
