"""Reply trees: root-to-leaf paths by pointer doubling, ranked, each formatted as one conversation.

Every message points to its parent. Self-joins double the reach of the pointers,
so depth, root and the score of the path from the root are known after as many
joins as the depth has binary digits. Leaves are ranked by score within their
tree, and the messages of the chosen paths are gathered with the same pointers.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vqspark.llm.graph import cut

#: Fixed values of the template: a turn is OPEN role CLOSE text END.
OPEN, CLOSE, END = "<s>[INST]", "[/INST]", "</s>"
#: What may steer a model and is broken up inside texts and roles.
CONTROL = r"(?<=<)(?=/?s>|</?SYS>>)|(?<=\[)(?=/?INST\])"
MAX_ROUNDS = 40


def escape(text: Column) -> Column:
    r"""Doubles each ``\`` and puts one after the first character of each control string."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, "\\\\")


def unescape(text: Column) -> Column:
    r"""Takes away the ``\`` before each character."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def paths(messages: DataFrame, per_tree: int = 1) -> DataFrame:
    """``(tree_id, path, rank, depth, node_id)``: the messages of the best ``per_tree`` root-to-leaf paths.

    ``messages(tree_id, node_id, parent_id, score)``; node ids are unique in a
    tree. A message whose parent is null or missing is a root. A path scores the
    sum of its messages (null counts as 0); ties go to the longer path, then to
    the smaller leaf. ``path`` is the leaf's node_id. Cycles have no root and
    give nothing.
    """
    own = messages.select("tree_id", "node_id", "parent_id", F.coalesce(F.col("score"), F.lit(0)).cast("double").alias("score"))
    parents = own.select(F.col("tree_id").alias("t"), F.col("node_id").alias("n"))
    known = own.join(parents, F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("parent_id") == F.col("n")), "left")
    # up: the ancestor reached, far: the steps to it, sum: the scores on the way, it excluded; without it, up to the root
    at = cut(known.select("tree_id", "node_id", F.col("n").alias("up"), F.when(F.col("n").isNotNull(), 1).otherwise(0).alias("far"), F.col("score").alias("sum")))
    leaves = at.join(at.select(F.col("tree_id").alias("t"), F.col("up").alias("p")).where("p is not null").distinct(), F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("node_id") == F.col("p")), "left_anti")
    leaves = leaves.select("tree_id", F.col("node_id").alias("leaf"))

    hops, done, live, left = [], [], at, None
    for _ in range(MAX_ROUNDS):
        done.append(live.where("up is null"))  # has reached its root and isn't joined again
        live = live.where("up is not null")
        todo = live.count()
        if not todo or todo == left:  # what never ends is a cycle
            break
        left = todo
        hops.append(live.select(F.col("tree_id").alias("t"), F.col("node_id").alias("n"), "up"))
        above = reduce(DataFrame.union, done, live)
        above = above.select(F.col("tree_id").alias("t"), F.col("node_id").alias("n"), F.col("up").alias("next"), F.col("far").alias("more"), F.col("sum").alias("add"))
        further = live.join(above, F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("up") == F.col("n")))
        live = cut(further.select("tree_id", "node_id", F.col("next").alias("up"), (F.col("far") + F.col("more")).alias("far"), (F.col("sum") + F.col("add")).alias("sum")))
    ends = reduce(DataFrame.union, done).select(F.col("tree_id").alias("t"), F.col("node_id").alias("n"), F.col("far").alias("depth"), F.col("sum").alias("total"))
    ranked = leaves.join(ends, F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("leaf") == F.col("n")))
    order = Window.partitionBy("tree_id").orderBy(F.desc("total"), F.desc("depth"), "leaf")
    ranked = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_tree)

    members = cut(ranked.select("tree_id", F.col("leaf").alias("path"), "rank", "depth", F.col("leaf").alias("node_id")))
    for k, hop in enumerate(hops):  # after this, all nodes less than 2 ** (k + 1) above the leaf are in
        higher = members.join(hop, F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("node_id") == F.col("n")))
        members = cut(members.union(higher.select("tree_id", "path", "rank", (F.col("depth") - (1 << k)).cast("int"), F.col("up").alias("node_id"))))
    return members


def format_paths(chosen: DataFrame, messages: DataFrame) -> DataFrame:
    """``(tree_id, path, rank, formatted, loss_spans)``: each chosen path in the template.

    ``messages(tree_id, node_id, role, text)``; null roles and texts are empty.
    ``loss_spans`` holds the 0-based start and the length, in code points of
    ``formatted``, of each assistant text as it stands there.
    """
    named = messages.select(F.col("tree_id").alias("t"), F.col("node_id").alias("n"), escape(F.coalesce("role", F.lit(""))).alias("role"), escape(F.coalesce("text", F.lit(""))).alias("text"))
    rows = chosen.join(named, F.col("tree_id").eqNullSafe(F.col("t")) & (F.col("node_id") == F.col("n")))
    turns = rows.groupBy("tree_id", "path", "rank").agg(F.array_sort(F.collect_list(F.struct("depth", "role", "text"))).alias("turns"))
    turn = lambda x: F.concat(F.lit(OPEN), x["role"], F.lit(CLOSE), x["text"], F.lit(END))
    head = lambda x: F.length(x["role"]) + len(OPEN + CLOSE)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def add(state, x):
        begin = state["at"] + head(x)
        here = F.array(F.struct(begin.alias("start"), F.length(x["text"]).alias("length")))
        spans = F.when(x["role"] == "assistant", F.concat(state["spans"], here)).otherwise(state["spans"])
        return F.struct((begin + F.length(x["text"]) + len(END)).alias("at"), spans.alias("spans"))

    return turns.select("tree_id", "path", "rank", F.array_join(F.transform("turns", turn), "").alias("formatted"), F.aggregate("turns", start, add, lambda s: s["spans"]).alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds ``turns`` (role and text, unescaped) and ``loss_text`` to rows with ``formatted`` and ``loss_spans``."""
    pattern = "(?s)<s>\\[INST\\](.*?)\\[/INST\\](.*?)</s>"
    roles, texts = (F.regexp_extract_all("formatted", F.lit(pattern), F.lit(i)) for i in (1, 2))
    turns = F.transform(F.arrays_zip(roles.alias("role"), texts.alias("text")), lambda x: F.struct(unescape(x["role"]).alias("role"), unescape(x["text"]).alias("text")))
    pieces = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    return formatted.withColumns({"turns": turns, "loss_text": F.array_join(pieces, "")})


def chain_messages(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Rows of plain conversations as trees without branches: by turn, each replies to the one before."""
    order = Window.partitionBy(id_col).orderBy(F.col(turn_col).asc_nulls_last(), "role", "text")
    numbered = rows.withColumn("node_id", F.row_number().over(order).cast("long"))
    return numbered.select(F.col(id_col).alias("tree_id"), "node_id", F.when(F.col("node_id") > 1, F.col("node_id") - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def format_conversations(rows: DataFrame) -> DataFrame:
    """``(conv_id, formatted, loss_spans)`` of rows ``(conv_id, turn, role, text)``.

    Rows go by turn (nulls last), those of one turn by role and text; repeated
    rows are turns of their own; rows with a null conv_id make one conversation.
    Other columns are not looked at. An empty table gives an empty table.
    """
    messages = cut(chain_messages(rows))
    out = format_paths(paths(messages), messages)
    return out.select(F.col("tree_id").alias("conv_id"), "formatted", "loss_spans")


def digests(formatted: DataFrame) -> DataFrame:
    """What is read back from formatted conversations, as counts and digests."""
    back = read_back(formatted)
    lines = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    sha = lambda c: F.sha2(c, 256)
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), sha(lines).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), sha(F.col("loss_text")).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
