"""Reply trees to training conversations. DataFrame functions only.

Messages with parents form trees. Self-joins on the parent, doubling the distance
each time, give every message its score summed from the root in as many rounds as
the depth has binary digits. The best leaf of a conversation (highest sum, then
smallest message) names the branch; the same jump tables, applied from the longest
to the shortest, list the messages on its path, and the path is formatted.

Template: `<|role|>`, a new line, the text, `<|end|>`, a new line. `&`, `<`, `[` (and
`|` in roles) are written as character references, so no text holds a control
string of this or another template, and reading back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomdex.shared import cut

#: Fixed values of the template: what stands for characters that begin control strings.
REFERENCES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"), ("|", "&#124;"))
END = "<|end|>\n"


def escape(text: Column, role: bool = False) -> Column:
    for char, reference in REFERENCES[: 4 if role else 3]:
        text = F.replace(text, F.lit(char), F.lit(reference))
    return text


def unescape(text: Column) -> Column:
    for char, reference in reversed(REFERENCES):
        text = F.replace(text, F.lit(reference), F.lit(char))
    return text


def best_branches(messages: DataFrame) -> DataFrame:
    """(conv, msg, depth) of the messages on each conversation's best branch, of messages (conv, msg, parent, score).

    A parent that the conversation lacks makes a root. Messages on or below a cycle
    have no root and belong to no branch. Null scores count 0.
    """
    nodes = messages.select("conv", "msg", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("total"))
    known = nodes.select(F.col("conv").alias("c"), F.col("msg").alias("m"))
    same = F.col("conv").eqNullSafe(F.col("c"))
    state = cut(nodes.join(known, same & (F.col("parent") == F.col("m")), "left").select("conv", "msg", F.col("m").alias("jump"), "total", F.lit(1).cast("long").alias("depth")))
    parents = state.where("jump is not null").select(F.col("conv").alias("c"), F.col("jump").alias("m")).distinct()
    largest = state.groupBy("conv").count().agg(F.max("count")).first()[0] or 0
    levels = []
    while state.where("jump is not null").limit(1).count() and (1 << len(levels)) <= largest:
        levels.append(state.where("jump is not null").select(F.col("conv").alias("c"), F.col("msg").alias("m"), "jump"))
        above = state.select(F.col("conv").alias("c"), F.col("msg").alias("m"), F.col("jump").alias("far"), F.col("total").alias("more"), F.col("depth").alias("deeper"))
        # messages that have reached their root wait; only the others are joined
        on = state.where("jump is not null").join(above, same & (F.col("jump") == F.col("m")))
        on = on.select("conv", "msg", F.col("far").alias("jump"), (F.col("total") + F.col("more")).alias("total"), (F.col("depth") + F.col("deeper")).alias("depth"))
        state = cut(state.where("jump is null").union(on))
    rooted = state.where("jump is null")
    leaves = rooted.join(parents, same & (F.col("msg") == F.col("m")), "left_anti")
    path = leaves.groupBy("conv").agg(F.min(F.struct((-F.col("total")).alias("total"), "msg")).alias("best")).select("conv", F.col("best.msg").alias("msg"))
    for level in reversed(levels):
        # written each time: the next step reads it twice
        path = cut(path.union(path.join(level, same & (F.col("msg") == F.col("m"))).select("conv", F.col("jump").alias("msg"))))
    place = rooted.select(F.col("conv").alias("c"), F.col("msg").alias("m"), "depth")
    return path.join(place, same & (F.col("msg") == F.col("m"))).select("conv", "msg", "depth")


def format_conversations(messages: DataFrame) -> DataFrame:
    """(conv, formatted, loss) of messages (conv, msg, parent, score, role, text): one row a conversation.

    `loss` lists the spans [start, stop) of formatted, in code points, that hold the
    texts of role "assistant". Null texts and roles are empty. Of rows that repeat a
    message of a conversation one counts: that of the smallest parent (none before
    all), role, text and score.
    """
    once = Window.partitionBy("conv", "msg").orderBy("parent", "role", "text", "score")
    messages = messages.select("conv", "msg", "parent", "score", "role", "text").withColumn("n", F.row_number().over(once)).where("n = 1").drop("n")
    branch = best_branches(messages).select(F.col("conv").alias("c"), F.col("msg").alias("m"), "depth")
    turns = messages.join(branch, F.col("conv").eqNullSafe(F.col("c")) & (F.col("msg") == F.col("m")))
    head = F.concat(F.lit("<|"), escape(F.coalesce("role", F.lit("")), role=True), F.lit("|>\n"))
    body = escape(F.coalesce("text", F.lit("")))
    turns = turns.select("conv", "depth", head.alias("head"), body.alias("body"), (F.coalesce("role", F.lit("")) == "assistant").alias("learn"))
    before = Window.partitionBy("conv").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    piece = F.concat("head", "body", F.lit(END))
    start = F.coalesce(F.sum(F.length(piece)).over(before), F.lit(0)) + F.length("head")
    turns = turns.select("conv", "depth", piece.alias("piece"), "learn", start.alias("start"), (start + F.length("body")).alias("stop"))
    whole = turns.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("depth", "piece", "learn", "start", "stop"))).alias("turns"))
    loss = F.transform(F.filter("turns", lambda t: t["learn"]), lambda t: F.struct(t["start"].alias("start"), t["stop"].alias("stop")))
    return whole.select("conv", F.array_join(F.col("turns.piece"), "").alias("formatted"), loss.alias("loss"))


def read_back(conversations: DataFrame) -> DataFrame:
    """(conv, formatted, turns, loss_text) of formatted conversations: roles and texts as they were, and the text under the loss mask."""
    turns = F.filter(F.split("formatted", r"<\|end\|>\n", -1), lambda t: t != "")
    cut_at = lambda t: F.call_function("locate", F.lit("|>\n"), t)
    turn = lambda t: F.struct(unescape(F.substring(t, F.lit(3), cut_at(t) - 3)).alias("role"), unescape(F.substring(t, cut_at(t) + 3, F.length(t))).alias("text"))
    loss = F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int")))), "")
    return conversations.select("conv", "formatted", F.transform(turns, turn).alias("turns"), loss.alias("loss_text"))
