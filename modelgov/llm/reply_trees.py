r"""Chat formatting of reply trees: every chosen root-to-leaf path becomes one conversation with a loss mask.

Method.  Messages answer messages.  Iterative self-joins on narrow pointer rows double each message's
distance to the ancestor it knows (1, 2, 4, ... replies up) and add up scores on the way, so a path of
n messages takes log2(n) joins; messages that have met their root leave the rounds.  Leaves now
know their whole branch's score and are ranked inside their tree.  Only for the chosen leaves the same pointer
tables are joined again, longest steps first, which lists each path's messages once.  Texts take
part in the last join only.  Every round is a written table.

A turn is the mark of its role, the text and a closing mark; other roles carry their name.  Marks inside texts get a backslash after
their first character, and marks with backslashes there one more, so formatting can be undone exactly.
The loss mask lists (start, length), in code points of the formatted text, of the assistants' texts.

Rows: a null text or role is empty; rows of one message id form one node, each of them a turn, in order of role and text,
repeated rows included; a message whose parent is null or absent is a root; of several parents
of one id the smallest counts; messages above which replies run in a circle have no root and are on
no path; equal scores rank by leaf id; a null score is 0; null trees are one tree; an empty table gives no rows;
other columns are ignored.  One conversation is one row, so a path must fit into one.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .work import Work

#: marks around a turn, by role; turns of other roles are ``[ROLE]name[/ROLE]text[/TURN]``
MARKS = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
NAME, NAME_END, TURN_END = "[ROLE]", "[/ROLE]", "[/TURN]"
BODY = r"/?s>|/?(?:SYS|INST|ROLE)\]|/TURN\]"
OPENINGS = r"(?=\[SYS\]|\[INST\]|<s>|\[ROLE\])"
LOSS_ROLE = "assistant"
SCORE = "decimal(38,9)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)({BODY})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({BODY})", "$1$2$3")


def opening(role: Column) -> Column:
    marked = F.concat(F.lit(NAME), escape(role), F.lit(NAME_END))
    for name, (mark, _) in MARKS.items():
        marked = F.when(role == name, F.lit(mark)).otherwise(marked)
    return marked


def closing(role: Column) -> Column:
    marked = F.lit(TURN_END)
    for name, (_, mark) in MARKS.items():
        marked = F.when(role == name, F.lit(mark)).otherwise(marked)
    return marked


class Paths:
    """Ancestors of all messages, in steps of 1, 2, 4, ... replies, and the score of every root-to-leaf path."""

    def __init__(self, links: DataFrame, work: Work):
        """``links``: tree, id, parent, score."""
        exact = F.coalesce(F.col("score").try_cast(SCORE), F.lit(0).cast(SCORE))
        grouped = links.groupBy("tree", "id").agg(F.min("parent").alias("parent"), F.sum(exact).cast(SCORE).alias("score"))
        self.work = work
        self.nodes = work.keep(grouped.withColumn("node", F.monotonically_increasing_id()))
        n, p = self.nodes.alias("n"), self.nodes.select("tree", "id", "node").alias("p")
        same = F.col("n.tree").eqNullSafe(F.col("p.tree")) & (F.col("n.parent") == F.col("p.id"))
        self.first = work.keep(n.join(p, same, "left").select(
            F.col("n.node").alias("node"), F.col("p.node").alias("above"), F.col("n.score").alias("total")))
        most = self.nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
        #: steps[k]: (node, above) for every message with an ancestor 2^k replies up
        self.steps: list[DataFrame] = []
        done, now = self.first.where("above IS NULL"), self.first
        while not (active := now.where("above IS NOT NULL")).isEmpty() and 1 << len(self.steps) <= most:
            self.steps.append(active)
            a, b = active.alias("a"), active.unionByName(done).alias("b")
            now = work.keep(a.join(b, F.col("a.above") == F.col("b.node")).select(
                "a.node", "b.above", (F.col("a.total") + F.col("b.total")).cast(SCORE).alias("total")))
            done = done.unionByName(now.where("above IS NULL"))
        self.rooted = done.select("node", "total")

    def branches(self, keep: int) -> DataFrame:
        """The ``keep`` best leaves of each tree: tree, leaf (id), path (node of the leaf), total, branch (rank)."""
        leaves = self.nodes.join(self.first.select(F.col("above").alias("node")).distinct(), "node", "left_anti")
        ranked = leaves.join(self.rooted, "node").select("tree", F.col("id").alias("leaf"), F.col("node").alias("path"), "total")
        best = W.partitionBy("tree").orderBy(F.desc("total"), F.asc("leaf"))
        return ranked.withColumn("branch", F.row_number().over(best)).where(F.col("branch") <= keep)

    def members(self, chosen: DataFrame) -> DataFrame:
        """Every message on the chosen paths: path, tree, id, up (replies above the leaf)."""
        now = chosen.select("path", F.col("path").alias("node"), F.lit(0).cast("long").alias("up"))
        for k in range(len(self.steps) - 1, -1, -1):
            s = self.steps[k].select("node", "above")
            here = F.struct(F.col("node"), F.col("up"))
            there = F.struct(F.col("above").alias("node"), (F.col("up") + (1 << k)).alias("up"))
            both = F.when(F.col("above").isNull(), F.array(here)).otherwise(F.array(here, there))
            now = now.join(s, "node", "left").select("path", F.explode(both).alias("at")).select("path", "at.*")
        return now.join(self.nodes.select("node", "tree", "id"), "node").select("path", "tree", "id", "up")


def conversations(messages: DataFrame, links: DataFrame | None = None, keep: int = 1) -> DataFrame:
    """Per chosen path: tree, branch, leaf, total, formatted, loss (array of start and length).

    ``messages`` has tree, id, role, text; parent and score are taken from ``links`` (tree, id, parent, score), or from
    ``messages`` itself.
    """
    work = Work(messages.sparkSession, "reply-trees")
    paths = Paths((messages if links is None else links).select("tree", "id", "parent", "score"), work)
    chosen = work.keep(paths.branches(keep))
    members = work.keep(paths.members(chosen))
    role, text = F.coalesce("m.role", F.lit("")), F.coalesce("m.text", F.lit(""))
    same = F.col("p.tree").eqNullSafe(F.col("m.tree")) & F.col("p.id").eqNullSafe(F.col("m.id"))
    turns = messages.select("tree", "id", "role", "text").alias("m").join(members.alias("p"), same).select(
        "p.path", (-F.col("p.up")).alias("place"), role.alias("role"), opening(role).alias("opening"),
        F.concat(escape(text), closing(role)).alias("rest"), F.char_length(closing(role)).alias("closing"),
    )
    whole = F.char_length("opening") + F.char_length("rest")
    before = W.partitionBy("path").orderBy("place", "role", "rest").rowsBetween(W.unboundedPreceding, -1)
    turns = turns.select(
        "path", "opening", "rest", F.coalesce(F.sum(whole).over(before), F.lit(0).cast("long")).alias("start"),
        F.when(F.col("role") == LOSS_ROLE, F.char_length("rest") - F.col("closing")).alias("loss"),
    )
    turn = F.struct("start", F.concat("opening", "rest").alias("turn"), F.char_length("opening").alias("skip"), "loss")
    grouped = turns.groupBy("path").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    spans = F.transform(
        F.filter("turns", lambda t: t["loss"].isNotNull()),
        lambda t: F.struct((t["start"] + t["skip"] + 1).alias("start"), t["loss"].cast("long").alias("length")),
    )
    formatted = grouped.select("path", F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"), spans.alias("loss"))
    return formatted.join(chosen, "path").select("tree", "branch", "leaf", "total", "formatted", "loss")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text, as an array of (role, text)."""

    def inside(piece: Column, mark: str, end: str) -> Column:
        return unescape(F.substring(piece, F.lit(len(mark) + 1), F.char_length(piece) - len(mark) - len(end)))

    def read(piece: Column) -> Column:
        name_end = F.locate(NAME_END, piece)
        after = name_end + len(NAME_END)
        turn = F.struct(
            unescape(F.substring(piece, F.lit(len(NAME) + 1), name_end - len(NAME) - 1)).alias("role"),
            unescape(F.substring(piece, after, F.char_length(piece) - after + 1 - len(TURN_END))).alias("text"),
        )
        for name, (mark, end) in MARKS.items():
            known = F.struct(F.lit(name).alias("role"), inside(piece, mark, end).alias("text"))
            turn = F.when(F.startswith(piece, F.lit(mark)), known).otherwise(turn)
        return turn

    return F.transform(F.filter(F.split(formatted, OPENINGS), lambda p: p != ""), read)


def read_loss(formatted: Column, loss: Column) -> Column:
    """The text under the loss mask, without the backslashes of formatting."""
    return F.array_join(
        F.transform(loss, lambda s: unescape(F.substring(formatted, s["start"].cast("int"), s["length"].cast("int")))), "")
