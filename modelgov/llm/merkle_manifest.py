"""Merkle dataset manifest: one hash tree over a table, and for every row the proof that leads to its root.

Method.  Bitmap-rank indexing.  The ids of a group are merged into a compressed bitmap: a table of
the 64-bit words that hold an id (``bit_or``, combined before the shuffle), words without ids being
absent.  Popcount directories give each word the number of leaves before it: words count inside their
container of 2^16 ids, containers inside 2^32, those inside 2^48, and those inside the group, so that
no directory step looks at more than 65,536 entries.  The rank of an id, and with it the coordinate of its leaf, is the
word's base plus the bits below its own; no leaf is sorted.  Leaves then go into slot arrays keyed by
(group, coordinate >> 10): one task hashes the ten levels above 1,024 slots, their tops are slots of the
next round, and after ceil(log 1024) rounds one node is left.  Sibling lists run down the same
blocks, one row per block, and each block proves its own leaves.

Hash input of a node: the hex digests of its one or two children, concatenated.  A last node without
a partner is hashed alone.  Subroots of groups, in order of group, are the leaves of the root's tree.

Rows: a null id counts as the smallest one; null groups are one group, in front of all others; rows of
one id are ordered by their leaf, equal rows among themselves in any order; an empty table gives
no rows; a null text or an empty one differ (``-`` and ``0:``); columns not named in ``fields`` are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.rank import number_within
from .work import Work

SLOT_BITS = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field_text(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*(field_text(f) for f in fields)), 256)


def node_hash(children: list[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def levels_above(slots: list[str], most: int) -> list[list[str]]:
    """The slots and every level above them, until one node is left or ``most`` levels are made."""
    levels = [slots]
    while len(levels) <= most and (most < 64 or len(levels[-1]) > 1):
        row = levels[-1]
        levels.append([node_hash(row[i : i + 2]) for i in range(0, len(row), 2)])
    return levels


def siblings(levels: list[list[str]], slot: int) -> list[str]:
    """Level by level from a slot to the top: ``L`` or ``R`` and the digest beside the path, or empty for none."""
    found = []
    for row in levels[:-1]:
        other = slot ^ 1
        found.append(("L" if other < slot else "R") + row[other] if other < len(row) else "")
        slot >>= 1
    return found


def folded(node: str, path: list[str]) -> str:
    for step in path:
        node = node_hash([node] if not step else [step[1:], node] if step[0] == "L" else [node, step[1:]])
    return node


def rank_words(ids: DataFrame, work: Work) -> DataFrame:
    """``grp``, ``word``, ``bits``, ``base``, ``extra``, ``leaves``: the bitmaps of all groups with their directories.

    ``ids`` has ``grp`` and ``id``.  ``base`` counts the group's leaves before the word, ``extra`` lists the bits of
    ids that come more than once with the surplus, ``leaves`` is the size of the group.
    """
    counted = ids.groupBy("grp", "id").agg(F.count("*").alias("n"))
    bit = F.col("id").bitwiseAND(F.lit(63)).cast("int")
    words = work.keep(
        counted.groupBy("grp", F.shiftright("id", 6).alias("word")).agg(
            F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits"),
            F.sum("n").alias("n"),
            F.collect_list(F.when(F.col("n") > 1, F.struct(bit.alias("bit"), (F.col("n") - 1).alias("more")))).alias("extra"),
        )
    )
    # directories: (shift of the entry inside the word number) from words up to the whole group
    none = F.lit(0).cast("long")
    now, parts = words.select("grp", "word", "n"), []
    for name, shift in (("word", 10), ("c16", 16), ("c32", 16), ("c48", 16)):
        up = F.shiftright(name, shift).alias("up")
        inside = W.partitionBy("grp", "up").orderBy(name).rowsBetween(W.unboundedPreceding, -1)
        level = now.withColumn("up", up).withColumn("_before", F.coalesce(F.sum("n").over(inside), none))
        parts.append((name, level.select("grp", name, "up", F.col("_before").alias(f"b_{name}"))))
        following = {"word": "c16", "c16": "c32", "c32": "c48", "c48": "all"}[name]
        now = now.groupBy("grp", up.alias(following)).agg(F.sum("n").alias("n"))
    # ids are signed, so the top directory has two entries: negative ids, then the others
    top = now.groupBy("grp").agg(
        F.sum("n").alias("leaves"), F.coalesce(F.sum(F.when(F.col("all") < 0, F.col("n"))), none).alias("negative")
    )
    directory = top
    for name, part in reversed(parts):
        above = {"word": "c16", "c16": "c32", "c32": "c48"}.get(name)
        d, p = directory.alias("d"), part.alias("p")
        same = F.col("d.grp").eqNullSafe(F.col("p.grp"))
        if above is None:
            start = F.when(F.col("p.up") >= 0, F.col("d.negative")).otherwise(none)
        else:
            same &= F.col(f"d.{above}") == F.col("p.up")
            start = F.col("d.base")
        directory = p.join(d, same).select(
            "p.grp", f"p.{name}", "d.leaves", (start + F.col(f"p.b_{name}")).alias("base")
        )
    w, d = words.alias("w"), directory.alias("d")
    both = F.col("w.grp").eqNullSafe(F.col("d.grp")) & (F.col("w.word") == F.col("d.word"))
    return w.join(d, both).select("w.grp", "w.word", "w.bits", "d.base", "w.extra", "d.leaves")


def placed(leaves: DataFrame, words: DataFrame) -> DataFrame:
    """The leaves with ``pos`` (coordinate in the group) and ``leaves`` (size of the group).

    ``leaves`` is a written table with ``grp``, ``id``, ``known``, ``leaf``, ``row`` and any others; rows of one id follow
    each other in order of leaf, equal ones as they are written, so that many copies need no common task.
    """
    low = F.col("l.id").bitwiseAND(F.lit(63)).cast("int")
    below = F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), low))
    same = F.col("l.grp").eqNullSafe(F.col("w.grp")) & (F.shiftright("l.id", 6) == F.col("w.word"))
    surplus = F.aggregate(
        F.filter("w.extra", lambda e: e["bit"] < low), F.lit(0).cast("long"), lambda n, e: n + e["more"]
    )
    ranked = leaves.alias("l").join(words.alias("w"), same).select(
        "l.*", (F.col("w.base") + F.bit_count(F.col("w.bits").bitwiseAND(below)) + surplus).alias("pos"), "w.leaves",
        F.exists("w.extra", lambda e: e["bit"] == low).alias("repeated"),
    )
    if words.where(F.size("extra") > 0).isEmpty():
        return ranked.drop("repeated")
    numbered = number_within(ranked.where("repeated").drop("repeated"), ["grp", "id"], ["known", "leaf", "row"], "_nth")
    return ranked.where("NOT repeated").drop("repeated").unionByName(
        numbered.withColumn("pos", F.col("pos") + F.col("_nth") - 1).drop("_nth")
    )


def _block_tops(rows: DataFrame) -> DataFrame:
    """The node above each block of slots: (grp, leaves, block, slots) to (grp, leaves, pos, node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tops = []
            for leaves, slots in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                most = SLOT_BITS if leaves > 1 << SLOT_BITS else 64
                tops.append(levels_above([s["leaf"] for s in slots], most)[-1][0])
            left = pa.array([-(-n // (1 << SLOT_BITS)) for n in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), left, batch.column(2), pa.array(tops)], ["grp", "leaves", "pos", "node"])

    kind = rows.schema["grp"].dataType.simpleString()
    return rows.mapInArrow(run, f"grp {kind}, leaves long, pos long, node string")


def _block_paths(rows: DataFrame) -> DataFrame:
    """The path of every slot from (grp, leaves, block, slots, path above): (grp, pos, path)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                leaves, block, slots, above = (batch.column(c)[i].as_py() for c in range(1, 5))
                levels = levels_above([s["leaf"] for s in slots], SLOT_BITS if leaves > 1 << SLOT_BITS else 64)
                paths = [siblings(levels, k) + (above or []) for k in range(len(slots))]
                at = pa.array([(block << SLOT_BITS) + k for k in range(len(slots))], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(0)[i].as_py()] * len(slots), batch.schema.field(0).type), at,
                     pa.array(paths, pa.list_(pa.string()))], ["grp", "pos", "path"])

    kind = rows.schema["grp"].dataType.simpleString()
    return rows.mapInArrow(run, f"grp {kind}, pos long, path array<string>")


def _blocks(nodes: DataFrame) -> DataFrame:
    """Slot arrays: (grp, leaves, pos, id, leaf, changed) to (grp, leaves, block, slots), slots in order."""
    slot = F.col("pos").bitwiseAND(F.lit((1 << SLOT_BITS) - 1)).cast("int").alias("slot")
    return nodes.groupBy("grp", "leaves", F.shiftright("pos", SLOT_BITS).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct(slot, "id", "leaf", "changed"))).alias("slots")
    )


class Tree:
    """The slot arrays of every round of one forest, written as tables."""

    def __init__(self, leaves: DataFrame, work: Work):
        self.work = work
        self.rounds = [work.keep(_blocks(leaves))]
        most = self.rounds[0].agg(F.max("leaves")).first()[0] or 0
        nodes = work.keep(_block_tops(self.rounds[0]))
        while most > 1 << SLOT_BITS:
            most = -(-most // (1 << SLOT_BITS))
            # finished groups (one node left) stay as they are and wait beside the rounds
            inner = nodes.where("leaves > 1")
            blocks = work.keep(_blocks(inner.select(
                "grp", "leaves", "pos", F.lit(None).cast("long").alias("id"), F.col("node").alias("leaf"), F.lit(None).cast("string").alias("changed"),
            )))
            self.rounds.append(blocks)
            nodes = work.keep(_block_tops(blocks).unionByName(nodes.where("leaves = 1")))
        self.roots = nodes.select("grp", F.col("node").alias("subroot"))

    def paths(self, above: DataFrame) -> DataFrame:
        """The path above every block of the first round: (grp, pos, path); ``above`` has (grp, path) of the groups' roots."""
        now = above.select("grp", F.lit(0).cast("long").alias("pos"), "path")
        for depth in range(len(self.rounds) - 1, 0, -1):
            blocks, u = self.rounds[depth].alias("b"), now.alias("u")
            same = F.col("b.grp").eqNullSafe(F.col("u.grp")) & (F.col("b.block") == F.col("u.pos"))
            lower = _block_paths(blocks.join(u, same, "left").select("b.grp", "b.leaves", "b.block", "b.slots", "u.path"))
            # groups that were one block of the round below keep the path of their root
            small = self.rounds[depth].select("grp").distinct()
            rest = now.alias("u").join(small.alias("s"), F.col("u.grp").eqNullSafe(F.col("s.grp")), "left_anti")
            now = self.work.keep(lower.unionByName(rest))
        return now


def prove(docs: DataFrame, tampered: Column, changed: dict[str, Column], *, id_column: str = "doc_id", group: str = "lang",
          fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Per row: id, ``grp``, ``pos``, ``leaf``, ``subroot``, ``root``, ``proof`` (siblings), ``proof_sha256``, ``folded_root``, ``verified``.

    Where ``tampered`` holds, ``folded_root`` starts from the leaf with the fields of ``changed`` in place of the
    original ones; the siblings are always the original ones.
    """
    spark = docs.sparkSession
    work = Work(spark, "merkle")
    rows = docs.select(*fields).select(*(F.col(f) for f in fields), tampered.alias("_tampered"))
    original = [F.col(f) for f in fields]
    other = [changed.get(f, F.col(f)) for f in fields]
    leaves = work.keep(rows.select(
        F.col(group).alias("grp"), F.coalesce(F.col(id_column), F.lit(-(2**63))).cast("long").alias("id"),
        F.col(id_column).isNotNull().alias("known"), leaf_hash(original).alias("leaf"),
        F.when(F.col("_tampered"), leaf_hash(other)).alias("changed"), F.monotonically_increasing_id().alias("row"),
    ))
    words = work.keep(rank_words(leaves.select("grp", "id"), work))
    at = placed(leaves, words)
    # a null id and the smallest number share a place in the bitmap, the null in front
    shown = F.when(F.col("known"), F.col("id"))
    tree = Tree(at.select("grp", "leaves", "pos", shown.alias("id"), "leaf", "changed"), work)

    groups = number_within(tree.roots.withColumn("_all", F.lit(0)), ["_all"], ["grp"], "_nth")
    groups = work.keep(groups.select((F.col("_nth") - 1).alias("pos"), "grp", "subroot", F.lit(0).alias("all")))
    count = groups.count()
    none = F.lit(None).cast("long")
    over = Tree(groups.select(
        F.lit(0).alias("grp"), F.lit(count).cast("long").alias("leaves"), "pos", none.alias("id"), F.col("subroot").alias("leaf"),
        F.lit(None).cast("string").alias("changed"),
    ), work)
    ends = over.paths(spark.sql("SELECT 0 AS grp, CAST(array() AS array<string>) AS path"))
    last = over.rounds[0].alias("b").join(ends.alias("u"), F.col("b.block") == F.col("u.pos"))
    tops = _block_paths(last.select("b.grp", "b.leaves", "b.block", "b.slots", "u.path"))
    root = over.roots.select(F.col("grp").alias("all"), F.col("subroot").alias("root"))
    above = work.keep(groups.join(tops.select("pos", "path"), "pos").join(root, "all").select("grp", "subroot", "root", "path"))

    down, a = tree.paths(above.select("grp", "path")).alias("u"), above.alias("a")
    down = down.join(a, F.col("u.grp").eqNullSafe(F.col("a.grp"))).select("u.grp", "u.pos", "u.path", "a.subroot", "a.root").alias("u")
    same = F.col("b.grp").eqNullSafe(F.col("u.grp")) & (F.col("b.block") == F.col("u.pos"))
    full = tree.rounds[0].alias("b").join(down, same).select("b.*", "u.path", "u.subroot", "u.root")
    return _proofs(full, id_column)


def _proofs(blocks: DataFrame, id_column: str) -> DataFrame:
    names = [id_column, "grp", "pos", "leaf", "subroot", "root", "proof", "proof_sha256", "folded_root", "verified"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                leaves, block, slots, above, subroot, root = (batch.column(c)[i].as_py() for c in range(1, 7))
                grp = batch.column(0)[i].as_py()
                levels = levels_above([s["leaf"] for s in slots], SLOT_BITS if leaves > 1 << SLOT_BITS else 64)
                ends: dict[str, str] = {}
                out: list[list] = [[] for _ in names]
                for k, s in enumerate(slots):
                    inside = siblings(levels, k)
                    top = folded(s["leaf"] if s["changed"] is None else s["changed"], inside)
                    if top not in ends:
                        ends[top] = folded(top, above)
                    proof = [step[1:] for step in (*inside, *above) if step]
                    row = (s["id"], grp, (block << SLOT_BITS) + k, s["leaf"], subroot, root, proof, node_hash(proof), ends[top], ends[top] == root)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                text = pa.string()
                kinds = [pa.int64(), batch.schema.field(0).type, pa.int64(), text, text, text, pa.list_(text), text, text, pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names)

    kind = blocks.schema["grp"].dataType.simpleString()
    schema = (f"{id_column} long, grp {kind}, pos long, leaf string, subroot string, root string, proof array<string>, "
              "proof_sha256 string, folded_root string, verified boolean")
    return blocks.mapInArrow(run, schema)
