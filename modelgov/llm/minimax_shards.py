"""Shards of near-equal size: minimax contiguous partition of atomic groups (law ``bytes``).

Method.  Rows with equal text form an atomic group; groups are ordered by the first 60 bits of
their text's SHA-256.  The driver binary-searches the smallest capacity with which a greedy walk
over the ordered group sizes needs no more than the given number of shards, and cuts there.  It
never sees the groups: it works on histograms of the order, a bounded number of segments, and
has those segments counted again on finer ones in which a cut may fall, until every cut falls on
a border between two groups.  So the capacity is the exact optimum of that order.

Groups larger than 1/64 of a shard (at most 64 per shard, so their number is bounded) get their
places in the order first: they are packed largest first on the least loaded shard, each pack
opens a shard, and the small groups fill up behind it.  A group above the even share has a shard
of its own, and the others are evened out without it.

Everything runs on DataFrame functions.  Slots count rows inside a shard over hashed cells, so
that a shard or a group of copies is never numbered by one task.

Rows: null texts count as empty (size 8 with the header) and form one group with empty texts;
null ids are rows like others; repeated rows get a slot each; an empty table gives an empty result;
fewer groups than shards leave shards empty; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .work import Work, rows_like, whole_text

BITS = 60
FIRST_BITS = 14
FINER_BITS = 7
LARGE = 64
CELLS = 1024
HEADER = 8


def position_of(text: Column) -> Column:
    """Place of a text in the order of groups: the first 60 bits of its SHA-256."""
    return F.conv(F.substring(F.sha2(text, 256), 1, BITS // 4), 16, 10).cast("long")


@dataclass(frozen=True)
class Cuts:
    """Small groups go by position, large groups by name; shards count from 0."""

    starts: list[int]  # position at which the next small shard starts
    shards: list[int]  # shard of each stretch of positions
    large: dict[int, int]
    capacity: int


def pack(large: list[tuple[int, int]], small_total: int, shards: int) -> tuple[list[list[tuple[int, int]]], list[int]]:
    """Large groups (position, size) on shards, and how many small bytes each shard should get."""
    packs: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    loads = [0] * shards
    for place, size in sorted(large, key=lambda g: (-g[1], g[0])):
        k = min(range(shards), key=lambda i: (loads[i], i))
        packs[k].append((place, size))
        loads[k] += size
    order = sorted(range(shards), key=lambda i: (-loads[i], i))
    packs, loads = [packs[i] for i in order], [loads[i] for i in order]
    open_ = shards  # the water level over the least loaded shards
    for first in range(shards):
        level = (small_total + sum(loads[first:])) / (shards - first)
        if loads[first] <= level:
            open_ = first
            break
    level = (small_total + sum(loads[open_:])) / max(1, shards - open_)
    return packs, [0 if i < open_ else max(0, round(level - loads[i])) for i in range(shards)]


class Sequence:
    """Ordered segments: large groups, single small groups (atoms), and stretches of small groups."""

    def __init__(self, place: np.ndarray, size: np.ndarray, kind: np.ndarray):
        self.place, self.size, self.kind = place, size, kind  # kind: 0 stretch, 1 atom, 2 large
        self.before = np.concatenate([[0], np.cumsum(size)])

    def walk(self, capacity: int, shards: int) -> list[int] | None:
        """Greedy cuts with whole segments, or None if they don't fit."""
        cuts, at = [0], 0
        for _ in range(shards):
            end = int(np.searchsorted(self.before, self.before[at] + capacity, "right")) - 1
            if end == len(self.size):
                return cuts
            if end == at:
                return None
            at = end
            cuts.append(at)
        return None

    def capacity(self, shards: int) -> int:
        """The smallest capacity that fits whole segments."""
        total = int(self.before[-1])
        lo, hi = max(-(-total // shards), int(self.size.max(initial=0)), 1), max(total, 1)
        while lo < hi:
            middle = (lo + hi) // 2
            if self.walk(middle, shards) is None:
                lo = middle + 1
            else:
                hi = middle
        return lo

    def doubtful(self, shards: int) -> np.ndarray:
        """Stretches in which a cut of the best partition may fall."""
        high = self.capacity(shards)
        total = int(self.before[-1])
        low = max(-(-total // shards), 1)
        out = np.zeros(len(self.size), bool)
        at = 0
        for k in range(1, shards):
            # cuts lie behind the walk over whole segments at the low bound and before the even division at the high one
            end = max(at, int(np.searchsorted(self.before, self.before[at] + low, "right")) - 1)
            top = int(np.searchsorted(self.before, min(k * high, total), "left"))
            out[max(0, end - 1) : top + 1] = True
            at = end
        return out & (self.kind == 0)


def find_cuts(groups: DataFrame, shards: int) -> Cuts:
    """``groups``: position, bytes of every group, as a written table."""
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    # more than total / (64 * shards) bytes each: there cannot be more than 64 * shards such groups
    border = max(1, total // (LARGE * shards))
    large = [(r[0], r[1]) for r in groups.where(F.col("bytes") > border).select("position", "bytes").collect()]
    small = groups.where(F.col("bytes") <= border)

    def counted(bits: int, parents: list[int] | None = None, shift: int = 0) -> list[tuple[int, int, int, int, int]]:
        """Segments of ``bits`` bits: position, bytes, kind, no pack, bits; inside ``parents`` only, if given."""
        rows = small.withColumn("_seg", F.shiftright("position", BITS - bits))
        if parents is not None:
            wanted = rows_like(groups.sparkSession, "_parent bigint", [(p >> shift,) for p in parents])
            rows = rows.join(F.broadcast(wanted), F.shiftright("position", shift) == F.col("_parent"), "left_semi")
        found = rows.groupBy("_seg").agg(F.sum("bytes").alias("b"), F.count("*").alias("n")).collect()
        return sorted((r["_seg"] << (BITS - bits), r["b"], int(r["n"] == 1 or bits == BITS), -1, bits) for r in found)

    stretch = counted(FIRST_BITS)
    packs, fill = pack(large, sum(s[1] for s in stretch), shards)
    closed = sum(1 for p, f in zip(packs, fill, strict=True) if p and not f)
    by_name = {place: k for k in range(closed) for place, _ in packs[k]}
    biggest = max([0, *(sum(size for _, size in p) for p in packs[:closed])])
    left = max(1, shards - closed)
    # each open pack goes before the stretch at which its shard's small bytes should start
    small_before = np.concatenate([[0], np.cumsum([s[1] for s in stretch])])
    wanted = np.concatenate([[0], np.cumsum(fill[closed:])])[:-1] if closed < shards else np.zeros(0)
    behind = np.searchsorted(small_before, wanted, "left").tolist()
    rows: list[tuple[int, int, int, int, int]] = []
    for i in range(len(stretch) + 1):
        for k, at in enumerate(behind):
            if at == i:
                rows += [(place, size, 2, k, BITS) for place, size in packs[closed + k]]
        rows += stretch[i : i + 1]
    while True:
        cols = np.asarray(rows, np.int64).reshape(-1, 5)
        line = Sequence(cols[:, 0], cols[:, 1], cols[:, 2])
        doubt = line.doubtful(left)
        if not doubt.any():
            break
        width = int(cols[doubt, 4].min())
        shift, finer = BITS - width, min(BITS, width + FINER_BITS)
        parents = set(cols[doubt & (cols[:, 4] == width), 0].tolist())
        parts: dict[int, list[tuple[int, int, int, int, int]]] = {}
        for part in counted(finer, sorted(parents), shift):
            parts.setdefault(part[0] >> shift << shift, []).append(part)
        rows = [part for row in rows for part in (parts[row[0]] if row[2] == 0 and row[4] == width and row[0] in parents else [row])]
    capacity = line.capacity(left)
    shard_at = np.zeros(len(line.size), np.int64)
    shard_at[(line.walk(capacity, left) or [0])[1:]] = 1
    shard_at = np.cumsum(shard_at) + closed
    starts, names = [], []
    for place, kind, shard in zip(line.place.tolist(), line.kind.tolist(), shard_at.tolist(), strict=True):
        if kind == 2:
            by_name[place] = shard
        elif not names or shard != names[-1]:
            starts.append(place)
            names.append(shard)
    return Cuts(starts, names, by_name, max(biggest, capacity if len(line.size) else 0))


def shard_of(position: Column, cuts: Cuts) -> Column:
    """Shard of a small group: the stretch its position lies in."""
    out = F.lit(cuts.shards[0] if cuts.shards else 0)
    for start, shard in zip(cuts.starts[1:], cuts.shards[1:], strict=True):
        out = F.when(position >= F.lit(start), F.lit(shard)).otherwise(out)
    return out.cast("int")


def shards(docs: DataFrame, count: int = 24, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, size, text_crc32, law, shard, slot, grown_shard; equal texts share a shard."""
    work = Work(docs.sparkSession, "shards")
    own = whole_text(text)
    rows = work.keep(docs.select(
        key, (F.octet_length(own).cast("long") + HEADER).alias("size"), F.crc32(own.cast("binary")).alias("text_crc32"),
        position_of(own).alias("position"),
    ))
    groups = work.keep(rows.groupBy("position").agg(F.sum("size").alias("bytes")))
    cuts = find_cuts(groups, count)
    work.drop(groups)
    # at most 64 * count rows
    large = rows_like(docs.sparkSession, "position bigint, _shard int", sorted(cuts.large.items()))
    placed = rows.join(F.broadcast(large), "position", "left").withColumn(
        "shard", F.coalesce("_shard", shard_of(F.col("position"), cuts))
    )
    cell = F.pmod(F.xxhash64(F.col(key), "text_crc32", "size"), F.lit(CELLS)).cast("int")
    placed = placed.withColumn("_cell", cell)
    inside = F.row_number().over(W.partitionBy("shard", "_cell").orderBy(key, "position")) - 1
    cells = placed.groupBy("shard", "_cell").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy("shard").orderBy("_cell")) - F.col("_n")
    starts = cells.select("shard", "_cell", before.alias("_before"))
    numbered = placed.withColumn("_inside", inside).join(starts, ["shard", "_cell"])
    return numbered.select(
        key, "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("_before") + F.col("_inside")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
