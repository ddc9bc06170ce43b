"""N-gram Jaccard self-join of documents with a count-vector R-tree; classes of linked documents.

A document's set holds its distinct five-word shingles (words lower-cased in A-Z), as 64-bit
hashes.  Two documents link when 100 * intersection >= 80 * union, on whole sets.

Method.  Hashes fall into groups (by their leading bits), and the number of hashes in each group
is a document's point.  The sum over groups of the smaller count bounds the intersection of two
sets from above, and the same sum over the largest counts of two boxes bounds it for all pairs
between them.  Boxes over similar sizes form an R-tree; box pairs whose bound is below the need
(4/9 of both sizes) are not opened, and pairs that survive are verified on their whole sets.

Spreading the work.  One tree over all documents would have to compare most of its leaves, because
no box over many unlike documents bounds anything, so the root fans out first, by the same
bound at its finest grain (each hash a group of its own).  Hashes are visited in one order for all documents, rare ones first;
when a document has passed the first n - need + 1 of its hashes, the rest cannot reach the
need.  So linked documents share a hash among those, and it suffices to join the documents of each
such hash (a run).  In every run:

1. documents with equal sets were merged to one node before; two nodes of the run are verified
   against the others, and components of the links found are built;
2. what those two leave of a run gets an R-tree over its points, if it still holds several
   components; surviving pairs between different components are verified, and components are
   built again.

Every pair of a run is then linked through a component, verified, or bounded away: no link is
lost, and a group of near copies never has all its pairs written.  Runs longer than ``RUN``
nodes are split into blocks, and each pair of blocks is a tree join of its own.

The order of hashes comes from a bounded sample of documents (``SAMPLE_DOCS``) and only shortens
runs; any order gives the same links.  Nodes are 64-bit sums over sets.

Rows: null, empty and blank texts have the empty set and link with nothing; fewer than five words make one shingle
of the whole sequence; equal rows are one class; rows with a null id take part, but do not
name a component (null if it has no other); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stars import components
from .tokens import blocks, mix, utf8, word_hashes
from .work import Work

WORDS = 5
SAMPLE_DOCS = 20_000
FREQUENT = 8
MOST_FREQUENT = 100_000
RUN = 1024
LEAF = 8
_ODD = np.asarray([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    data, offsets = utf8(column)
    for lo, hi in blocks(offsets):
        own = offsets[lo : hi + 1] - offsets[lo]
        words, _, _, before = word_hashes(data[offsets[lo] : offsets[hi]], own, lower=True)
        n = max(0, len(words) - WORDS + 1)
        rolled = np.zeros(n, np.uint64)
        for k in range(WORDS):
            rolled += words[k : k + n] * _ODD[k]
        rolled = mix(rolled)
        for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
            if b - a >= WORDS:
                yield np.unique(rolled[a : b - WORDS + 1])
            elif b > a:
                yield mix(np.asarray([(words[a:b] * _ODD[: b - a]).sum() + np.uint64(b - a)], np.uint64))
            else:
                yield rolled[:0]


def node_of(shingles: np.ndarray) -> int:
    """A number for a set: the same for equal sets."""
    return int((mix(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(shingles))).astype(np.int64))


def need(a, b):
    """Smallest intersection with which sets of these sizes link: 180 i >= 80 (a + b)."""
    return -(-4 * (a + b) // 9)


def groups_of(n: int) -> int:
    """How many groups a set of n hashes is counted in: a power of two, about two hashes each."""
    return 1 << min(14, max(4, (max(1, n) // 2).bit_length()))


def counts_of(shingles: np.ndarray) -> np.ndarray:
    g = groups_of(len(shingles))
    return np.bincount((shingles >> np.uint64(64 - (g.bit_length() - 1))).astype(np.int64), minlength=g).astype(np.uint32)


def point_bytes(shingles: np.ndarray) -> bytes:
    """Counts as bytes, in the narrowest of three widths that holds them; the first byte names it."""
    counts = counts_of(shingles)
    kind = np.min_scalar_type(counts.max(initial=0)).type
    return bytes([kind().itemsize]) + counts.astype(kind).tobytes()


def point(raw) -> np.ndarray:
    return np.frombuffer(raw, {1: np.uint8, 2: np.uint16, 4: np.uint32}[raw[0]], offset=1)


def folded(counts: np.ndarray, groups: int) -> np.ndarray:
    """Counts over fewer groups: neighbouring groups summed, in a width that holds any text's shingles."""
    return counts.reshape(groups, -1).sum(axis=1, dtype=np.uint32) if len(counts) > groups else counts


def profiles(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, node, counts (binary) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, nodes, points = [], [], []
            for s in shingle_sets(batch.column(1)):
                sizes.append(len(s))
                nodes.append(node_of(s))
                points.append(point_bytes(s))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(points, pa.binary())],
                ["doc_id", "n_shingles", "node", "counts"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, node long, counts binary")


def frequent_hashes(docs: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that several documents of a bounded sample hold, with their counts; only used as an order."""
    part = min(1.0, SAMPLE_DOCS / max(1, total))
    sample = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < F.lit(int(part * (1 << 20))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column(0)))
            h, n = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    found = (
        sample.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
        .where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "h").limit(MOST_FREQUENT).toPandas()
    )
    h, n = found["h"].to_numpy(np.int64).astype(np.uint64), found["n"].to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def first_hashes(shingles: np.ndarray, frequent: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, int]:
    """The hashes after which the rest cannot reach the need, and how many of them do as the smaller set."""
    n = len(shingles)
    if not n:
        return shingles, 0
    most = n - -(-4 * n // 5) + 1
    short = n - -(-8 * n // 9) + 1
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
        known = frequent[at] == shingles
        if known.any():
            order = np.lexsort((shingles, np.where(known, times[at], 0)))
            return shingles[order[:most]], short
    return shingles[:most], short


def key_rows(docs: DataFrame, hot: dict[int, object], frequent: np.ndarray, times: np.ndarray) -> DataFrame:
    """key, node, size, short: a row for each first hash of each document.

    ``hot`` names the one document that stands for each of the few largest classes of equal sets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            keys, nodes, sizes, shorts, lengths = [], [], [], [], []
            for doc, s in zip(ids, shingle_sets(batch.column(1)), strict=True):
                if not len(s):
                    continue
                node = node_of(s)
                if node in hot and hot[node] != doc:
                    continue
                own, short = first_hashes(s, frequent, times)
                keys.append(own)
                lengths.append(len(own))
                nodes.append(node)
                sizes.append(len(s))
                shorts.append(np.arange(len(own)) < short)
            if keys:
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate(keys).astype(np.int64)), pa.array(np.repeat(np.asarray(nodes, np.int64), lengths)),
                    pa.array(np.repeat(np.asarray(sizes, np.int32), lengths)), pa.array(np.concatenate(shorts)),
                ], ["key", "node", "size", "short"])

    return docs.select("doc_id", "text").mapInArrow(run, "key long, node long, size int, short boolean")


def shared_runs(rows: DataFrame) -> DataFrame:
    """Rows of keys that two or more nodes have, each (key, node) once; streams over sorted rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # the last (key, node), not decided yet
        held_joined = False
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table])
            key, node = table.column(0).to_numpy(), table.column(1).to_numpy()
            if not len(key):
                continue
            fresh = np.ones(len(key), bool)
            fresh[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
            at = np.flatnonzero(fresh)
            k = key[at]
            same = k[1:] == k[:-1]
            joined = np.zeros(len(at), bool)
            joined[1:] |= same
            joined[:-1] |= same
            if held is not None and held_joined:
                joined[0] = True
            out = at[:-1][joined[:-1]]
            held, held_joined = table.slice(at[-1], 1), bool(joined[-1])
            if len(out):
                yield from table.take(pa.array(out)).combine_chunks().to_batches()
        if held is not None and held_joined:
            yield from held.combine_chunks().to_batches()

    return rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "key long, node long, size int, short boolean")


def distinct_runs(rows: DataFrame) -> DataFrame:
    """Runs with the same nodes become one: copies of a passage share many keys, but one set of documents.

    Runs are told apart by their number of nodes and two sums of node hashes; a node's ``short``
    holds if it held in any of the runs, which only lets more pairs through.
    """
    sums = [F.sum(F.xxhash64(F.lit(k), "node").cast("decimal(38,0)")).alias(f"_s{k}") for k in (1, 2)]
    signs = rows.groupBy("key").agg(F.count("*").alias("_n"), *sums).select("key", F.xxhash64("_n", "_s1", "_s2").alias("_run"))
    return (
        rows.join(signs, "key").groupBy(F.col("_run").alias("key"), "node")
        .agg(F.first("size").alias("size"), F.max("short").alias("short"))
    )


def active_sets(docs: DataFrame, active: DataFrame) -> DataFrame:
    """node, shingles (binary) of the documents that stand for the active nodes (doc_id, node).

    A bit table of fixed size tells most other documents apart before any set is sent; what
    passes it is joined exactly.
    """
    bits = 1 << 23
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    words = active.select(F.floor(bit / 64).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast(pmod(pmod(xxhash64(doc_id), {bits}), 64) as int))").alias("b"))
    filled = words.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()  # 2**17 rows at most
    table = np.zeros(bits // 64, np.int64)
    table[filled["w"].to_numpy(np.int64)] = filled["b"].to_numpy(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(2).to_numpy()
            hit = np.flatnonzero((table[at >> 6] >> (at & 63)) & 1)
            for lo in range(0, len(hit), 512):
                part = batch.take(pa.array(hit[lo : lo + 512]))
                sets = list(shingle_sets(part.column(1)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                    ["doc_id", "node", "shingles"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text", bit.alias("bit")).mapInArrow(run, f"doc_id {kind}, node long, shingles binary")
    named = active.select(F.col("doc_id").alias("_doc"), F.col("node").alias("_node"))
    return found.join(named, (F.col("node") == F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("_doc"))).select("node", "shingles")


def _paired(pairs: DataFrame, rows: DataFrame, column: str) -> DataFrame:
    """a, b and the binary column of either."""
    left = rows.select(F.col("node").alias("a"), F.col(column).alias("of_a"))
    right = rows.select(F.col("node").alias("b"), F.col(column).alias("of_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "of_a", "of_b")


def _chosen(pairs: DataFrame, read: Callable, good: Callable[[np.ndarray, np.ndarray], bool]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of_a, of_b = batch.column(2), batch.column(3)
            keep = [
                i for i in range(len(batch))
                if good(read(of_a[i].as_py()), read(of_b[i].as_py()))
            ]
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return pairs.mapInArrow(run, "a long, b long")


def bounded(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """The pairs whose counts do not rule a link out."""

    def good(a: np.ndarray, b: np.ndarray) -> bool:
        g = min(len(a), len(b))
        return int(np.minimum(folded(a, g), folded(b, g)).sum(dtype=np.int64)) >= need(int(a.sum(dtype=np.int64)), int(b.sum(dtype=np.int64)))

    return _chosen(_paired(pairs, points, "counts"), point, good)


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, work: Work) -> DataFrame:
    """The pairs that link, compared on their whole sets; sets are built for the pairs' nodes only."""
    members = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes, "node").select("doc_id", "node")
    sets = work.keep(active_sets(docs, work.keep(members)).dropDuplicates(["node"]))

    def good(a: np.ndarray, b: np.ndarray) -> bool:
        return len(np.intersect1d(a, b, assume_unique=True)) >= need(len(a), len(b))

    links = work.keep(_chosen(_paired(pairs, sets, "shingles"), lambda raw: np.frombuffer(raw, np.uint64), good))
    work.drop(sets)
    return links


class Tree:
    """R-tree over one run: items in order of size, boxes of LEAF neighbours with their largest counts.

    A box also knows its range of sizes and of labels: boxes with one label between them need no look.
    """

    def __init__(self, sizes: np.ndarray, labels: np.ndarray, counts: list[np.ndarray]):
        self.order = np.argsort(sizes, kind="stable")
        own = sizes[self.order]
        label = labels[self.order]
        boxes = [counts[i] for i in self.order.tolist()]
        self.levels = [(own, own, label, label)]
        self.inside: list[list[np.ndarray]] = [[]]  # per box: its members' counts over the box's groups
        while len(boxes) > 1 or len(self.levels) == 1:
            low, high, first, last = self.levels[-1]
            heads = range(0, len(boxes), LEAF)
            members = []
            for h in heads:
                part = boxes[h : h + LEAF]
                g = min(map(len, part))
                members.append(np.stack([folded(c, g) for c in part]))
            at = np.asarray(heads)
            self.levels.append((
                np.minimum.reduceat(low, at), np.maximum.reduceat(high, at),
                np.minimum.reduceat(first, at), np.maximum.reduceat(last, at),
            ))
            self.inside.append(members)
            boxes = [m.max(axis=0) for m in members]

    def pairs(self) -> Iterator[tuple[int, int]]:
        """Pairs of positions with different labels whose bound reaches the need."""
        stack = [(len(self.levels) - 1, 0, 0)]
        while stack:
            level, i, j = stack.pop()
            a, b = self.inside[level][i], self.inside[level][j]
            g = min(a.shape[1], b.shape[1])
            a, b = (m.reshape(len(m), g, -1).sum(axis=2, dtype=np.uint32) if m.shape[1] > g else m for m in (a, b))
            low, high, first, last = self.levels[level - 1]
            x, y = np.arange(i * LEAF, i * LEAF + len(a)), np.arange(j * LEAF, j * LEAF + len(b))
            bound = np.minimum(a[:, None, :], b[None, :, :]).sum(axis=2, dtype=np.int64)
            on = bound >= need(low[x][:, None], low[y][None, :])
            on &= 4 * np.maximum(low[x][:, None], low[y][None, :]) <= 5 * np.minimum(high[x][:, None], high[y][None, :])
            one = (first[x] == last[x])[:, None] & (first[y] == last[y])[None, :] & (first[x][:, None] == first[y][None, :])
            on &= ~one
            if i == j:
                if level > 1:  # a box with itself holds pairs whatever its bound says
                    np.fill_diagonal(on, first[x] != last[x])
                on = np.triu(on, 1 if level == 1 else 0)
            for p, q in zip(*(k.tolist() for k in np.nonzero(on)), strict=True):
                if level == 1:
                    yield int(self.order[x[p]]), int(self.order[y[q]])
                else:
                    stack.append((level - 1, int(x[p]), int(y[q])))


def tree_pairs(rows: DataFrame, points: DataFrame) -> DataFrame:
    """Pairs a < b of different labels inside a run whose counts do not rule a link out.

    ``rows``: key, node, size, short, label; ``points``: node, counts.  Long runs are split into
    pairs of blocks.
    """
    parts = rows.groupBy("key").agg(F.ceil(F.count("*") / RUN).cast("int").alias("_parts"))
    block = F.pmod(F.xxhash64("node"), F.col("_parts")).cast("int")
    cut = rows.join(parts, "key").withColumn("block", block)
    cut = cut.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    cut = cut.withColumn("i", F.least("block", "_other")).withColumn("j", F.greatest("block", "_other"))

    # a node has at most as many runs as first hashes; a pair is taken in the first run it shares
    of_node = rows.groupBy("node").agg(F.collect_list("key").alias("runs")).join(points, "node")

    def joined(group: tuple[int, int, int], own: list[tuple]) -> Iterator[tuple[int, int]]:
        key, i, j = group
        runs = [frozenset(r[6]) for r in own]
        sizes, labels = np.asarray([r[1] for r in own]), np.asarray([r[3] for r in own])
        for x, y in Tree(sizes, labels, [point(r[4]) for r in own]).pairs():
            p, q = own[x], own[y]
            if {p[5], q[5]} == {i, j} and min(runs[x] & runs[y]) == key:
                yield min(p[0], q[0]), max(p[0], q[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, own = None, []
        out: list[tuple[int, int]] = []
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r[:3] != group:
                    out += joined(group, own) if own else []
                    group, own = r[:3], []
                own.append(r[3:])
                if len(out) > 50_000:
                    yield _pairs_batch(out)
                    out = []
        out += joined(group, own) if own else []
        yield _pairs_batch(out)

    spread = cut.join(of_node, "node").select("key", "i", "j", "node", "size", "short", "label", "counts", "block", "runs")
    spread = spread.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return spread.mapInArrow(run, "a long, b long").distinct()


def _pairs_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    own = list(dict.fromkeys(pairs))
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in own], pa.int64()), pa.array([p[1] for p in own], pa.int64())], ["a", "b"])


def classes(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles, node (its set), component_id, root (the component's smallest node)."""
    work = Work(docs.sparkSession, "ngram-join")
    own = work.keep(profiles(docs))
    nodes = work.keep(
        own.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    )
    total = own.count()
    # classes with more than a thousandth of all rows: fewer than a thousand
    hot = {r["node"]: r["doc_id"] for r in nodes.where(F.col("copies") > max(1, total // 1000)).where("copies > 1").collect()}
    frequent, times = frequent_hashes(docs, total)
    shared = work.keep(shared_runs(key_rows(docs, hot, frequent, times)))
    runs = work.keep(distinct_runs(shared))
    work.drop(shared)
    active = runs.select("node").distinct()
    points = work.keep(own.join(active, "node").select("node", "counts").dropDuplicates(["node"]))

    # 1. two nodes of each run, those of least and of greatest hash, against the others
    chosen = F.struct(F.xxhash64("node").alias("h"), "node", "size", "short")
    ends = runs.groupBy("key").agg(F.array(F.min(chosen), F.max(chosen)).alias("ends"))
    stars = runs.join(ends, "key").select("node", "size", "short", F.explode("ends").alias("o")).where(
        (F.col("node") != F.col("o.node"))
        & (4 * F.greatest("size", "o.size") <= 5 * F.least("size", "o.size"))
        & (F.col("short") & (F.col("size") <= F.col("o.size")) | F.col("o.short") & (F.col("o.size") <= F.col("size")))
    ).select(F.least("node", "o.node").alias("a"), F.greatest("node", "o.node").alias("b")).distinct()
    tested = work.keep(stars)
    links = verified(work.keep(bounded(tested, points)), docs, nodes, work)
    labels = components(links, work)

    # 2. what those two leave of a run, if it still holds several components: trees over the points
    inner = runs.join(ends, "key").where(~F.array_contains(F.transform("ends", lambda e: e["node"]), F.col("node"))).drop("ends")
    labelled = inner.join(labels, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")
    open_ = labelled.groupBy("key").agg(F.min("label").alias("_low"), F.max("label").alias("_high")).where("_low <> _high").select("key")
    rest = work.keep(labelled.join(open_, "key"))
    more = tree_pairs(rest, points).join(tested, ["a", "b"], "left_anti")
    more = verified(work.keep(more), docs, nodes, work)
    labels = components(links.union(more), work)
    work.drop(runs, rest, points)

    named = own.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = (
        own.where("n_shingles > 0").join(labels, "node", "left").groupBy(F.coalesce("root", "node").alias("root"))
        .agg(F.min("doc_id").alias("component_id"))
    )
    some = named.where("n_shingles > 0").join(names, "root").select("doc_id", "n_shingles", "node", "component_id", "root")
    none = named.where("n_shingles = 0").select("doc_id", "n_shingles", "node", F.col("doc_id").alias("component_id"), "root")
    return some.union(none)


def kept_documents(docs: DataFrame) -> DataFrame:
    """One document of each class: the row of the smallest id; documents without words all stay.

    Of rows that share id and set, one stays.  Columns are those of ``docs``.
    """
    work = Work(docs.sparkSession, "ngram-keep")
    done = classes(docs)
    best = done.where("n_shingles > 0").groupBy("root").agg(F.min(F.struct("doc_id", "node")).alias("best")).select("best.*")
    best = work.keep(best)

    # the whole row travels as one column, so that names cannot clash
    rows = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("_row"))
    at = docs.columns.index("text")

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column(0).field(at)))
            columns = [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([node_of(s) for s in sets], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["_row", "_n", "_node"])

    from pyspark.sql import Window as W
    from pyspark.sql import types as T

    keyed = rows.mapInArrow(nodes, T.StructType([*rows.schema.fields, T.StructField("_n", T.LongType()), T.StructField("_node", T.LongType())]))
    chosen = best.select(F.col("doc_id").alias("_doc"), F.col("node").alias("_best"))
    worded = keyed.where("_n > 0").join(chosen, F.col("_row.doc_id").eqNullSafe(F.col("_doc")) & (F.col("_node") == F.col("_best")))
    one = worded.withColumn("_place", F.row_number().over(W.partitionBy("_doc", "_best").orderBy("_n"))).where("_place = 1")
    return one.select("_row.*").union(keyed.where("_n = 0").select("_row.*"))
