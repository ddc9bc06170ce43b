"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, exact rerank.

Method.  On a bounded sample a rotation is learned that makes the signs of the rotated, centred
unit vectors balanced binary codes (iterative quantisation: codes from the rotation, rotation from
the codes by the orthogonal Procrustes solution, repeated).  Vectors with fewer components than a
code has bits get several rotations, each from another start.  Every vector gets a code.  The code
is cut into substrings; a table per substring lists codes under every value a few bits away, so two
codes meet in a table when their substrings differ in few bits.  Codes that meet and differ in at
most a radius of bits are compared on the original vectors in double precision.

The length of the substrings, the bits in which they may differ and the radius come from pairs whose
cosine is known: the sample's own links, and pairs made to lie just at the threshold from its vectors,
in any direction and inside the sample's spread.  ``RECALL`` of each kind must be found.  Where tables
that find them would hold two unlike codes together too often (a strong common direction: unlike
vectors are then hardly farther apart than linked ones), all vectors are compared in pairs of blocks:
nothing is missed, and the cost is that of all pairs.

Equal vectors are one entry of the index, so a hot vector costs as much as any other; the tables hold
distinct codes, so a hot code does too.  A pair of codes is taken in the first table where they meet,
and there at one value, so it comes up once; vectors of one code are paired without the tables.
Retrieval by tables is approximate (recall is measured against brute force in the tests), the comparison is
exact: no pair below the threshold is linked.

Bound: the rotation is fitted on at most ``SAMPLE`` vectors, those of least hash; all are indexed.  Vectors below a hash
that leaves hardly more than the sample are all that is sent for it, and lists of table values are joined by sorting: the
planner takes them for as small as the codes they are made of, and would send them through the driver.

Rows: vectors that are null, empty, zero or hold null or non-finite components link with nothing;
vectors of different lengths don't link; equal rows (equal ids too) are linked to each other;
null ids take part but do not name a component; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stars import components
from .vectors import doubles, matrix, usable
from .work import Work

SAMPLE = 10_000
ROUNDS = 30
WIDTHS = (16, 12, 8)
MOST_APART = 3
RECALL = 0.95
#: Table rows that two unlike codes may share on average; beyond it, comparing all vectors costs less.
MEETINGS = 1 / 16
KNOWN = 4_000
BLOCK = 4_096


def learn_rotation(sample: np.ndarray, bits: int, rounds: int = ROUNDS, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Centre and projection (dimension x bits) whose signs are the codes."""
    centre = sample.mean(axis=0)
    x = sample - centre
    _, directions = np.linalg.eigh(x.T @ x)
    basis = directions[:, ::-1][:, :bits]
    projected = x @ basis
    rotation, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(basis.shape[1], basis.shape[1])))
    for _ in range(rounds):
        codes = np.where(projected @ rotation >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(projected.T @ codes)
        rotation = left @ right
    return centre, basis @ rotation


def projection_of(sample: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Centre and projection to as many bits, by as many rotations as the components need."""
    size = sample.shape[1]
    centre, parts = sample.mean(axis=0), []
    for seed, lo in enumerate(range(0, bits, size), 5):
        parts.append(learn_rotation(sample, min(size, bits - lo), seed=seed)[1])
    return centre, np.concatenate(parts, axis=1)


def codes_of(x: np.ndarray, centre: np.ndarray, projection: np.ndarray) -> np.ndarray:
    weights = np.uint64(1) << np.arange(projection.shape[1], dtype=np.uint64)
    return (((x - centre) @ projection >= 0) * weights).sum(axis=1, dtype=np.uint64)


def known_pairs(sample: np.ndarray, threshold: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs of unit vectors by kind: the sample's own, and two kinds made at the threshold."""
    n = len(sample)
    rng = np.random.default_rng(7)
    left, right, have = [], [], 0
    for lo in range(0, n, 256):
        i, j = np.nonzero(sample[lo : lo + 256] @ sample.T >= threshold)
        later = np.flatnonzero(i + lo < j)
        later = later if len(later) <= KNOWN else rng.choice(later, KNOWN, replace=False)
        left.append(i[later] + lo)
        right.append(j[later])
        have += len(later)
        if have >= 10 * KNOWN:
            break
    own = sample[np.concatenate(left)], sample[np.concatenate(right)]
    at = rng.integers(n, size=KNOWN)
    x, other = sample[at], sample[(at + rng.integers(1, n, size=KNOWN)) % n]

    def unit(v: np.ndarray) -> np.ndarray:
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)

    # any direction
    noise = rng.normal(size=x.shape)
    noise = unit(noise - (noise * x).sum(axis=1, keepdims=True) * x)
    anywhere = threshold * x + np.sqrt(max(0.0, 1 - threshold * threshold)) * noise
    # inside the spread: part of the vector's own way from the centre, part of another's
    centre = sample.mean(axis=0)
    low, high = np.zeros((KNOWN, 1)), np.ones((KNOWN, 1))
    for _ in range(30):
        part = (low + high) / 2
        inside = unit(centre + part * (x - centre) + np.sqrt(1 - part * part) * (other - centre))
        near = (inside * x).sum(axis=1, keepdims=True) >= threshold
        low, high = np.where(near, low, part), np.where(near, part, high)
    inside = unit(centre + high * (x - centre) + np.sqrt(1 - high * high) * (other - centre))
    return [own, (x, anywhere), (x, inside)]


def tables_of(bits: int, width: int) -> list[tuple[int, int]]:
    """First bit and length of every substring."""
    return [(lo, min(width, bits - lo)) for lo in range(0, bits, width)]


def part_apart(differ: np.ndarray, table: tuple[int, int]) -> np.ndarray:
    """In how many bits of a substring codes differ."""
    return np.bitwise_count((differ >> np.uint64(table[0])) & np.uint64((1 << table[1]) - 1)).astype(np.int64)


def shared_values(width: int, apart: int, most: int) -> int:
    """Values under which both of two substrings are listed that differ in some bits."""
    far, near = most - most // 2, most // 2
    return sum(
        comb(apart, i) * comb(width - apart, k)
        for i in range(apart + 1) for k in range(width - apart + 1) if i + k <= far and apart - i + k <= near
    )


def fit_tables(sample: np.ndarray, threshold: float, centre: np.ndarray, projection: np.ndarray) -> tuple[int, int, int] | None:
    """Substring length, bits apart and radius that find the known pairs at least cost; none if no tables are worth it."""
    bits = projection.shape[1]
    kinds = [codes_of(x, centre, projection) ^ codes_of(y, centre, projection) for x, y in known_pairs(sample, threshold)]
    kinds = [d for d in kinds if len(d) >= 100]
    distinct = np.unique(codes_of(sample, centre, projection))
    rng = np.random.default_rng(9)
    unlike = np.zeros(0, np.uint64)
    if len(distinct) > 1:
        at = rng.integers(len(distinct), size=100_000)
        unlike = distinct[at] ^ distinct[(at + rng.integers(1, len(distinct), size=len(at))) % len(distinct)]
    best = None
    for width in WIDTHS:
        tables = tables_of(bits, width)
        near = [np.min([part_apart(d, t) for t in tables], axis=0) for d in kinds]
        for most in range(MOST_APART + 1):
            rows = sum(
                np.asarray([shared_values(t[1], k, most) for k in range(t[1] + 1)])[part_apart(unlike, t)].sum() for t in tables
            ) / max(1, len(unlike))
            if rows > MEETINGS or best is not None and rows >= best[0]:
                continue
            wanted = []
            for d, n in zip(kinds, near, strict=True):
                full = np.bitwise_count(d[n <= most])
                # the radius loses none of the known pairs that meet
                wanted.append(int(full.max()) if len(full) >= RECALL * len(d) else None)
            if None not in wanted:
                best = rows, width, most, max(wanted)
    return best and best[1:]


def flips(width: int, most: int) -> list[int]:
    return [sum(1 << b for b in own) for n in range(most + 1) for own in combinations(range(width), n)]


def table_pairs(entries: DataFrame, centre: np.ndarray, projection: np.ndarray, plan: tuple[int, int, int], work: Work) -> DataFrame:
    """Pairs a < b whose codes meet in a table and differ in at most a radius of bits."""
    width, most, radius = plan

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = codes_of(matrix(batch.column(1)), centre, projection) if len(batch) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.astype(np.int64))], ["node", "code"])

    codes = work.keep(entries.select("node", "unit").mapInArrow(run, "node long, code long"))
    tables = tables_of(projection.shape[1], width)
    part = lambda code, t: F.shiftrightunsigned(code, t[0]).bitwiseAND(F.lit((1 << t[1]) - 1))
    far, near = most - most // 2, most // 2
    distinct = work.keep(codes.select("code").distinct())

    def listed(name: str, bits: int) -> DataFrame:
        spots = F.array(*(F.struct(F.lit(k).alias("t"), part(F.col("code"), t).alias("v")) for k, t in enumerate(tables)))
        ways = [F.array(*(F.lit(f).cast("long") for f in flips(t[1], bits))) for t in tables]
        rows = distinct.select("code", F.explode(spots).alias("s")).select("code", "s.t", "s.v")
        own = F.element_at(F.array(*ways), F.col("t") + 1)
        rows = rows.select("code", "t", "v", F.explode(own).alias("f"))
        return rows.select(F.col("code").alias(name), "t", F.col("v").bitwiseXOR(F.col("f")).alias("v"))

    apart = F.bit_count(F.col("ca").bitwiseXOR(F.col("cb")))
    met = listed("ca", far).join(listed("cb", near).hint("merge"), ["t", "v"]).where((F.col("ca") < F.col("cb")) & (apart <= radius))
    # the first table in which the substrings are near enough, and one value there
    first = F.lit(len(tables))
    value = F.lit(-1).cast("long")
    for k, t in reversed(list(enumerate(tables))):
        at = part(F.col("ca"), t)
        differ = at.bitwiseXOR(part(F.col("cb"), t))
        n = F.bit_count(differ)
        # what the other list does not reach is flipped here, from the lowest differing bit on
        rest = differ
        for bit in range(far):
            lowest = rest.bitwiseAND(-rest)
            at = F.when(n - near > bit, at.bitwiseXOR(lowest)).otherwise(at)
            rest = rest.bitwiseXOR(lowest)
        first = F.when(n <= most, F.lit(k)).otherwise(first)
        value = F.when(n <= most, at).otherwise(value)
    near_codes = met.where((F.col("t") == first) & (F.col("v") == value)).select("ca", "cb")
    of_a, of_b = codes.toDF("x", "ca"), codes.toDF("y", "cb")
    across = near_codes.join(of_a, "ca").join(of_b, "cb")
    within = of_a.join(of_b.withColumnRenamed("cb", "ca"), "ca").where(F.col("x") < F.col("y"))
    ordered = across.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return ordered.union(within.select("x", "y"))


def block_pairs(entries: DataFrame, threshold: float, count: int, size: int) -> DataFrame:
    """Pairs a < b with a cosine near or above the threshold, from products of all pairs of blocks."""
    rows = max(64, min(BLOCK, (1 << 21) // size))
    blocks = -(-count // rows)
    own = F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int")
    spread = entries.select("node", "unit", own.alias("own"))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    spread = spread.select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "unit")

    def compared(i: int, j: int, own: np.ndarray, nodes: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        a, b = np.flatnonzero(own == i), np.flatnonzero(own == j)
        for lo in range(0, len(a), 512):
            part = a[lo : lo + 512]
            # the exact comparison follows; sums in another order differ by far less than this
            p, q = np.nonzero(x[part] @ x[b].T >= threshold - 1e-9)
            p, q = nodes[part[p]], nodes[b[q]]
            keep = p < q if i == j else slice(None)
            p, q = p[keep], q[keep]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, parts = None, []
        for batch in batches:
            if not len(batch):
                continue
            i, j = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            edges = [0, *cuts.tolist(), len(i)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if (i[lo], j[lo]) != group:
                    if parts:
                        yield from compared(*group, *map(np.concatenate, zip(*parts, strict=True)))
                    group, parts = (i[lo], j[lo]), []
                piece = batch.slice(lo, hi - lo)
                parts.append((piece.column(2).to_numpy(), piece.column(3).to_numpy(), matrix(piece.column(4))))
        if parts:
            yield from compared(*group, *map(np.concatenate, zip(*parts, strict=True)))

    return spread.repartition("i", "j").sortWithinPartitions("i", "j").mapInArrow(run, "a long, b long")


def sample_of(entries: DataFrame, count: int) -> np.ndarray:
    """The ``SAMPLE`` vectors of least hash among ``count``, by hash; all, if there are fewer.

    Hashes are spread evenly, so a bound on them leaves about half as many again as are wanted, and no
    partition sends the driver a sample of its own.
    """
    wanted, share = min(SAMPLE, count), 1.5 * SAMPLE / max(count, 1)
    while True:
        low = entries.select("node", "unit", F.xxhash64("node").alias("h"))
        if share < 1:
            low = low.where(F.col("h") < int(share * 2**64) - 2**63)
        rows = low.orderBy("h", "node").limit(SAMPLE).select("unit").toArrow()
        if share >= 1 or rows.num_rows >= wanted:
            return matrix(rows.column(0))
        share *= 4


def linked_pairs(entries: DataFrame, threshold: float, bits: int, count: int, size: int, work: Work) -> DataFrame:
    """Pairs a < b of entries (node, unit: vector of length one) with cosine at or above the threshold."""
    x = sample_of(entries, count)
    if len(x) < 2:
        return entries.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    centre, projection = projection_of(x, bits)
    plan = fit_tables(x, threshold, centre, projection)
    candidates = table_pairs(entries, centre, projection, plan, work) if plan else block_pairs(entries, threshold, count, size)
    units = entries.select("node", "unit")
    whole = (
        candidates.join(units.toDF("a", "ua"), "a").join(units.toDF("b", "ub"), "b")
        .withColumn("cosine", F.aggregate(F.zip_with("ua", "ub", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x))
    )
    return whole.where(F.col("cosine") >= threshold).select("a", "b")


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.9, bits: int = 64, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """Per row: key, n_links, component_id, kept."""
    work = Work(vectors.sparkSession, "itq")
    rows = vectors.select(F.col(key).alias("id"), doubles(vector).alias("x"))
    largest = F.array_max(F.transform("x", lambda x: F.abs(x)))
    good = usable(F.col("x")) & (F.coalesce(largest, F.lit(0.0)) > 0)
    # scaled by the largest component first, so that squares neither overflow nor vanish
    scaled = F.transform("x", lambda x: x / F.col("_most"))
    length = F.sqrt(F.aggregate(F.col("_scaled"), F.lit(0.0), lambda s, x: s + x * x))
    rows = rows.withColumn("_most", F.when(good, largest)).withColumn("_scaled", F.when(F.col("_most").isNotNull(), scaled))
    rows = rows.withColumn("unit", F.when(F.col("_most").isNotNull(), F.transform("_scaled", lambda x: x / length)))
    rows = work.keep(rows.select("id", "unit", F.xxhash64("unit").alias("node")))
    entries = work.keep(
        rows.where(F.col("unit").isNotNull()).groupBy("node").agg(F.first("unit").alias("unit"), F.count("*").alias("copies"))
    )
    by_length = entries.groupBy(F.size("unit").alias("n")).count().collect()
    pairs = None
    for n, count in sorted(map(tuple, by_length)):
        found = linked_pairs(entries.where(F.size("unit") == n), threshold, bits, count, n, work)
        pairs = found if pairs is None else pairs.union(found)
    if pairs is None:
        pairs = entries.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    pairs = work.keep(pairs)
    labels = components(pairs, work)
    copies = entries.select("node", "copies")
    both = pairs.union(pairs.select("b", "a")).toDF("node", "other")
    links = both.join(copies.toDF("other", "n"), "other").groupBy("node").agg(F.sum("n").alias("others"))
    nodes = copies.join(links, "node", "left").join(labels, "node", "left").select(
        "node", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")
    )
    named = rows.where(F.col("unit").isNotNull()).join(nodes, "node")
    names = rows.where(F.col("unit").isNotNull()).groupBy("node").agg(F.min("id").alias("id")).join(nodes, "node")
    names = names.groupBy("root").agg(F.min("id").alias("component_id"))
    some = named.join(names, "root").select(F.col("id").alias(key), "n_links", "component_id")
    none = rows.where(F.col("unit").isNull()).select(F.col("id").alias(key), F.lit(0).cast("long"), F.col("id"))
    return some.union(none).withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))
