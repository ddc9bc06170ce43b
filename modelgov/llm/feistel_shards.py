"""Training-order materialisation: a keyed Feistel permutation gives every sequence a global slot.

Method.  Token ids of each document (a binary column of fixed-width little-endian ids) are cut into
sequences of ``length`` ids; the last one of a document is shorter and padded in the shard.  Sequences are
numbered from 0 without gaps, in an order that depends on ids and tokens only; a Feistel network
over the next power of four, walked along its cycles until it falls below the number of
sequences, permutes the numbers.  The slot a sequence gets names its shard (slot // per_shard) and
its place in it (slot % per_shard * stride), so a reader goes through shards in order and
resumes at any slot with one seek.

A shard is one row: shard, first_slot, n, stride, payload.  A record is a header (doc_id 8 bytes,
sequence 4, number of ids 4) and ``length`` ids.  Shards are range partitions of the slots; the
ranges are known beforehand, since slots are dense, so nothing is sampled.

Rows: null and empty token columns give one empty sequence, so every document has a slot; null ids are
stored as the smallest 64-bit number; equal rows get a slot for each of their sequences; an
empty table gives no shards; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.rank import number_within
from .tokens import mix
from .work import Work, rows_like

CELLS = 4096
#: rows of one written task, in order, whose numbers travel together
CHUNK_BITS = 14
ROUNDS = 6
HEADER = 16
NO_ID = -(2**63)
#: higher levels save about a tenth of the bytes and cost more time
PACK = pa.Codec("zstd", compression_level=1)
FAST = {"parquet.compression.codec.zstd.level": "1"}


def permuted(at: np.ndarray, total: int, key: int) -> np.ndarray:
    """The slot of each number below ``total``: a bijection on [0, total)."""
    half = max(1, -(-max(1, (max(total, 1) - 1).bit_length()) // 2))
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = mix(np.arange(ROUNDS, dtype=np.uint64) + np.uint64(key % 2**63) * np.uint64(2 * ROUNDS + 1))
    out = np.asarray(at, np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> shift, x & mask
        for k in keys:
            left, right = right, left ^ (mix(right + k) & mask)
        out[todo] = (left << shift) | right
        todo = todo[out[todo] >= np.uint64(total)]
    return out.astype(np.int64)


def write_shards(
    docs: DataFrame, path: str, *, tokens: Column | None = None, width: int = 1, length: int = 2048, per_shard: int = 2048,
    key: int = 17, id_column: str = "doc_id",
) -> tuple[DataFrame, int]:
    """Write the shards of all sequences under ``path``; return a scan of them and the number of slots."""
    spark = docs.sparkSession
    work = Work(spark, "feistel")
    size = length * width
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col("tokens") if tokens is None else tokens, F.lit(b"")).alias("tokens"))
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("tokens") / size)).cast("long").alias("n")
    row = F.monotonically_increasing_id()
    rows = rows.select("id", F.xxhash64("tokens").alias("digest"), n, "tokens").withColumn("row", row)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = work.keep_bucketed(rows.withColumn("chunk", F.shiftright("row", CHUNK_BITS)), "chunk", buckets, **FAST)
    firsts, total = _numbered(held.select("row", "id", "digest", "n"), work)
    # numbers travel to the buckets of the payloads, a chunk of rows at a time; payloads stay
    place = F.col("row").bitwiseAND(F.lit((1 << CHUNK_BITS) - 1)).cast("int")
    chunks = firsts.groupBy(F.shiftright("row", CHUNK_BITS).alias("chunk")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("row", "first"))), lambda x: x["first"]).alias("firsts"))
    numbered = held.select("chunk", "row", "id", "tokens").join(chunks.hint("shuffle_hash"), "chunk").select(
        "id", F.get("firsts", place).alias("first"), "tokens")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots, records = [], []
            taken = 0

            def out() -> pa.RecordBatch:
                at = permuted(np.asarray(slots, np.uint64), total, key)
                return pa.RecordBatch.from_arrays([pa.array(at), pa.array(at // per_shard), pa.array(records, pa.binary())], ["slot", "shard", "record"])

            for doc, first, cell in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                whole = cell.as_py()
                for k in range(max(1, -(-len(whole) // size))):
                    part = whole[k * size : (k + 1) * size]
                    slots.append(first + k)
                    records.append(squeezed(struct.pack("<qII", NO_ID if doc is None else doc, k, len(part) // width) + part))
                    taken += len(part)
                    if taken > 4_000_000:
                        yield out()
                        slots, records, taken = [], [], 0
            if slots:
                yield out()

    placed = numbered.mapInArrow(cut, "slot long, shard long, record binary")
    shards = -(-total // per_shard)
    tasks = max(1, min(shards, int(spark.conf.get("spark.sql.shuffle.partitions")) * 4))
    ranged = placed.repartitionById(tasks, F.floor(F.col("shard") * tasks / max(1, shards)).cast("int")).sortWithinPartitions("slot")
    stride = HEADER + size

    def glue(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, first, records = None, 0, []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([
                pa.array([shard], pa.int64()), pa.array([first], pa.int64()), pa.array([len(records)], pa.int64()),
                pa.array([stride], pa.int64()), pa.array([b"".join(records)], pa.binary()),
            ], ["shard", "first_slot", "n", "stride", "payload"])

        for batch in batches:
            for slot, own, record in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if own != shard:
                    if records:
                        yield out()
                    shard, first, records = own, slot, []
                records.append(unsqueezed(record.as_py()).ljust(stride, b"\0"))
        if records:
            yield out()

    done = ranged.mapInArrow(glue, "shard long, first_slot long, n long, stride long, payload binary")
    done.write.mode("overwrite").options(compression="zstd", **FAST).option("parquet.block.size", str(16 << 20)).parquet(path)
    work.drop(held, firsts)
    return spark.read.schema(done.schema).parquet(path), total


def squeezed(body: bytes) -> bytes:
    """Compressed for the way through a shuffle, in front its length."""
    return struct.pack("<I", len(body)) + PACK.compress(body, asbytes=True)


def unsqueezed(body: bytes) -> bytes:
    return PACK.decompress(memoryview(body)[4:], struct.unpack_from("<I", body)[0], asbytes=True)


def _numbered(rows: DataFrame, work: Work) -> tuple[DataFrame, int]:
    """``row``, ``first`` (number of the row's first sequence) and the number of sequences; texts take no part.

    Groups of equal rows are ordered by id and digest inside cells, cells by number; equal rows take their
    numbers in the order they were written, which shows in no result.
    """
    group = F.pmod(F.xxhash64("id", "digest"), F.lit(CELLS)).cast("int").alias("cell")
    groups = work.keep(rows.groupBy("id", "digest", "n").agg(F.count("*").alias("copies")).select("*", group))
    sums = sorted((r["cell"], r["n"]) for r in groups.groupBy("cell").agg(F.sum(F.col("n") * F.col("copies")).alias("n")).collect())  # CELLS rows at most
    before, starts = 0, []
    for c, m in sums:
        starts.append((c, before))
        before += m
    offsets = rows_like(work.spark, "cell int, _before bigint", starts)
    earlier = W.partitionBy("cell").orderBy("id", "digest").rowsBetween(W.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(F.col("n") * F.col("copies")).over(earlier), F.lit(0).cast("long"))
    firsts = groups.withColumn("_inside", inside).join(F.broadcast(offsets), "cell").select(
        "id", "digest", "copies", (F.col("_before") + F.col("_inside")).alias("first"))
    r, f = rows.alias("r"), firsts.alias("f")
    same = F.col("r.id").eqNullSafe(F.col("f.id")) & (F.col("r.digest") == F.col("f.digest"))
    joined = r.join(f, same).select("r.row", "r.id", "r.digest", "r.n", "f.copies", "f.first")
    done = joined.where("copies = 1").select("row", "first")
    if not groups.where("copies > 1").isEmpty():
        equal = number_within(joined.where("copies > 1"), ["id", "digest"], ["row"], "_nth")
        done = done.unionByName(equal.select("row", (F.col("first") + (F.col("_nth") - 1) * F.col("n")).alias("first")))
    return work.keep(done), before


def read_slots(shards: DataFrame, width: int = 1, from_slot: int = 0, tokens: bool = True) -> DataFrame:
    """The sequences of written shards: slot, shard, offset, doc_id, sequence, n_tokens, crc32 and, if asked for, tokens."""
    names = ["slot", "shard", "offset", "doc_id", "sequence", "n_tokens", "crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 1024):
                part = batch.slice(lo, 1024)
                heads, sums, bodies = [], [], []
                for record in part.column(3):
                    view = memoryview(record.as_buffer())
                    head = struct.unpack_from("<qII", view)
                    body = view[HEADER : HEADER + head[2] * width]
                    heads.append(head)
                    sums.append(zlib.crc32(body))
                    if tokens:
                        bodies.append(bytes(body))
                docs = [None if h[0] == NO_ID else h[0] for h in heads]
                columns = [*part.columns[:3], *(pa.array(c, pa.int64()) for c in (docs, [h[1] for h in heads], [h[2] for h in heads], sums))]
                if tokens:
                    columns.append(pa.array(bodies, pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names + ["tokens"] * tokens)

    skip = F.greatest(F.lit(0).cast("long"), from_slot - F.col("first_slot"))
    some = shards.where(F.col("first_slot") + F.col("n") > from_slot).select(
        "shard", "first_slot", "stride", "payload", F.explode(F.sequence(skip, F.col("n") - 1)).alias("i"))
    # a record at a time leaves the shard, so that no task sends whole shards to its worker, and no padding
    start = (F.col("i") * F.col("stride")).cast("int")
    count = F.conv(F.concat(*(F.hex(F.substring("payload", start + HEADER - k, F.lit(1))) for k in range(4))), 16, 10).cast("int")
    records = some.select(
        (F.col("first_slot") + F.col("i")).alias("slot"), "shard", (F.col("i") * F.col("stride")).alias("offset"),
        F.substring("payload", start + 1, HEADER + count * width).alias("record"))
    return records.mapInArrow(run, ", ".join(f"{n} long" for n in names) + ", tokens binary" * tokens)
