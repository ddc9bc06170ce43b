"""Exact top-k inner products by block-at-a-time pruning.

Method.  Components are terms with the integer weight floor(256 * x).  Documents are ordered by id
and cut into blocks; a block keeps the largest and the smallest weight of every term and a
forward index (its documents' weights).  For each query the blocks are ordered by the sum of the
greatest contributions each term can make, and are scored through their forward index until the next
bound falls below the k-th score found.  A bound equal to it is still opened, since a smaller id
wins a tie.

Work is spread over (shard of blocks, chunk of queries) pairs: chunks of queries are sent to every
shard, shards stay where they are, and each pair hands back k rows a query, which a window merges.
Inner products are summed in doubles while they are exact there, and in integers of any size beyond;
scores outside 64 bits are cut to its ends.

Rows: vectors that are null, empty or hold null or non-finite components take no part; rows of
different lengths do not meet; equal ids are ranked in a defined but arbitrary order after all
else; null ids take no part; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .vectors import doubles, matrix, usable
from .work import Work

BLOCK = 256
SHARD_ROWS = 8192
CHUNK = 512
EXACT = float(2**53)


def _packed(rows: DataFrame, most: int) -> DataFrame:
    """Consecutive rows by id as one row: n, size, ids and weights as bytes; the pack's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts = [], []

        def out() -> pa.RecordBatch:
            x = np.concatenate(parts)
            return pa.RecordBatch.from_arrays([
                pa.array([x.shape[1]], pa.int32()), pa.array([np.concatenate(ids).tobytes()], pa.binary()),
                pa.array([x.tobytes()], pa.binary()),
            ], ["dims", "ids", "weights"])

        def even(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            sizes = batch.column(1).value_lengths().to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(sizes)]
            return (batch.slice(lo, hi - lo) for lo, hi in zip(edges, edges[1:], strict=False) if hi > lo)

        for batch in (part for b in batches for part in even(b)):
            x = matrix(batch.column(1))
            own = batch.column(0).to_numpy()
            while len(own):
                room = most - sum(map(len, ids))
                if parts and parts[-1].shape[1] != x.shape[1]:
                    yield out()
                    ids, parts, room = [], [], most
                ids.append(own[:room])
                parts.append(np.floor(256.0 * x[:room]))
                own, x = own[room:], x[room:]
                if sum(map(len, ids)) == most:
                    yield out()
                    ids, parts = [], []
        if ids:
            yield out()

    ranged = rows.repartitionByRange("dims", "id").sortWithinPartitions("dims", "id")
    packs = ranged.select("id", "x").mapInArrow(run, "dims int, ids binary, weights binary")
    return packs.withColumn("pack", F.monotonically_increasing_id())


def _dots(q: np.ndarray, x: np.ndarray, exact: bool) -> np.ndarray:
    if exact:
        return (q @ x.T).astype(np.int64)
    big = np.asarray([[int(v) for v in r] for r in q], object) @ np.asarray([[int(v) for v in r] for r in x], object).T
    ends = np.iinfo(np.int64)
    return np.clip(big, ends.min, ends.max).astype(np.int64)


def search_shard(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[list[int], list[int], list[int], int]:
    """Best k documents of a shard for each query; also how many blocks were opened."""
    heads = np.arange(0, len(ids), BLOCK)
    top, low = np.maximum.reduceat(x, heads), np.minimum.reduceat(x, heads)
    plus, minus = np.maximum(q, 0), np.minimum(q, 0)
    exact = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * x.shape[1] < EXACT
    bounds = plus @ top.T + minus @ low.T
    if not exact:
        bounds = bounds * (1 + 1e-9 * np.sign(bounds)) + 1.0
    order = np.argsort(-bounds, axis=1, kind="stable")
    best_score = np.full((len(q), k), np.iinfo(np.int64).min)
    best_id = np.full((len(q), k), np.iinfo(np.int64).max)
    filled = np.zeros(len(q), np.int64)
    opened = 0
    going = np.arange(len(q))
    for step in range(len(heads)):
        block = order[going, step]
        keep = (filled[going] < k) | (bounds[going, block] >= best_score[going, -1].astype(np.float64))
        going, block = going[keep], block[keep]
        if not len(going):
            break
        for b in np.unique(block).tolist():  # the queries that open the same block now share its forward index
            rows = going[block == b]
            lo, hi = int(heads[b]), min(len(ids), int(heads[b]) + BLOCK)
            scores = _dots(q[rows], x[lo:hi], exact)
            own = np.broadcast_to(ids[lo:hi], scores.shape)
            valid = own != q_ids[rows][:, None]
            opened += len(rows)
            score = np.concatenate([best_score[rows], np.where(valid, scores, np.iinfo(np.int64).min)], axis=1)
            name = np.concatenate([best_id[rows], np.where(valid, own, np.iinfo(np.int64).max)], axis=1)
            pick = _order(score, name, k)
            best_score[rows] = np.take_along_axis(score, pick, axis=1)
            best_id[rows] = np.take_along_axis(name, pick, axis=1)
            filled[rows] = np.minimum(k, filled[rows] + valid.sum(axis=1))
    out_q, out_id, out_score = [], [], []
    for i in range(len(q)):
        n = int(filled[i])
        out_q += [int(q_ids[i])] * n
        out_id += best_id[i, :n].tolist()
        out_score += best_score[i, :n].tolist()
    return out_q, out_id, out_score, opened


def _order(score: np.ndarray, name: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of each row: by score, then by smaller name."""
    by_name = np.argsort(name, axis=1, kind="stable")
    by_score = np.argsort(~np.take_along_axis(score, by_name, axis=1), axis=1, kind="stable")[:, :k]
    return np.take_along_axis(by_name, by_score, axis=1)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of every query row."""
    work = Work(vectors.sparkSession, "topk")
    rows = vectors.select(F.col(key).cast("long").alias("id"), is_query.alias("q"), doubles(vector).alias("x"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("x"))).withColumn("dims", F.size("x"))
    rows = work.keep(rows)
    shards = work.keep(_packed(rows, SHARD_ROWS))
    chunks = work.keep(_packed(rows.where("q"), CHUNK))
    names = shards.select("dims", F.col("pack").alias("shard"))
    sent = chunks.join(names, "dims").select("shard", F.col("ids").alias("q_ids"), F.col("weights").alias("q"), "dims")
    pairs = sent.join(shards.select(F.col("pack").alias("shard"), "ids", "weights"), "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                q_ids, q, dims, ids, x = (batch.column(c)[i].as_py() for c in ("q_ids", "q", "dims", "ids", "weights"))
                found = search_shard(
                    np.frombuffer(q_ids, np.int64), np.frombuffer(q).reshape(-1, dims),
                    np.frombuffer(ids, np.int64), np.frombuffer(x).reshape(-1, dims), k,
                )
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found[:3]], ["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(run, "query_id long, vec_id long, score long")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
