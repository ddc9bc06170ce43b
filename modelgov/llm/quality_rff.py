"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Method.  Each text becomes a vector of statistics (sizes, shares of character classes, repeated
words and the like), standardised on the training rows.  Random Fourier features approximate a
Gaussian kernel over these vectors.  Every partition sums its part of the normal equations in
fixed-point integers, so the totals do not depend on how rows are spread; the driver solves the
small ridge system.  Scores of rows that a model has not seen (three folds) are counted in bins,
and pooling adjacent violators turns the bins into a rising map from score to share of label 1.

Bound: the model is fitted on at most ``sample_rows`` labelled rows, those of least hash.  Scoring
covers every row and every whole text.

Rows: a null text counts as empty; empty texts get a score too; rows with a null id are never
learned from; several labels of one id are averaged (one half or more is 1); an id that several
rows carry is learned from each; without both labels the score is the share of label 1 (0.5
without labels); other columns pass through ``score`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tokens import blocks, utf8, word_hashes
from .work import Work

SAMPLE_ROWS = 20_000
FEATURES = 192
FOLDS = 3
BINS = 1000
RIDGE = 3.0
#: Fixed-point steps to one: products of two features sum exactly in 64 bits over 2**31 rows.
STEPS = 1 << 16

_KIND = np.zeros(256, np.int64)  # by first byte: 0 other ASCII, 1 lower, 2 upper, 3 digit, 4 blank, 5 line break, 6 stop, 7 mark, 8 bar, 9 bang, 10 beyond ASCII
for _chars, _k in (("abcdefghijklmnopqrstuvwxyz", 1), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), ("0123456789", 3), (" \t\v\f", 4), ("\n\r", 5), (".,;:?'\"()-", 6), ("#$%&*@^~_=+<>/\\", 7), ("|", 8), ("!", 9)):
    _KIND[[ord(_c) for _c in _chars]] = _k
_KIND[128:] = 10
N_STATISTICS = 26


def _statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    out = np.zeros((n, N_STATISTICS))
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(n), sizes)
    kinds = _KIND[data]
    counts = np.bincount(row * 11 + kinds, minlength=n * 11).reshape(n, 11).astype(float)
    letters = counts[:, 1] + counts[:, 2] + counts[:, 10]
    share = counts / np.maximum(1, sizes)[:, None]
    out[:, 0] = np.log1p(sizes)
    out[:, 1:12] = np.sqrt(share)
    out[:, 12] = counts[:, 2] / np.maximum(1, letters)
    hashes, opens, ends, before = word_hashes(data, offsets)
    words = np.diff(before)
    of = np.repeat(np.arange(n), words)
    per = np.maximum(1, words)
    lengths = (ends - opens).astype(float)
    out[:, 13] = np.log1p(words)
    out[:, 14] = np.bincount(of, lengths, n) / per
    out[:, 15] = np.sqrt(np.maximum(0, np.bincount(of, lengths**2, n) / per - out[:, 14] ** 2))
    last, first = kinds[ends - 1], kinds[opens]
    out[:, 16] = np.bincount(of, (last >= 7) & (last <= 9), n) / per
    out[:, 17] = np.bincount(of, last == 6, n) / per
    out[:, 18] = np.bincount(of, first == 2, n) / per
    out[:, 19] = np.bincount(of, (ends - opens == 1) & (first >= 6) & (first <= 9), n) / per
    again = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    out[:, 20] = np.bincount(of[1:], again, n) / per
    # Words by row and hash: how many are distinct, and how often the most frequent one comes.
    order = np.lexsort((hashes, of))
    h, o = hashes[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    heads = np.flatnonzero(new)
    runs = np.diff(np.append(heads, len(h)))
    out[:, 21] = np.bincount(o[heads], minlength=n) / per
    most = np.zeros(n)
    np.maximum.at(most, o[heads], runs)
    out[:, 22] = most / per
    out[:, 23] = np.bincount(o[heads], minlength=n) / np.sqrt(per)
    # Shares that hold within the worst line rather than on the average.
    marks = ((last >= 7) & (last <= 9)).astype(float)
    inside = np.arange(len(of)) - before[of]
    block = inside // 32 + of * (len(of) // 32 + 2)
    _, where = np.unique(block, return_inverse=True)
    here = np.bincount(where)
    worst = np.bincount(where, marks) / np.maximum(8, here)
    top = np.zeros(n)
    if len(of):
        heads = np.flatnonzero(np.append(True, np.diff(where) > 0))
        np.maximum.at(top, of[heads], worst)
        second = kinds[np.minimum(opens + 1, len(kinds) - 1)]
        upper = np.bincount(where, (first == 2) & (second == 2) & (ends - opens > 1)) / np.maximum(8, here)
        loud = np.zeros(n)
        np.maximum.at(loud, of[heads], upper)
        out[:, 25] = loud
    out[:, 24] = top
    return out


def statistics(column: pa.Array) -> np.ndarray:
    """A row of statistics for every text, computed on the whole text."""
    data, offsets = utf8(column)
    parts = [
        _statistics(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        for lo, hi in blocks(offsets)
    ]
    return np.concatenate(parts) if parts else np.zeros((0, N_STATISTICS))


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    spread: np.ndarray
    seed: int
    features: int
    bandwidth: float
    weights: np.ndarray
    knots: np.ndarray  # raw scores, rising
    levels: np.ndarray  # calibrated scores at the knots, rising

    def fourier(self, x: np.ndarray) -> np.ndarray:
        """Fixed-point random Fourier features, with a constant as the last one."""
        rng = np.random.default_rng(self.seed)
        w = rng.normal(0, 1 / self.bandwidth, (len(self.mean), self.features))
        b = rng.uniform(0, 2 * np.pi, self.features)
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        out = np.empty((len(x), self.features + 1))
        out[:, :-1] = np.rint(np.cos(z @ w + b) * STEPS)
        out[:, -1] = STEPS
        return out

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.fourier(x) @ self.weights / STEPS

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not len(self.knots):
            return np.full(len(x), float(self.levels[0]))
        return np.interp(self.raw(x), self.knots, self.levels)


def training_rows(labels: DataFrame, allowed: Column, label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Ids and labels that may be learned from: the ``sample_rows`` of least hash among the allowed."""
    known = labels.where(allowed & F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    per_id = known.groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    return per_id.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)


def fit(
    docs: DataFrame, rows: DataFrame, *, text: str = "text", features: int = FEATURES, ridge: float = RIDGE,
    bandwidth: float | None = None, seed: int = 7,
) -> Model:
    """Fit on the documents that ``rows`` (doc_id, y; at most SAMPLE_ROWS of them) labels."""
    spark = docs.sparkSession
    work = Work(spark, "quality")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "y", "x"]
            )

    chosen = docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(rows), "doc_id")
    schema = T.StructType([docs.schema["doc_id"], T.StructField("y", T.IntegerType()), T.StructField("x", T.ArrayType(T.DoubleType()))])
    sample = work.keep(chosen.select("doc_id", "text", "y").mapInArrow(measure, schema).repartition(8, "doc_id"))
    dims = range(N_STATISTICS)
    moments = sample.agg(
        F.count("*").alias("n"), F.sum("y").alias("ones"),
        *(F.avg(F.col("x")[i]).alias(f"m{i}") for i in dims), *(F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in dims),
    ).first()
    n, ones = moments["n"], moments["ones"] or 0
    if ones in (0, n):
        level = np.asarray([ones / n if n else 0.5])
        return Model(np.zeros(0), np.zeros(0), seed, 0, 1.0, np.zeros(0), np.zeros(0), level)
    mean = np.round([moments[f"m{i}"] for i in dims], 6)
    spread = np.round([moments[f"s{i}"] for i in dims], 6)
    spread[spread < 1e-6] = 1.0
    bare = Model(mean, spread, seed, features, bandwidth or float(np.sqrt(2 * N_STATISTICS)), np.zeros(features + 1), np.zeros(0), np.zeros(1))
    fold = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int").alias("fold")
    held = sample.select(fold, "y", "x")

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for pdf in batches:
            for lo in range(0, len(pdf), 4096):
                part = pdf.iloc[lo : lo + 4096]
                z = bare.fourier(np.stack(part["x"].to_numpy()))
                y = np.where(part["y"].to_numpy() > 0, STEPS, 0).astype(float)
                for k in np.unique(part["fold"]):
                    at = (part["fold"] == k).to_numpy()
                    whole = np.column_stack([z[at], y[at]])
                    # 4,096 products of 32 bits: exact in a double
                    total[int(k)] = total.get(int(k), 0) + np.rint(whole.T @ whole).astype(np.int64)
        for k, a in total.items():
            i, j = np.triu_indices(len(a))
            yield pd.DataFrame({"fold": k, "i": i.astype(np.int32), "j": j.astype(np.int32), "v": a[i, j]})

    parts = (
        held.mapInPandas(sums, "fold int, i int, j int, v long").groupBy("fold", "i", "j").agg(F.sum("v").alias("v"))
    ).toPandas()
    size = features + 2
    gram = np.zeros((FOLDS, size, size))
    gram[parts["fold"], parts["i"], parts["j"]] = parts["v"] / STEPS**2
    gram[parts["fold"], parts["j"], parts["i"]] = parts["v"] / STEPS**2
    penalty = ridge * np.eye(size - 1)
    penalty[-1, -1] = 1e-6

    def solve(a: np.ndarray) -> np.ndarray:
        return np.linalg.solve(a[:-1, :-1] + penalty, a[:-1, -1])

    others = [solve(gram.sum(0) - gram[k]) for k in range(FOLDS)]

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            z = bare.fourier(np.stack(pdf["x"].to_numpy())) / STEPS
            raw = np.einsum("ij,ij->i", z, np.stack(others)[pdf["fold"].to_numpy()])
            yield pd.DataFrame({"bin": np.rint(np.clip(raw, -1, 2) * BINS).astype(np.int32), "y": pdf["y"]})

    bins = (
        held.mapInPandas(binned, "bin int, y int").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("ones"))
    ).toPandas().sort_values("bin")
    knots, levels = isotonic(bins["bin"].to_numpy() / BINS, bins["ones"].to_numpy(float), bins["n"].to_numpy(float))
    work.drop(sample)
    return Model(mean, spread, seed, features, bare.bandwidth, solve(gram.sum(0)), knots, levels)


def isotonic(at: np.ndarray, ones: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; a rising, piecewise linear map through the pools' centres."""
    pools: list[list[float]] = []  # centre sum, ones, n
    for a, o, c in zip(at, ones, n, strict=True):
        pools.append([a * c, o, c])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], last, strict=True)]
    knots = np.asarray([p[0] / p[2] for p in pools])
    levels = np.asarray([(p[1] + 0.5) / (p[2] + 1) for p in pools])
    levels = np.maximum.accumulate(levels)
    # Beyond the outer pools the map goes on rising a little, so that scores keep their order.
    knots = np.concatenate([[knots[0] - 1.0], knots, [knots[-1] + 1.0]])
    levels = np.concatenate([[levels[0] * 0.5], levels, [1 - (1 - levels[-1]) * 0.5]])
    return knots, levels


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the score of every whole text; all other columns stay as they are."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(np.clip(model.scores(statistics(pa.Array.from_pandas(texts, type=pa.large_string()))), 0.0, 1.0))

    return docs.withColumn(into, scored(F.col(text)))


def held_out(key: str = "doc_id") -> Column:
    """Rows kept from learning: crc32 of the id as text, modulo 5, is 0; null ids too."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(True))
