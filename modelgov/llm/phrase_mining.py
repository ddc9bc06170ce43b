r"""Phrase collocation mining: frequent phrases of each language, scored by how firmly their parts hold together.

Method.  Suffix pointers sorted by multikey three-way quicksort, to a depth of ``longest`` words.  Words are counted
first.  Then every word position is a suffix, its first ``longest`` words its key; suffixes that begin
with an infrequent word are abandoned, later infrequent words end the key.  Tasks merge equal keys and route them
by their leading words: by the first word; where that is hot (more than 1/1024 of all words, so at most
1024 words are), by the second as well, and so on.  So no routed group is hot, and every phrase that goes beyond its hot
leading words is whole in one task.  There all partitions of one round are split at once into smaller,
equal and larger: an equal partition's size is the count of a phrase and it is sorted on by the next
word; partitions lighter than ``least`` are abandoned.  Phrases made of hot words alone are parts of several tasks and summed.

Words are told apart by 64-bit digests of language and word.  The count of words shows every clash of
digests, and the run starts again with another salt, so counts are exact.

Phrases: text is lower-cased (A-Z), cut into pieces at ``[.,;:!?\x0A-\x0D]``, pieces into words ``[^\x20\x09]+``; occurrences
may overlap.  A cut after k words scores floor(10^6 * a * a / (l * r)); the phrase scores as its worst cut.

Rows: a null text is empty, a null language ``und``; empty texts and pieces have no words; equal rows count each time;
a text of any length is read in slices; ties rank by phrase in byte order; an empty table gives no rows; other
columns are ignored.  Counts may reach 10^15.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tokens import mix
from .work import Work

BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
END = b"\xff"  # no byte of UTF-8
TABLE = bytes.maketrans(bytes(range(ord("A"), ord("Z") + 1)) + BREAKS + b"\t", bytes(range(ord("a"), ord("z") + 1)) + END * len(BREAKS) + b" ")
SLICE = 1 << 20
#: words held by a task, of all languages, before it hands out what it counted, and keys likewise
MOST_WORDS = 1 << 18
MOST_KEYS = 1 << 19
#: bytes of keys that leave a task at once
PAYLOAD_BYTES = 4 << 20
HOT_SHARE = 1024
#: bits of the table of frequent words; its size is fixed, a fuller one only lets more infrequent words through
TABLE_BITS = 25
PARTITION_BYTES = 32 << 20


class Words(dict):
    """Numbers of one language's words, in order of appearance; 0 ends a piece."""

    def __init__(self, lang: str, salt: int) -> None:
        super().__init__({END: 0})
        self.start = hashlib.blake2b(lang.encode() + b"\0", digest_size=8, salt=salt.to_bytes(8, "little"))
        self.names = np.zeros(1, np.uint64)

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number

    def numbers(self, texts: list[bytes]) -> np.ndarray:
        """The words of all texts; a 0 stands between pieces and between texts."""
        whole, found, lo = END.join(texts).translate(TABLE), [], 0
        while lo < len(whole):
            hi = whole.find(b" ", lo + SLICE) if len(whole) - lo > SLICE else -1
            part = (whole[lo:] if hi < 0 else whole[lo:hi]).replace(END, b" " + END + b" ").split()
            found.append(np.fromiter(map(self.__getitem__, part), np.int32, len(part)))
            lo = len(whole) if hi < 0 else hi + 1
        return np.concatenate([*found, np.zeros(1, np.int32)])

    def digests(self) -> np.ndarray:
        """The digest of each word, in order of number; 0 stands for the end of a piece only."""
        new = []
        for word in islice(self, len(self.names), None):
            h = self.start.copy()
            h.update(word)
            new.append(int.from_bytes(h.digest(), "little") or 1)
        self.names = np.concatenate([self.names, np.array(new, np.uint64)])
        return self.names


def by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    """Texts of a batch by language, in lists of about one slice."""
    groups: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
        if text.is_valid:
            groups.setdefault(lang, []).append(text.as_py())
            sizes[lang] = sizes.get(lang, 0) + len(groups[lang][-1])
            if sizes[lang] > SLICE:
                yield lang, groups.pop(lang)
                sizes[lang] = 0
    yield from groups.items()


def word_counts(texts: DataFrame, salt: int) -> DataFrame:
    """``h``, ``lang``, ``word``, ``f`` of every word; ``texts`` has lang and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[Words, np.ndarray]] = {}

        def out(lang: str) -> pa.RecordBatch:
            words, counts = held.pop(lang)
            names = list(words)[1:]
            return pa.RecordBatch.from_arrays(
                [pa.array(words.digests()[1:].view(np.int64)), pa.array([lang] * len(names), pa.string()),
                 pa.array(names, pa.binary()).cast(pa.string()), pa.array(counts[1 : len(words)])], ["h", "lang", "word", "f"])

        for batch in batches:
            for lang, own in by_lang(batch):
                words, counts = held.get(lang) or (Words(lang, salt), np.zeros(1, np.int64))
                new = np.bincount(words.numbers(own), minlength=len(words))
                new[: len(counts)] += counts
                held[lang] = words, new
                if sum(len(w) for w, _ in held.values()) > MOST_WORDS:
                    for other in list(held):
                        yield out(other)
        for lang in list(held):
            yield out(lang)

    rows = texts.mapInArrow(run, "h long, lang string, word string, f long")
    return rows.groupBy("h", "lang", "word").agg(F.sum("f").alias("f"))


def merged(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of ``keys`` (small numbers, one row a suffix) and their summed weights."""
    if not len(keys):
        return keys, weights
    bits = max(1, int(keys.max()).bit_length())
    if bits * keys.shape[1] <= 63:
        packed = np.zeros(len(keys), np.int64)
        for column in keys.T:
            packed = (packed << bits) | column
        order = np.argsort(packed, kind="stable")
        new = np.flatnonzero(np.diff(packed[order], prepend=-1))
    else:
        order = np.lexsort(keys.T[::-1])
        new = np.flatnonzero(np.concatenate([[True], (np.diff(keys[order], axis=0) != 0).any(axis=1)]))
    return keys[order[new]], np.add.reduceat(weights[order], new)


def gathered(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The keys and weights of several lists, ``merged``."""
    return found[0] if len(found) == 1 else merged(np.concatenate([k for k, _ in found]), np.concatenate([w for _, w in found]))


def hot_words(keys: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """How many leading words of each suffix are hot; the last word does not count."""
    leading = np.zeros(len(keys), np.int64)
    going = np.ones(len(keys), bool)
    for column in keys.T[:-1]:
        going &= np.isin(column, hot)
        leading += going
    return leading


def routed(texts: DataFrame, frequent, hot: np.ndarray, longest: int, parts: int, salt: int) -> DataFrame:
    """``part``, ``payload``: suffix keys with their weights, merged in each task; ``frequent`` is a broadcast bit table."""

    def out(words: Words, found: list) -> Iterator[pa.RecordBatch]:
        names = words.digests()
        keys, weights = gathered(found)
        found.clear()
        keys = names[keys]
        leading = hot_words(keys, hot)
        route = keys[:, 0].copy()
        for d in range(1, longest):
            route = np.where(leading >= d, mix(route * np.uint64(3) + keys[:, d]), route)
        part = (mix(route) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(parts + 1))
        at, body, size = [], [], 0
        for p in np.flatnonzero(np.diff(cuts)).tolist():
            rows = order[cuts[p] : cuts[p + 1]]
            at.append(p)
            body.append(np.column_stack([keys[rows], weights[rows].view(np.uint64)]).tobytes())
            size += len(body[-1])
            if size > PAYLOAD_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(body, pa.binary())], ["part", "payload"])
                at, body, size = [], [], 0
        if at:
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(body, pa.binary())], ["part", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = frequent.value
        held: dict[str, tuple[Words, list]] = {}
        known: dict[str, np.ndarray] = {}

        def n_keys() -> int:
            return sum(len(k) for _, found in held.values() for k, _ in found)

        for batch in batches:
            for lang, own in by_lang(batch):
                words, found = held.setdefault(lang, (Words(lang, salt), []))
                at = words.numbers(own)
                fine = known.get(lang, np.zeros(1, bool))
                if len(fine) < len(words):
                    fine = known[lang] = in_table(table, words.digests())
                at = np.concatenate([np.where(fine[at], at, 0), np.zeros(longest, np.int32)]).astype(np.int32)
                n = len(at) - longest
                keys = np.empty((n, longest), np.int32)
                alive = np.ones(n, bool)
                for d in range(longest):
                    alive &= at[d : d + n] > 0
                    keys[:, d] = np.where(alive, at[d : d + n], 0)
                keys = keys[keys[:, 1] > 0]
                found.append(merged(keys, np.ones(len(keys), np.int64)))
                if n_keys() > MOST_KEYS:
                    for _, some in held.values():
                        some[:] = [gathered(some)] if some else []
                    if n_keys() > MOST_KEYS // 2:
                        for other, some in held.values():
                            if some:
                                yield from out(other, some)
                if sum(len(w) for w, _ in held.values()) > MOST_WORDS:
                    for other, some in held.values():
                        if some:
                            yield from out(other, some)
                    held.clear()
                    known.clear()
        for other, some in held.values():
            if some:
                yield from out(other, some)

    return texts.mapInArrow(run, "part int, payload binary")


def in_table(table: np.ndarray, names: np.ndarray) -> np.ndarray:
    at = names & np.uint64((1 << TABLE_BITS) - 1)
    found = (table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)
    return (found > 0) & (names > 0)


def quicksort_counts(keys: np.ndarray, weights: np.ndarray, least: int, shared: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(depth, pointers, counts): for every phrase of ``depth`` words, a suffix that begins with it and its weight.

    ``keys`` has one row a depth and one column a suffix; key 0 ends a suffix.  All suffixes begin with ``shared`` words whose
    partitions are not whole here: those are neither abandoned nor left out, however light.
    """
    deepest = len(keys)
    pointers = np.arange(keys.shape[1])
    start, length, depth = np.zeros(1, np.int64), np.array([len(pointers)]), np.zeros(1, np.int64)
    while len(pointers):
        part = np.repeat(np.arange(len(start)), length)
        middle = pointers[start + length // 2]
        pivot = keys[depth, middle]
        own = keys[depth[part], pointers]
        side = np.where(own == pivot[part], 1, np.where(own < pivot[part], 0, 2))
        child = part * 3 + side
        sizes = np.bincount(child, minlength=3 * len(start))
        heavy = np.bincount(child, weights=weights[pointers], minlength=3 * len(start)).astype(np.int64)
        equal = np.arange(len(start)) * 3 + 1
        told = (pivot > 0) & ((heavy[equal] >= least) | (depth < shared))
        for d in range(1, deepest):
            some = told & (depth == d)
            if some.any():
                yield d + 1, middle[some], heavy[equal[some]]
        alive = (sizes > 0) & ((heavy >= least) | np.repeat(depth < shared, 3))
        alive[equal] = (told & (depth + 1 < deepest))
        new_depth = np.repeat(depth, 3)
        new_depth[equal] += 1
        new_start = np.cumsum(np.where(alive, sizes, 0)) - np.where(alive, sizes, 0)
        moved = np.empty(int(sizes[alive].sum()), np.int64)
        for k in range(3):
            here = np.flatnonzero(side == k)
            before = np.cumsum(sizes[k::3]) - sizes[k::3]
            to = new_start[child[here]] + np.arange(len(here)) - before[part[here]]
            kept = alive[child[here]]
            moved[to[kept]] = pointers[here[kept]]
        pointers, start, length, depth = moved, new_start[alive], sizes[alive], new_depth[alive]


def phrase_counts(routes: DataFrame, hot: np.ndarray, longest: int, least: int, parts: int) -> DataFrame:
    """``words`` (array of digests), ``f`` of every phrase of 2 to ``longest`` words with ``f`` of ``least`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [np.frombuffer(x.as_buffer(), np.uint64).reshape(-1, longest + 1) for b in batches for x in b.column(1)]
        if not found:
            return
        rows = np.concatenate(found)
        found.clear()
        leading = hot_words(rows[:, :longest], hot)
        for shared in range(longest):
            own = leading == shared
            keys = np.stack([rows[own, d] for d in range(longest)])
            for depth, at, f in quicksort_counts(keys, rows[own, longest].astype(np.int64), least, shared):
                for lo in range(0, len(at), 65536):
                    some = at[lo : lo + 65536]
                    flat = np.ascontiguousarray(keys[:depth, some].T).view(np.int64).ravel()
                    words = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * depth, pa.int32()), pa.array(flat))
                    whole = pa.array(np.full(len(some), depth > shared))
                    yield pa.RecordBatch.from_arrays([words, pa.array(f[lo : lo + 65536]), whole], ["words", "f", "whole"])

    rows = routes.repartitionById(parts, "part").mapInArrow(run, "words array<bigint>, f long, whole boolean")
    return rows


def frequent_table(words: DataFrame) -> np.ndarray:
    """Bits of frequent words: at most 2^(TABLE_BITS - 6) rows reach the driver, whatever the number of words."""
    at = F.col("h").bitwiseAND(F.lit((1 << TABLE_BITS) - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    rows = words.groupBy(F.shiftright(at, 6).alias("slot")).agg(F.bit_or(bit).alias("bits")).toArrow()
    table = np.zeros(1 << (TABLE_BITS - 6), np.uint64)
    table[rows["slot"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return table


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(10^6 * a * a / (l * r)) in exact decimals."""
    wide = [x.cast("decimal(15,0)") for x in (a, a, left, right)]
    top = (wide[0] * wide[1] * F.lit(1000000).cast("decimal(7,0)")).cast("decimal(38,0)")
    return F.call_function("div", top, (wide[2] * wide[3]).cast("decimal(38,0)")).cast("long")


def collocations(docs: DataFrame, *, longest: int = 3, least: int = 10, top: int = 2000, share: int = 50) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best phrases.

    A phrase goes if a longer one with at least ``share`` percent of its count holds its words side by side.
    """
    spark = docs.sparkSession
    work = Work(spark, "phrases")
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    salt = 0
    while True:
        words = work.keep(word_counts(texts, salt))
        if words.groupBy("h").count().where("count > 1").isEmpty():
            break
        work.drop(words)
        salt += 1
    total = words.agg(F.sum("f")).first()[0] or 0
    frequent = words.where(F.col("f") >= least)
    # at most HOT_SHARE words have that share of all words
    hot = np.array([r[0] for r in words.where(F.col("f") * HOT_SHARE > total).select("h").collect()], np.int64).view(np.uint64)
    table = spark.sparkContext.broadcast(frequent_table(frequent))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total * 8 * (longest + 1) // PARTITION_BYTES))
    found = work.keep(phrase_counts(routed(texts, table, hot, longest, parts, salt), hot, longest, least, parts))
    parted = found.where("NOT whole").groupBy("words").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    phrases = found.where("whole").select("words", "f").unionByName(parted)
    counts = work.keep(phrases.unionByName(frequent.select(F.array("h").alias("words"), "f")))
    work.drop(found)
    return _ranked(counts, words, work, top, share)


def _ranked(counts: DataFrame, words: DataFrame, work: Work, top: int, share: int) -> DataFrame:
    size = F.size("words")
    phrases = counts.where(size > 1).withColumnRenamed("f", "a")
    cut = F.explode(F.sequence(F.lit(1), size - 1)).alias("k")
    cuts = phrases.select("words", "a", cut).select(
        "*", F.slice("words", 1, F.col("k")).alias("first"), F.slice("words", F.col("k") + 1, size).alias("rest"))
    left = counts.select(F.col("words").alias("first"), F.col("f").alias("l"))
    right = counts.select(F.col("words").alias("rest"), F.col("f").alias("r"))
    cuts = cuts.join(left, "first").join(right, "rest").withColumn("score", score(F.col("a"), F.col("l"), F.col("r")))
    scored = cuts.groupBy("words").agg(F.min(F.struct("score", "k", "l", "r", "a")).alias("least")).select("words", "least.*")
    inside = F.flatten(F.transform(
        F.sequence(F.lit(2), size - 1),
        lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda at: F.slice("words", at, n))))
    longer = phrases.where(size > 2).select(F.explode(inside).alias("words"), "a").groupBy("words").agg(F.max("a").alias("longer"))
    alone = scored.join(longer, "words", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    named = alone.select("*", F.col("words")[0].alias("h")).join(words.select("h", "lang"), "h")
    best = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    # ranks with ties, so that words are looked up for what may be listed only
    near = work.keep(named.withColumn("place", F.rank().over(best)).where(F.col("place") <= top).select("words", "lang", "a", "l", "r", "score"))
    spelled = near.select("words", F.posexplode("words").alias("at", "h")).join(words.select("h", "word"), "h").groupBy("words").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    sizes = words.groupBy("lang").agg(F.sum("f").alias("n"))
    exact = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    listed = near.join(spelled, "words").withColumn("rank", F.row_number().over(exact)).where(F.col("rank") <= top)
    return listed.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
