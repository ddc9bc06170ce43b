"""Byte-level BPE: encode whole texts to token ids, and decode ids to bytes.

Method.  A batch of texts is cut into pieces by character classes (the same pieces the pattern
of the vocabulary gives).  Distinct pieces that are no token themselves become rows of byte ids,
bucketed by length into padded matrices.  In each round every row of a matrix merges its leftmost
pair of least rank; pair ranks come from an open-addressing hash table, and the column that a
merge frees is compacted away, so a matrix narrows by one column a round.  Rows without a pair to
merge leave the matrix.  A piece longer than ``WIDEST`` bytes is merged with a heap instead, which
gives the same ids: a matrix of one such row would cost the square of its length.

Rows: null texts count as empty and give no tokens; empty texts give no tokens; equal rows stay
separate rows; an empty table gives an empty result; other columns of the input are ignored, so
their names cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

WIDEST = 1024
WIDTHS = (4, 6, 8, 10, 12, 16, 24, 32, 64, 128, 256, 512, WIDEST)
CHUNK_CHARS = 1_000_000
#: a chunk holds this many characters at most, unless a single text cannot be cut
CHUNK_POWERS = 1 << 21
CACHE_PIECES = 400_000
NO_RANK = np.int32(2**31 - 1)

#: The splitting pattern of the vocabulary files this module reads (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

OTHER, LETTER, NUMBER, SPACE, EDGE = range(5)


def char_classes() -> np.ndarray:
    """Class of every code point: letter, number, white space, other.

    The tokenizer library has Unicode tables of its own, older than those of Python's.  Which code points are in a
    class is therefore read from the library: with single bytes as its only tokens and the class as its
    pattern, it gives back the members among all code points.
    """
    text = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    of = np.zeros(0x110000, np.uint8)
    for kind, name in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        reader = tiktoken.Encoding(name, pat_str=name, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        members = bytes(reader.encode_ordinary(text)).decode()
        of[np.frombuffer(members.encode("utf-32-le"), np.uint32)] = kind
    return of


def piece_starts(chars: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Where pieces start in texts that are each closed by one EDGE position; EDGE starts one too."""
    before = np.concatenate([[EDGE], kinds[:-1]])
    after = np.concatenate([kinds[1:], [EDGE]])
    space, was_space = kinds == SPACE, before == SPACE
    blank_before = np.concatenate([[False], chars[:-1] == 0x20]) & was_space
    edge = kinds == EDGE
    last = (after != SPACE) & (after != EDGE)  # the last of a run goes with what follows
    start = (space & (~was_space | last)) | (~space & ((was_space & (~blank_before | edge)) | (~was_space & (kinds != before))))
    # 's 't 'm 'd 're 've 'll are pieces where an apostrophe opens a piece.
    marks = np.flatnonzero((chars == 0x27) & start & (kinds != EDGE))
    if len(marks):
        room = np.concatenate([chars, np.zeros(2, chars.dtype)])
        ends = np.concatenate([kinds, np.full(2, EDGE, kinds.dtype)])
        one, two = room[marks + 1], room[marks + 2]
        inside = ends[marks + 1] != EDGE
        single = inside & np.isin(one, [ord(c) for c in "stmd"])
        double = inside & (ends[marks + 2] != EDGE) & (
            (np.isin(one, [ord("r"), ord("v")]) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        )
        for hit, size in ((marks[single], 2), (marks[double], 3)):
            start[hit + 1] = False
            at = hit + size
            start[at[at < len(start)]] = True
    return np.flatnonzero(start)


def powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of ``base`` modulo 2^64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


#: an odd number and its inverse modulo 2^64
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)


@lru_cache(1)
def _chunk_powers() -> tuple[np.ndarray, np.ndarray]:
    return powers(BASE, CHUNK_POWERS), powers(INVERSE, CHUNK_POWERS)


def hash_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of the base and of its inverse; kept for chunks of ordinary texts only."""
    return _chunk_powers() if n <= CHUNK_POWERS else (powers(BASE, n), powers(INVERSE, n))


def piece_hashes(chars: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of each piece, from sums over all characters: equal pieces have equal ones."""
    up, down = hash_powers(len(chars))
    mixed = chars + np.uint64(0x1000)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(29)
    mixed *= up[: len(chars)]
    sums = np.zeros(len(chars) + 1, np.uint64)
    np.cumsum(mixed, out=sums[1:])
    return (sums[ends] - sums[starts]) * down[starts]


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions of all characters of pieces, piece by piece."""
    upto = np.cumsum(sizes)
    return np.arange(int(sizes.sum())) + np.repeat(starts - (upto - sizes), sizes)


def distinct_pieces(chars: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first of each set of equal pieces, and for every piece the number of its set.

    Pieces are grouped by a hash of their characters and then compared character by character.
    """
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sizes = ends - starts
    which, first = numbered(pa.array(piece_hashes(chars, starts, ends) if hashes is None else hashes))
    example = first[which]
    same = sizes[example] == sizes
    if same.all():
        others = np.flatnonzero(example != np.arange(len(starts)))
        at = spread(starts[others], sizes[others])
        same = chars[at] == chars[at + np.repeat(starts[example[others]] - starts[others], sizes[others])]
    if not same.all():  # two pieces with one hash
        which, first = numbered(pa.array([chars[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.large_binary()))
    return first, which


def numbered(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each value the number of its set of equal ones, and the first index of each set."""
    coded = values.dictionary_encode()
    which = coded.indices.to_numpy()
    first = np.empty(len(coded.dictionary), np.int64)
    first[which[::-1]] = np.arange(len(which) - 1, -1, -1)
    return which, first


class Ragged:
    """Byte strings by number, in one buffer; ``join`` gathers many of them at once."""

    def __init__(self, rows: list[bytes]):
        self.flat = np.frombuffer(b"".join(rows), np.uint8)
        self.lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        self.starts = np.cumsum(self.lengths) - self.lengths

    def join(self, ids: np.ndarray) -> bytes:
        lengths = self.lengths[ids]
        before = np.cumsum(lengths) - lengths
        at = np.arange(int(lengths.sum())) + np.repeat(self.starts[ids] - before, lengths)
        return self.flat[at].tobytes()


class PairRanks:
    """Rank of the token that two neighbouring tokens make: open addressing over numpy arrays."""

    def __init__(self, ranks: dict[bytes, int], size: int):
        pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a * size + b] = rank
        self.size = np.uint64(size)
        bits = max(4, int(len(pairs) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.uint64((1 << bits) - 1)
        self.keys = np.full(1 << bits, np.iinfo(np.uint64).max, np.uint64)
        self.ranks = np.full(1 << bits, NO_RANK, np.int32)
        keys = np.fromiter(pairs.keys(), np.uint64, len(pairs))
        values = np.fromiter(pairs.values(), np.int32, len(pairs))
        slot = self._slot(keys)
        empty = np.iinfo(np.uint64).max
        while len(keys):
            free = self.keys[slot] == empty
            _, first = np.unique(slot, return_index=True)
            put = np.zeros(len(keys), bool)
            put[first] = True
            put &= free
            self.keys[slot[put]], self.ranks[slot[put]] = keys[put], values[put]
            keys, values, slot = keys[~put], values[~put], (slot[~put] + np.uint64(1)) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.uint64) * self.size + right.astype(np.uint64)
        shape, keys = keys.shape, keys.ravel()
        slot = self._slot(keys)
        seen = self.keys[slot]
        out = self.ranks[slot]
        unsure = np.flatnonzero((seen != keys) & (seen != np.iinfo(np.uint64).max))
        out[seen != keys] = NO_RANK
        at = slot[unsure]
        while len(unsure):
            at = (at + np.uint64(1)) & self.mask
            seen = self.keys[at]
            hit = seen == keys[unsure]
            out[unsure[hit]] = self.ranks[at[hit]]
            go = ~hit & (seen != np.iinfo(np.uint64).max)
            unsure, at = unsure[go], at[go]
        return out.reshape(shape)


class PieceCache:
    """Numbers of pieces by hash, open addressing; a piece found has been compared with the one kept, character by character.

    Of pieces with one hash the first is kept; the others are never found.
    """

    def __init__(self) -> None:
        self._empty(16)
        self.hashes, self.starts, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _empty(self, bits: int) -> None:
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int32)

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, chars: np.ndarray, starts: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The number of each piece, -1 if it is not kept."""
        out = np.full(len(starts), -1, np.int64)
        todo, slot = np.arange(len(starts)), self._slot(hashes)
        while len(todo):
            seen = self.slots[slot]
            filled = seen >= 0
            todo, slot, seen = todo[filled], slot[filled], seen[filled]
            hit = self.hashes[seen] == hashes[todo]
            out[todo[hit]] = seen[hit]
            todo, slot = todo[~hit], (slot[~hit] + 1) & self.mask
        found = np.flatnonzero(out >= 0)
        found = found[self.sizes[out[found]] == sizes[found]]
        kept = out[found]
        at = spread(starts[found], sizes[found])
        differ = chars[at] != self.flat[at + np.repeat(self.starts[kept] - starts[found], sizes[found])]
        right = np.ones(len(found), bool)
        right[np.repeat(np.arange(len(found)), sizes[found])[differ]] = False
        done = np.full(len(starts), -1, np.int64)
        done[found[right]] = kept[right]
        return done

    def add(self, chars: np.ndarray, starts: np.ndarray, sizes: np.ndarray, hashes: np.ndarray) -> None:
        """Keep pieces, which get the next numbers in order."""
        number = np.arange(len(self.starts), len(self.starts) + len(starts))
        upto = len(self.flat) + np.cumsum(sizes)
        self.flat = np.concatenate([self.flat, chars[spread(starts, sizes)]])
        self.hashes = np.concatenate([self.hashes, hashes])
        self.starts, self.sizes = np.concatenate([self.starts, upto - sizes]), np.concatenate([self.sizes, sizes])
        if 2 * len(self.starts) > len(self.slots):
            self._empty((4 * len(self.starts)).bit_length())
            number = np.arange(len(self.starts))
        slot = self._slot(self.hashes[number])
        while len(number):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = number[free]  # of several pieces one is put
            # pieces of a hash that is here already, their own included, are done
            going = self.hashes[self.slots[slot]] != self.hashes[number]
            number, slot = number[going], (slot[going] + 1) & self.mask


class Codec:
    """Encoder and decoder of one vocabulary file of ``base64-token rank`` lines."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.size = max(self.ranks.values()) + 2  # one more id, for padding
        self.pad = self.size - 1
        self.tokens = [b""] * self.size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.pairs = PairRanks(self.ranks, self.size)
        self.bytes = np.asarray([self.ranks[bytes([b])] for b in range(256)], np.int32)
        every = np.broadcast_to(self.bytes, (256, 256))
        self.byte_pairs = self.pairs(every.T, every)
        self.kinds = char_classes()
        self._forget()

    @cached_property
    def decimals(self) -> Ragged:
        return Ragged([b"%d " % i for i in range(self.size)])

    @cached_property
    def spellings(self) -> Ragged:
        return Ragged(self.tokens)

    def _forget(self) -> None:
        self.known = PieceCache()
        self.flat, self.starts, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    # merging

    def _merge_matrix(self, rows: list[bytes], lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows in one array, and the number of ids of each row."""
        columns = np.arange(width)
        m = np.full((len(rows), width), self.pad, np.int32)
        used = columns < lengths[:, None]
        raw = np.zeros(m.shape, np.uint8)
        raw[used] = np.frombuffer(b"".join(rows), np.uint8)
        m[used] = self.bytes[raw[used]]
        out = np.full((len(rows), width), self.pad, np.int32)
        lengths = lengths.copy()
        row = np.arange(len(rows))
        r = np.where(used[:, 1:], self.byte_pairs[raw[:, :-1], raw[:, 1:]], NO_RANK)
        while len(row):
            at = r.argmin(axis=1)
            line = np.arange(len(row))
            best = r[line, at]
            live = best != NO_RANK
            if not live.all():
                done = ~live
                out[row[done], : m.shape[1]] = m[done]
                m, r, row, at, best = m[live], r[live], row[live], at[live], best[live]
                line = np.arange(len(row))
            m[line, at] = best
            lengths[row] -= 1
            keep = np.ones(m.shape, bool)
            keep[line, at + 1] = False
            m = m[keep].reshape(len(row), keep.shape[1] - 1)
            if m.shape[1] == 1:
                out[row, :1] = m
                break
            keep = np.ones(r.shape, bool)
            keep[line, at] = False
            r = r[keep].reshape(len(row), keep.shape[1] - 1)
            left = np.flatnonzero(at > 0)
            r[left, at[left] - 1] = self.pairs(m[left, at[left] - 1], best[left])
            right = np.flatnonzero(at < r.shape[1])
            r[right, at[right]] = self.pairs(best[right], m[right, at[right] + 1])
        return out[columns < lengths[:, None]], lengths

    def _merge_long(self, piece: bytes) -> np.ndarray:
        ids = self.bytes[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        first = self.pairs(np.asarray(ids[:-1]), np.asarray(ids[1:])).tolist()
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != NO_RANK]
        heapq.heapify(heap)

        def offer(i: int, j: int) -> None:
            merged = self.ranks.get(self.tokens[ids[i]] + self.tokens[ids[j]])
            if merged is not None:
                heapq.heappush(heap, (merged, i, ids[i], ids[j]))

        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
                offer(i, after[j])
            if before[i] >= 0:
                offer(before[i], i)
        return np.asarray([x for x in ids if x >= 0], np.int32)

    def _learn(self, pieces: list[str]) -> None:
        """Encode pieces not seen yet and put their ids, in order, at the end of the cache."""
        raw = [p.encode() for p in pieces]
        ranks = np.fromiter(map(self.ranks.get, raw, repeat(-1)), np.int32, len(raw))
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        group = np.where(ranks >= 0, -1, np.searchsorted(WIDTHS, sizes))
        order, flat, lengths = [], [], []
        for g in np.unique(group).tolist():
            members = np.flatnonzero(group == g)
            if g < 0:
                order.append(members)
                flat.append(ranks[members])
                lengths.append(np.ones(len(members), np.int64))
                continue
            step = max(1, 4_000_000 // WIDTHS[g]) if g < len(WIDTHS) else 1
            for lo in range(0, len(members), step):
                part = members[lo : lo + step]
                if g < len(WIDTHS):
                    ids, n = self._merge_matrix([raw[i] for i in part.tolist()], sizes[part], WIDTHS[g])
                else:
                    ids = self._merge_long(raw[part[0]])
                    n = np.asarray([len(ids)])
                order.append(part)
                flat.append(ids)
                lengths.append(n)
        order, lengths = np.argsort(np.concatenate(order)), np.concatenate(lengths)
        starts = len(self.flat) + np.cumsum(lengths) - lengths
        self.flat = np.concatenate([self.flat, *flat])
        self.lengths, self.starts = np.concatenate([self.lengths, lengths[order]]), np.concatenate([self.starts, starts[order]])

    # texts

    def _encode_chunk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the number of ids of each."""
        joined = "\n".join(texts) + "\n"
        chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kinds = self.kinds[chars]
        edges = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))) - 1
        kinds[edges] = EDGE
        starts = piece_starts(chars, kinds)
        ends = np.append(starts[1:], len(chars))
        real = kinds[starts] != EDGE
        starts, ends = starts[real], ends[real]
        hashes = piece_hashes(chars, starts, ends)
        first, which = distinct_pieces(chars, starts, ends, hashes)
        if len(self.starts) > CACHE_PIECES:
            self._forget()
        one, sizes, own = starts[first], (ends - starts)[first], hashes[first]
        at = self.known.find(chars, one, sizes, own)
        new = np.flatnonzero(at < 0)
        if len(new):
            at[new] = np.arange(len(self.starts), len(self.starts) + len(new))
            self._learn([joined[a:b] for a, b in zip(one[new].tolist(), (one + sizes)[new].tolist(), strict=True)])
            self.known.add(chars, one[new], sizes[new], own[new])
        at = at[which]
        lengths = self.lengths[at]
        upto = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.flat[np.arange(int(upto[-1])) + np.repeat(self.starts[at] - upto[:-1], lengths)]
        per_text = np.diff(upto[np.searchsorted(starts, edges)], prepend=0)
        return ids, per_text

    def _parts(self, text: str) -> Iterator[str]:
        """A long text cut where a piece must start: at a blank between two other characters."""
        lo = 0
        while len(text) - lo > CHUNK_CHARS:
            cut = regex.compile(r"(?<=\S) (?=\S)").search(text, lo + CHUNK_CHARS // 2)
            if cut is None or cut.start() <= lo:
                break
            yield text[lo : cut.start()]
            lo = cut.start()
        yield text[lo:]

    def encode(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """Token ids of each text, in order; null is empty."""
        waiting: list[str] = []
        size = 0
        for text in texts:
            text = text or ""
            if len(text) > CHUNK_CHARS:
                yield from self._flush(waiting)
                waiting, size = [], 0
                yield np.concatenate([self._encode_chunk([part])[0] for part in self._parts(text)])
                continue
            waiting.append(text)
            size += len(text) + 1
            if size > CHUNK_CHARS:
                yield from self._flush(waiting)
                waiting, size = [], 0
        yield from self._flush(waiting)

    def _flush(self, texts: list[str]) -> Iterator[np.ndarray]:
        if texts:
            ids, per_text = self._encode_chunk(texts)
            yield from np.split(ids, np.cumsum(per_text)[:-1])

    def decode(self, ids: np.ndarray) -> bytes:
        return self.spellings.join(ids)

    def spell(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by single blanks."""
        return self.decimals.join(ids)[:-1]


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of a vocabulary file, built once in each worker process."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``ids`` (array of int) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = list(codec(path).encode(batch.column(1).to_pylist()))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, flat)], [key, "ids"])

    schema = T.StructType([df.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return df.select(key, text).mapInArrow(run, schema)


def packed(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", width: int = 2) -> DataFrame:
    """``key``, ``tokens`` (binary): the ids of every whole text, ``width`` bytes each, lowest byte first.

    Batches hold about a megabyte of ids, whatever the number of texts; ids never become Python numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[bytes] = []
            lo = held = 0
            for ids in codec(path).encode(x.as_py() for x in batch.column(1)):
                rows.append(ids.astype(f"<u{width}").tobytes())
                held += len(rows[-1])
                if held > 1 << 20:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(rows)), pa.array(rows, pa.binary())], [key, "tokens"])
                    lo, rows, held = lo + len(rows), [], 0
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(rows)), pa.array(rows, pa.binary())], [key, "tokens"])

    return df.select(key, text).mapInArrow(run, T.StructType([df.schema[key], T.StructField("tokens", T.BinaryType())]))


def decode(df: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key``, ``bytes`` (binary) of every list of ids; null ids are empty, unknown ids an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = codec(path)
            rows = [of.decode(np.asarray(x if x is not None else [], np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], [key, "bytes"])

    schema = T.StructType([df.schema[key], T.StructField("bytes", T.BinaryType())])
    return df.select(key, ids).mapInArrow(run, schema)


def round_trip(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``key``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``, ``exact``.

    Encodes and decodes inside one pass, so ids never leave the task.  ``exact`` tells whether the
    decoded bytes are the UTF-8 bytes of the text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = codec(path)
            texts = batch.column(1).to_pylist()
            n, spelled, decoded, exact = [], [], [], []
            for whole, ids in zip(texts, of.encode(texts), strict=True):
                back = of.decode(ids)
                n.append(len(ids))
                spelled.append(hashlib.sha256(of.spell(ids)).hexdigest())
                decoded.append(hashlib.sha256(back).hexdigest())
                exact.append(back == (whole or "").encode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(spelled, pa.string()),
                 pa.array(decoded, pa.string()), pa.array(exact, pa.bool_())],
                [key, "n_tokens", "ids_sha256", "decoded_sha256", "exact"],
            )

    schema = T.StructType([
        df.schema[key], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()), T.StructField("exact", T.BooleanType()),
    ])
    return df.select(key, text).mapInArrow(run, schema)
