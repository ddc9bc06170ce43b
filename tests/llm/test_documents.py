"""Operators on documents: brute force, round trips, held-out accuracy, and odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from modelgov.llm import byte_bpe, feistel_shards, hash_mixture, license_patience, minimax_shards, ngram_rtree_join, quality_rff, queries

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = [(None, "no id"), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, "one"), (6, "word " * 30_000)]
WORDS = "the of model field table report measure filter column value row key".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 400)) for _ in range(n))


# byte-level BPE


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.codec(PATH).ranks, special_tokens={})


def test_pattern_is_that_of_the_files():
    assert byte_bpe.PATTERN == public_tokenizers.PATTERN


def test_encoding_equals_the_library(reference):
    rng = random.Random(3)
    letters = "  \n\t's're ve'll'dm aAzé漢字0９½²‿,.!''\r\x1c\x85_-|<endoftext>"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts += ["a" * 5000, "é" * 3000, " " * 2000, "x" + " " * 500 + "y", "ab " * 700_000, None, ""]
    for text, ids in zip(texts, byte_bpe.codec(PATH).encode(texts), strict=True):
        assert ids.tolist() == reference.encode_ordinary(text or "")
        assert byte_bpe.codec(PATH).decode(ids) == (text or "").encode()


def test_every_code_point_is_split_as_the_library_does(reference):
    texts = [chr(c) + "'s 1" for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for text, ids, want in zip(texts, byte_bpe.codec(PATH).encode(texts), reference.encode_ordinary_batch(texts, num_threads=4), strict=True):
        assert ids.tolist() == want, hex(ord(text[0]))


def test_round_trip_rows(documents, reference):
    docs = documents(ODD).withColumn("ids", F.lit("clash"))
    got = byte_bpe.round_trip(docs, PATH).collect()
    want = Counter()
    for doc, text in ODD:
        ids = reference.encode_ordinary(text or "")
        spelled = " ".join(map(str, ids)).encode()
        want[doc, len(ids), hashlib.sha256(spelled).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest(), True] += 1
    assert Counter(map(tuple, got)) == want
    encoded = byte_bpe.encode(docs, PATH)
    assert byte_bpe.decode(encoded, PATH).count() == len(ODD)
    assert byte_bpe.round_trip(documents([]), PATH).count() == 0


# quality classifier


def test_classifier_tells_unseen_rows_apart(spark, documents):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(400):
        junk = i % 4 == 0
        text = prose(rng, 80) if not junk else " ".join(w + "$$$" for w in prose(rng, 80).split())
        rows.append((i, text))
        labels.append((i, int(not junk)))
    labels += [(None, 1), (7, None), (9999, 0)]
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    docs = documents(rows + ODD)
    model = quality_rff.fit(docs, quality_rff.training_rows(table, ~quality_rff.held_out()))
    scored = quality_rff.score(docs.withColumn("y", F.lit(1)), model).withColumn("held", quality_rff.held_out()).collect()
    assert len(scored) == len(rows) + len(ODD)
    assert all(0 <= r.score <= 1 for r in scored)
    test = [r for r in scored[: len(rows)] if r.held]
    assert len(test) > 40
    assert np.mean([(r.score >= 0.3) == (r.doc_id % 4 != 0) for r in test]) > 0.97


def test_classifier_without_labels(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int")
    docs = documents(ODD)
    model = quality_rff.fit(docs, quality_rff.training_rows(none, ~quality_rff.held_out()))
    assert {r.score for r in quality_rff.score(docs, model).collect()} == {0.5}
    assert quality_rff.score(documents([]), model).count() == 0


def test_statistics_do_not_depend_on_batches():
    texts = ["a b c", None, "", "The THE the!! " * 40_000, "é|é x"]
    whole = quality_rff.statistics(pa.array(texts))
    one = np.concatenate([quality_rff.statistics(pa.array([t], pa.string())) for t in texts])
    assert np.allclose(whole, one)


def test_isotonic_rises():
    knots, levels = quality_rff.isotonic(np.arange(6.0), np.asarray([0, 3, 1, 2, 9, 10.0]), np.full(6, 10.0))
    assert (np.diff(knots) > 0).all() and (np.diff(levels) >= 0).all()


# shards


def fewest(sizes, capacity):
    n, room = 1, capacity
    for s in sizes:
        if s > capacity:
            return None
        if s > room:
            n, room = n + 1, capacity
        room -= s
    return n


@pytest.mark.parametrize("shards", [1, 5, 24])
def test_cuts_are_the_optimum_of_their_order(spark, shards):
    rng = random.Random(shards)
    groups = [(rng.getrandbits(60), rng.randint(100, 180)) for _ in range(3000)]
    groups += [(0, 9), (1, 9), (2**60 - 1, 9)]
    cuts = minimax_shards.find_cuts(spark.createDataFrame(groups, "position long, bytes long"), shards)
    total = sum(s for _, s in groups)
    border = max(1, total // (64 * shards))
    sizes = [s for p, s in sorted(groups) if s <= border]
    assert len(sizes) == len(groups)  # nothing large here: the order is that of positions
    assert fewest(sizes, cuts.capacity) <= shards
    assert fewest(sizes, cuts.capacity - 1) is None or fewest(sizes, cuts.capacity - 1) > shards


def test_shards_hold_groups_and_number_rows(documents):
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randint(1, 60))) for i in range(600)] + [(i, "copy " * 40) for i in range(600, 900)] + ODD[:-1]
    got = minimax_shards.shards(documents(rows).withColumn("shard", F.lit("x")), 24).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    assert all(sorted(r.slot for r in rs) == list(range(len(rs))) for rs in by.values())
    of = defaultdict(set)
    for r in got:
        of[r.text_crc32].add(r["shard"])
    assert all(len(s) == 1 for s in of.values())
    loads = {k: sum(r["size"] for r in rs) for k, rs in by.items()}
    copies = 300 * (8 + 200)
    assert max(loads.values()) == copies  # the group of copies has a shard of its own
    rest = [v for v in loads.values() if v != copies]
    assert len(rest) == 23 and max(rest) < 1.1 * min(rest)
    assert {r["size"] for r in got if r.doc_id in (1, 2)} >= {8}
    assert minimax_shards.shards(documents([]), 24).count() == 0


# mixture


def test_mixture_comes_near_its_targets(documents):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randint(1, 30)), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(3000)]
    rows += [(None, "x y", "a"), (1, None, "b"), (2, " ", "d"), (3, "same words", "c"), (3, "same words", "c")]
    docs = documents(rows)
    got = hash_mixture.mix(docs).collect()
    assert len(got) == len(rows)
    size = Counter()
    for _, text, source in rows:
        size[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    order = ["a", "b", "c", "d", None]
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, stopped = {}, set()
    while True:
        left = sum(size.values()) - sum(3 * size[s] for s in stopped)
        free = sum(weight[s] for s in order if s not in stopped)
        target = {s: 3.0 * size[s] if s in stopped else left * weight[s] / free for s in order}
        over = {s for s in order if target[s] > 3 * size[s]}
        if not over:
            break
        stopped |= over
    taken = Counter()
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 30 for s in order)
    again = hash_mixture.mix(docs.repartition(7)).collect()
    assert Counter((r.doc_id, r.taken) for r in again) == Counter((r.doc_id, r.taken) for r in got)
    mixed = hash_mixture.materialise_mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)
    assert hash_mixture.mix(documents([])).count() == 0


# near duplicates


def brute(rows):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    names = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            names[find(i)].append(doc)
    return Counter((rows[i][0], len(sets[i]), min(names[find(i)], default=None) if sets[i] else rows[i][0]) for i in range(len(rows)))


def near_rows(rng):
    rows = list(ODD)
    passage = prose(rng, 60)
    for i in range(40):
        base = prose(rng, rng.choice([3, 5, 6, 20, 150])).split()
        rows.append((100 + i * 10, " ".join(base)))
        for k in range(rng.randint(0, 4)):
            other = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                other[rng.randrange(len(other))] = "changed" + str(rng.random())
            rows.append((101 + i * 10 + k, (" ".join(other)).upper() if k == 2 else " ".join(other)))
        rows.append((109 + i * 10, prose(rng, 10) + " " + passage + " " + prose(rng, 10)))
    hot = prose(rng, 100).split()
    for i in range(150):
        other = list(hot)
        other[rng.randrange(len(other))] = f"own{i}"
        rows.append((1000 + i, " ".join(other)))
    return rows


def test_classes_equal_brute_force(documents, monkeypatch):
    rows = near_rows(random.Random(8))
    docs = documents(rows).withColumn("node", F.lit("clash"))
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_rtree_join.classes(docs).collect())
    assert got == brute(rows)
    monkeypatch.setattr(ngram_rtree_join, "RUN", 16)  # long runs as pairs of blocks
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_rtree_join.classes(docs).collect())
    assert got == brute(rows)
    assert ngram_rtree_join.classes(documents([])).count() == 0


def test_one_document_of_each_class_stays(documents):
    rows = near_rows(random.Random(9))
    kept = Counter(r.doc_id for r in ngram_rtree_join.kept_documents(documents(rows)).collect())
    want = brute(rows)
    named = {c for (_, n, c) in want if n and c is not None}
    assert named <= set(kept)
    assert all(n == 1 for d, n in kept.items() if d in named)
    assert kept[1] == kept[2] == kept[3] == 1  # without words


def test_tree_loses_no_pair():
    rng = np.random.default_rng(0)
    sets = []
    for _ in range(30):
        base = rng.integers(0, 2**63, rng.integers(4, 300)).astype(np.uint64) * np.uint64(2)
        for _ in range(rng.integers(1, 5)):
            own = base.copy()
            own[: max(1, len(own) // 30)] += np.uint64(1)
            sets.append(np.unique(own))
    sizes = np.asarray([len(s) for s in sets])
    tree = ngram_rtree_join.Tree(sizes, np.arange(len(sets)), [ngram_rtree_join.counts_of(s) for s in sets])
    found = {tuple(sorted(p)) for p in tree.pairs()}
    linked = {
        (i, j) for j in range(len(sets)) for i in range(j)
        if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))
    }
    assert linked and linked <= found and len(found) < len(sets) ** 2 // 4


def test_counts_of_huge_sets_do_not_wrap():
    """Near copies of over 16 * 65,535 shingles in one run with a tiny set, and a group of over 65,535."""
    rng = np.random.default_rng(5)
    huge = rng.integers(1 << 64, size=1_150_000, dtype=np.uint64)
    sets = [np.unique(s) for s in (huge, huge[:-1000], huge[:10])]
    raw = [ngram_rtree_join.point_bytes(s) for s in sets]
    tree = ngram_rtree_join.Tree(np.asarray([len(s) for s in sets]), np.arange(3), [ngram_rtree_join.point(r) for r in raw])
    assert [set(p) for p in tree.pairs()] == [{0, 1}]
    counts = [ngram_rtree_join.folded(ngram_rtree_join.point(r), 16).sum(dtype=np.int64) for r in raw]
    assert counts == [len(s) for s in sets]
    crowded = ngram_rtree_join.point(ngram_rtree_join.point_bytes(np.arange(70_000, dtype=np.uint64)))
    assert crowded.sum(dtype=np.int64) == 70_000


def test_boxes_of_huge_sets_do_not_wrap():
    """The same above the leaves, where boxes of huge sets are held against boxes of tiny ones."""
    rng = np.random.default_rng(6)
    huge = rng.integers(1 << 64, size=1_150_000, dtype=np.uint64)
    sets = [np.unique(huge[k:]) for k in range(12)] + [np.unique(huge[20 * k : 20 * k + 10 + k]) for k in range(4)]
    counts = [ngram_rtree_join.point(ngram_rtree_join.point_bytes(s)) for s in sets]
    tree = ngram_rtree_join.Tree(np.asarray([len(s) for s in sets]), np.arange(len(sets)), counts)
    found = {frozenset(p) for p in tree.pairs()}
    assert {frozenset((i, j)) for i in range(12) for j in range(i)} <= found


# licenses


def test_licenses(documents):
    mit = next(t for k, f, t in license_patience.NOTICES if (k, f) == ("MIT", "grant"))
    broken = mit.replace("furnished", "given").replace("deal in", "deal with")
    rows = [
        (11, "Some text. Released under the MIT License. More text."), (12, "released UNDER the mit\nlicense"), (13, "a license to print the word"),
        (14, "x " * 20_000 + mit + " y" * 20_000), (15, broken), (16, "Licensed under CC BY-NC 4.0.\n" * 3), *ODD[:5],
        (17, "This work is licensed under the GNU General Public License, version 3."),
    ]
    got = license_patience.license_finds(documents(rows).withColumn("start", F.lit(0))).collect()
    found = Counter((r.doc_id, r.license, r.form) for r in got)
    assert found[11, "MIT", "line"] == found[12, "MIT", "line"] == found[14, "MIT", "grant"] == found[15, "MIT", "grant"] == 1
    assert found[16, "CC-BY-NC-4.0", "line"] == 3 and found[17, "GPL-3.0", "line"] == 1
    assert {r.doc_id for r in got} == {11, 12, 14, 15, 16, 17}
    text = dict(rows)
    assert {text[r.doc_id][r.start : r.end] for r in got if r.doc_id == 11} == {"Released under the MIT License"}
    assert all(r.coverage < 1 for r in got if r.doc_id == 15)
    assert license_patience.license_finds(documents([])).count() == 0


def test_words_around_a_notice_do_not_cut_it():
    """Behind a copyright line, behind and before each of its own words, with one of them again inside, and in a row."""
    for known in (license_patience.Notice(*n) for n in license_patience.NOTICES):
        text = known.text
        words = text.split()

        def found(body, known=known):
            return [(f[2], body[f[3] : f[4]]) for f in license_patience.scan(body, [known])]

        bare = text.rstrip(".")
        for line in ("Copyright (c) 2020 Jane Doe.", "Copyright (c) 2020 Jane Doe. All rights reserved.", *known.telling):
            assert found(f"{line}\n{text}") == [(1.0, bare)]
            assert found(f"{text}\n{line}") == [(1.0, bare)]
            middle = len(words) // 2
            inside = found(" ".join([*words[:middle], line, *words[middle:]]))
            assert [f[0] for f in inside] == [1.0]
        assert found(f"Copyright Jane Doe. {text}\n" * 3) == [(1.0, bare)] * 3
        assert found("x " * 500 + f"{text} {text}" + " y" * 500) == [(1.0, bare)] * 2


def test_the_alignment_decides(monkeypatch):
    """Without it nothing is found; what it covers is what a find reports, and never more than the subsequence."""
    rng = random.Random(4)
    for known in (license_patience.Notice(*n) for n in license_patience.NOTICES):
        words = known.text.split()
        for _ in range(30):
            body = " ".join(rng.choice(["junk", *words]) if rng.random() < 0.12 else w for w in words)
            finds = license_patience.scan(f"before {body} after", [known])
            for _, _, coverage, start, end in finds:
                own = license_patience.words_of(f"before {body} after"[start:end])[0]
                pairs = license_patience.align(own, known.words)
                assert coverage == len(pairs) / len(known.words) >= license_patience.THRESHOLD
                assert all(own[i] == known.words[j] for i, j in pairs)
                assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
                assert len(pairs) <= known.common(own, range(len(own)), len(known.words))[0]
    monkeypatch.setattr(license_patience, "align", lambda a, b: [])
    known = [license_patience.Notice(*n) for n in license_patience.NOTICES]
    assert all(license_patience.scan(n.text, known) == [] for n in known)


def test_finds_hold_what_windows_hold():
    """No stretch between the finds holds the need in a short window; finds do not overlap."""
    rng = random.Random(8)
    notice = license_patience.Notice("a", "b", "a b c d e f g h a b")
    for _ in range(300):
        words = [rng.choice("abcdefghxy") if rng.random() < 0.4 else "abcdefghab"[i % 10] for i in range(rng.randint(0, 60))]
        finds = notice.finds(words, 0.8)
        assert all(f[2] <= g[1] for f, g in zip(finds, finds[1:], strict=False))
        edges = [0, *(x for f in finds for x in f[1:]), len(words)]
        for lo, hi in zip(edges[::2], edges[1::2], strict=True):
            for i in range(lo, hi):
                assert notice.common(words, range(i, min(hi, i + 30)), 10)[0] < 8
        for got, lo, hi in finds:
            table = np.zeros((hi - lo + 1, 11), int)
            for i in range(hi - lo):
                for j in range(10):
                    table[i + 1, j + 1] = max(table[i, j + 1], table[i + 1, j], table[i, j] + (words[lo + i] == notice.words[j]))
            assert got == table[-1, -1] >= 8


def test_alignment_rises_and_matches():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.choice("abcdefgh") for _ in range(rng.randint(0, 14))] for _ in range(2))
        pairs = license_patience.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))


# training order


@pytest.mark.parametrize("total", [1, 2, 3, 17, 1000, 4097])
def test_permutation_is_a_bijection(total):
    slots = feistel_shards.permuted(np.arange(total), total, 5)
    assert sorted(slots.tolist()) == list(range(total))
    if total > 100:
        assert (slots != np.arange(total)).mean() > 0.9
        assert (slots != feistel_shards.permuted(np.arange(total), total, 6)).any()


def test_shards_give_every_token_back(documents, tmp_path):
    rng = random.Random(6)
    rows = [(100 + i, prose(rng, rng.randint(0, 200))) for i in range(80)] + ODD
    docs = documents(rows)

    def digest(df, name):
        shards, total = feistel_shards.write_shards(df, str(tmp_path / name), tokens=F.col("text").cast("binary"), length=100, per_shard=64)
        seen = feistel_shards.read_slots(shards).collect()
        assert sorted(r.slot for r in seen) == list(range(total))
        assert all(r.offset == (r.slot % 64) * (16 + 100) and r["shard"] == r.slot // 64 for r in seen)
        assert [r.n for r in shards.orderBy("shard").collect()][:-1] == [64] * (-(-total // 64) - 1)
        return shards, {r.slot: (r.doc_id, r.sequence, bytes(r.tokens)) for r in seen}

    shards, first = digest(docs, "a")
    _, again = digest(docs.repartition(5), "b")
    assert first == again
    whole = defaultdict(lambda: defaultdict(list))
    for doc, k, tokens in first.values():
        whole[doc][k].append(tokens)
    for doc, text in rows:
        if doc != 4:  # two equal rows
            assert b"".join(whole[doc][k][0] for k in sorted(whole[doc])) == (text or "").encode()
    late = feistel_shards.read_slots(shards, from_slot=100)
    assert sorted(r.slot for r in late.collect()) == list(range(100, len(first)))
    empty, total = feistel_shards.write_shards(documents([]), str(tmp_path / "c"), tokens=F.col("text").cast("binary"))
    assert total == 0 and empty.count() == 0


def test_query_writes_token_ids(spark):
    """The registered query's sequences hold the ids of op2's vocabulary."""
    sf = "/root/testdata/sf0.001"
    codec = byte_bpe.codec(PATH)
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = Counter()
    for doc, ids in zip([r.doc_id for r in rows], codec.encode([r.text for r in rows]), strict=True):
        for k in range(max(1, -(-len(ids) // 2048))):
            part = np.asarray(ids[2048 * k : 2048 * (k + 1)], np.uint16)
            want[doc, k, len(part), zlib.crc32(part.tobytes())] += 1
    got = queries.op10_feistel_shards(spark, sf).collect()
    assert Counter((r.doc_id, r.sequence, r.n_tokens, r.crc32) for r in got) == want
    assert sorted(r.slot for r in got) == list(range(len(got)))


def test_shards_of_token_ids(documents, tmp_path):
    docs = documents([(1, "some words to encode " * 50), (2, "")])
    packed = byte_bpe.packed(docs, PATH)
    shards, _ = feistel_shards.write_shards(packed, str(tmp_path / "s"), width=2, length=64, per_shard=2)
    rows = sorted(feistel_shards.read_slots(shards, width=2).collect(), key=lambda r: (r.doc_id, r.sequence))
    ids = np.concatenate([np.frombuffer(r.tokens, np.uint16) for r in rows if r.doc_id == 1])
    assert byte_bpe.codec(PATH).decode(ids) == ("some words to encode " * 50).encode()


def test_pieces_of_one_hash_keep_their_own_ids(monkeypatch):
    """Grouping and cache tell pieces apart by their characters; the cache grows with its pieces and is emptied between chunks."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    of = byte_bpe.Codec(path)
    real = byte_bpe.piece_hashes
    monkeypatch.setattr(byte_bpe, "piece_hashes", lambda *a: real(*a) % np.uint64(97))
    monkeypatch.setattr(byte_bpe, "CHUNK_CHARS", 3000)
    monkeypatch.setattr(byte_bpe, "CACHE_PIECES", 900)
    r = random.Random(5)
    texts = [" ".join("".join(r.choice("abcé9'.\n") for _ in range(r.randint(1, 4))) for _ in range(300)) for _ in range(30)] * 2
    whole = tiktoken.Encoding("whole", pat_str=byte_bpe.PATTERN, mergeable_ranks=of.ranks, special_tokens={})
    assert [x.tolist() for x in of.encode(texts)] == [whole.encode_ordinary(t) for t in texts]
    monkeypatch.setattr(byte_bpe, "piece_hashes", real)
    monkeypatch.setattr(byte_bpe, "CHUNK_CHARS", 2_000_000)
    of = byte_bpe.Codec(path)
    wide = [" ".join(str(k * 7919) for k in range(60_000)), "", None]
    assert [x.tolist() for x in of.encode(wide)] == [whole.encode_ordinary(t or "") for t in wide]
    assert len(of.known.slots) > len(of.known.starts) > 1 << 15
