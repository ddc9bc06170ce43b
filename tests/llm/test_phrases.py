"""Phrase mining against plain counting."""

import random
import re
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from modelgov.llm import phrase_mining as pm

LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def expected(rows, longest=3, least=10, top=2000, share=50):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        own = counts.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in range(1, longest + 1):
                own.update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, own in counts.items():
        found = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in found.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    inside[p[i : i + n]] = max(inside[p[i : i + n]], a)
        listed = []
        for p, a in found.items():
            if 100 * inside[p] >= share * a:
                continue
            score, k = min((10**6 * a * a // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            listed.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(listed)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def corpus(seed, n=900):
    r = random.Random(seed)
    common = [*(f"c{i}" for i in range(9)), "the", "of", "And", "x y", "é漢", "\x00", "a\x1fb"]
    rare = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(n):
        words = [r.choice(common) if r.random() < 0.6 else r.choice(rare) for _ in range(r.randrange(0, 60))]
        if r.random() < 0.5:
            at = r.randrange(len(words) + 1)
            words[at:at] = r.choice([["New", "York", "City"], ["w1", "w2"], ["the", "the", "the"]])
        text = "".join(w + r.choice([" "] * 9 + ["  ", "\t", ". ", ",", "\n", "\x0b", "?! "]) for w in words)
        rows.append((r.choice(["en", "en", "de", None, "und", "é"]), r.choice([text, text, text.upper(), None, ""])))
    rows += [("en", "of the " * 3_000), ("long", "z" * 300_000), ("long", "q" * 300_000 + " r " * 30), *[("copy", "one two three four.")] * 30]
    return rows


def mined(spark, rows, **more):
    frame = spark.createDataFrame(rows, "lang string, text string").select("*", F.lit(1).alias("words"), F.lit(2).alias("h"), F.lit(3).alias("f"))
    return sorted(tuple(r) for r in pm.collocations(frame.repartition(5), **more).collect())


def test_against_plain_counting(spark, monkeypatch):
    monkeypatch.setattr(pm, "HOT_SHARE", 40)  # hot first words, hot pairs and cold words side by side
    monkeypatch.setattr(pm, "SLICE", 5000)
    rows = corpus(1)
    got = mined(spark, rows, least=4)
    assert got == expected(rows, least=4)
    assert len(got) > 50


def test_other_lengths_and_early_output(spark, monkeypatch):
    monkeypatch.setattr(pm, "MOST_WORDS", 50)
    monkeypatch.setattr(pm, "MOST_KEYS", 300)
    rows = corpus(2, 150)
    assert mined(spark, rows, longest=4, least=3, top=25, share=80) == expected(rows, 4, 3, 25, 80)


def test_a_clash_of_digests_starts_again(spark, monkeypatch):
    counted, salts = pm.word_counts, []

    def clashing(texts, salt):
        salts.append(salt)
        words = counted(texts, salt)
        return words.unionByName(words.limit(1).withColumn("word", F.lit("another"))) if salt == 0 else words

    monkeypatch.setattr(pm, "word_counts", clashing)
    rows = corpus(3, 40)
    assert mined(spark, rows) == expected(rows)
    assert salts == [0, 1]


def test_empty_table(spark):
    assert mined(spark, []) == []
    assert mined(spark, [("en", None), (None, "")]) == []


@pytest.mark.parametrize(("seed", "least", "vocabulary"), [(0, 1, 3), (1, 4, 20), (2, 2, 500), (3, 5, 2)])
def test_quicksort_counts_equal_partitions(seed, least, vocabulary):
    r = np.random.default_rng(seed)
    keys = r.integers(0, vocabulary, (3, 3000)).astype(np.uint64)
    keys[2, keys[1] == 0] = 0
    keys[1, keys[0] == 0] = 0
    keys[2, keys[1] == 0] = 0
    weights = r.integers(1, 4, 3000)
    want = Counter()
    for a, b, c, w in zip(*keys.tolist(), weights.tolist(), strict=True):
        if a and b:
            want[a, b] += w
            if c:
                want[a, b, c] += w
    for shared in range(3):
        got = Counter()
        for depth, at, f in pm.quicksort_counts(keys, weights, least, shared):
            for i, n in zip(at.tolist(), f.tolist(), strict=True):
                assert tuple(keys[:depth, i].tolist()) not in got
                got[tuple(keys[:depth, i].tolist())] = n
        assert got == {p: n for p, n in want.items() if n >= least or len(p) <= shared}


def test_keys_leave_a_task_in_bounded_batches(monkeypatch):
    """All languages share the room for keys, and a batch holds a bounded number of bytes, however many parts there are."""
    monkeypatch.setattr(pm, "PAYLOAD_BYTES", 2000, raising=False)
    monkeypatch.setattr(pm, "MOST_KEYS", 3000)
    taken = []
    texts = SimpleNamespace(mapInArrow=lambda run, schema: run)
    table = SimpleNamespace(value=np.full(1 << (pm.TABLE_BITS - 6), 2**64 - 1, np.uint64))
    run = pm.routed(texts, table, np.zeros(0, np.uint64), 3, 64, 0)

    def batches():
        for k in range(12):
            taken.append(k)
            words = " ".join(f"w{(k * 7 + i * i) % 997}" for i in range(700))
            yield pa.RecordBatch.from_arrays([pa.array([f"l{k}"]), pa.array([words])], ["lang", "text"])

    found, when = [], []
    for b in run(batches()):
        found.append(b)
        when.append(len(taken))
    assert min(when) < 12  # twelve languages together passed the limit that none passed alone
    for b in found:
        assert sum(len(x.as_py()) for x in b.column(1)[:-1]) <= 2000
    weights = [np.frombuffer(x.as_py(), np.uint64).reshape(-1, 4)[:, 3].sum() for b in found for x in b.column(1)]
    assert sum(weights) == 12 * 699
