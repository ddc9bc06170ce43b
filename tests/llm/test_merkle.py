"""The Merkle manifest against a tree built in plain Python."""

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from modelgov.llm import merkle_manifest

COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"
FIELDS = merkle_manifest.FIELDS


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def beside(levels, at):
    path = []
    for level in levels[:-1]:
        path.append((at ^ 1 < at, level[at ^ 1]) if at ^ 1 < len(level) else None)
        at //= 2
    return path


def expected(rows):
    rows = [(d, s, lang, n, t) for d, s, lang, n, t in rows]
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees, members = [], []
    for g in order:
        own = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf((r[0], r[1], r[2], r[3], r[4]))))
        members.append(own)
        trees.append(climb([leaf(r) for r in own]))
    top = climb([t[-1][0] for t in trees])
    out = []
    for g, (own, tree) in enumerate(zip(members, trees, strict=True)):
        for k, row in enumerate(own):
            path = beside(tree, k) + beside(top, g)
            bad = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[3] is not None
            node = leaf((*row[:3], row[3] + 1, row[4])) if bad else tree[0][k]
            for step in path:
                node = H(node) if step is None else H(step[1], node) if step[0] else H(node, step[1])
            out.append((row[0], tree[0][k], tree[-1][0], top[-1][0], H(*(s[1] for s in path if s)), node, not bad))
    return out


def proved(frame):
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    got = merkle_manifest.prove(frame, tampered, {"n_chars": more})
    return [tuple(r) for r in got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()]


def same(got, rows):
    def key(r):
        return tuple((v is not None, v) for v in r)

    assert sorted(got, key=key) == sorted(expected(rows), key=key)


def test_odd_rows_against_plain_python(spark):
    r = random.Random(5)
    rows = [(r.choice([i, i * 1000003, -i, -i * 7 - 2**40]), "s", r.choice(["en", "de", None, "é", ""]), r.choice([i, None]), f"text {i}") for i in range(300)]
    rows += [(17, "s", "en", 5, "same")] * 9 + [(17, "s", "en", 5, f"other {i}") for i in range(4)] + [(None, None, "en", None, None)] * 3
    rows += [(2**63 - 1, "s", "en", 2**63 - 1, ""), (-(2**63), "s", "en", 1, "least"), (4, "s", "alone", 1, None), (4, "s", "alone2", 1, "x" * 300_000)]
    frame = spark.createDataFrame(rows, COLUMNS).select("*", F.lit(1).alias("leaf"), F.lit(2).alias("pos"), F.lit(3).alias("grp"))
    same(proved(frame), rows)


def test_several_rounds_of_slot_arrays(spark, monkeypatch):
    monkeypatch.setattr(merkle_manifest, "SLOT_BITS", 3)
    for sizes in ([1], [700, 8, 9, 64, 65, 1]):
        rows = [(i * 3 + 1, "s", f"g{g}", i, str(i)) for g, n in enumerate(sizes) for i in range(n)]
        same(proved(spark.createDataFrame(rows, COLUMNS)), rows)


def test_empty_table_gives_no_rows(spark):
    assert proved(spark.createDataFrame([], COLUMNS)) == []
