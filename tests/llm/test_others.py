"""Operators on embeddings and pages, components, and the registered queries against their SQL."""

import os
import random
from collections import Counter
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from modelgov.llm import block_topk, itq_near_dup, queries, warc_revisits
from modelgov.llm.stars import components
from modelgov.llm.work import Work

SF = "/root/testdata/sf0.001"


def vectors(seed=0, n=300):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=32).tolist()) for i in range(n)]
    for k in range(60):
        base = np.asarray(rows[k % 7][1])
        rows.append((n + k, (base + rng.normal(size=32) * 0.12 * np.linalg.norm(base) / 6).tolist()))
    rows += [(1000 + k, rows[3][1]) for k in range(20)] + [(2000, (np.asarray(rows[3][1]) * 1e-200).tolist())]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 32), (3003, [float("nan")] * 32), (3004, [1.0] * 31 + [None]),
             (3005, [float("inf")] * 32), (3006, [1.0, 2.0]), (None, rows[5][1]), (3007, rows[5][1]), (3007, rows[5][1])]
    return rows


def usable(v, zero=False):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v))


def test_near_duplicates_against_brute_force(spark):
    rows = vectors()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("node", F.lit("clash"))
    got = itq_near_dup.near_duplicates(frame).collect()
    units = [np.asarray(v) / np.max(np.abs(v)) if usable(v) else None for _, v in rows]
    units = [u / np.linalg.norm(u) if u is not None else None for u in units]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(units):
        for j in range(i):
            b = units[j]
            if a is not None and b is not None and len(a) == len(b) and a @ b >= 0.9:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    found = sum(r.n_links for r in got)
    assert found >= 0.9 * sum(links) and found <= sum(links) and len(got) == len(rows)
    if found == sum(links):
        names = {}
        for i, (name, _) in enumerate(rows):
            if name is not None:
                names[find(i)] = min(name, names.get(find(i), name))
        want = Counter((rows[i][0], links[i], names.get(find(i))) for i in range(len(rows)))
        assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)
    assert itq_near_dup.near_duplicates(frame.limit(0)).count() == 0


def test_recall_on_given_vectors(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = frame.orderBy("vec_id").toPandas()
    x = np.stack(rows["embedding"].to_numpy()).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = ((x @ x.T) >= 0.9).sum() - len(x)
    got = itq_near_dup.near_duplicates(frame).agg(F.sum("n_links")).first()[0]
    assert 0.9 * want <= got <= want


def test_recall_off_centre_and_with_few_components(spark):
    """Pairs planted around a common direction (mean cosine of unlike rows), and in vectors of any length."""
    rng = np.random.default_rng(11)
    rows, links = [], {}
    for k, (size, common) in enumerate([(8, 0.0), (16, 0.0), (32, 0.0), (64, 0.8), (63, 0.69), (384, 0.8)]):
        centre = rng.normal(size=size)
        centre *= np.sqrt(common) / np.linalg.norm(centre)
        x = centre + rng.normal(size=(500, size)) * np.sqrt((1 - common) / size)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        noise = rng.normal(size=x.shape)
        noise -= (noise * x).sum(axis=1, keepdims=True) * x
        noise /= np.linalg.norm(noise, axis=1, keepdims=True)
        cosine = rng.uniform(0.9, 0.97, size=(500, 1))
        x = np.concatenate([x, cosine * x + np.sqrt(1 - cosine**2) * noise])
        links[k] = int(((x @ x.T) >= 0.9).sum() - len(x))
        rows += [(10_000 * k + i, v.tolist()) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = itq_near_dup.near_duplicates(frame).groupBy((F.col("vec_id") / 10_000).cast("int").alias("k")).agg(F.sum("n_links").alias("n"))
    for k, n in got.collect():
        assert 0.9 * links[k] <= n <= links[k], (k, n, links[k])


@pytest.mark.parametrize("plan", [(16, 2, 20), (16, 3, 64), (12, 1, 25), (8, 0, 64)])
def test_tables_give_each_near_pair_once(spark, plan):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(120, 40))
    x = np.concatenate([x, x + rng.normal(size=x.shape) * 0.3, x[:5]])
    centre, projection = itq_near_dup.projection_of(x, 64)
    codes = itq_near_dup.codes_of(x, centre, projection)
    width, most, radius = plan
    want = set()
    for i in range(len(x)):
        for j in range(i):
            differ = int(codes[i] ^ codes[j])
            parts = [((differ >> lo) & ((1 << n) - 1)).bit_count() for lo, n in itq_near_dup.tables_of(64, width)]
            if not differ or min(parts) <= most and differ.bit_count() <= radius:
                want.add((j, i))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node long, unit array<double>")
    got = [tuple(r) for r in itq_near_dup.table_pairs(frame, centre, projection, plan, Work(spark, "t")).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_sample_and_table_values_stay_off_the_driver(spark, monkeypatch):
    """Few more vectors than the sample are read for it, and lists of table values are never broadcast."""
    monkeypatch.setattr(itq_near_dup, "SAMPLE", 50)
    rows = [(i, [float(i), 1.0]) for i in range(4000)]
    frame = spark.createDataFrame(rows, "node long, unit array<double>").repartition(8)
    seen = []
    limit = type(frame).limit
    monkeypatch.setattr(type(frame), "limit", lambda df, n: seen.append(df.count()) or limit(df, n))
    got = itq_near_dup.sample_of(frame, 4000)
    monkeypatch.undo()
    want = [r[0][0] for r in frame.orderBy(F.xxhash64("node"), "node").limit(50).select("unit").collect()]
    assert got[:, 0].tolist() == want and sum(seen) < 200
    x = np.random.default_rng(14).normal(size=(60, 64))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node long, unit array<double>")
    found = itq_near_dup.table_pairs(frame, *itq_near_dup.projection_of(x, 64), (16, 3, 64), Work(spark, "t"))
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "Generate" in plan and not [p for p in plan.split("BroadcastHashJoin")[1:] if "[t#" in p.split("\n")[0]]


def test_blocks_give_each_linked_pair_once(spark, monkeypatch):
    monkeypatch.setattr(itq_near_dup, "BLOCK", 64)
    x = np.random.default_rng(13).normal(size=(400, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node long, unit array<double>")
    got = [tuple(r) for r in itq_near_dup.block_pairs(frame, 0.9, 400, 5).collect()]
    assert sorted(got) == list(map(tuple, np.argwhere(np.triu(x @ x.T >= 0.9, 1)).tolist()))


def test_rotation_is_orthogonal():
    sample = np.random.default_rng(1).normal(size=(500, 16))
    _, projection = itq_near_dup.learn_rotation(sample, 16)
    assert np.allclose(projection.T @ projection, np.eye(16))


def test_top_k_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(block_topk, "SHARD_ROWS", 100)
    monkeypatch.setattr(block_topk, "BLOCK", 16)
    rows = vectors(2) + [(4000, [1e30] * 32), (4050, [-1e30] * 32)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("id", F.lit("clash"))
    got = Counter(map(tuple, block_topk.top_k(frame, F.col("vec_id") % 50 == 0).collect()))
    good = [(i, [int(np.floor(256.0 * c)) for c in v]) for i, v in rows if i is not None and usable(v, zero=True)]
    want = Counter()
    ends = np.iinfo(np.int64)
    for q, a in good:
        if q % 50 == 0:
            scored = [(-max(ends.min, min(ends.max, sum(x * y for x, y in zip(a, b, strict=True)))), i) for i, b in good if i != q and len(a) == len(b)]
            for rank, (s, i) in enumerate(sorted(scored)[:5], 1):
                want[q, rank, i, -s] += 1
    assert got == want
    assert block_topk.top_k(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_blocks_below_the_bound_stay_closed():
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(size=(4096, 8)) * 4)
    x[:256] += 4000
    *_, opened = block_topk.search_shard(np.asarray([-1]), np.ones((1, 8)), np.arange(4096), x, 5)
    assert opened == 1


def test_components(spark):
    rng = random.Random(0)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(300)] + [(i, i + 1) for i in range(500, 700)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), Work(spark, "test")).collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in root}


def test_canonical_urls(spark):
    same = ["http://www.Example.org:80/a/b/?y=2&x=1&utm_source=z#top", "https://user@example.org/a/b?x=1&y=2", "EXAMPLE.org:443/a/b/?x=1&y=2"]
    rows = [(u,) for u in [*same, None, "  ", "#only"]]
    got = [r[0] for r in spark.createDataFrame(rows, "u string").select(warc_revisits.canonical_url(F.col("u"))).collect()]
    assert got[:3] == ["example.org/a/b?x=1&y=2"] * 3 and got[3:] == [None] * 3


def test_revisits_against_a_plain_loop(spark):
    rng = random.Random(1)
    t0 = datetime(2024, 1, 1)
    rows = []
    for i in range(600):
        hot = rng.random() < 0.4
        url = "http://hot.org/" if hot else rng.choice([f"http://h{rng.randint(0, 30)}.org/p", None, " "])
        when = rng.choice([t0 + timedelta(seconds=rng.randint(0, 40_000)), t0, None])
        tag, day = rng.choice(['"a"', '"b"', 'W/"a"', None]), rng.choice(["d1", "d2", None])
        headers = rng.choice([{k: v for k, v in (("etag", tag), ("last-modified", day), ("x", str(i)), ("cache-control", str(i))) if v}, None])
        if rng.random() < 0.5:
            rows.append((i, "response", url, when, rng.choice([200, 200, 404]), headers, rng.choice([f"p{i}", None])))
        else:
            rows.append((i, rng.choice(["revisit", "revisit", None]), url, when, 304, headers, None))
    schema = "record_id long, type string, uri string, date timestamp, status int, headers map<string,string>, payload string"
    frame = spark.createDataFrame(rows, schema).withColumn("url", F.lit("clash"))
    got = {r.record_id: r for r in warc_revisits.resolve(frame).collect()}
    assert set(got) == {r[0] for r in rows if r[1] == "revisit"}
    for rid, kind, url, when, _, headers, _ in rows:
        if kind != "revisit":
            continue
        before = [
            r for r in rows
            if r[1] == "response" and r[4] == 200 and r[6] and url and url.strip() and r[2] == url and when and r[3] and r[3] < when
        ]
        old = max(before, key=lambda r: (r[3], r[0]), default=None)
        new, known = headers or {}, (old[5] or {}) if old else {}
        if old is None:
            want = ("no_response", None, None)
        elif "etag" in new and "etag" in known:
            want = ("resolved" if new["etag"].removeprefix("W/") == known["etag"].removeprefix("W/") else "changed", old[0], None)
        elif "last-modified" in new and "last-modified" in known:
            want = ("resolved" if new["last-modified"] == known["last-modified"] else "changed", old[0], None)
        else:
            want = ("unverified", old[0], None)
        assert (got[rid].outcome, got[rid].refers_to) == want[:2]
        if want[0] == "resolved":
            assert got[rid].headers == known | {k: v for k, v in new.items() if k in warc_revisits.PERMITTED}
            assert got[rid].payload == old[6]
        else:
            assert got[rid].headers is None and got[rid].payload is None
    assert warc_revisits.resolve(frame.limit(0)).count() == 0


needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@needs_data
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    frame = queries.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    cursor = con.execute(queries.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert Counter(tuple(plain(r[c]) for c in columns) for r in frame.collect()) == want


@needs_data
def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, total = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
    done = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert 0 < len(done) and all(r.exact for r in done)
    clean = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").count()
    kept = corpus_pipeline.STAGES[0][1](spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    good = kept.join(spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1"), "doc_id").count()
    assert good >= 0.98 * clean and kept.count() < total
    assert corpus_pipeline.run(spark, SF).count() == len(done)
