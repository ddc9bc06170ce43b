"""The pipeline's stages on null, empty, repeated and clashing rows."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"
CLASHES = ["_n", "_node", "_score", "score", "row", "_row", "_place", "_copy", "copies", "size", "ids", "n_shingles", "root", "doc"]
STAGES = dict(corpus_pipeline.STAGES)
FILTERS = [name for name, _ in corpus_pipeline.STAGES[:-1]]


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    words = "several plain words that make one text of more than five words"
    rows = [(None, None, None, None, None), (900_001, None, "en", "src0", 0), (900_002, "", "en", None, 0), (900_003, " \n ", None, "src1", 3),
            *[(900_004, words, "en", "src1", len(words))] * 3, (900_005, words, "en", "src2", len(words)), (900_006, "x " * 200_000, "en", "src2", 400_000)]
    return docs.unionByName(spark.createDataFrame(rows, docs.schema)).repartition(4)


def rows_of(df):
    return Counter(map(tuple, df.select("doc_id", "text", "lang", "source", "n_chars").collect()))


@pytest.mark.parametrize("stage", FILTERS)
def test_clashing_columns_change_nothing(spark, odd, stage):
    plain = STAGES[stage](spark, odd, SF)
    wide = odd.select("*", *(F.lit(f"own {c}").alias(c) for c in CLASHES))
    done = STAGES[stage](spark, wide, SF)
    assert plain.columns == odd.columns and done.columns == wide.columns
    got = done.collect()
    assert all(r[c] == f"own {c}" for r in got for c in CLASHES)
    assert rows_of(done) == rows_of(plain)
    assert set(rows_of(plain)) <= set(rows_of(odd))
    if stage == "n-gram Jaccard join":
        assert {r.doc_id for r in got} >= {None, 900_001, 900_002, 900_003, 900_004, 900_006} and 900_005 not in {r.doc_id for r in got}
        assert sum(r.doc_id == 900_004 for r in got) == 1


@pytest.mark.parametrize("stage", list(STAGES))
def test_an_empty_table_stays_empty(spark, odd, stage):
    assert STAGES[stage](spark, odd.limit(0), SF).count() == 0


def test_the_last_stage_counts_every_row(spark, odd):
    last = list(STAGES)[-1]
    done = STAGES[last](spark, odd.withColumn("ids", F.lit("own")), SF)
    assert done.count() == odd.count() and done.where("NOT exact").count() == 0
