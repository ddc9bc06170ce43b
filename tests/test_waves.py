"""What a run leaves on disk: files of their own wave by wave, and shuffles no longer than their job."""

from __future__ import annotations

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from modelgov.plans import registry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
registry.load_all()
needs_data = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


def rows(df) -> Counter:
    return Counter(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())


def files_below(folder: str, ending: str) -> int:
    return sum(n.endswith(ending) for _, _, names in os.walk(folder) for n in names)


@needs_data
@pytest.mark.parametrize(("name", "ending"), [("layout_scan", ".pbix"), ("report_files", ".json"), ("rendered_files", ".tmdl")])
def test_files_of_one_wave_are_on_disk_at_a_time(spark, monkeypatch, name, ending):
    shared = spark.sparkContext.getCheckpointDir() or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    shared = shared.removeprefix("file:")
    whole = rows(registry.run(name, spark, SF_DIR))
    monkeypatch.setattr(registry, "WAVE_BYTES", 200_000)
    from modelgov.plans import waves

    seen, remove = [], waves.remove_named_files
    monkeypatch.setattr(waves, "remove_named_files", lambda s, path: seen.append(files_below(shared, ending)) or remove(s, path))
    assert rows(registry.run(name, spark, SF_DIR)) == whole
    assert len(seen) > 3 and max(seen) < sum(seen) == sum(whole.values()) and files_below(shared, ending) == 0


def test_shuffles_are_released_when_their_job_ends(spark):
    def shuffle_files() -> int:
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return sum("shuffle_" in found.apply(k).getName() for k in range(found.size()))

    spark.conf.unset("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    registry.QUERIES["probe"] = lambda ctx: ctx.spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    try:
        df = registry.run("probe", spark, SF_DIR)
        before = shuffle_files()
        assert sorted(r["count"] for r in df.collect()) == [142, 143, 143, 143, 143, 143, 143]
        assert df.count() == 7 and df.collect() == df.collect()
        assert shuffle_files() <= before
    finally:
        del registry.QUERIES["probe"]
