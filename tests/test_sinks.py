"""Sinks that keep the old rows until the new ones are complete, and score files without a named column."""

import os
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from stakeperf.plans.runs import StakingRun
from stakeperf.sources import files as IO
from tests import inspect_plans as inspect


def names(path):
    return sorted(x for x in os.listdir(path))


def failing(spark, rows=1000):
    """A frame whose last task raises after others have written."""
    return spark.range(rows).repartition(4).select(F.when(F.col("id") == rows - 1, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long").alias("id"))


def test_failed_persist_leaves_the_old_rows(spark, tmp_path):
    path = str(tmp_path / "out")
    assert IO.persist(spark.range(5), path, "first")
    assert not IO.persist(failing(spark), path, "second")
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == list(range(5))
    assert names(tmp_path) == ["out"]
    assert IO.persist(spark.range(3), path, "third")
    assert spark.read.parquet(path).count() == 3 and names(tmp_path) == ["out"]


def test_a_switch_that_fails_midway_restores(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "out")
    assert IO.persist(spark.range(5), path)
    real = IO._file_system

    class Refuses:
        """A file system that takes no new rows."""

        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            return getattr(self.fs, name)

        def rename(self, a, b):
            return False if ".new-" in a.toString() else self.fs.rename(a, b)

    def refusing(spark, p):
        fs, at = real(spark, p)
        return Refuses(fs), at

    monkeypatch.setattr(IO, "_file_system", refusing)
    assert not IO.persist(spark.range(9), path)
    monkeypatch.undo()
    assert spark.read.parquet(path).count() == 5 and names(tmp_path) == ["out"]
    # cut off between the renames: the old rows lie beside, and the next write finds them
    os.rename(path, tmp_path / ".out.old-abc")
    assert not IO.persist(failing(spark), path)
    assert spark.read.parquet(path).count() == 5


SCORES = "model_name string, roundNumber long, seq long, displayName string, date string, day string, payoutPending double, atRisk double"


def scores(spark, models, rounds=3):
    return spark.createDataFrame([(m, r, 0, "mmc", "2024-01-02", "1", float(r), 1.0) for m in models for r in range(rounds)], SCORES)


def test_one_model_is_rewritten_alone(spark, tmp_path):
    root = str(tmp_path / "staked")
    IO.write_per_model(scores(spark, "abc"), root)
    IO.write_per_model(scores(spark, "b", 7), root, only_models=True)
    count = lambda: {r.model_name: r["count"] for r in IO.scan_models(spark, root).groupBy("model_name").count().collect()}
    assert count() == {"a": 3, "b": 7, "c": 3}
    bad = scores(spark, "ab").withColumn("day", F.when(F.col("roundNumber") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("day")))
    for only in (True, False):
        with pytest.raises(Exception, match="lost"):
            IO.write_per_model(bad, root, only_models=only)
        assert count() == {"a": 3, "b": 7, "c": 3}
    IO.write_per_model(scores(spark, "d"), root)
    assert count() == {"d": 3} and names(tmp_path) == ["staked"]


def test_files_follow_the_size_of_a_model(spark, tmp_path):
    """One model with nine tenths of the rows gets many files of like size, most others one each."""
    root = str(tmp_path / "staked")
    n = 200_000
    rows = spark.range(n, numPartitions=8).select(F.when(F.col("id") % 10 > 0, "hot").otherwise(F.concat(F.lit("m"), F.col("id") % 7)).alias("model_name"),
                                                   F.xxhash64("id").alias("roundNumber"), F.sha2(F.col("id").cast("string"), 256).alias("date"))
    keys = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "1m", "spark.sql.adaptive.rebalancePartitionsSmallPartitionFactor": "0.2"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        IO.write_per_model(rows, root)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    sizes = defaultdict(list)
    for folder, _, files in os.walk(root):
        for f in files:
            if f.endswith(".csv"):
                sizes[os.path.basename(folder)].append(os.path.getsize(f"{folder}/{f}"))
    hot = sizes.pop("model_name=hot")
    assert len(hot) > 6 and max(hot) < 4 * (sum(hot) / len(hot))
    # models of the hot one's shuffle partition (there are four) are split with it
    assert sum(len(x) == 1 for x in sizes.values()) >= len(sizes) // 2 and all(len(x) <= len(hot) for x in sizes.values())
    assert spark.read.option("header", True).csv(root).count() == n


def test_files_without_a_display_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text('roundNumber,seq,displayName,date,day,payoutPending,atRisk\n1,1,mmc,2024-01-02,1,3.5,10\n')
    (tmp_path / "b.csv").write_text('"roundNumber","atRisk","day","payoutPending","date"\n1,10,1,3.5,2024-01-02\n1,10,2,4.5,2024-01-03\n')
    (tmp_path / "c.csv").write_text("")
    (tmp_path / "d.csv").write_text("anything,else\nx,y\n")
    (tmp_path / "e.csv").write_text("roundNumber,atRisk,day,payoutPending,date\n" + "".join(f"{k},1,1,2,2024-01-02\n" for k in range(5000)))
    df = IO.scan_model_files(spark, str(tmp_path))
    got = {r.model_name: r["count"] for r in df.groupBy("model_name").count().collect()}
    assert got == {"a": 1, "b": 2, "d": 1, "e": 5000}
    assert [tuple(r) for r in df.where("model_name = 'b'").orderBy("seq").select("displayName", "day", "payoutPending", "atRisk").collect()] == [(None, "1", 3.5, 10.0), (None, "2", 4.5, 10.0)]
    ts = StakingRun(df.where("model_name = 'b'"), spark.createDataFrame([], "date date, symbol string, price double"), prefiltered=True).ts
    assert sorted(r.dailypayout for r in ts.collect()) == [1.0, 3.5]


def test_every_file_is_scanned_once(spark, tmp_path):
    (tmp_path / "a.csv").write_text("roundNumber,displayName\n1,mmc\n")
    (tmp_path / "b.csv").write_text("displayName,roundNumber\nmmc,2\n")
    plan = inspect.plan_text(IO.scan_model_files(spark, str(tmp_path)), "simple")
    assert plan.count("FileScan csv") == 2 and "FileScan text" not in plan
    assert plan.count("a.csv") <= 1 and plan.count("b.csv") <= 1
