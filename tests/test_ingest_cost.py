"""What the nested scores and their text cost a row: no window over the lines, one text a number."""

import json
import random
from datetime import datetime
from decimal import Decimal

from pyspark.sql import functions as F

from stakeperf.functions.columns import plain_digits
from stakeperf.operators import scores as S
from stakeperf.plans.queries import response_documents, stringify_stage
from stakeperf.sources import fixtures as FX

LINE = ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
        "l_discount double, l_tax double, l_returnflag string, l_shipdate timestamp")


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_are_dealt_once_and_sorted_in_their_order(spark, sf_small):
    plan = executed(FX.fx_nested(spark, sf_small))
    assert "Window" not in plan
    assert plan.count("Exchange hashpartitioning(l_orderkey") == 1


def test_nested_scores_of_odd_lines(spark, tmp_path):
    t = datetime(2024, 1, 2, 3, 4, 5)
    lines = [(1, 5, 5, 2, 1.0, 9.0, 0.1, 0.0, "A", t), (1, 5, 5, 1, 2.0, 8.0, 0.1, 0.0, "N", None), (1, 4, 5, 2, 3.0, 7.0, 0.1, 0.0, "R", t),
             (1, 4, 5, 2, 3.0, 7.0, 0.1, 0.0, "R", t), (1, None, 5, None, 4.0, 6.0, None, None, None, t), (None, 1, 1, 1, 1.0, 1.0, 0.1, 0.0, "A", t)]
    spark.createDataFrame(lines, LINE).repartition(3).write.parquet(f"{tmp_path}/lineitem.parquet")
    orders = [(1, 7, 1.5), (1, 7, 1.5), (2, 8, 2.5), (None, 9, 3.5)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    rows = FX.fx_nested(spark, str(tmp_path)).collect()
    got = sorted((r.model_name, None if r.intraRoundSubmissionScores is None else [s.payoutSettled for s in r.intraRoundSubmissionScores]) for r in rows)
    assert got == [("m7", [4.0, 2.0, 3.0, 3.0, 1.0]), ("m7", [4.0, 2.0, 3.0, 3.0, 1.0]), ("m8", None), ("m9", None)]


def test_a_number_becomes_text_once(spark, sf_small):
    plan = executed(stringify_stage(spark, sf_small)).lower()
    assert "rlike" not in plan and "regexp_replace" not in plan
    assert plan.count("payoutpending as string)") == 1


def test_digits_of_many_magnitudes(spark):
    rng = random.Random(7)
    xs = [rng.choice((-1, 1)) * round(rng.random(), rng.randint(1, 17)) * 10.0 ** rng.randint(-40, 40) for _ in range(3000)]
    xs += [rng.choice((-1, 1)) * float(rng.randint(1, 10**17)) for _ in range(500)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for text, raw in df.select(plain_digits("x"), F.col("x").cast("string")).collect():
        want = format(Decimal(raw), "f")
        want = want.rstrip("0").rstrip(".") if "." in want else want
        assert text == ("0" if want == "-0" else want)
    flat = df.select(F.col("x").alias("value"))
    assert S.stringify_scores(flat).collect() == df.select(plain_digits("x").alias("value")).collect()


def test_records_of_documents_are_sorted_once(spark, sf_small, monkeypatch):
    # the records are sorted once, for their window, and written in that order
    plans = []
    write = type(spark.range(1).write).text

    def text(self, path, **options):
        plans.append(executed(self._df))
        return write(self, path, **options)

    monkeypatch.setattr(type(spark.range(1).write), "text", text)
    response_documents(spark, sf_small)
    above, window, below = plans[-1].partition("Window [")
    assert window and "Sort [" not in above and below.count("Sort [document") == 1


def test_documents_of_records_that_come_twice(spark, sf_small, tmp_path):
    for t in ("orders", "lineitem"):
        rows = spark.read.parquet(f"{sf_small}/{t}.parquet")
        rows.union(rows).repartition(5).write.parquet(f"{tmp_path}/{t}.parquet")
    root = response_documents(spark, str(tmp_path))
    texts = {r.file: json.loads(r.value) for r in spark.read.text(f"{root}/*/*", wholetext=True).select("value", F.col("_metadata.file_path").alias("file")).collect()}
    numbers = [[r["roundNumber"] for r in d["data"]["v2RoundModelPerformances"]] for d in texts.values()]
    assert len(texts) == 21 and sum(map(len, numbers)) == spark.read.parquet(f"{tmp_path}/orders.parquet").count()
    assert all(n == sorted(n, reverse=True) for n in numbers)
