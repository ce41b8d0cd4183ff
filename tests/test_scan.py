"""The affine scan against a plain fold: long series, wipe-outs, gaps, many keys."""

import math
import random

import pytest
from pyspark.sql import functions as F

from stakeperf.operators import assets as A
from stakeperf.operators.windows import affine_scan
from tests import inspect_plans as inspect


def fold(rows):
    x, out = 0.0, []
    for place, a, b in sorted(rows):
        out.append((place, x, a * x + b))
        x = a * x + b
    return out


@pytest.mark.parametrize("sizes", [(), (4,), (2, 8), (3, 12, 48)])
def test_scan_equals_a_fold(spark, sizes):
    rnd = random.Random(len(sizes))
    series = {k: [(p, rnd.choice([0.0, 1.0, 0.5, -1.0, 2.0]), rnd.choice([0.0, 1.0, -3.0])) for p in sorted(rnd.sample(range(-60, 200), rnd.randrange(1, 90)))] for k in "abc"}
    df = spark.createDataFrame([(k, *r) for k, rows in series.items() for r in rows], "k string, place long, a double, b double").repartition(3)
    got = sorted((r.k, r.place, r.before, r.after) for r in affine_scan(df, ["k"], sizes).collect())
    assert got == sorted((k, *r) for k, rows in series.items() for r in fold(rows))
    assert affine_scan(df.where("a > 9"), ["k"], sizes).count() == 0


def test_hundred_thousand_days(spark):
    n = 100_000
    day = F.col("id").cast("int")
    ret = F.when(day % 30011 == 7, -1.0).otherwise(F.sin(F.col("id")) / 50)
    returns = spark.range(n).select(F.date_from_unix_date(day).alias("date"), F.lit("X").alias("asset"), ret.alias("ret"))
    flows = spark.range(0, n, 13).select(F.date_from_unix_date(day).alias("date"), F.lit("X").alias("asset"), F.cos(F.col("id")).alias("inv"))
    out = A.asset_balances(returns, flows)
    assert "Window" not in inspect.plan_text(out, "simple")
    got = {r.d: r.balance for r in out.select(F.unix_date("date").alias("d"), "balance").collect()}
    x, scale = 0.0, 0.0
    assert len(got) == n
    for d in range(n):
        r = -1.0 if d % 30011 == 7 else math.sin(d) / 50
        x = x * (1 + r) + (math.cos(d) if d % 13 == 0 else 0.0)
        scale = 0.0 if r == -1.0 else max(abs(x), scale * (1 + r))
        assert abs(got[d] - x) <= 1e-9 * max(scale, 1.0)


def test_returns_across_months(spark):
    rows = [("2024-01-30", 2.0), ("2024-01-31", 4.0), ("2024-02-01", 5.0), ("2024-04-05", None), ("2024-04-06", 3.0), ("2025-04-06", 6.0)]
    df = spark.createDataFrame([(d, "X", p) for d, p in rows], "date string, asset string, price double").withColumn("date", F.to_date("date"))
    got = {str(r.date): r.ret for r in A.asset_returns(df).collect()}
    assert got == {"2024-01-30": 0.0, "2024-01-31": 1.0, "2024-02-01": 0.25, "2024-04-05": 0.0, "2024-04-06": 0.0, "2025-04-06": 1.0}
