"""Ledger half: blotter join, pattern selection, balances against a fold."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tests import inspect_plans as inspect
from stakeperf.functions.columns import columns_like
from stakeperf.operators import assets as A
from stakeperf.operators import ledger as L
from stakeperf.operators import quality as Q
from stakeperf.operators.windows import prefix_sum


def test_balances_match_a_sequential_fold(spark):
    rnd = random.Random(3)
    rows, flows = [], []
    d0 = date(2024, 1, 1)
    for a in ("X", "Y", "Z"):
        for i in range(300):
            r = -1.0 if rnd.random() < 0.03 else rnd.uniform(-0.5, 0.8)
            rows.append((d0 + timedelta(days=i), a, 0.0 if i == 0 else r))
            flows.append((d0 + timedelta(days=i), a, rnd.choice([0.0, 0.0, rnd.uniform(0, 1000)])))
    ret = spark.createDataFrame(rows, "date date, asset string, ret double")
    fl = spark.createDataFrame(flows, "date date, asset string, inv double")
    got = {(r.asset, r.date): r.balance for r in A.asset_balances(ret, fl).collect()}
    inv = {(a, d): v for d, a, v in flows}
    for a in ("X", "Y", "Z"):
        b = 0.0
        for d, aa, r in sorted(x for x in rows if x[1] == a):
            b = b * (1 + r) + inv[(a, d)]
            assert got[(a, d)] == pytest.approx(b, rel=1e-9, abs=1e-6)


def test_prefix_sum_matches_running_total(spark):
    rnd = random.Random(11)
    rows = [(k, i, rnd.randint(0, 9)) for k in ("a", "b") for i in range(500)]
    df = spark.createDataFrame(rows, "k string, i bigint, v bigint")
    out = prefix_sum(df, F.col("v"), ["k"], [F.col("i")], F.floor(F.col("i") / 37), "c", inclusive=False)
    got = {(r.k, r.i): r.c for r in out.collect()}
    for k in ("a", "b"):
        run = 0
        for _, i, v in [x for x in rows if x[0] == k]:
            assert got[(k, i)] == run
            run += v


def test_blotter_full_outer_join_fills_zero_and_suffixes(spark):
    inv = spark.createDataFrame([(date(2024, 1, 1), 5.0, 1.0)], "date date, GLDInv double, X double")
    fi = spark.createDataFrame([(date(2024, 1, 2), 7.0, 2.0)], "date date, BondInv double, X double")
    out = {r.date: r for r in L.investment_blotter(inv, fi).collect()}
    assert set(out[date(2024, 1, 1)].asDict()) == {"date", "GLDInv", "X.x", "BondInv", "X.y"}
    assert out[date(2024, 1, 1)]["BondInv"] == 0.0 and out[date(2024, 1, 2)]["GLDInv"] == 0.0


def test_pattern_selection_is_case_insensitive(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "date int, NMRInv int, nmr int, GLD int")
    assert columns_like(df, "NMR") == ["NMRInv", "nmr"]


def test_cash_balance_running_sum(spark):
    rows = [(date(2024, 1, d), 10.0, 1.0, -0.5, 2.0) for d in (1, 2, 3)]
    wf = spark.createDataFrame(rows, "date date, Principal double, Interest double, Adjustments double, GLDInv double")
    got = [r.cashbalance for r in L.cash_balance(wf).orderBy("date").collect()]
    assert got == [8.5, 17.0, 25.5]


def test_drop_empty_series_and_profile(spark):
    px = spark.createDataFrame([(date(2024, 1, 1), "A", 1.0), (date(2024, 1, 1), "B", None)],
                               "date date, asset string, price double")
    assert [r.asset for r in A.drop_empty_series(px).collect()] == ["A"]
    prof = {r.column_name: r for r in Q.table_profile(A.to_wide(px, ["A", "B"], "price")).collect()}
    assert prof["B"]["is_empty_series"] and not prof["A"]["is_empty_series"]
    assert not prof["date"]["table_is_empty"]
    empty = Q.table_profile(spark.createDataFrame([], "x double")).collect()[0]
    assert empty["table_is_empty"] and empty["n_rows"] == 0


def test_asset_values_grid_without_join(spark):
    px = spark.createDataFrame([(date(2024, 1, 1), "GLD", 1.0), (date(2024, 1, 2), "GLD", 2.0)],
                               "date date, asset string, price double")
    grid = A.asset_values(px)
    assert grid.count() == 14 and {r.value for r in grid.collect()} == {0.0}
    assert "Join" not in inspect.plan_text(grid, "simple")
