"""Semantic unit tests on hand-made rows: one or more per quirk of the
"""

from datetime import date

import pytest
from pyspark.sql import functions as F

from stakeperf.operators import calendar as C
from stakeperf.operators import cumulative as CU
from stakeperf.operators import portfolio as P
from stakeperf.operators import scores as S
from stakeperf.operators import staking as ST
from stakeperf.sources import files as IO

TS_SCHEMA = ("model_name string, roundNumber bigint, seq bigint, displayName string, date string, "
             "day double, payoutPending double, atRisk double")


def ts_frame(spark, rows):
    return spark.createDataFrame(rows, TS_SCHEMA)


def by_key(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_daily_payout_first_row_and_differences(spark):
    rows = [("m", 1, 1, "mmc", "2024-01-02 00:00:00", 1.0, 10.0, 100.0),
            ("m", 1, 2, "mmc", "2024-01-03 00:00:00", 2.0, 15.0, 100.0),
            ("m", 1, 3, "mmc", "2024-01-04 00:00:00", 3.0, 12.0, 100.0)]
    out = by_key(ST.staked_daily(ts_frame(spark, rows)), "seq")
    assert [out[(i,)]["dailypayout"] for i in (1, 2, 3)] == [10.0, 5.0, -3.0]
    assert out[(1,)]["dailyrets"] == 0.0
    assert out[(2,)]["dailyrets"] == pytest.approx(0.05)
    assert out[(3,)]["stakeandpayout"] == 112.0


def test_telescoping_sum_of_daily_payouts(spark):
    rows = [("m", r, r * 10 + d, "mmc", f"2024-01-{d + 1:02d} 00:00:00", float(d), float(d * d + r), 50.0)
            for r in (1, 2) for d in range(1, 8)]
    out = ST.staked_daily(ts_frame(spark, rows)).groupBy("roundNumber").agg(F.sum("dailypayout").alias("s"))
    got = {r.roundNumber: r.s for r in out.collect()}
    assert got == {1: pytest.approx(49.0 + 1), 2: pytest.approx(49.0 + 2)}


def test_ties_on_day_break_by_seq(spark):
    # Q2: two metrics share (round, day); differences interleave in file order.
    rows = [("m", 1, 2, "fnc_v4", "2024-01-02 00:00:00", 1.0, 7.0, 10.0),
            ("m", 1, 1, "mmc", "2024-01-02 00:00:00", 1.0, 3.0, 10.0),
            ("m", 1, 3, "mmc", "2024-01-03 00:00:00", 2.0, 4.0, 10.0)]
    out = by_key(ST.staked_daily(ts_frame(spark, rows)), "seq")
    assert out[(1,)]["dailypayout"] == 3.0
    assert out[(2,)]["dailypayout"] == 4.0
    assert out[(3,)]["dailypayout"] == -3.0


def test_missing_day_sorts_last_and_missing_values_become_zero(spark):
    rows = [("m", 1, 1, "mmc", "2024-01-02 00:00:00", None, 5.0, 10.0),
            ("m", 1, 2, "mmc", "2024-01-03 00:00:00", 1.0, None, 10.0)]
    out = by_key(ST.staked_daily(ts_frame(spark, rows)), "seq")
    assert out[(2,)]["dailypayout"] == 0.0            # first row, payout missing -> 0
    assert out[(1,)]["dailypayout"] == 0.0            # 5 - NULL -> 0
    assert out[(1,)]["dailyrets"] == 0.0


def test_division_by_zero_is_null_not_error(spark):
    rows = [("m", 1, 1, "mmc", "2024-01-02 00:00:00", 1.0, 5.0, 0.0),
            ("m", 1, 2, "mmc", "2024-01-03 00:00:00", 2.0, 6.0, 0.0)]
    out = ST.staked_daily(ts_frame(spark, rows)).collect()
    assert all(r["returns"] is None for r in out)
    assert all(r["dailyrets"] == 0.0 for r in out)


def test_wallet_estimate_null_when_a_day_is_missing(spark):
    rows = [("m", 1, 1, "mmc", "2024-01-02 01:00:00", 2.0, 5.0, 11.0),
            ("m", 2, 2, "mmc", "2024-01-02 02:00:00", 1.0, 5.0, 22.0),
            ("m", 3, 3, "mmc", "2024-01-03 02:00:00", None, 5.0, 33.0),
            ("m", 3, 4, "mmc", "2024-01-03 03:00:00", 1.0, 5.0, 44.0)]
    out = by_key(ST.staked_by_date(ST.staked_daily(ts_frame(spark, rows))), "date")
    assert out[(date(2024, 1, 2),)]["walletestimate"] == 22.0   # smallest day wins
    assert out[(date(2024, 1, 3),)]["walletestimate"] is None   # min(day) is NA


def test_stake_weighted_return_zero_unless_positive_weight_sum(spark):
    rows = [("m", 1, 1, "mmc", "2024-01-02 00:00:00", 1.0, -5.0, 2.0),
            ("m", 1, 2, "mmc", "2024-01-02 00:00:00", 2.0, -1.0, 2.0)]
    out = ST.staked_by_date(ST.staked_daily(ts_frame(spark, rows))).collect()
    assert out[0]["NMRwtret"] == 0.0


def test_first_date_change_is_null(spark):
    rows = [("m", 1, 1, "mmc", "2024-01-02 00:00:00", 1.0, 5.0, 10.0),
            ("m", 1, 2, "mmc", "2024-01-03 00:00:00", 2.0, 8.0, 10.0)]
    out = by_key(ST.staked_by_date(ST.staked_daily(ts_frame(spark, rows))), "date")
    assert out[(date(2024, 1, 2),)]["totalpayoutdailychg"] is None
    assert out[(date(2024, 1, 3),)]["totalpayoutdailychg"] == -2.0
    assert out[(date(2024, 1, 3),)]["return"] == pytest.approx(-0.2)


BD_SCHEMA = ("model_name string, date date, totalpayout double, cumstake double, walletestimate double, "
             "NMRwtret double, totalpayoutdailychg double, return double, leveredreturn double")


def test_weekend_and_monday_collapse_to_friday_keeping_monday(spark):
    # Q3/Q4: Sat, Sun and Mon all map to Fri; the Monday row survives
    # unchanged (its change is not recomputed).
    rows = [("m", date(2024, 1, 5), 1.0, 1.0, 1.0, 0.0, 0.1, 0.1, 0.1),   # Fri -> Thu
            ("m", date(2024, 1, 6), 2.0, 1.0, 1.0, 0.0, 0.2, 0.2, 0.2),   # Sat -> Fri
            ("m", date(2024, 1, 7), 3.0, 1.0, 1.0, 0.0, 0.3, 0.3, 0.3),   # Sun -> Fri
            ("m", date(2024, 1, 8), 4.0, 1.0, 1.0, 0.0, 0.4, 0.4, 0.4)]   # Mon -> Fri
    out = by_key(ST.bizday_by_date(spark.createDataFrame(rows, BD_SCHEMA)), "date")
    assert set(out) == {(date(2024, 1, 4),), (date(2024, 1, 5),)}
    assert out[(date(2024, 1, 5),)]["totalpayout"] == 4.0
    assert out[(date(2024, 1, 5),)]["totalpayoutdailychg"] == 0.4


def test_redate_with_holiday_calendar(spark):
    hol = spark.createDataFrame([(date(2024, 1, 15),)], "date date")
    cal = C.build_calendar(spark, date(2024, 1, 1), date(2024, 1, 31), hol)
    d = spark.createDataFrame([(date(2024, 1, 16),), (date(2024, 1, 13),), (date(2024, 1, 12),)], "date date")
    out = by_key(C.shift_dates(d, "date", cal), "date")
    assert out[(date(2024, 1, 16),)]["prev_biz"] == date(2024, 1, 12)   # Mon 15th is a holiday
    assert out[(date(2024, 1, 13),)]["next_biz"] == date(2024, 1, 16)
    assert out[(date(2024, 1, 12),)]["next_biz"] == date(2024, 1, 16)
    # outside the calendar window -> NULL, so the caller's fallback applies
    far = spark.createDataFrame([(date(2025, 6, 4),)], "date date")
    assert C.shift_dates(far, "date", cal).collect()[0]["next_biz"] is None


def test_bizday_ts_dedupes_before_daily_sum(spark):
    # Q6: Sat and Mon rows land on the same Friday; only the last survives
    # and the daily "sum" is over that one row.
    rows = [("m", 1, 1, "mmc", "2024-01-06 10:00:00", 1.0, 5.0, 10.0),
            ("m", 1, 2, "mmc", "2024-01-08 10:00:00", 2.0, 9.0, 10.0)]
    ts = ST.staked_daily(ts_frame(spark, rows))
    red = CU.bizday_ts(ts)
    agg = CU.daily_aggregates(red).collect()
    assert len(agg) == 1
    assert agg[0]["date"] == date(2024, 1, 5)
    assert agg[0]["ts_totalpayout"] == 9.0
    assert agg[0]["ts_totalpayoutdailychg"] == 4.0


def test_token_return_over_matched_dates_only(spark):
    # Q12: the lag runs over the semi-joined dates.
    prices = spark.createDataFrame(
        [(date(2024, 1, d), "NMR", float(p)) for d, p in [(1, 10), (2, 20), (3, 40)]],
        "date date, asset string, price double")
    port = spark.createDataFrame([(date(2024, 1, 1),), (date(2024, 1, 3),)], "date date")
    out = by_key(P.nmr_prices(prices, port), "date")
    assert out[(date(2024, 1, 1),)]["NMRreturn"] == 0.0
    assert out[(date(2024, 1, 3),)]["NMRreturn"] == 3.0


def _bd(spark, rows):
    return spark.createDataFrame(rows, BD_SCHEMA)


def test_cumulative_null_wallet_gives_zero_balance_and_price_default(spark):
    # D9 order: cumbalance = totalpayout + NULL = NULL, then NULL -> 0.
    bd = _bd(spark, [("m", date(2024, 1, 2), 3.0, 7.0, None, 0.0, None, None, None)])
    daily = spark.createDataFrame([], "model_name string, date date, ts_totalpayout double, "
                                      "ts_totalpayoutdailychg double")
    token = spark.createDataFrame([], "date date, NMR double, NMRreturn double")
    r = CU.cumulative_by_model(bd, daily, token).collect()[0]
    assert r["cumbalance"] == 0.0 and r["cumstakebalance"] == 10.0
    assert r["NMR"] == 1.0 and r["cumstakeUSD"] == 10.0


def test_cumulative_routes_models_without_rows(spark):
    # A model with per-date rows but no per-round rows.
    bd = _bd(spark, [("a", date(2024, 1, 2), 3.0, 7.0, 2.0, 0.5, 1.0, 0.1, 0.1),
                     ("b", date(2024, 1, 2), 3.0, 7.0, 2.0, 0.5, 1.0, 0.1, 0.1)])
    ts = ST.staked_daily(ts_frame(spark, [("a", 1, 1, "mmc", "2024-01-03 00:00:00", 1.0, 4.0, 7.0)]))
    token = spark.createDataFrame([(date(2024, 1, 2), 2.0, 0.0)], "date date, NMR double, NMRreturn double")
    out = by_key(CU.cumulative(bd, CU.bizday_ts(ts), token), "model_name")
    assert out[("a",)]["totalpayout"] == 4.0 and out[("a",)]["cumbalance"] == 6.0
    assert out[("b",)]["totalpayout"] == 0.0 and out[("b",)]["cumbalance"] == 2.0
    assert out[("b",)]["cumUSD"] == 4.0


def test_portfolio_cumulative_balances_are_zero(spark):
    port = spark.createDataFrame([(date(2024, 1, 2), 5.0, 3.0)], "date date, cumstake double, walletestimate double")
    token = spark.createDataFrame([], "date date, NMR double, NMRreturn double")
    r = CU.cumulative_allmodels(port, token).collect()[0]
    assert (r["cumbalance"], r["cumstakebalance"], r["cumUSD"], r["NMR"]) == (0.0, 0.0, 0.0, 1.0)


NESTED = ("model_name string, roundNumber bigint, atRisk double, intraRoundSubmissionScores "
          "array<struct<date:string, day:int, displayName:string, payoutPending:double, "
          "payoutSettled:double, percentile:double, value:double>>")


def _nested(spark):
    s = lambda n, d: ("2024-01-0%d 00:00:00" % d, d, n, 1.0, 2.0, 0.5, 0.1)
    return spark.createDataFrame([
        ("m", 1, 10.0, [s("mmc", 1), s("fnc_v4", 1), s("fnc_v4", 2), s("mmc", 2)]),
        ("m", 2, 10.0, None),
        ("m", 3, 10.0, [s("mmc", 3), s("fnc_v4", 3)]),
    ], NESTED)


def test_flatten_keeps_records_without_scores(spark):
    flat = S.flatten_scores(_nested(spark))
    assert flat.count() == 7
    empty = flat.where("roundNumber = 2").collect()[0]
    assert empty["seq"] is None and empty["displayName"] is None


def test_filter_documented_membership(spark):
    assert S.filter_scores(S.flatten_scores(_nested(spark))).count() == 6


def test_filter_parity_recycles_metric_names(spark):
    # Q1: row i kept iff metric == ("mmc", "fnc_v4")[(i-1) % 2]; rows are
    # 1 mmc, 2 fnc_v4, 3 fnc_v4, 4 mmc, 5 <none>, 6 mmc, 7 fnc_v4.
    kept = S.filter_scores_parity(S.flatten_scores(_nested(spark)))
    got = sorted((r.roundNumber, r.seq) for r in kept.collect())
    assert got == [(1, 0), (1, 1)]


def test_parity_row_index_matches_a_plain_row_number(spark):
    import random
    rnd = random.Random(7)
    rows = [("m%d" % (i % 3), rnd.randrange(0, 500), i, "mmc", None, 1.0, 1.0, 1.0) for i in range(3000)]
    df = ts_frame(spark, rows)
    idx = S.score_row_index(df, seq_block=4).collect()
    want = {}
    for m in ("m0", "m1", "m2"):
        mine = sorted((r for r in rows if r[0] == m), key=lambda r: (r[1], r[2]))
        want.update({r[2]: i + 1 for i, r in enumerate(mine)})
    assert {r["seq"]: r["row_index"] for r in idx} == want


def test_null_scores_default_row(spark):
    out = S.null_scores_default(_nested(spark)).where("roundNumber = 2").collect()
    assert len(out) == 1 and out[0]["seq"] == 0 and out[0]["payoutPending"] is None


def test_stringify_like_r_tostring(spark):
    df = spark.createDataFrame([(23.0, 0.05, None, "x", 6, -0.0, 1e30)],
                               "a double, b double, c double, d string, e int, f double, g double")
    r = S.stringify_scores(df, ["a", "b", "c", "d", "e", "f", "g"]).collect()[0]
    assert (r.a, r.b, r.c, r.d, r.e, r.f) == ("23", "0.05", "", "x", "6", "0")
    assert r.g == "1" + "0" * 30


def test_text_keeps_every_digit_at_any_magnitude(spark, tmp_path):
    values = [0.12345678901234, 0.015743892738291, 1e-12, 3e28, -1.5e-7, 1234567.25, 12345678.5, 1.2345678912e9,
              9007199254740993.0, 5e-324, 1.7976931348623157e308, 100.0, -0.0, 0.1, 123456789012345680.0]
    df = spark.createDataFrame([(v,) for v in values], "payoutPending double")
    text = [r[0] for r in S.stringify_scores(df).collect()]
    assert all("e" not in t.lower() and not t.endswith(".") for t in text)
    assert [float(t) for t in text] == values
    assert text[:4] == ["0.12345678901234", "0.015743892738291", "0.000000000001", "3" + "0" * 28]
    # a score file reads back equal
    path = str(tmp_path / "scores")
    rows = df.selectExpr("'m' model_name", "1L roundNumber", "payoutPending", "'mmc' displayName")
    IO.write_per_model(S.stringify_scores(rows), path)
    assert sorted(r.payoutPending for r in IO.scan_models(spark, path).collect()) == sorted(values)


def test_score_files_are_read_by_their_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("roundNumber,displayName,date,day,payoutPending,atRisk\n1,mmc,2024-01-02,1,5,20\n1,mmc,2024-01-02,1,7,20\n")
    (tmp_path / "b c.csv").write_text('"","intraRoundSubmissionScores.payoutPending",atRisk,roundNumber,intraRoundSubmissionScores.displayName,intraRoundSubmissionScores.day,intraRoundSubmissionScores.date\n"1",7,NA,2,mmc,3,2024-01-05\n')
    got = {(r.model_name, r.payoutPending): r for r in IO.scan_model_files(spark, str(tmp_path)).collect()}
    assert set(got) == {("a", 5.0), ("a", 7.0), ("b c", 7.0)}
    r = got["b c", 7.0]
    assert (r.roundNumber, r.displayName, r.day, r.date, r.atRisk) == (2, "mmc", "3", "2024-01-05", None)
    assert got["a", 5.0].seq < got["a", 7.0].seq       # file order breaks ties
    ts = by_key(ST.staked_daily(S.clean_scores(IO.scan_model_files(spark, str(tmp_path)).where("model_name = 'a'"))), "payoutPending")
    assert ts[(7.0,)]["dailypayout"] == 2.0
    empty = tmp_path / "none"
    empty.mkdir()
    assert IO.scan_model_files(spark, str(empty)).count() == 0


def test_positional_filter_follows_record_order(spark):
    rows = [("m", 11, 0, 0, "mmc"), ("m", 10, 1, 0, "mmc"), ("m", 10, 1, 1, "mmc")]
    df = spark.createDataFrame(rows, "model_name string, roundNumber long, rec_pos long, seq long, displayName string")
    got = sorted((r.roundNumber, r.seq) for r in S.filter_scores_parity(df).collect())
    assert got == [(10, 1), (11, 0)]                   # rows 1 and 3; row 2 is at the other metric's place


def test_decimal_amounts_and_repeated_dates_in_the_ledger(spark):
    from decimal import Decimal

    from stakeperf.operators import ledger as L

    inv = spark.createDataFrame([(date(2024, 1, 1), None), (date(2024, 1, 2), Decimal("1.00"))], "date date, NMRInv decimal(18,2)")
    cash = spark.createDataFrame([(date(2024, 1, 1), 60.0, 0.0, 0.0), (date(2024, 1, 1), 40.0, 0.0, 0.0)], "date date, Principal double, Interest double, Adjustments double")
    grid = spark.createDataFrame([(date(2024, 1, d),) for d in (1, 2)], "date date")
    frame = L.working_frame(grid, ["NMR"], inv, cash)
    assert frame.count() == 3                          # the doubled cash date keeps both rows
    assert sorted((r.date.day, r.cashbalance) for r in L.cash_balance(frame).collect()) == [(1, 100.0), (2, 99.0)]
    rets = spark.createDataFrame([(date(2024, 1, 1), "NMR", 0.0), (date(2024, 1, 2), "NMR", 1.0)], "date date, asset string, ret double")
    out = L.ledger_with_balances(frame, rets, ["NMR"]).collect()
    assert sorted((r.date.day, r.NMR, r.cashbalance) for r in out) == [(1, 0.0, 100.0), (1, 0.0, 100.0), (2, 1.0, 99.0)]


def test_bad_date_text_is_counted_and_left_out(spark):
    rows = [("m", 1, 1, "mmc", "n/a", 1.0, 5.0, 10.0), ("m", 1, 2, "mmc", "2024-01-02", 2.0, 9.0, 10.0), ("m", 1, 3, "mmc", None, 2.0, 9.0, 10.0)]
    ts = ST.staked_daily(ts_frame(spark, rows))
    assert [r.date for r in ST.bizday_by_date(ST.staked_by_date(ts)).collect()] == [date(2024, 1, 1)]
    raw = spark.createDataFrame([("m", "n/a", "x", "", None), ("m", None, "2", "1.5", "z")], "model_name string, date string, day string, payoutPending string, atRisk string")
    reg = spark.createDataFrame([("m",), ("gone",)], "model_name string")
    got = by_key(S.model_status(reg, raw), "model_name")
    r = got[("m",)]
    assert (r.ok, r.n_rows, r.bad_date, r.bad_day, r.bad_payoutPending, r.bad_atRisk) == (True, 2, 1, 1, 0, 1)
    assert not got[("gone",)].ok and got[("gone",)].n_rows == 0


def test_holiday_shifts_need_no_window(spark):
    days = [date(2024, 12, 24), date(2024, 12, 25), date(2024, 12, 26), date(2024, 12, 27), date(2024, 12, 28), date(9999, 12, 27)]
    cal = C.holiday_shifts(spark.createDataFrame([(d,) for d in days] + [(None,)], "date date"))
    d = spark.createDataFrame([(date(2024, 12, 23),), (date(2024, 12, 30),), (date(9999, 12, 24),), (date(2024, 12, 29),)], "date date")
    out = by_key(C.shift_dates(d, "date", cal), "date")
    assert out[(date(2024, 12, 23),)]["next_biz"] == date(2024, 12, 30)
    assert out[(date(2024, 12, 30),)]["prev_biz"] == date(2024, 12, 23)
    assert out[(date(2024, 12, 29),)]["prev_biz"] == date(2024, 12, 23)
    assert out[(date(9999, 12, 24),)]["next_biz"] == date(9999, 12, 28)


def test_clean_scores_casts_and_blank_dates(spark):
    df = spark.createDataFrame([("m", " ", "", "x", "3")],
                               "model_name string, `intraRoundSubmissionScores.date` string, day string, "
                               "payoutPending string, atRisk string")
    r = S.clean_scores(df).collect()[0]
    assert r["date"] is None and r["day"] is None and r["payoutPending"] is None and r["atRisk"] == 3.0


def test_run_summary_lists_failures(spark):
    reg = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "model_name string, model_id string")
    nested = spark.createDataFrame([("a",), ("a",)], "model_name string")
    r = S.run_summary(reg, nested).collect()[0]
    assert (r.total_models, r.successful, r.failed, r.failed_names) == (3, 1, 2, "b, c")
    status = S.model_status(reg, nested.selectExpr("model_name", "'' date", "'' day", "'' payoutPending", "'' atRisk"))
    assert sorted(r.model_name for r in status.where("not ok").collect()) == ["b", "c"]


def test_missing_csv_is_empty_with_schema(spark, tmp_path):
    df = IO.read_csv_typed(spark, str(tmp_path / "nope.csv"), "date date, GLDInv double")
    assert df.count() == 0 and df.columns == ["date", "GLDInv"]
    with pytest.raises(Exception):
        IO.read_csv_typed(spark, str(tmp_path / "nope.csv"), "date date", fail_if_missing=True)


def test_persist_reports_failure(spark, tmp_path):
    df = spark.range(3)
    assert IO.persist(df, str(tmp_path / "ok"), "ok")
    blocker = tmp_path / "file"
    blocker.write_text("x")
    assert not IO.persist(df, str(blocker / "sub"), "bad")


def test_blocked_lag_equals_plain_window(spark, sf_small):
    # Tiny blocks split every round into many tasks; the result must equal
    # one block per round (a plain window) and the oracle-checked query.
    from stakeperf.plans.queries import staking
    from tests.compare import digest

    scores = staking(spark, sf_small).scores
    tiny = ST.staked_daily(scores, seq_block=3)
    whole = ST.staked_daily(scores, seq_block=1 << 62)
    a = digest(tiny.columns, [tuple(r) for r in tiny.collect()])[0]
    b = digest(whole.columns, [tuple(r) for r in whole.collect()])[0]
    assert a == b


def test_null_round_is_kept_as_its_own_group(spark):
    rows = [("m", None, 1, "mmc", "2024-01-02 00:00:00", 1.0, 5.0, 10.0),
            ("m", None, 2, "mmc", "2024-01-03 00:00:00", 2.0, 8.0, 10.0)]
    out = by_key(ST.staked_daily(ts_frame(spark, rows)), "seq")
    assert len(out) == 2 and out[(2,)]["dailypayout"] == 3.0


def test_bizday_by_date_with_holiday_calendar(spark):
    # Mon 2024-01-15 is a holiday: Tue 16th moves back to Fri 12th, and the
    # Sunday 14th moves forward to Tue 16th and back to Fri 12th as well.
    hol = spark.createDataFrame([(date(2024, 1, 15),)], "date date")
    cal = C.build_calendar(spark, date(2024, 1, 1), date(2024, 1, 31), hol)
    rows = [("m", date(2024, 1, 14), 1.0, 1.0, 1.0, 0.0, 0.1, 0.1, 0.1),
            ("m", date(2024, 1, 16), 2.0, 1.0, 1.0, 0.0, 0.2, 0.2, 0.2),
            ("m", date(2024, 1, 17), 3.0, 1.0, 1.0, 0.0, 0.3, 0.3, 0.3)]
    out = by_key(ST.bizday_by_date(spark.createDataFrame(rows, BD_SCHEMA), cal), "date")
    assert set(out) == {(date(2024, 1, 12),), (date(2024, 1, 16),)}
    assert out[(date(2024, 1, 12),)]["totalpayout"] == 2.0


def test_bizday_by_date_falls_back_outside_the_calendar(spark):
    cal = C.build_calendar(spark, date(2024, 1, 1), date(2024, 1, 31))
    rows = [("m", date(2024, 3, 6), 1.0, 1.0, 1.0, 0.0, 0.1, 0.1, 0.1)]
    out = ST.bizday_by_date(spark.createDataFrame(rows, BD_SCHEMA), cal).collect()
    assert out[0]["date"] == date(2024, 3, 5)       # original date minus one calendar day


def test_scan_models_reads_r_style_na(spark, tmp_path):
    d = tmp_path / "model_name=m1"
    d.mkdir()
    (d / "part.csv").write_text("roundNumber,seq,displayName,date,day,payoutPending,atRisk\n"
                                "1,1,mmc,NA,NA,NA,5\n")
    r = IO.scan_models(spark, str(tmp_path), null_value="NA").collect()[0]
    assert r["model_name"] == "m1" and r["date"] is None and r["payoutPending"] is None and r["atRisk"] == 5.0


def test_nan_input_is_missing(spark):
    # Q5: NaN from a file counts as missing (R's replace_na / na.rm), not as
    # a number that would poison every sum.
    df = spark.createDataFrame([("m", "2024-01-02 00:00:00", "1", "NaN", "4")],
                               "model_name string, date string, day string, payoutPending string, atRisk string")
    r = S.clean_scores(df).collect()[0]
    assert r["payoutPending"] is None and r["atRisk"] == 4.0 and r["day"] == 1.0


def test_model_id_lookup_null_when_unknown(spark):
    names = spark.createDataFrame([("a",), ("a",), ("zz",)], "model_name string")
    reg = spark.createDataFrame([("a", "id-a"), ("b", "id-b")], "model_name string, model_id string")
    got = {r.model_name: r.model_id for r in S.model_ids(names, reg).collect()}
    assert got == {"a": "id-a", "zz": None}
