"""The command line over files derived from the test tables."""

import json

from stakeperf.__main__ import main
from stakeperf.operators import scores as S
from stakeperf.plans import queries as QP
from stakeperf.session import scratch_path
from stakeperf.sources import files as IO
from stakeperf.sources import fixtures as FX


def test_staking_and_ledger_commands(spark, sf_small):
    root = scratch_path(spark, "cli")
    IO.write_per_model(S.filter_scores(FX.fx_scores(spark, sf_small)), f"{root}/staked", "csv")
    FX.fx_token_prices(spark, sf_small).write.parquet(f"{root}/token")
    out = f"{root}/out-staking"
    assert main(["staking", "--scores", f"{root}/staked", "--partitioned", "--token-prices", f"{root}/token",
                 "--out", out], spark) == 0
    assert spark.read.parquet(f"{out}/cumstakedmodel_by_date").count() == QP.q_cumulative_all(spark, sf_small).count()

    FX.fx_prices(spark, sf_small).write.parquet(f"{root}/prices")
    data = f"{root}/data"
    for name, df in (("investments.csv", FX.fx_investments(spark, sf_small)),
                     ("fixedincome.csv", FX.fx_fixedincome(spark, sf_small)),
                     ("cashbalance.csv", FX.fx_cash(spark, sf_small))):
        df.write.option("header", True).csv(f"{data}/{name}")
    out = f"{root}/out-ledger"
    assert main(["ledger", "--prices", f"{root}/prices", "--data-dir", data, "--start", "1900-01-01",
                 "--end", "2199-12-31", "--out", out], spark) == 0
    assert spark.read.parquet(f"{out}/cashBalance").count() == QP.q_cash_balance(spark, sf_small).count()
    assert set(spark.read.parquet(f"{out}/NMRledger").columns) == {"date", "NMR", "NMRInv"}


def test_ingest_command(spark, tmp_path):
    doc = {"data": {"v2RoundModelPerformances": [
        {"roundNumber": 1, "atRisk": 2.0, "intraRoundSubmissionScores": [
            {"date": "2024-01-02", "day": 1, "displayName": "mmc", "payoutPending": 0.5,
             "payoutSettled": 0.0, "percentile": 0.1, "value": 0.2}]}]}}
    responses = tmp_path / "responses"
    responses.mkdir()
    (responses / "m1.json").write_text(json.dumps(doc))
    models = tmp_path / "models.csv"
    models.write_text("model_name\nm1\nm2\n")
    out = str(tmp_path / "out")
    assert main(["ingest", "--responses", str(responses), "--out", out, "--models", str(models)], spark) == 0
    summary = spark.read.parquet(f"{out}/run_summary").collect()[0]
    assert (summary.total_models, summary.successful, summary.failed) == (2, 1, 1)
    status = {r.model_name: r.ok for r in spark.read.parquet(f"{out}/model_status").collect()}
    assert status == {"m1": True, "m2": False}
    assert IO.scan_models(spark, f"{out}/staked").count() == 1


def test_staking_with_holidays(spark, sf_small, tmp_path):
    from datetime import date

    from stakeperf.operators import staking as ST
    from stakeperf.operators.calendar import build_calendar

    root = scratch_path(spark, "cli-hol")
    IO.write_per_model(S.filter_scores(FX.fx_scores(spark, sf_small)), f"{root}/staked", "csv")
    FX.fx_token_prices(spark, sf_small).write.parquet(f"{root}/token")
    hol = tmp_path / "holidays.csv"
    hol.write_text("date\n2024-01-01\n2024-01-15\n")
    out = f"{root}/out"
    assert main(["staking", "--scores", f"{root}/staked", "--partitioned", "--token-prices", f"{root}/token",
                 "--holidays", str(hol), "--out", out], spark) == 0
    got = spark.read.parquet(f"{out}/stakedmodel_by_date")
    # no re-dated row lands on a holiday or a weekend
    assert got.where("date IN (DATE'2024-01-01', DATE'2024-01-15') OR dayofweek(date) IN (1, 7)").count() == 0
    # and it equals the operator run with the same calendar
    cal = build_calendar(spark, date(2023, 11, 1), date(2024, 3, 1),
                         spark.createDataFrame([(date(2024, 1, 1),), (date(2024, 1, 15),)], "date date"))
    want = ST.bizday_by_date(QP.staking(spark, sf_small).by_date(), cal)
    assert got.count() == want.count()
