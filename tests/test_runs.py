"""The end-to-end run API over user tables (here: the fixtures)."""

from stakeperf.plans import queries as QP
from stakeperf.plans.runs import LedgerRun, StakingRun
from stakeperf.session import scratch_path
from stakeperf.sources import fixtures as FX
from tests.compare import digest


def _digest(df):
    return digest(df.columns, [tuple(r) for r in df.collect()])[0]


def test_ledger_run_persists_what_the_source_persists(spark, sf_small):
    run = LedgerRun(FX.fx_prices(spark, sf_small), FX.fx_investments(spark, sf_small),
                    FX.fx_fixedincome(spark, sf_small), FX.fx_cash(spark, sf_small), QP.LEDGER)
    out = scratch_path(spark, "ledger-run")
    assert run.persist(out) == {"investmentBlotter": True, "cashBalance": True}
    assert spark.read.parquet(f"{out}/cashBalance").count() == run.cash_balance().count()
    assert spark.read.parquet(f"{out}/investmentBlotter").count() == run.blotter().count()
    assert set(run.token_ledger().columns) == {"date", "NMR", "NMRInv"}


def test_staking_run_shared_and_recomputed_agree(spark, sf_small):
    def build(shared):
        run = StakingRun(FX.fx_scores(spark, sf_small), FX.fx_token_prices(spark, sf_small), QP.STAKING,
                         shared=shared)
        return QP._out(run.cumulative(), QP.CUM_COLS)
    assert _digest(build(True)) == _digest(build(False))
    assert _digest(build(False)) == _digest(QP.q_cumulative_all(spark, sf_small))


def test_wide_prices_in_configured_order(spark, sf_small):
    run = LedgerRun(FX.fx_prices(spark, sf_small), FX.fx_investments(spark, sf_small),
                    FX.fx_fixedincome(spark, sf_small), FX.fx_cash(spark, sf_small), QP.LEDGER)
    wide = run.wide_prices()
    # all-missing series (SOL, MATIC) are dropped; the rest keep config order
    assert wide.columns == ["date", *[a for a in QP.LEDGER.asset_columns if a not in ("SOL", "MATIC")]]
    assert wide.count() == run.live_prices().select("date").distinct().count()
