"""End-to-end runs over user tables: the two halves of the analysis.

``StakingRun`` and ``LedgerRun`` take DataFrames (your tables, not the test
fixtures) and expose every intermediate result of the source analysis as a
lazy DataFrame, named as the source names them.  Nothing runs until an
output is written or collected, except the optional materialization of the
per-(model, date) summary, which several outputs share.

    run = StakingRun(scores, token_prices)
    run.cumulative().write.parquet(...)

    ledger = LedgerRun(prices, investments, fixedincome, cash, LedgerConfig(...))
    ledger.persist(out_dir)        # blotter and cash balance, as the source does
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import wraps

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stakeperf.config import SCORE_METRICS, TOKEN_COLUMN, LedgerConfig
from stakeperf.operators import assets as A
from stakeperf.operators import cumulative as CU
from stakeperf.operators import ledger as L
from stakeperf.operators import portfolio as P
from stakeperf.operators import scores as S
from stakeperf.operators import staking as ST
from stakeperf.session import materialize
from stakeperf.sources import files as IO


def once(method: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Build an intermediate once per run: every output that needs it gets
    the same DataFrame, so identical subtrees can share their shuffles
    (exchange reuse) instead of being planned again."""
    @wraps(method)
    def wrapper(self):
        memo = self.__dict__.setdefault("_memo", {})
        if method.__name__ not in memo:
            memo[method.__name__] = method(self)
        return memo[method.__name__]
    return wrapper


class StakingRun:
    """Staking performance for all models at once.

    ``scores``: flat score rows (``model_name, roundNumber, seq, displayName,
    date, day, payoutPending, atRisk``; text or numbers), unfiltered.
    ``token_prices``: long ``(date, symbol, price)``; the token's symbol
    is configured in ``config``.
    ``shared=True`` materializes the per-(model, date) summary, so that however
    many outputs are produced, the raw rows are read for it only (and for
    ``ts`` itself, where that is written).
    """

    def __init__(self, scores: DataFrame, token_prices: DataFrame, config: LedgerConfig = LedgerConfig(),
                 calendar: DataFrame | None = None, metrics: Sequence[str] = SCORE_METRICS,
                 shared: bool = False, prefiltered: bool = False):
        self.config, self.calendar = config, calendar
        rows = scores if prefiltered else S.filter_scores(scores, metrics)
        self.scores = S.clean_scores(rows)
        self.shared = shared
        self.token_prices = token_prices

    @property
    def ts(self) -> DataFrame:
        """The per-round rows; dealt into ranges and written at their first use."""
        memo = self.__dict__.setdefault("_memo", {})
        if "ts" not in memo:
            memo["ts"] = ST.staked_daily(self.scores)
        return memo["ts"]

    @property
    def summary(self) -> DataFrame:
        """One row per (model, date); written at its first use when shared."""
        memo = self.__dict__.setdefault("_memo", {})
        if "summary" not in memo:
            summary = ST.daily_summary(self.ts)
            memo["summary"] = materialize(summary) if self.shared else summary
        return memo["summary"]

    # -- per model
    @once
    def by_date(self) -> DataFrame:
        """Per-date aggregates, changes and returns, before re-dating."""
        return ST.by_date_from_summary(self.summary)

    @once
    def by_date_biz(self) -> DataFrame:
        """``stakedmodel_by_date``: re-dated to business days."""
        return ST.bizday_by_date(self.by_date(), self.calendar)

    @once
    def ts_biz(self) -> DataFrame:
        """The per-round rows re-dated and de-duplicated (cumulative stage)."""
        return CU.bizday_ts_from_summary(self.summary, self.ts.columns, self.calendar)

    # -- portfolio
    @once
    def portfolio(self) -> DataFrame:
        """``allmodels`` before the currency adjustment."""
        return P.allmodels(self.by_date_biz())

    @once
    def token(self) -> DataFrame:
        """``nmrprices``: token price and return on the portfolio's dates."""
        px = A.drop_empty_series(A.asset_prices(self.token_prices, self.config.start, self.config.end,
                                                self.config.assets))
        return P.nmr_prices(px, self.portfolio())

    @once
    def currency(self) -> DataFrame:
        """``allmodels`` with the token price, its return and the adjusted returns."""
        return P.allmodels_currency(self.portfolio(), self.token())

    # -- cumulative
    @once
    def cumulative_models(self) -> DataFrame:
        return CU.cumulative(self.by_date_biz(), self.ts_biz(), self.token())

    @once
    def cumulative_portfolio(self) -> DataFrame:
        return CU.cumulative_allmodels(self.currency(), self.token())

    @once
    def cumulative(self) -> DataFrame:
        """``cumstakedmodel_by_date``: every model plus the ``allmodels`` rows, from one
        pass over the per-date rows.  Their dates are the portfolio's, so the prices need
        no semi join, and a missing price counts as 1 whether its series is empty or not."""
        prices = A.asset_prices(self.token_prices, self.config.start, self.config.end, self.config.assets)
        token = P.token_prices(prices).select("date", F.col("price").alias(TOKEN_COLUMN))
        return CU.cumulative_at_once(self.by_date_biz(), self.ts_biz(), token)


class LedgerRun:
    """The multi-asset cash ledger.

    ``prices``: long ``(date, symbol, price)``; ``investments`` /
    ``fixedincome``: ``date`` plus amount columns (investment columns contain
    "Inv"); ``cash``: ``date, Principal, Interest, Adjustments``.
    """

    def __init__(self, prices: DataFrame, investments: DataFrame, fixedincome: DataFrame, cash: DataFrame,
                 config: LedgerConfig = LedgerConfig(), shared: bool = False):
        self.config = config
        self.asset_names = config.asset_columns
        self.prices = A.asset_prices(prices, config.start, config.end, config.assets)
        self.investments, self.fixedincome, self.cash = investments, fixedincome, cash
        self.shared = shared
        self._frame: DataFrame | None = None

    @once
    def live_prices(self) -> DataFrame:
        """``assetprices`` without all-missing series."""
        return A.drop_empty_series(self.prices)

    def wide_prices(self) -> DataFrame:
        """``assetprices`` as the source shows it: ``date`` plus one column
        per surviving asset, in configured (priority, symbol) order.  The
        surviving names are read first (at most one per configured asset),
        so the pivot needs no extra pass to find its columns."""
        live = self.live_prices()
        alive = {r["asset"] for r in live.select("asset").distinct().collect()}
        names = [a for a in self.asset_names if a in alive]
        return A.to_wide(live, names, "price").select("date", *names)

    @once
    def returns(self) -> DataFrame:
        """``assetrets``."""
        return A.asset_returns(self.live_prices())

    @once
    def asset_values(self) -> DataFrame:
        return A.asset_values(self.prices, self.config.assets)

    @once
    def blotter(self) -> DataFrame:
        """``investmentblotter``: the full outer join over all dates."""
        return L.investment_blotter(self.investments, self.fixedincome)

    def working_frame(self) -> DataFrame:
        """``workingdf`` before balances (inputs restricted to the range)."""
        if self._frame is None:
            c = self.config
            blotter = L.investment_blotter(self.investments, self.fixedincome, c.start, c.end)
            frame = L.working_frame(self.prices, self.asset_names, blotter, self.cash, c.start, c.end)
            self._frame = materialize(frame) if self.shared else frame
        return self._frame

    @once
    def balances(self) -> DataFrame:
        """Running asset balances, long ``(date, asset, balance)``."""
        return A.asset_balances(self.returns(), L.investment_flows(self.working_frame()))

    @once
    def cash_balance(self) -> DataFrame:
        return L.cash_balance(self.working_frame())

    @once
    def ledger(self) -> DataFrame:
        """``workingdf`` with asset balances and ``cashbalance``."""
        return L.ledger_with_balances(self.working_frame(), self.returns(), self.asset_names)

    @once
    def token_ledger(self) -> DataFrame:
        """``NMRledger``."""
        return L.token_ledger(self.ledger())

    def persist(self, out_dir: str) -> dict[str, bool]:
        """Write the two tables the source persists; report each outcome."""
        base = out_dir.rstrip("/")
        return {
            "investmentBlotter": IO.persist(self.blotter(), f"{base}/investmentBlotter", "investment blotter"),
            "cashBalance": IO.persist(self.cash_balance(), f"{base}/cashBalance", "cash balance"),
        }
