"""The cash ledger: investment blotter, working frame, cash balance and the
token ledger."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stakeperf.config import CASH_COLUMNS, INVESTMENT_PATTERN, TOKEN_COLUMN
from stakeperf.functions.columns import coalesce_numeric, columns_like, quoted
from stakeperf.operators.assets import asset_balances, to_wide
from stakeperf.operators.windows import prefix_sum


def investment_blotter(investments: DataFrame, fixedincome: DataFrame,
                       start: date | None = None, end: date | None = None) -> DataFrame:
    """FULL OUTER join on ``date``, missing -> 0.  Non-key columns present
    on both sides get the suffixes ``.x`` / ``.y``, as in dplyr.

    An optional date range filters both sides *before* the join (the same
    rows as filtering the result, but it reaches both scans)."""
    left, right = investments, fixedincome
    if start is not None and end is not None:
        in_range = F.col("date").between(F.lit(start), F.lit(end))
        left, right = left.where(in_range), right.where(in_range)
    shared = (set(left.columns) & set(right.columns)) - {"date"}
    for c in shared:
        left = left.withColumnRenamed(c, c + ".x")
        right = right.withColumnRenamed(c, c + ".y")
    return coalesce_numeric(left.join(right, "date", "full_outer"))


def working_frame(grid_dates: DataFrame, asset_names: Sequence[str], blotter: DataFrame,
                  cash: DataFrame, start: date | None = None, end: date | None = None) -> DataFrame:
    """One row per grid date: zero asset columns, the blotter's columns and
    the cash columns, all missing values 0 (left joins on ``date``).

    ``start`` / ``end`` (the range the grid dates come from) restrict the
    blotter and cash inputs before the joins; rows outside could not match
    anyway, and the literal range reaches their scans as pushed filters."""
    if start is not None and end is not None:
        in_range = F.col("date").between(F.lit(start), F.lit(end))
        blotter, cash = blotter.where(in_range), cash.where(in_range)
    base = grid_dates.select("date").distinct().select("date", *[F.lit(0.0).alias(a) for a in asset_names])
    return coalesce_numeric(base.join(blotter, "date", "left").join(cash, "date", "left"))


def investment_flows(frame: DataFrame, pattern: str = INVESTMENT_PATTERN) -> DataFrame:
    """Long ``(date, asset, inv)`` from the investment columns of a frame,
    summed per date: column ``<asset>Inv`` feeds asset ``<asset>``."""
    inv_cols = columns_like(frame, pattern)
    if not inv_cols:
        return (frame.select("date", F.lit(None).cast("string").alias("asset"), F.lit(0.0).alias("inv"))
                .where(F.lit(False)))
    per_date = frame.groupBy("date").agg(*[F.sum(quoted(c).cast("double")).alias(c) for c in inv_cols])
    stacked = per_date.unpivot("date", [quoted(c) for c in inv_cols], "_col", "inv")
    return stacked.select("date", F.regexp_replace("_col", "(?i)" + pattern + "$", "").alias("asset"), "inv")


def cash_balance(frame: DataFrame, cash_columns: Sequence[str] = CASH_COLUMNS,
                 pattern: str = INVESTMENT_PATTERN) -> DataFrame:
    """Running cash, one row per date: cumulative sum by date of the cash
    columns minus the investment columns, over all rows of a date.  A blocked prefix sum with one block per month: the
    per-date windows run per month in parallel and only the month totals
    (one row per month) form a single ordered series.  The frame is read
    twice (block totals and in-block sums): materialize an expensive one."""
    inv_cols = columns_like(frame, pattern)
    net = sum((quoted(c).cast("double") for c in cash_columns), F.lit(0.0)) - sum((quoted(c).cast("double") for c in inv_cols), F.lit(0.0))
    per_date = frame.groupBy("date").agg(F.sum(net).alias("_net"))
    month = F.year("date") * 12 + F.month("date")
    out = prefix_sum(per_date, F.col("_net"), [], [F.col("date")], month,
                     "cashbalance")
    return out.select("date", "cashbalance")


def ledger_with_balances(frame: DataFrame, returns: DataFrame, asset_names: Sequence[str]) -> DataFrame:
    """The working frame with asset columns replaced by running balances of
    the assets that have returns (others stay 0), plus ``cashbalance``.  Rows
    that share a date stay as many rows, each with the date's balances."""
    bal = asset_balances(returns, investment_flows(frame))
    wide = to_wide(bal, asset_names, "balance")
    out = frame.drop(*asset_names).join(wide, "date", "left")
    out = out.fillna(0.0, subset=list(asset_names))
    return out.join(cash_balance(frame), "date", "left")


def token_ledger(ledger: DataFrame, token: str = TOKEN_COLUMN) -> DataFrame:
    """``date`` plus every column whose name contains the token."""
    return ledger.select("date", *[c for c in columns_like(ledger, token)])
