"""Cumulative balances per model, in token and in USD.

Two quirks of the reference are kept on purpose and named here:

* the raw per-round rows are re-dated and de-duplicated *before* the daily
  sums, so ``daily_aggregates`` sums (nearly always) one row per date;
* ``totalpayout`` / ``totalpayoutdailychg`` change meaning in this stage:
  they become the sum of ``payoutPending`` / of ``dailypayout`` of the rows
  that survived the de-duplication.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stakeperf.config import ALL_MODELS, TOKEN_COLUMN
from stakeperf.functions.columns import coalesce_numeric, col_or
from stakeperf.operators.calendar import redate
from stakeperf.operators.staking import daily_summary

M, RN = "model_name", "roundNumber"


def bizday_ts_from_summary(summary: DataFrame, ts_columns: list[str],
                           calendar: DataFrame | None = None) -> DataFrame:
    """Re-dated raw rows from the per-date summary: each date's last row
    moves to its new date, the last of those per (model, new date) is kept,
    and a date left missing becomes the model's latest date minus one day."""
    x = redate(summary.select(M, "date", "_last", "_last_key"), "date", "_new", calendar)
    kept = x.groupBy(M, "_new").agg(F.max_by("_last", "_last_key").alias("_row"))
    latest = F.max("_new").over(Window.partitionBy(M))
    rest = [c for c in ts_columns if c not in (M, "date")]
    return (kept.withColumn("date", F.coalesce(F.col("_new"), F.date_sub(latest, 1)))
            .select(M, "date", *[F.col("_row")[c].alias(c) for c in rest]))


def bizday_ts(ts: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """Re-date the per-round rows: weekend -> next business day, then one
    business day back; keep per (model, new date) the last row in the order
    (full date text, round, day with NULL last, seq); a date left missing
    becomes the model's latest date minus one day."""
    return bizday_ts_from_summary(daily_summary(ts), ts.columns, calendar)


def daily_aggregates(redated_ts: DataFrame) -> DataFrame:
    return (redated_ts.groupBy(M, "date")
            .agg(F.coalesce(F.sum("payoutPending"), F.lit(0.0)).alias("ts_totalpayout"),
                 F.coalesce(F.sum("dailypayout"), F.lit(0.0)).alias("ts_totalpayoutdailychg")))


def _complete(by_date: DataFrame) -> DataFrame:
    """The per-date rows without the returns; a measure they lack is 0."""
    names = ["totalpayout", "cumstake", "walletestimate", "NMRwtret", "totalpayoutdailychg"]
    rest = [c for c in by_date.columns if c not in (*names, "return", "leveredreturn")]
    return by_date.select(*rest, *[col_or(by_date, c, 0.0).alias(c) for c in names])


def _with_usd(df: DataFrame, token: DataFrame, asset: str) -> DataFrame:
    px = token.select("date", F.col(asset).alias("_px"))
    return (df.join(px, "date", "left")
            .withColumn(asset, F.coalesce(F.col("_px"), F.lit(1.0))).drop("_px")
            .withColumn("cumUSD", F.col("cumbalance") * F.col(asset))
            .withColumn("cumstakeUSD", F.col("cumstakebalance") * F.col(asset)))


def cumulative_by_model(by_date: DataFrame, daily: DataFrame, token: DataFrame,
                        asset: str = TOKEN_COLUMN) -> DataFrame:
    """Per-model cumulative balances when the model has per-round rows."""
    x = (_complete(by_date)
         .join(daily.hint("merge"), [M, "date"], "left")
         .withColumn("totalpayout", F.coalesce("ts_totalpayout", "totalpayout", F.lit(0.0)))
         .withColumn("totalpayoutdailychg", F.coalesce("ts_totalpayoutdailychg", "totalpayoutdailychg", F.lit(0.0)))
         .withColumn("cumbalance", F.col("totalpayout") + F.col("walletestimate"))
         .withColumn("cumstakebalance", F.col("totalpayout") + F.col("cumstake"))
         .drop("ts_totalpayout", "ts_totalpayoutdailychg"))
    return _with_usd(coalesce_numeric(x), token, asset)


def cumulative_missing_ts(by_date: DataFrame, token: DataFrame, asset: str = TOKEN_COLUMN) -> DataFrame:
    """Per-model cumulative balances when the model has no per-round rows:
    payouts are 0, balances are the wallet estimate and the stake."""
    x = (_complete(by_date)
         .withColumn("totalpayout", F.lit(0.0))
         .withColumn("totalpayoutdailychg", F.lit(0.0))
         .withColumn("cumbalance", F.col("walletestimate"))
         .withColumn("cumstakebalance", F.col("cumstake")))
    return _with_usd(coalesce_numeric(x), token, asset)


def cumulative(by_date: DataFrame, ts_redated: DataFrame, token: DataFrame,
               asset: str = TOKEN_COLUMN) -> DataFrame:
    """Both branches in one pass: a model with per-round rows takes the
    per-round branch, a model without them the missing-rows branch.  The
    per-model flag comes from a distinct list of model names (one row per
    model), so routing adds no second scan of ``by_date``."""
    has_ts = ts_redated.select(M).distinct().withColumn("_has_ts", F.lit(True))
    daily = daily_aggregates(ts_redated)
    has = F.coalesce(F.col("_has_ts"), F.lit(False))
    x = (_complete(by_date)
         .join(has_ts, M, "left")
         .join(daily.hint("merge"), [M, "date"], "left")
         .withColumn("totalpayout",
                     F.when(has, F.coalesce("ts_totalpayout", "totalpayout", F.lit(0.0))).otherwise(F.lit(0.0)))
         .withColumn("totalpayoutdailychg",
                     F.when(has, F.coalesce("ts_totalpayoutdailychg", "totalpayoutdailychg", F.lit(0.0)))
                     .otherwise(F.lit(0.0)))
         .withColumn("cumbalance", F.col("totalpayout") + F.col("walletestimate"))
         .withColumn("cumstakebalance", F.col("totalpayout") + F.col("cumstake"))
         .drop("ts_totalpayout", "ts_totalpayoutdailychg", "_has_ts"))
    return _with_usd(coalesce_numeric(x), token, asset)


def cumulative_allmodels(portfolio: DataFrame, token: DataFrame, asset: str = TOKEN_COLUMN) -> DataFrame:
    """The portfolio row of the cumulative table: balances are literal 0,
    as in the reference."""
    x = (portfolio.select("date", "cumstake", "walletestimate")
         .withColumn("cumbalance", F.lit(0.0))
         .withColumn("cumstakebalance", F.lit(0.0)))
    return _with_usd(x, token, asset)


def cumulative_all(per_model: DataFrame, portfolio_cum: DataFrame) -> DataFrame:
    """Per-model rows plus the portfolio rows tagged ``allmodels``."""
    return per_model.unionByName(portfolio_cum.withColumn(M, F.lit(ALL_MODELS)), allowMissingColumns=True)


def cumulative_at_once(by_date: DataFrame, ts_redated: DataFrame, token: DataFrame,
                       asset: str = TOKEN_COLUMN) -> DataFrame:
    """``cumulative_all`` over ``cumulative`` and ``cumulative_allmodels`` from one pass
    over the per-date rows (one row per model and date): grouping sets give each model's
    row and the portfolio's, one join brings the daily sums, one the token's price."""
    measures = ["totalpayout", "cumstake", "walletestimate", "NMRwtret", "totalpayoutdailychg"]
    x = (_complete(by_date)
         .groupingSets([[M, "date"], ["date"]], M, "date")
         .agg(*[F.sum(c).alias(c) for c in measures], (F.grouping_id() > 0).alias("_all")))
    daily = daily_aggregates(ts_redated).withColumn("_ts", F.lit(True))
    # a model has per-round rows if any of its dates has, be it a date of by_date or not
    model = Window.partitionBy(M, F.coalesce("_all", F.lit(False)))
    x = (x.join(daily.hint("merge"), [M, "date"], "full")
         .withColumn("_has", F.col(M).isNotNull() & F.coalesce(F.max("_ts").over(model), F.lit(False)))
         .where(F.col("_all").isNotNull()))
    whole, has, zero = F.col("_all"), F.col("_has"), F.lit(0.0)
    total = F.when(has, F.coalesce("ts_totalpayout", "totalpayout", zero)).otherwise(zero)
    change = F.when(has, F.coalesce("ts_totalpayoutdailychg", "totalpayoutdailychg", zero)).otherwise(zero)
    x = x.select(
        F.when(whole, ALL_MODELS).otherwise(F.col(M)).alias(M), "date",
        F.coalesce("cumstake", zero).alias("cumstake"), F.coalesce("walletestimate", zero).alias("walletestimate"),
        F.when(~whole, F.coalesce("NMRwtret", zero)).alias("NMRwtret"),
        F.when(~whole, total).alias("totalpayout"), F.when(~whole, change).alias("totalpayoutdailychg"),
        F.when(whole, zero).otherwise(F.coalesce(total + F.col("walletestimate"), zero)).alias("cumbalance"),
        F.when(whole, zero).otherwise(F.coalesce(total + F.col("cumstake"), zero)).alias("cumstakebalance"))
    return _with_usd(x, token, asset)
