"""Staking performance: per-round differences, per-date aggregates and the
business-day re-dating of the per-date rows.

Orderings (each ends in ``seq`` so that ties break the way the reference's
stable sorts break them -- by file order):

* inside a (model, round): ``day`` (NULL last), ``seq``;
* inside a (model, date): full date text, round, ``day``, ``seq``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stakeperf.functions.columns import date_of_text, safe_div
from stakeperf.operators.calendar import redate
from stakeperf.operators.windows import ranged_lag

M, RN = "model_name", "roundNumber"


def staked_daily(scores: DataFrame, seq_block: int | None = None) -> DataFrame:
    """Per-round metrics over cleaned score rows.

    returns        = payoutPending / atRisk
    dailypayout    = payoutPending on the first row of a round, else the
                     change from the previous row; missing -> 0
    stakeandpayout = atRisk + payoutPending
    dailyrets      = 0 on the first row, else the change of ``returns``;
                     missing -> 0

    Order inside a (model, round): ``day`` (NULL last), then ``seq``.  The
    lag runs over ranges of rows (``ranged_lag``), so even a round holding a large
    share of all rows is spread over tasks, of about ``seq_block`` rows if given.
    """
    p = F.col("payoutPending")
    x = scores.withColumn("returns", safe_div(p, F.col("atRisk")))
    x = ranged_lag(x, [M, RN], [F.col("day").isNull(), F.col("day"), F.col("seq")], ["payoutPending", "returns"], seq_block)
    first = F.col("_first")
    return (x.withColumn("dailypayout",
                         F.coalesce(F.when(first, p).otherwise(p - F.col("_prev_payoutPending")), F.lit(0.0)))
            .withColumn("stakeandpayout", F.col("atRisk") + p)
            .withColumn("dailyrets",
                        F.coalesce(F.when(first, F.lit(0.0))
                                   .otherwise(F.col("returns") - F.col("_prev_returns")), F.lit(0.0)))
            .drop("_first", "_prev_payoutPending", "_prev_returns"))


def _last_order() -> Column:
    """Order of "the last row" among per-round rows of one date: full date
    text, round, day with missing last, file order."""
    return F.struct(F.col("_full"), F.col(RN), F.col("day").isNull().alias("_day_missing"),
                    F.col("day"), F.col("seq"))


def daily_summary(ts: DataFrame) -> DataFrame:
    """One row per (model, date) over the per-round rows, holding everything
    later stages need from the raw rows:

    totalpayout    = sum(dailypayout)          (missing -> 0)
    cumstake       = sum(atRisk)               (missing -> 0)
    walletestimate = atRisk of the first row with the smallest ``day``;
                     NULL if any ``day`` of the date is missing
    NMRwtret       = stake-weighted sum of dailyrets, weights
                     stakeandpayout / sum(stakeandpayout); 0 unless that
                     sum is positive
    _last, _last_key = the date's last raw row and its ordering key, from
                     which the re-dated raw rows are derived (a last-of-last
                     is the last of the union, so no second pass over raw
                     rows is needed)

    Rows without a date, or with text that is no date, take no part
    (``scores.model_status`` counts the latter).

    A single aggregate with partial (map-side) aggregation: a model that
    holds most rows does not produce a hot task.
    """
    x = (ts.withColumn("_full", F.col("date"))
         .withColumn("date", date_of_text("date"))
         .where(F.col("date").isNotNull()))
    sp = F.col("stakeandpayout")
    first_order = F.struct(F.col("day"), F.col("_full"), F.col(RN), F.col("seq"))
    payload = [c for c in ts.columns if c not in (M, "date")] + ["_full"]
    return x.groupBy(M, "date").agg(
        F.coalesce(F.sum("dailypayout"), F.lit(0.0)).alias("totalpayout"),
        F.coalesce(F.sum("atRisk"), F.lit(0.0)).alias("cumstake"),
        F.when(F.count("day") == F.count(F.lit(1)), F.min_by("atRisk", first_order)).alias("walletestimate"),
        F.when(F.sum(sp) > 0,
               F.coalesce(F.sum(sp * F.col("dailyrets")), F.lit(0.0)) / F.sum(sp))
        .otherwise(F.lit(0.0)).alias("NMRwtret"),
        F.max_by(F.struct(*payload), _last_order()).alias("_last"),
        F.max(_last_order()).alias("_last_key"),
    )


def by_date_from_summary(summary: DataFrame) -> DataFrame:
    """The day-over-day change of ``totalpayout`` and the two returns."""
    w = Window.partitionBy(M).orderBy("date")
    chg = F.col("totalpayout") - F.lag("totalpayout").over(w)
    return (summary.select(M, "date", "totalpayout", "cumstake", "walletestimate", "NMRwtret")
            .withColumn("totalpayoutdailychg", chg)
            .withColumn("return", safe_div("totalpayoutdailychg", "cumstake"))
            .withColumn("leveredreturn", safe_div("totalpayoutdailychg", "walletestimate")))


def staked_by_date(ts: DataFrame) -> DataFrame:
    """Per (model, date) aggregates of the per-round rows (see
    ``daily_summary``), then the day-over-day change and the returns."""
    return by_date_from_summary(daily_summary(ts))


def bizday_by_date(by_date: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """Re-date per-date rows to business days and keep, per new date, the
    row whose original date is latest.  A date the calendar cannot shift
    falls back to the original date minus one calendar day.  The changes
    computed before re-dating are kept as they are (not recomputed)."""
    shifted = (redate(by_date, "date", "_new", calendar)
               .withColumn("_new", F.coalesce(F.col("_new"), F.date_sub("date", 1))))
    payload = [c for c in by_date.columns if c not in (M, "date")]
    kept = (shifted.groupBy(M, "_new")
            .agg(F.max_by(F.struct(*payload), F.col("date")).alias("_row")))
    return kept.select(M, F.col("_new").alias("date"), *[F.col("_row")[c].alias(c) for c in payload])
