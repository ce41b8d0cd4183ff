"""Portfolio roll-up across models and the token-currency adjustment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stakeperf.config import TOKEN_COLUMN
from stakeperf.functions.columns import safe_div


def allmodels(by_date: DataFrame) -> DataFrame:
    """Sum four measures over all models per date (missing -> 0) and derive
    the portfolio returns.  Partial aggregation runs before the shuffle, so
    a model holding most rows does not make a hot task."""
    def s(c):
        return F.coalesce(F.sum(c), F.lit(0.0)).alias(c)

    return (by_date.groupBy("date")
            .agg(s("totalpayout"), s("cumstake"), s("walletestimate"), s("totalpayoutdailychg"))
            .withColumn("return", safe_div("totalpayoutdailychg", "cumstake"))
            .withColumn("leveredreturn", safe_div("totalpayoutdailychg", "walletestimate")))


def token_prices(prices: DataFrame, asset: str = TOKEN_COLUMN) -> DataFrame:
    """``(date, price)`` of one asset from a long (date, asset, price) table."""
    return prices.where(F.col("asset") == asset).select("date", "asset", "price")


def nmr_prices(prices: DataFrame, portfolio: DataFrame, asset: str = TOKEN_COLUMN) -> DataFrame:
    """Token price and its return on the portfolio's dates only: the semi
    join runs first, so the return is taken between consecutive *matched*
    dates.  Missing return -> 0."""
    px = token_prices(prices, asset).join(portfolio.select("date"), "date", "left_semi")
    w = Window.partitionBy("asset").orderBy("date")
    ret = safe_div(F.col("price"), F.lag("price").over(w)) - F.lit(1.0)
    return px.select("date", F.col("price").alias(asset), F.coalesce(ret, F.lit(0.0)).alias(asset + "return"))


def allmodels_currency(portfolio: DataFrame, token: DataFrame, asset: str = TOKEN_COLUMN) -> DataFrame:
    """Add the token price, its return and the currency-adjusted returns
    (NULL where the token has no price that day)."""
    r = F.col(asset + "return")
    return (portfolio.join(token, "date", "left")
            .withColumn("return_currency", F.col("return") + r)
            .withColumn("leveredreturn_currency", F.col("leveredreturn") + r))
