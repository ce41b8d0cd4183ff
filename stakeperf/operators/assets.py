"""Asset prices, returns, the zero grid and running asset balances.

Prices are kept long, ``(date, asset, price)``; wide frames appear only at
the edge (``to_wide``).  No task holds an asset's whole series: the lag works on
months, the running balance on blocks of dates.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stakeperf.config import ASSET_CONFIG, AssetSpec, active_assets
from stakeperf.functions.columns import as_number, safe_div, strip_suffix
from stakeperf.operators.windows import affine_scan, blocked_lag


def asset_prices(prices: DataFrame, start: date, end: date,
                 config: Sequence[AssetSpec] = ASSET_CONFIG) -> DataFrame:
    """The price source: active configured symbols within [start, end].
    The symbol list and the date range are literals, so both reach the
    Parquet scan as pushed filters.  ``asset`` is the symbol without its
    "-USD" suffix; ``priority`` is carried for ordering at the edge."""
    active = active_assets(tuple(config))
    prio = F.lit(None).cast("double")
    for a in active:
        prio = F.when(F.col("symbol") == a.symbol, F.lit(a.priority)).otherwise(prio)
    return (prices.where(F.col("symbol").isin([a.symbol for a in active])
                         & F.col("date").between(F.lit(start), F.lit(end)))
            .select("date", strip_suffix("symbol").alias("asset"), as_number("price").alias("price"),
                    prio.alias("priority")))


def drop_empty_series(prices: DataFrame) -> DataFrame:
    """Drop assets whose prices are all missing: a partial-aggregated list of
    the assets that have a price, and a semi join with it, so no task holds a
    whole series."""
    priced = prices.where(F.col("price").isNotNull()).select("asset").distinct()
    return prices.join(priced, "asset", "left_semi")


def asset_returns(prices: DataFrame) -> DataFrame:
    """Simple daily return per asset, ``price / previous price - 1``;
    missing -> 0 (first date, unpriced dates and the date after one).  The lag is
    blocked by month."""
    x = prices.select("date", "asset", "price", (F.year("date") * 12 + F.month("date")).alias("_month"), F.unix_date("date").cast("bigint").alias("_day"))
    x = blocked_lag(x, ["asset"], "_month", "_day", ["price"], 1 << 16)
    ret = safe_div(F.col("price"), F.col("_prev_price")) - F.lit(1.0)
    return x.select("date", "asset", F.coalesce(ret, F.lit(0.0)).alias("ret"))


def asset_values(prices: DataFrame, config: Sequence[AssetSpec] = ASSET_CONFIG) -> DataFrame:
    """Zero grid: every price date times every configured asset.  The asset
    list is configuration, so it is a literal array exploded per date: no
    join, no shuffle beyond the distinct dates."""
    names = [a.column for a in active_assets(tuple(config))]
    return (prices.select("date").distinct()
            .select("date", F.explode(F.array(*[F.lit(n) for n in names])).alias("asset"))
            .withColumn("value", F.lit(0.0)))


def asset_balances(returns: DataFrame, flows: DataFrame) -> DataFrame:
    """Running balance per asset: ``B_t = B_{t-1} * (1 + r_t) + inv_t``, ``B_0 = 0``.

    A day is the affine map ``B -> (1 + r) B + inv``; ``affine_scan`` composes the
    maps by blocks of dates, so no task holds a series, nothing is divided by a running
    product, and a return of -1 simply wipes the balance out.  ``flows`` is
    ``(date, asset, inv)``; missing flows are 0."""
    x = returns.join(flows, ["date", "asset"], "left")
    maps = x.select("asset", F.unix_date("date").alias("place"), (F.lit(1.0) + F.col("ret")).alias("a"), F.coalesce(F.col("inv"), F.lit(0.0)).alias("b"))
    return affine_scan(maps, ["asset"]).select(F.date_from_unix_date(F.col("place").cast("int")).alias("date"), "asset", F.col("after").alias("balance"))


def to_wide(long: DataFrame, names: Sequence[str], value: str, key: str = "asset",
            fill: float | None = None) -> DataFrame:
    """Pivot a long (date, key, value) frame to one column per name, with the
    names given so that no extra job is needed to find them."""
    wide = long.groupBy("date").pivot(key, list(names)).agg(F.first(value))
    if fill is not None:
        wide = wide.fillna(fill, subset=list(names))
    return wide
