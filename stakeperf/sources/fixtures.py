"""Fixtures: the reference's input shapes, derived from the test tables.

Each function reads parquet under ``sf_dir`` and returns a lazy DataFrame in
the schema the pipeline expects (see FIXTURES.md).  Money sums go through
``decimal(18,2)`` so every engine adds them exactly.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stakeperf.config import ASSET_CONFIG

# Order priority -> asset symbol of the price fixture.
PRIORITY_SYMBOL = {
    "1-URGENT": "GLD",
    "2-HIGH": "ETH-USD",
    "3-MEDIUM": "BTC-USD",
    "4-NOT SPECIFIED": "NMR-USD",
    "5-LOW": "SPXZ",
}
# Line return flag -> metric name of the nested fixture.
RETURNFLAG_METRIC = {"A": "mmc", "N": "fnc_v4", "R": "other"}
# Holidays of the calendar fixture.
HOLIDAYS = (date(2024, 1, 1), date(2024, 1, 15))
# The ledger fixtures' date range, wider than any order date, so
# that the ledger queries read whole tables; and a range that cuts, for the
# price source, whose feature it is.
LEDGER_START = date(1900, 1, 1)
LEDGER_END = date(2199, 12, 31)
PRICES_START = date(1996, 1, 1)
PRICES_END = date(1999, 12, 31)
N_MODELS = 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def money_sum(c: Column) -> Column:
    return F.sum(c.cast("decimal(18,2)")).cast("double")


def _model(key: Column) -> Column:
    return F.concat(F.lit("m"), (key % N_MODELS).cast("string"))


def fx_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1: flat score rows, one per event (text columns as in the per-model CSV)."""
    e = table(spark, sf_dir, "events")
    metric = (F.when(F.col("event_type") == "view", "mmc")
              .when(F.col("event_type") == "click", "fnc_v4")
              .otherwise(F.col("event_type")))
    return e.select(
        _model(F.col("user_id")).alias("model_name"),
        F.expr(f"user_id div {N_MODELS}").alias("roundNumber"),
        F.col("event_id").alias("seq"),
        metric.alias("displayName"),
        F.when(F.col("event_id") % 101 == 0, F.lit(None).cast("string"))
        .when(F.col("event_id") % 89 == 0, F.lit("n/a"))
        .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("date"),
        F.when(F.col("event_id") % 97 == 0, F.lit("")).otherwise(F.dayofmonth("ts").cast("string")).alias("day"),
        F.when(F.col("event_id") % 53 != 0, F.round(F.col("value") - 50, 2) + F.lit(0.0)).alias("payoutPending"),
        (F.col("event_id") % 37).cast("double").alias("atRisk"),
    )


def fx_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2: nested round records, ``intraRoundSubmissionScores`` as a sorted
    array of structs; orders without lines carry a NULL array.  Records come in
    descending round order (``rec_pos``); ``percentile`` has up to 17
    significant digits and ``value`` magnitudes from 1e-14 to 1e27."""
    o = table(spark, sf_dir, "orders")
    li = table(spark, sf_dir, "lineitem")
    metric = F.lit(None).cast("string")
    for flag, name in reversed(list(RETURNFLAG_METRIC.items())):
        metric = F.when(F.col("l_returnflag") == flag, name).otherwise(metric)
    sort_key = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice",
                "l_quantity", "l_discount", "l_tax", "l_returnflag"]
    score = F.struct(
        F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("date"),
        F.col("l_linenumber").alias("day"),
        metric.alias("displayName"),
        F.col("l_extendedprice").alias("payoutPending"),
        F.col("l_quantity").alias("payoutSettled"),
        (F.col("l_discount") / 7).alias("percentile"),
        F.when(F.col("l_linenumber") % 4 == 0, F.col("l_tax") * 1e-12)
        .when(F.col("l_linenumber") % 4 == 1, F.col("l_tax") * 1e28)
        .otherwise(F.col("l_tax") / 3).alias("value"),
    )
    # Lines are dealt by order once, as they are, and each order's array is sorted by
    # the full key; lines per order are few, so the array is bounded.  Lines without an
    # order key belong to no order.
    lines = li.where(F.col("l_orderkey").isNotNull()).select("l_orderkey", *sort_key).repartition("l_orderkey")
    per_order = (lines.withColumn("s", score)
                 .groupBy("l_orderkey")
                 .agg(F.sort_array(F.collect_list(F.struct(*sort_key, "s"))).alias("_lines"))
                 .select("l_orderkey", F.transform("_lines", lambda x: x["s"]).alias("intraRoundSubmissionScores")))
    # The arrays side grows with the line table: never broadcast it (a size
    # estimate of an aggregate is not a bound); sort-merge on the order key.
    return (o.join(per_order.hint("merge"), o.o_orderkey == per_order.l_orderkey, "left")
            .select(_model(F.col("o_custkey")).alias("model_name"),
                    F.col("o_orderkey").alias("roundNumber"),
                    (F.lit(1 << 40) - F.col("o_orderkey")).alias("rec_pos"),
                    F.col("o_totalprice").alias("atRisk"),
                    "intraRoundSubmissionScores"))


def fx_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """long price table (date, symbol, price) on the grid of order dates
    times the configured symbols; unpriced cells are NULL.

    One conditional aggregate per date (average order price per priority),
    then ``unpivot``: no join, so a date filter on the result reaches the
    orders scan."""
    o = table(spark, sf_dir, "orders")
    sym_of = {s: pri for pri, s in PRIORITY_SYMBOL.items()}

    def avg_of(pri):
        hit = F.col("o_orderpriority") == pri
        return F.try_divide(money_sum(F.when(hit, F.col("o_totalprice"))), F.count(F.when(hit, F.lit(1))))

    per_date = o.groupBy(F.to_date("o_orderdate").alias("date")).agg(
        *[(avg_of(sym_of[a.symbol]) if a.symbol in sym_of else F.lit(None).cast("double")).alias(a.symbol)
          for a in ASSET_CONFIG])
    return per_date.unpivot("date", [a.symbol for a in ASSET_CONFIG], "symbol", "price")


def fx_token_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """daily token price from purchase events, symbol ``NMR-USD``."""
    e = table(spark, sf_dir, "events")
    return (e.where(F.col("event_type") == "purchase")
            .groupBy(F.to_date("ts").alias("date"))
            .agg((money_sum(F.col("value")) / F.count(F.lit(1))).alias("price"),
                 F.max(F.when(F.col("event_type") == "purchase", F.lit("NMR-USD"))).alias("symbol"))
            .select("date", "symbol", "price"))


def fx_investments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """investment blotter, one column per invested asset."""
    o = table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "F")

    def inv(pri):
        return money_sum(F.when(F.col("o_orderpriority") == pri, F.col("o_totalprice")))

    return (o.groupBy(F.to_date("o_orderdate").alias("date"))
            .agg(inv("1-URGENT").alias("GLDInv"), inv("2-HIGH").alias("ETHInv"),
                 inv("4-NOT SPECIFIED").alias("NMRInv")))


def fx_fixedincome(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "A")
    return (li.groupBy(F.to_date("l_shipdate").alias("date"))
            .agg(money_sum(F.col("l_extendedprice")).alias("BondInv")))


def fx_cash(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "R")
    return (li.groupBy(F.to_date("l_shipdate").alias("date"))
            .agg(money_sum(F.col("l_extendedprice")).alias("Principal"),
                 money_sum(F.col("l_tax")).alias("Interest"),
                 (-money_sum(F.col("l_discount"))).alias("Adjustments")))


def fx_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model registry (name -> id): one model per customer key class plus
    ``m_none``, registered but without scores; the ids are made up."""
    c = table(spark, sf_dir, "customer")
    names = (c.select(_model(F.col("c_custkey")).alias("model_name"))
             .unionByName(spark.range(1).select(F.lit("m_none").alias("model_name")))
             .distinct())
    return names.select("model_name",
                        F.concat(F.lit("id-"), F.substring(F.md5("model_name"), 1, 12)).alias("model_id"))


def fx_holidays(spark: SparkSession) -> DataFrame:
    """holiday dates of the calendar fixture (configuration, two rows)."""
    return spark.createDataFrame([(d,) for d in HOLIDAYS], "date date")
