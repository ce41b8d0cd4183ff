"""The query catalog: one plan per operator of the inventory.

Each entry takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
test tables at ``sf_dir``.  The staking and ledger queries are outputs of
``plans.runs.StakingRun`` / ``LedgerRun`` built over the fixtures, so a query
for a late stage is literally the plan of the earlier stages plus its own
step.  Doubles are rounded only at the very end (``_out``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from stakeperf.config import LedgerConfig
from stakeperf.functions.columns import edge_round
from stakeperf.operators import assets as A
from stakeperf.operators import calendar as C
from stakeperf.operators import cumulative as CU
from stakeperf.operators import ledger as L
from stakeperf.operators import quality as Q
from stakeperf.operators import scores as S
from stakeperf.plans.runs import LedgerRun, StakingRun
from stakeperf.session import scratch_path, stage
from stakeperf.sources import fixtures as FX
from stakeperf.sources import files as IO

Query = Callable[[SparkSession, str], DataFrame]

LEDGER = LedgerConfig(start=FX.LEDGER_START, end=FX.LEDGER_END)   # ledger half (fixture F3 range)
STAKING = LedgerConfig()                                           # staking half: the reference's range
ASSET_NAMES = LEDGER.asset_columns

SCORE_COLS = ["model_name", "roundNumber", "atRisk", "seq", "date", "day", "displayName",
              "payoutPending", "payoutSettled", "percentile", "value"]
CLEAN_COLS = ["model_name", "roundNumber", "seq", "displayName", "date", "day", "payoutPending", "atRisk"]
TS_COLS = CLEAN_COLS + ["returns", "dailypayout", "stakeandpayout", "dailyrets"]
BY_DATE_COLS = ["model_name", "date", "totalpayout", "cumstake", "walletestimate", "NMRwtret",
                "totalpayoutdailychg", "return", "leveredreturn"]
CUM_COLS = ["model_name", "date", "totalpayout", "cumstake", "walletestimate", "NMRwtret",
            "totalpayoutdailychg", "cumbalance", "cumstakebalance", "NMR", "cumUSD", "cumstakeUSD"]
CUM_ALL_COLS = ["date", "cumstake", "walletestimate", "cumbalance", "cumstakebalance", "NMR",
                "cumUSD", "cumstakeUSD"]


# Pass-through source doubles (money with two decimals, integral values).
RAW_SCORE = ("atRisk", "payoutPending", "payoutSettled", "percentile", "value")
RAW_CLEAN = ("day", "payoutPending", "atRisk")


def _out(df: DataFrame, cols: list[str], raw: tuple[str, ...] = ()) -> DataFrame:
    """Final projection; computed doubles are rounded to nine significant
    digits (``edge_round``).  ``raw`` names pass-through source values, which
    stay as they are."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*[edge_round(c).alias(c) if isinstance(types[c], DoubleType) and c not in raw
                       else F.col(c) for c in cols])


# ---------------------------------------------------------------- stages

def staking(spark, sf, shared: bool = False) -> StakingRun:
    """The staking half over fixtures F1 (scores) and F4 (token prices)."""
    return StakingRun(FX.fx_scores(spark, sf), FX.fx_token_prices(spark, sf), STAKING, shared=shared)


def ledger(spark, sf, shared: bool = False) -> LedgerRun:
    """The ledger half over fixtures F3 (prices) and F5 (blotter, cash)."""
    return LedgerRun(FX.fx_prices(spark, sf), FX.fx_investments(spark, sf), FX.fx_fixedincome(spark, sf),
                     FX.fx_cash(spark, sf), LEDGER, shared=shared)


# ---------------------------------------------------------------- queries

def q_scan_models(spark, sf):
    root = scratch_path(spark, "staked")
    IO.write_per_model(FX.fx_scores(spark, sf), root, "csv")
    return IO.scan_models(spark, root).select(*CLEAN_COLS)


#: Models whose files lack ``displayName`` in ``mixed_score_files``.
UNNAMED = "[369]$"


def mixed_score_files(spark, sf, rows: DataFrame) -> str:
    """Rows of fixture F1 as the source's files: one per model, rows in file order
    without ``seq``.  Of the models a third have no ``displayName`` column, and half of
    the rest prefixed columns in another order."""
    root = scratch_path(spark, "mixed")
    rows = rows.repartition("model_name").sortWithinPartitions("model_name", "seq")
    plain = ["roundNumber", "displayName", "date", "day", "payoutPending", "atRisk"]
    unnamed, odd = F.col("model_name").rlike(UNNAMED), F.crc32("model_name") % 2 == 1
    prefixed = ["atRisk", "payoutPending", "day", "displayName", "date", "roundNumber"]
    names = [F.col(c).alias(c if c in ("atRisk", "roundNumber") else S.SCORE_PREFIX + c) for c in prefixed]
    layouts = [(~unnamed & ~odd, plain), (~unnamed & odd, names), (unnamed, [c for c in plain if c != "displayName"])]
    for which, columns in layouts:
        rows.where(which).select("model_name", *columns).write.mode("append").partitionBy("model_name").option("header", True).csv(root)
    return root


FILE_COLS = [c for c in CLEAN_COLS if c != "seq"]


def q_scan_model_files(spark, sf):
    """Each file by its own header."""
    return IO.scan_models(spark, mixed_score_files(spark, sf, FX.fx_scores(spark, sf))).select(*FILE_COLS)


def q_staked_daily_files(spark, sf):
    """The per-round rows over files of filtered scores, as the source writes them; the
    staking half asks for no ``displayName``, and ties break by the rows' order in their file."""
    root = mixed_score_files(spark, sf, S.filter_scores(FX.fx_scores(spark, sf)))
    run = StakingRun(IO.scan_models(spark, root), FX.fx_token_prices(spark, sf), STAKING, prefiltered=True)
    return _out(run.ts, [c for c in TS_COLS if c != "seq"], RAW_CLEAN)


#: A document's records are numbered in blocks of 4,096 places, which is what a window holds.
DOCUMENT_BLOCK_BITS = 12


def response_documents(spark, sf) -> str:
    """Fixture F2 as stored response documents, one per model, compressed.  The records are
    built and stored before they are dealt by document, so the disk never holds the shuffles of both.
    A document's records are sorted, which spills, and written as its lines in turn, so no task
    holds a document.  The sort asked for is the window's own, so the records are sorted once;
    the window goes by blocks of a document, of which the first and the last are looked up."""
    root = scratch_path(spark, "responses")
    document = F.coalesce(F.concat("model_name", F.lit(".json")), F.lit("__HIVE_DEFAULT_PARTITION__"))
    keys = ["rec_pos", "roundNumber", "atRisk", S.SCORES]
    with stage(FX.fx_nested(spark, sf).select(document.alias("document"), *keys)) as stored:
        block = F.shiftright("rec_pos", DOCUMENT_BLOCK_BITS)
        # a record without a place comes first, in a block of its own
        ends = stored.groupBy("document").agg(
            F.when(F.count("rec_pos") == F.count(F.lit(1)), F.min(block)).alias("first_block"), F.max(block).alias("last_block"))
        order = Window.partitionBy("document", "block").orderBy(*keys)
        records = (stored.repartition("document").withColumn("block", block)
                   .withColumn("n", F.row_number().over(order)).withColumn("more", F.lead(F.lit(True), 1, False).over(order))
                   .sortWithinPartitions("document", "block", *keys).join(F.broadcast(ends), "document"))
        first = (F.col("n") == 1) & F.col("block").eqNullSafe(F.col("first_block"))
        last = ~F.col("more") & F.col("block").eqNullSafe(F.col("last_block"))
        begin = F.when(first, F.lit('{"data":{"v2RoundModelPerformances":[')).otherwise(F.lit(""))
        end = F.when(last, F.lit("]}}")).otherwise(F.lit(","))
        lines = records.select("document", F.concat(begin, F.to_json(F.struct("roundNumber", "atRisk", S.SCORES)), end).alias("value"))
        lines.write.partitionBy("document").option("compression", "gzip").text(root)
    return root


def q_read_responses(spark, sf):
    """Stored response documents, read back with each record's position in its document."""
    return _out(S.flatten_scores(IO.read_responses(spark, response_documents(spark, sf))), [*SCORE_COLS, "rec_pos"], RAW_SCORE)


def q_asset_prices(spark, sf):
    run = LedgerRun(FX.fx_prices(spark, sf), FX.fx_investments(spark, sf), FX.fx_fixedincome(spark, sf),
                    FX.fx_cash(spark, sf), LedgerConfig(start=FX.PRICES_START, end=FX.PRICES_END))
    return _out(run.prices, ["date", "asset", "price"])


def q_drop_empty_series(spark, sf):
    return _out(ledger(spark, sf).live_prices(), ["date", "asset", "price"])


def q_asset_returns(spark, sf):
    return _out(ledger(spark, sf).returns(), ["date", "asset", "ret"])


def q_asset_values(spark, sf):
    return _out(ledger(spark, sf).asset_values(), ["date", "asset", "value"])


def q_asset_balances(spark, sf):
    return _out(ledger(spark, sf).balances(), ["date", "asset", "balance"])


INVESTMENTS_SCHEMA = "date date, GLDInv double, ETHInv double, NMRInv double"
FIXEDINCOME_SCHEMA = "date date, BondInv double"


def q_investment_blotter(spark, sf):
    """The blotter as the source reads it: two CSV files in a data folder
    (here written from fixture F5), scanned with explicit schemas."""
    datadir = scratch_path(spark, "data")
    for name, df in ((LEDGER.investments_file, FX.fx_investments(spark, sf)),
                     (LEDGER.fixedincome_file, FX.fx_fixedincome(spark, sf))):
        df.write.mode("overwrite").option("header", True).csv(f"{datadir}/{name}")
    inv, fi = IO.read_investment_data(spark, datadir, LEDGER.investments_file, LEDGER.fixedincome_file,
                                      INVESTMENTS_SCHEMA, FIXEDINCOME_SCHEMA)
    cols = ["date", "GLDInv", "ETHInv", "NMRInv", "BondInv"]
    return _out(L.investment_blotter(inv, fi), cols, tuple(cols))


WORKING_COLS = ["date", *ASSET_NAMES, "GLDInv", "ETHInv", "NMRInv", "BondInv", "Principal", "Interest", "Adjustments"]


def q_working_frame(spark, sf):
    return _out(ledger(spark, sf).working_frame(), WORKING_COLS, tuple(WORKING_COLS))


CASH_SCHEMA = "date date, Principal double, Interest double, Adjustments double"


def q_cash_balance(spark, sf):
    """The cash input read as the source reads it: ``cashbalance.csv`` in the
    data folder (here written from fixture F5), typed, and required."""
    datadir = scratch_path(spark, "data")
    FX.fx_cash(spark, sf).write.mode("overwrite").option("header", True).csv(f"{datadir}/{LEDGER.cashbalance_file}")
    cash = IO.read_csv_typed(spark, f"{datadir}/{LEDGER.cashbalance_file}", CASH_SCHEMA, fail_if_missing=True)
    # the blocked running sum reads the (per-date) working frame twice, so
    # the frame is materialized once instead of re-scanning its four inputs
    run = LedgerRun(FX.fx_prices(spark, sf), FX.fx_investments(spark, sf), FX.fx_fixedincome(spark, sf),
                    cash, LEDGER, shared=True)
    return _out(run.cash_balance(), ["date", "cashbalance"])


def q_nmr_ledger(spark, sf):
    # the working frame feeds flows, the frame itself and the cash balance
    led = ledger(spark, sf, shared=True).token_ledger()
    return _out(led, ["date", "NMR", "NMRInv"], ("NMRInv",))


def q_table_profile(spark, sf):
    wide = A.to_wide(ledger(spark, sf).prices, ASSET_NAMES, "price")
    return Q.table_profile(wide.select("date", *ASSET_NAMES))


def q_flatten_scores(spark, sf):
    return _out(S.flatten_scores(FX.fx_nested(spark, sf)), SCORE_COLS, RAW_SCORE)


def q_null_scores_default(spark, sf):
    return _out(S.null_scores_default(FX.fx_nested(spark, sf)), SCORE_COLS, RAW_SCORE)


def q_filter_scores(spark, sf):
    return _out(S.filter_scores(S.flatten_scores(FX.fx_nested(spark, sf))), SCORE_COLS, RAW_SCORE)


def q_filter_scores_parity(spark, sf):
    return _out(S.filter_scores_parity(S.flatten_scores(FX.fx_nested(spark, sf))), SCORE_COLS, RAW_SCORE)


def stringify_stage(spark, sf):
    return S.stringify_scores(S.filter_scores(S.flatten_scores(FX.fx_nested(spark, sf))))


def q_filter_scores_documents(spark, sf):
    """The positional filter over response documents that come whole: the row index is
    the place in the document, so there is no window and one scan."""
    root = response_documents(spark, sf)
    return _out(S.filter_scores_parity(IO.read_response_scores(spark, root)), [*SCORE_COLS, "rec_pos"], RAW_SCORE)


def q_stringify_scores(spark, sf):
    return _out(stringify_stage(spark, sf), SCORE_COLS, RAW_SCORE)


def q_round_numbers(spark, sf):
    return S.round_numbers(FX.fx_nested(spark, sf))


def q_model_ids(spark, sf):
    return S.model_ids(FX.fx_nested(spark, sf), FX.fx_models(spark, sf)).select("model_name", "model_id")


def q_run_summary(spark, sf):
    return S.run_summary(FX.fx_models(spark, sf), FX.fx_nested(spark, sf))


def q_model_status(spark, sf):
    return S.model_status(FX.fx_models(spark, sf), FX.fx_scores(spark, sf))


def q_rejected_cells(spark, sf):
    """The cells that ``model_status`` counts."""
    return S.rejected_cells(FX.fx_scores(spark, sf))


def q_clean_scores(spark, sf):
    return _out(staking(spark, sf).scores, CLEAN_COLS, RAW_CLEAN)


def q_staked_daily(spark, sf):
    return _out(staking(spark, sf).ts, TS_COLS, RAW_CLEAN)


def q_staked_by_date(spark, sf):
    return _out(staking(spark, sf).by_date(), BY_DATE_COLS)


def q_weekend_flags(spark, sf):
    return C.weekend_flags(staking(spark, sf).by_date(), ["model_name"]).select("model_name", "date", "is_weekend")


def q_bizday_shift(spark, sf):
    dates = FX.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    return C.shift_dates(dates).select("date", "is_weekend", "next_biz", "prev_biz")


def q_bizday_shift_holidays(spark, sf):
    dates = FX.table(spark, sf, "events").select(F.to_date("ts").alias("date")).distinct()
    return C.shift_dates(dates, "date", C.BusinessDays.from_table(FX.fx_holidays(spark))).select("date", "is_weekend", "next_biz", "prev_biz")


def q_bizday_offsets(spark, sf):
    """Every event date moved by several business days at once, past weekends and holidays."""
    days = C.BusinessDays.from_table(FX.fx_holidays(spark))
    dates = FX.table(spark, sf, "events").select(F.to_date("ts").alias("date")).distinct()
    return dates.select("date", *[days.shift("date", n).alias(name) for n, name in ((-21, "back_21"), (-2, "back_2"), (5, "on_5"), (64, "on_64"))])


def q_bizday_by_date(spark, sf):
    return _out(staking(spark, sf).by_date_biz(), BY_DATE_COLS)


def q_bizday_ts(spark, sf):
    return _out(staking(spark, sf).ts_biz(), TS_COLS, RAW_CLEAN)


PORTFOLIO_COLS = ["date", "totalpayout", "cumstake", "walletestimate", "totalpayoutdailychg", "return", "leveredreturn"]


def q_allmodels(spark, sf):
    return _out(staking(spark, sf).portfolio(), PORTFOLIO_COLS)


def q_nmr_prices(spark, sf):
    return _out(staking(spark, sf).token(), ["date", "NMR", "NMRreturn"])


def q_allmodels_currency(spark, sf):
    return _out(staking(spark, sf, shared=True).currency(),
                PORTFOLIO_COLS + ["NMR", "NMRreturn", "return_currency", "leveredreturn_currency"])


def q_daily_aggregates(spark, sf):
    return _out(CU.daily_aggregates(staking(spark, sf).ts_biz()),
                ["model_name", "date", "ts_totalpayout", "ts_totalpayoutdailychg"])


def q_cumulative_by_model(spark, sf):
    return _out(staking(spark, sf, shared=True).cumulative_models(), CUM_COLS)


def q_cumulative_missing_ts(spark, sf):
    st = staking(spark, sf, shared=True)
    return _out(CU.cumulative_missing_ts(st.by_date_biz(), st.token()), CUM_COLS)


def q_cumulative_default_columns(spark, sf):
    """Per-model balances where the per-date rows lack some columns: 0 takes their place."""
    st = staking(spark, sf, shared=True)
    rows = st.by_date_biz().drop("walletestimate", "NMRwtret", "totalpayout")
    return _out(CU.cumulative_missing_ts(rows, st.token()), CUM_COLS)


def q_cumulative_allmodels(spark, sf):
    return _out(staking(spark, sf, shared=True).cumulative_portfolio(), CUM_ALL_COLS)


def q_cumulative_all(spark, sf):
    return _out(staking(spark, sf, shared=True).cumulative(), CUM_COLS)


def q_sink_roundtrip_scores(spark, sf):
    root = scratch_path(spark, "scores-csv")
    IO.write_per_model(stringify_stage(spark, sf), root, "csv")
    back = spark.read.option("header", True).option("basePath", root).option("emptyValue", "").csv(root)
    # an empty cell is NULL in the file and "" in the source's text
    return back.select("model_name", *[F.coalesce(F.col(c), F.lit("")).alias(c) if c in S.TEXT_FIELDS else F.col(c)
                                       for c in SCORE_COLS if c != "model_name"])


def q_sink_roundtrip_cash(spark, sf):
    path = scratch_path(spark, "cash-balance")
    ok = IO.persist(ledger(spark, sf, shared=True).cash_balance(), path, "cash balance")
    if not ok:
        raise RuntimeError("cash balance sink failed")
    return _out(spark.read.parquet(path), ["date", "cashbalance"])


QUERIES: dict[str, Query] = {
    "scan_models": q_scan_models,
    "scan_model_files": q_scan_model_files,
    "staked_daily_files": q_staked_daily_files,
    "read_responses": q_read_responses,
    "model_status": q_model_status,
    "rejected_cells": q_rejected_cells,
    "cumulative_default_columns": q_cumulative_default_columns,
    "asset_prices": q_asset_prices,
    "drop_empty_series": q_drop_empty_series,
    "asset_returns": q_asset_returns,
    "asset_values": q_asset_values,
    "asset_balances": q_asset_balances,
    "investment_blotter": q_investment_blotter,
    "working_frame": q_working_frame,
    "cash_balance": q_cash_balance,
    "nmr_ledger": q_nmr_ledger,
    "table_profile": q_table_profile,
    "flatten_scores": q_flatten_scores,
    "null_scores_default": q_null_scores_default,
    "filter_scores": q_filter_scores,
    "filter_scores_parity": q_filter_scores_parity,
    "filter_scores_documents": q_filter_scores_documents,
    "stringify_scores": q_stringify_scores,
    "round_numbers": q_round_numbers,
    "model_ids": q_model_ids,
    "run_summary": q_run_summary,
    "clean_scores": q_clean_scores,
    "staked_daily": q_staked_daily,
    "staked_by_date": q_staked_by_date,
    "weekend_flags": q_weekend_flags,
    "bizday_shift": q_bizday_shift,
    "bizday_shift_holidays": q_bizday_shift_holidays,
    "bizday_offsets": q_bizday_offsets,
    "bizday_by_date": q_bizday_by_date,
    "bizday_ts": q_bizday_ts,
    "allmodels": q_allmodels,
    "nmr_prices": q_nmr_prices,
    "allmodels_currency": q_allmodels_currency,
    "daily_aggregates": q_daily_aggregates,
    "cumulative_by_model": q_cumulative_by_model,
    "cumulative_missing_ts": q_cumulative_missing_ts,
    "cumulative_allmodels": q_cumulative_allmodels,
    "cumulative_all": q_cumulative_all,
    "sink_roundtrip_scores": q_sink_roundtrip_scores,
    "sink_roundtrip_cash": q_sink_roundtrip_cash,
}

