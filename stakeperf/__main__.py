"""Command line: the source's three scripts as Spark jobs over files.

    python -m stakeperf ingest  --responses DIR --out DIR [--models FILE]
    python -m stakeperf staking --scores DIR --token-prices PATH --out DIR [--holidays FILE] [--start D] [--end D]
    python -m stakeperf ledger  --prices PATH --data-dir DIR --start D --end D --out DIR

Outputs are Parquet folders under ``--out`` (one per result table).  Paths
may be on any file system Spark can read; nothing is collected to the driver.
"""

from __future__ import annotations

import argparse
import sys
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from stakeperf.config import LedgerConfig
from stakeperf.operators import scores as S
from stakeperf.operators.calendar import BusinessDays
from stakeperf.plans.runs import LedgerRun, StakingRun
from stakeperf.session import build_session
from stakeperf.sources import files as IO

PRICES_SCHEMA = "date date, symbol string, price double"
CASH_SCHEMA = "date date, Principal double, Interest double, Adjustments double"


def _write(df: DataFrame, out: str, name: str) -> None:
    df.write.mode("overwrite").parquet(f"{out.rstrip('/')}/{name}")


def _prices(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith(".csv"):
        return IO.read_csv_typed(spark, path, PRICES_SCHEMA, fail_if_missing=True)
    return spark.read.parquet(path)


def ingest(spark: SparkSession, a: argparse.Namespace) -> None:
    """Stored responses -> per-model score files (+ run summary)."""
    records = IO.read_responses(spark, a.responses)
    rows = S.stringify_scores(S.filter_scores(S.flatten_scores(records)))
    IO.write_per_model(rows, f"{a.out.rstrip('/')}/staked", "csv")
    if a.models:
        registry = spark.read.option("header", True).csv(a.models)
        _write(S.run_summary(registry, records), a.out, "run_summary")
        _write(S.model_status(registry, rows), a.out, "model_status")


def staking(spark: SparkSession, a: argparse.Namespace) -> None:
    scores = IO.scan_models(spark, a.scores) if a.partitioned else IO.scan_model_files(spark, a.scores)
    calendar = None
    if a.holidays:
        # business days = weekdays minus the listed holidays
        calendar = BusinessDays.from_table(IO.read_csv_typed(spark, a.holidays, "date date", fail_if_missing=True))
    default = LedgerConfig()
    cfg = LedgerConfig(start=date.fromisoformat(a.start) if a.start else default.start,
                       end=date.fromisoformat(a.end) if a.end else date.max)
    run = StakingRun(scores, _prices(spark, a.token_prices), cfg, calendar=calendar,
                     shared=True, prefiltered=True)
    _write(run.ts, a.out, "stakedmodel_ts")
    _write(run.by_date_biz(), a.out, "stakedmodel_by_date")
    _write(run.currency(), a.out, "allmodels")
    _write(run.token(), a.out, "nmrprices")
    _write(run.cumulative(), a.out, "cumstakedmodel_by_date")


def ledger(spark: SparkSession, a: argparse.Namespace) -> None:
    cfg = LedgerConfig(start=date.fromisoformat(a.start), end=date.fromisoformat(a.end))
    base = a.data_dir.rstrip("/")
    inv, fi = IO.read_investment_data(spark, base, cfg.investments_file, cfg.fixedincome_file,
                                      a.investments_schema, a.fixedincome_schema)
    cash = IO.read_csv_typed(spark, f"{base}/{cfg.cashbalance_file}", CASH_SCHEMA, fail_if_missing=True)
    run = LedgerRun(_prices(spark, a.prices), inv, fi, cash, cfg, shared=True)
    run.persist(a.out)
    _write(run.ledger(), a.out, "workingdf")
    _write(run.token_ledger(), a.out, "NMRledger")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="stakeperf")
    sub = p.add_subparsers(dest="cmd", required=True)
    i = sub.add_parser("ingest")
    i.add_argument("--responses", required=True)
    i.add_argument("--out", required=True)
    i.add_argument("--models", help="CSV with a model_name column (expected models)")
    s = sub.add_parser("staking")
    s.add_argument("--scores", required=True, help="folder of <model>.csv (or model_name=<m>/ folders)")
    s.add_argument("--partitioned", action="store_true", help="scores are model_name=<m>/ folders")
    s.add_argument("--token-prices", required=True, help="Parquet or CSV: date, symbol, price")
    s.add_argument("--holidays", help="CSV with a date column: non-business weekdays")
    s.add_argument("--start", help="first token price date (default: the configured start)")
    s.add_argument("--end", help="last token price date (default: none, all later prices are used)")
    s.add_argument("--out", required=True)
    led = sub.add_parser("ledger")
    led.add_argument("--prices", required=True, help="Parquet or CSV: date, symbol, price")
    led.add_argument("--data-dir", required=True, help="folder with investments/fixedincome/cashbalance CSV")
    led.add_argument("--start", required=True)
    led.add_argument("--end", required=True)
    led.add_argument("--investments-schema", default="date date, GLDInv double, ETHInv double, NMRInv double")
    led.add_argument("--fixedincome-schema", default="date date, BondInv double")
    led.add_argument("--out", required=True)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or build_session()
    {"ingest": ingest, "staking": staking, "ledger": ledger}[a.cmd](spark, a)
    return 0


if __name__ == "__main__":
    sys.exit(main())
