"""Plan hygiene: no Python in any plan, pushed filters reach the scan, and
results do not depend on the number of shuffle partitions (which proves the
tie-breaks are total orders)."""

import pytest

from tests import inspect_plans as inspect
from stakeperf.plans import queries as QP
from tests.compare import digest

QUERIES = dict(QP.QUERIES)
WRITERS = {"filter_scores_documents", "scan_models", "sink_roundtrip_scores", "sink_roundtrip_cash"}


def plan_text(df) -> str:
    return inspect.plan_text(df, "simple")


def formatted(df) -> str:
    return inspect.plan_text(df, "formatted")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITERS))
def test_no_python_and_no_cartesian_in_plan(spark, sf_small, name):
    summary = inspect.plan_summary(QUERIES[name](spark, sf_small))
    assert summary["python"] == 0 and summary["cartesian"] == 0


def test_filters_reach_the_scan(spark, sf_small):
    # the ledger date range becomes a Parquet filter on the orders scan
    text = formatted(QP.q_asset_prices(spark, sf_small))
    assert "GreaterThanOrEqual(o_orderdate,1996-01-01T00:00)" in text
    assert "LessThan(o_orderdate,2000-01-01T00:00)" in text
    # the score fixture reads only the columns it uses (no `props`)
    scores = formatted(QP.q_clean_scores(spark, sf_small))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>" \
        in scores


@pytest.mark.parametrize("name", ["staked_daily", "staked_by_date", "bizday_by_date", "bizday_ts",
                                  "filter_scores_parity", "cumulative_all", "asset_balances"])
def test_results_independent_of_partitioning(spark, sf_small, name):
    out = []
    for parts in ("1", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        df = QUERIES[name](spark, sf_small)
        out.append(digest(df.columns, [tuple(r) for r in df.collect()])[0])
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert out[0] == out[1]


def test_ledger_range_reaches_every_scan(spark, sf_small):
    # the working frame only keeps dates of the ledger range, so every input
    # scan (prices, investments, fixed income, cash) gets the range pushed
    text = formatted(QP.q_working_frame(spark, sf_small))
    scans = inspect.scan_sections(QP.q_working_frame(spark, sf_small))
    assert len(scans) == 4
    for sec in scans:
        pushed = next(line for line in sec.splitlines() if line.startswith("PushedFilters"))
        assert "GreaterThanOrEqual(o_orderdate,1900-01-01" in pushed or "GreaterThanOrEqual(l_shipdate,1900-01-01" in pushed


# Single-partition exchanges are allowed only over bounded data:
#   cash_balance            the month totals of the blocked prefix sum
#   table_profile, run_summary   global aggregates (partial aggregation first)
#   nmr_prices and its users   the token's per-date price series
SINGLE_PARTITION_OK = {"cash_balance", "table_profile", "run_summary", "nmr_prices",
                       "allmodels_currency", "cumulative_by_model", "cumulative_missing_ts",
                       "cumulative_allmodels", "cumulative_all", "nmr_ledger"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WRITERS - SINGLE_PARTITION_OK))
def test_no_single_partition_exchange(spark, sf_small, name):
    assert "SinglePartition" not in plan_text(QUERIES[name](spark, sf_small))
