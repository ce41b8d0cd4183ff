"""The fixtures reproduce the counts FIXTURES.md states for the test tables."""

import os

import pytest
from pyspark.sql import functions as F

from stakeperf.operators import scores as S
from stakeperf.sources import fixtures as FX

# sf: (priced cells, blotter dates, without fixed income, without investments,
#      score rows, kept by the metric filter, NULL date, blank day, NULL payout,
#      zero stake, ledger-range orders, ledger-range dates, NULL arrays, flattened rows)
EXPECTED = {
    "0.001": (1402, 1565, 194, 1119, 1000, 398, 10, 11, 19, 28, 60, 45, 27, 6027),
    "0.01": (8623, 2500, 1, 403, 10000, 3988, 100, 104, 189, 271, 540, 90, 257, 60257),
}


@pytest.mark.parametrize("sf", sorted(EXPECTED))
def test_fixture_counts(spark, sf):
    d = f"/root/testdata/sf{sf}"
    if not os.path.isdir(d):
        pytest.skip("test tables not present")
    px = FX.fx_prices(spark, d)
    j = (FX.fx_investments(spark, d).withColumn("i", F.lit(1))
         .join(FX.fx_fixedincome(spark, d).withColumn("f", F.lit(1)), "date", "full_outer"))
    sc = FX.fx_scores(spark, d)
    o = FX.table(spark, d, "orders").where("o_orderdate >= '1998-01-01' and o_orderdate < '1998-04-01'")
    n = FX.fx_nested(spark, d)
    got = (px.where("price is not null").count(), j.count(), j.where("f is null").count(),
           j.where("i is null").count(), sc.count(), S.filter_scores(sc).count(),
           sc.where("date is null").count(), sc.where("day = ''").count(),
           sc.where("payoutPending is null").count(), sc.where("atRisk = 0").count(),
           o.count(), o.select(F.to_date("o_orderdate")).distinct().count(),
           n.where("intraRoundSubmissionScores is null").count(), S.flatten_scores(n).count())
    assert got == EXPECTED[sf]


# sf: (models, (model, round) pairs, tied (model, round, day) groups after the
#      metric filter, (model, date) groups, of which on a weekend)
EXPECTED_SCORES = {"0.001": (15, 15, 99, 262, 71), "0.01": (21, 150, 994, 630, 168)}


@pytest.mark.parametrize("sf", sorted(EXPECTED_SCORES))
def test_score_fixture_groups(spark, sf):
    from stakeperf.functions.calendar import is_weekend
    from stakeperf.plans.queries import staking

    d = f"/root/testdata/sf{sf}"
    if not os.path.isdir(d):
        pytest.skip("test tables not present")
    sc = FX.fx_scores(spark, d)
    st = staking(spark, d)
    bd = st.by_date()
    got = (sc.select("model_name").distinct().count(), sc.select("model_name", "roundNumber").distinct().count(),
           st.scores.groupBy("model_name", "roundNumber", "day").count().where("count > 1").count(),
           bd.count(), bd.where(is_weekend("date")).count())
    assert got == EXPECTED_SCORES[sf]
