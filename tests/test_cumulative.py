"""The cumulative table from one pass equals the two branches put together."""

from datetime import date

import pytest

from stakeperf.operators import cumulative as CU
from stakeperf.operators import portfolio as P
from stakeperf.plans import queries as QP
from tests import inspect_plans as inspect
from tests.compare import digest

BY_DATE = "model_name string, date date, totalpayout double, cumstake double, walletestimate double, NMRwtret double, totalpayoutdailychg double"
TS = "model_name string, date date, payoutPending double, dailypayout double"
D = [date(2024, 1, d) for d in range(1, 6)]

ROWS = [("a", D[0], 1.0, 10.0, 5.0, 0.1, None), ("a", D[1], 2.0, 11.0, None, 0.2, 1.0), ("b", D[0], None, None, 7.0, None, None),
        ("c", D[2], 3.0, 4.0, 5.0, 0.0, 6.0), ("allmodels", D[1], 1.0, 1.0, 1.0, 1.0, 1.0), (None, D[0], 9.0, 8.0, 7.0, 6.0, 5.0)]
#: c has rows on another date only, b has none.
DAYS = [("a", D[0], 3.0, 1.5), ("a", D[0], 4.0, None), ("a", D[1], None, None), ("c", D[4], 1.0, 1.0), ("allmodels", D[1], 2.0, 2.0), (None, D[0], 1.0, 1.0)]


@pytest.mark.parametrize("rows,days", [(ROWS, DAYS), (ROWS, []), ([], DAYS)])
def test_one_pass_equals_both_branches(spark, rows, days):
    by_date, ts = spark.createDataFrame(rows, BY_DATE), spark.createDataFrame(days, TS)
    token = spark.createDataFrame([(D[0], 2.0), (D[1], None), (D[4], 3.0)], "date date, NMR double")
    both = CU.cumulative_all(CU.cumulative(by_date, ts, token), CU.cumulative_allmodels(P.allmodels(by_date), token))
    once = CU.cumulative_at_once(by_date, ts, token)
    a, b = (digest(QP.CUM_COLS, [tuple(r) for r in df.select(*QP.CUM_COLS).collect()])[0] for df in (both, once))
    assert a == b


def test_at_most_three_scans(spark, sf_small):
    assert inspect.plan_summary(QP.q_cumulative_all(spark, sf_small))["scans"] <= 3
