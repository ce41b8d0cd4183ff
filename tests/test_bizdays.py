"""Shifts by any number of business days, against stepping day by day."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from stakeperf.operators import calendar as C
from stakeperf.operators import scores as S
from stakeperf.plans.queries import response_documents
from stakeperf.sources import files as IO
from tests import inspect_plans as inspect


def step(d, n, holidays):
    way = timedelta(1 if n > 0 else -1)
    for _ in range(abs(n)):
        d += way
        while d.weekday() > 4 or d in holidays:
            d += way
    return d


@pytest.mark.parametrize("count", [0, 1, 2, 40, 300])
def test_shift_steps_over_weekends_and_holidays(spark, count):
    rnd = random.Random(count)
    start = date(1969, 6, 1)
    holidays = {start + timedelta(rnd.randrange(1200)) for _ in range(count)}
    holidays |= {date(1970, 12, 24) + timedelta(k) for k in range(9)} if count > 2 else set()
    days = C.BusinessDays.from_table(spark.createDataFrame([(d,) for d in [*holidays, *holidays]] + [(None,)], "date date"))
    dates = spark.range(1200).select(F.date_add(F.lit(start), F.col("id").cast("int")).alias("date"))
    offsets = (1, -1, 2, -3, 17, -40)
    out = dates.select("date", *[days.shift("date", n).alias(f"s{i}") for i, n in enumerate(offsets)])
    for r in out.collect():
        assert r[1:] == tuple(step(r.date, n, holidays) for n in offsets), r
    plan = inspect.plan_text(C.shift_dates(dates, "date", days), "simple")
    assert "Join" not in plan and "Exchange" not in plan


def test_shift_edges(spark):
    days = C.BusinessDays.of([date(2024, 12, 25)])
    df = spark.createDataFrame([(None,), (date(9999, 12, 24),)], "date date")
    assert {r[0] for r in df.select(days.shift("date", 1)).collect()} == {None, date(9999, 12, 27)}
    with pytest.raises(ValueError):
        days.shift("date", 0)


def test_whole_documents_are_indexed_without_a_window(spark, sf_small):
    root = response_documents(spark, sf_small)
    plan = inspect.plan_text(S.filter_scores_parity(IO.read_response_scores(spark, root)), "simple")
    assert plan.count("FileScan json") == 1 and "Exchange" not in plan and "Window" not in plan
    exploded = S.score_row_index(S.flatten_scores(IO.read_responses(spark, root)))
    whole = IO.read_response_scores(spark, root).select(*exploded.columns)
    assert sorted(map(tuple, whole.collect()), key=repr) == sorted(map(tuple, exploded.collect()), key=repr)
