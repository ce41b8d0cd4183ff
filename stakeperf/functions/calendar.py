"""Weekend-only business-day arithmetic as closed-form Column expressions.

``dayofweek``: Sunday = 1 ... Saturday = 7.  Shifting by one business day is
"the first business day strictly after / before": Friday + 1 = Monday,
Saturday + 1 = Monday, Monday - 1 = Friday, Sunday - 1 = Friday.
No join, no window: these stay in the scan's code-generated stage.
For calendars with holidays see ``stakeperf.operators.calendar``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def is_weekend(d: Column | str) -> Column:
    return F.dayofweek(_c(d)).isin(1, 7)


def next_weekday(d: Column | str) -> Column:
    d = _c(d)
    step = F.when(F.dayofweek(d) == 6, 3).when(F.dayofweek(d) == 7, 2).otherwise(1)
    return F.date_add(d, step)


def prev_weekday(d: Column | str) -> Column:
    d = _c(d)
    step = F.when(F.dayofweek(d) == 2, 3).when(F.dayofweek(d) == 1, 2).otherwise(1)
    return F.date_sub(d, step)
