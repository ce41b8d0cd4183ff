"""Column-level helpers.  All of them return native Spark ``Column``s, so they
stay inside whole-stage code generation; none is a Python UDF."""

from stakeperf.functions.columns import (  # noqa: F401
    as_number,
    blank_to_null,
    coalesce_numeric,
    col_or,
    columns_like,
    date_of_text,
    edge_round,
    r_text,
    safe_div,
    strip_suffix,
)
from stakeperf.functions.calendar import (  # noqa: F401
    is_weekend,
    next_weekday,
    prev_weekday,
)
