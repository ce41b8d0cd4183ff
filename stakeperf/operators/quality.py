"""Table checks: empty table, all-missing columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table_profile(df: DataFrame) -> DataFrame:
    """One row per column: rows in the table, non-missing values, and the
    two emptiness tests (``n_rows = 0``; ``n_values = 0``).  One aggregate
    pass over the table, then the single result row is unpivoted."""
    cols = df.columns
    aggs = [F.count(F.lit(1)).alias("_rows")] + [F.count(F.col(c)).alias(f"_v{i}") for i, c in enumerate(cols)]
    one = df.agg(*aggs)
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"_v{i}").alias("n_values"))
                      for i, c in enumerate(cols)])
    return (one.select(F.col("_rows").alias("n_rows"), F.explode(pairs).alias("_p"))
            .select(F.col("_p.column_name").alias("column_name"), "n_rows",
                    F.col("_p.n_values").alias("n_values"),
                    (F.col("n_rows") == 0).alias("table_is_empty"),
                    (F.col("_p.n_values") == 0).alias("is_empty_series")))
