"""Plan inspection through the public ``DataFrame.explain`` output.

``plan_summary`` counts what matters for scale in a physical plan: shuffles,
reused shuffles, broadcasts, scans, windows, Python evaluation and
single-partition exchanges -- the checks we run after every operator.
"""

from __future__ import annotations

import contextlib
import io
import re

from pyspark.sql import DataFrame


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode=mode)
    return buf.getvalue()


def scan_sections(df: DataFrame) -> list[str]:
    """The ``(n) Scan parquet`` sections of the formatted plan."""
    return [sec for sec in plan_text(df).split("\n\n") if re.match(r"\s*\(\d+\) Scan ", sec)]


def plan_summary(df: DataFrame) -> dict[str, int]:
    text = plan_text(df, "simple")
    return {
        "exchanges": len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", text)),
        "single_partition": text.count("SinglePartition"),
        "broadcasts": text.count("BroadcastExchange"),
        "reused": text.count("ReusedExchange"),
        "scans": text.count("FileScan") + text.count("Scan ExistingRDD"),
        "windows": len(re.findall(r"\bWindow \[", text)),
        "python": text.count("BatchEvalPython") + text.count("ArrowEvalPython") + text.count("FlatMapGroupsInPandas"),
        "cartesian": text.count("CartesianProduct") + text.count("BroadcastNestedLoopJoin"),
    }
