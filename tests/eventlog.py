"""Per-stage task statistics from a Spark event log (the JSON lines Spark
writes when ``spark.eventLog.enabled`` is set), for checking that no task
carries a disproportionate share of the rows."""

from __future__ import annotations

import glob
import io
import json
import os
from collections import defaultdict


def _lines(path: str):
    """Lines of one event-log file; Spark 4 writes zstd-compressed files."""
    if path.endswith(".zstd"):
        import zstandard

        with open(path, "rb") as fh, zstandard.ZstdDecompressor().stream_reader(fh) as reader:
            yield from io.TextIOWrapper(reader, encoding="utf-8")
    elif path.endswith((".lz4", ".snappy", ".lzf")):
        raise ValueError(f"unsupported event-log codec: {path} (set spark.eventLog.compression.codec=zstd)")
    else:
        with open(path) as fh:
            yield from fh


def task_records(log_dir: str, shuffle_only: bool = True) -> dict[int, list[int]]:
    """Stage id -> records read by each task: shuffle reads (the measure of
    key skew), plus scan input when ``shuffle_only`` is False."""
    per_stage: dict[int, list[int]] = defaultdict(list)
    paths = [p for p in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True) if os.path.isfile(p)]
    for path in paths:
        for line in _lines(path):
            if '"SparkListenerTaskEnd"' not in line:
                continue
            ev = json.loads(line)
            m = ev.get("Task Metrics") or {}
            n = m.get("Shuffle Read Metrics", {}).get("Total Records Read", 0)
            if not shuffle_only:
                n += m.get("Input Metrics", {}).get("Records Read", 0)
            per_stage[ev["Stage ID"]].append(n)
    return dict(per_stage)


def max_task_share(log_dir: str) -> float:
    """Largest fraction of a stage's shuffled records read by one task, over
    the stages that read at least 1,000 records."""
    worst = 0.0
    for counts in task_records(log_dir).values():
        total = sum(counts)
        if total >= 1000:
            worst = max(worst, max(counts) / total)
    return worst


def max_task_records(log_dir: str) -> int:
    """The most shuffled records any single task read, over all stages."""
    return max((max(v) for v in task_records(log_dir).values() if v), default=0)

