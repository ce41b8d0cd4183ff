"""Task balance under a hot key, measured from Spark's own event log: a
third of all score rows sit in one (model, round, day).  With a plain window
one task reads at least that third; with the blocked operators no task reads
more than a small fraction of all rows."""

import os
import subprocess
import sys
import tempfile

import pytest

from tests.eventlog import max_task_records

APP = os.path.join(os.path.dirname(os.path.abspath(__file__)), "apps", "skew_app.py")
SF = "/root/testdata/sf0.01"


def run(mode: str) -> float:
    """Largest number of rows one task read, as a fraction of all rows."""
    log_dir = tempfile.mkdtemp(prefix="stakeperf-eventlog-")
    done = subprocess.run([sys.executable, APP, log_dir, mode, SF], check=True, timeout=600,
                          capture_output=True, text=True)
    rows = int(done.stdout.strip().splitlines()[-1])
    return max_task_records(log_dir) / rows


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_blocked_lag_spreads_a_hot_round():
    assert run("plain") > 0.3
    assert run("blocked") < 0.15


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_row_index_spreads_a_hot_model():
    assert run("index-plain") > 0.3
    assert run("index-blocked") < 0.15
