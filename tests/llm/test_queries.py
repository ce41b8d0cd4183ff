"""The registered queries: SQL parity where there is SQL, and where the part ends."""

import os
import re

import pytest

from stakeperf.llm import urls
from stakeperf.llm.queries import ORACLE_SQL, QUERIES
from tests.compare import compare, duck

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(sp, sf_small, name):
    ok, ns, nd, detail = compare(sp, name, QUERIES[name], ORACLE_SQL[name], sf_small, duck(sf_small))
    assert ok, f"{name}: spark={ns} duck={nd} {detail}"


def test_nothing_else_imports_this_part():
    for folder, _, files in os.walk(os.path.join(ROOT, "stakeperf")):
        if os.path.basename(folder) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                with open(os.path.join(folder, f), encoding="utf-8") as text:
                    assert not re.search(r"^\s*(from|import) stakeperf\.llm", text.read(), re.MULTILINE), f


def test_url_filter_runs_no_python(sp, sf_small, monkeypatch):
    monkeypatch.setattr(urls, "written", lambda df, name: df)  # all stages in one plan
    plan = QUERIES["op6_bloom_url_filter"](sp, sf_small)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert "BroadcastHashJoin" in plan and "ShuffledHashJoin" in plan
