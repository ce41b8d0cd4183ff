"""Whole plans and plan tooling.

* ``runs``     -- StakingRun / LedgerRun: both halves end to end over user tables
* ``queries``  -- the query catalog over the test tables (driver contract)
* ``oracle``   -- the same computations as DuckDB SQL (correctness oracle)
* ``inspect``  -- plan shape from the public explain output
* ``eventlog`` -- per-task shuffle records from Spark's event log
"""
