"""stakeperf: staked-model performance and multi-asset cash ledgers on Spark.

Every operator is a lazy ``DataFrame -> DataFrame`` function built from
Spark's own windows, aggregates and joins.  Sub-packages:

* ``sources``   -- typed scans (CSV, nested JSON, price tables) and sinks
* ``functions`` -- Column-level helpers (safe division, R-style text, calendar)
* ``operators`` -- the relational / time-series operators of the pipeline
* ``plans``     -- whole query plans over the test tables and their SQL oracle
* ``streaming`` -- incremental ingest of stored score responses
"""

from stakeperf.config import ASSET_CONFIG, AssetSpec, LedgerConfig  # noqa: F401

__version__ = "0.1.0"
