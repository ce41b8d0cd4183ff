"""Incremental ingest of stored score responses (Structured Streaming)."""

from stakeperf.streaming.ingest import score_ingest_query  # noqa: F401
