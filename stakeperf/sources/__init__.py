"""Typed scans, the stored-response source and the sinks."""

from stakeperf.sources.files import (  # noqa: F401
    persist,
    read_csv_typed,
    read_investment_data,
    read_nested_scores,
    read_responses,
    scan_model_files,
    scan_models,
    write_per_model,
)
