"""Write PLANS.md: the shape of every registered query's physical plan
(before AQE re-planning), from the public explain output."""

import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def main(sf_dir: str = "/root/testdata/sf0.01") -> None:
    from stakeperf.plans.queries import QUERIES
    from tests.inspect_plans import plan_summary
    from stakeperf.session import build_session

    spark = build_session("local[4]", 8)
    cols = ["exchanges", "scans", "windows", "broadcasts", "single_partition", "python", "cartesian"]
    lines = ["# Plan shapes", "",
             "Physical plans of every query as planned (before AQE's run-time changes),",
             f"of the first part over `{sf_dir}`; regenerate with `python tests/plan_table.py`.",
             "Writers (`scan_models`, `sink_*`, `investment_blotter`, `cash_balance`) are shown for",
             "the read-back or final plan.  `broadcasts` are only the explicit ones:",
             "sessions here never broadcast on estimates.", "",
             "| query | " + " | ".join(cols) + " |", "|" + " --- |" * (len(cols) + 1)]
    for name, fn in QUERIES.items():
        s = plan_summary(fn(spark, sf_dir))
        lines.append(f"| {name} | " + " | ".join(str(s[c]) for c in cols) + " |")
    with open(os.path.join(ROOT, "PLANS.md"), "w") as fh:
        fh.write("\n".join(lines) + "\n")
    spark.stop()


if __name__ == "__main__":
    main(*sys.argv[1:])
