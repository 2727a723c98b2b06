"""Command line: run the data sets of a workload file.

    python -m hopgrid workload.txt --runs 3 --strategy bitmask --strategy pruned --mode component --limit 1024
"""

from __future__ import annotations

import argparse
import sys

from hopgrid.plans.engine import MODES, STRATEGIES, run_workload, summary
from hopgrid.session import local_session


def main(argv: list[str] | None = None) -> int:
    """Prints a line per run and the summary; 1 if an answer differs from its reference."""
    ask = argparse.ArgumentParser(prog="hopgrid", description="closeness top-7 of the data sets in a workload file")
    ask.add_argument("workload", help="lines of: number of vertices, path of the edge file, expected answer")
    ask.add_argument("--runs", type=int, default=1)
    ask.add_argument("--strategy", action="append", choices=STRATEGIES, help="may be given several times (default: auto)")
    ask.add_argument("--mode", choices=MODES, default="component")
    ask.add_argument("--limit", type=int, help="search from so many sources only; answers aren't compared then")
    own = ask.parse_args(argv)
    spark = local_session("hopgrid")
    report = run_workload(spark, own.workload, own.runs, tuple(own.strategy or ["auto"]), own.mode, own.limit)
    for r in report:
        print("\t".join(f"{k}={v}" for k, v in r.items()))
    for r in summary(spark, report).orderBy("dataset", "mean_ms").collect():
        print(f"{r['dataset']}\t{r['strategy']}\truns={r['runs']}\tmean={r['mean_ms']}\tmin={r['min_ms']}\tfactor={r['factor']}\tcorrect={r['correct']}")
    return int(any(r["correct"] is False for r in report))


if __name__ == "__main__":
    sys.exit(main())
