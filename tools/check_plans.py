"""Look for plan nodes that do not scale in every registered query.

    python tools/check_plans.py SF_DIR [name ...]

Prints cross and nested-loop joins, windows without partition keys, and row-at-a-time
Python nodes.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SIGNS = {
    "cross join": r"CartesianProduct",
    "nested loop join": r"BroadcastNestedLoopJoin",
    "one-task window": r"Window [^\n]*\n[^\n]*Sort [^\n]*\n[^\n]*Exchange SinglePartition",
    "row python": r"BatchEvalPython",
    "single partition": r"Exchange SinglePartition",
}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def main() -> None:
    from shelfmark.registry import QUERIES
    from shelfmark.session import get_session

    spark = get_session(cores="8")
    names = sys.argv[2:] or list(QUERIES)
    for name in names:
        plan = plan_of(QUERIES[name](spark, sys.argv[1]))
        found = [sign for sign, pattern in SIGNS.items() if re.search(pattern, plan, re.M)]
        if found:
            print(f"{name:26} {', '.join(found)}", flush=True)
    print(f"{len(names)} plans read")


if __name__ == "__main__":
    main()
