"""Plan audit: for each registered query, the executed plan's scans, exchanges,
single-partition exchanges (and what feeds them), broadcasts and Python stages.

usage: python tests/plan_audit.py [sf_dir] [key ...]
"""
from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def audit(df) -> dict:
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    single = []
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            nxt = " | ".join(x.strip()[:70] for x in lines[i + 1:i + 3])
            single.append(nxt)
    return {
        "scans": plan.count("FileScan"),
        "exchanges": len(re.findall(r"Exchange (hash|range|RoundRobin|Single)", plan)),
        "single_partition": single,
        "broadcasts": plan.count("BroadcastExchange"),
        "python": plan.count("ArrowEvalPython") + plan.count("MapInPandas") + plan.count("BatchEvalPython"),
        "window_group_limit": plan.count("WindowGroupLimit"),
    }


def main(argv):
    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    import __spark_entry__ as E
    from textlab.session import get_session
    spark = get_session("local[8]")
    qs = E.queries()
    for k in (argv[2:] or sorted(qs)):
        try:
            a = audit(qs[k](spark, sf))
            print(k, a, flush=True)
        except Exception as e:
            print(k, "ERR", str(e)[:200], flush=True)


if __name__ == "__main__":
    main(sys.argv)
