"""Execute catalogue queries and print their final (adaptive) physical plans.

Usage: python tools/show_plans.py [sf_dir] query [query ...]   ('flagship' = entry pipeline)
Prints a one-line operator census per query, then ``explain('formatted')``.
"""

from __future__ import annotations

import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from seqtok.plans.catalogue import QUERIES, events_windows  # noqa: E402
from seqtok.session import local_session  # noqa: E402

CENSUS = ["Exchange SinglePartition", "Exchange hashpartitioning", "Exchange rangepartitioning",
          "Exchange RoundRobinPartitioning", "BroadcastExchange", "ReusedExchange",
          "BroadcastHashJoin", "SortMergeJoin", "BroadcastNestedLoopJoin", "CartesianProduct",
          "Window", "Generate", "HashAggregate", "ObjectHashAggregate", "WholeStageCodegen",
          "EvalPython"]


def main() -> None:
    args = sys.argv[1:]
    sf = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.1"
    spark = local_session()
    for name in args:
        df = events_windows(spark, sf) if name == "flagship" else QUERIES[name](spark, sf)
        df._jdf.queryExecution().toRdd().count()  # run this DataFrame's own plan
        plan = df._jdf.queryExecution().executedPlan().toString()
        final = plan.split("+- == Initial Plan ==")[0]
        census = {k: len(re.findall(re.escape(k), final)) for k in CENSUS}
        print(f"== {name}: {{{', '.join(f'{k}: {v}' for k, v in census.items() if v)}}}")
        df.explain("formatted")


if __name__ == "__main__":
    main()
