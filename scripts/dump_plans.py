"""Write the executed (final, adaptive) physical plans of the headline queries to PLANS.md.

Usage: python scripts/dump_plans.py [sf_dir]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quarry.plans import queries as Q  # noqa: E402
from quarry.session import build_session  # noqa: E402

NAMES = ["assemble_retrieval", "mips_exact", "ivf_probe", "gather_blocks", "ema", "make_batches",
         "length_cutoffs", "loss_mean_stream"]


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[8]", shuffle_partitions=8)
    out = ["# Executed plans", "",
           f"Final adaptive physical plans of the headline queries at `{os.path.basename(sf)}` on `local[8]`, "
           "produced by `scripts/dump_plans.py`. Expression ids are stripped. Scans of checkpointed "
           "intermediate tables appear as `Scan ExistingRDD`.", ""]
    for name in NAMES:
        df = Q.QUERIES[name](spark, sf)
        df.collect()  # executes this DataFrame's own plan, so the adaptive plan is final
        plan = df._jdf.queryExecution().executedPlan().toString()
        plan = re.sub(r"#\d+L?", "", plan)
        plan = re.sub(r"\[plan_id=\d+\]", "", plan)
        lines = [ln[:220] for ln in plan.split("+- == Initial Plan ==")[0].splitlines()]
        n_ex = sum("Exchange hashpartitioning" in ln or "Exchange rangepartitioning" in ln
                   or "Exchange RoundRobin" in ln for ln in lines)
        n_bc = sum("BroadcastExchange" in ln for ln in lines)
        out += [f"## {name}", "", f"Shuffle exchanges: {n_ex}; broadcast exchanges: {n_bc} "
                "(checkpointed inputs were produced by earlier jobs, not shown).", "", "```", *lines, "```", ""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(out))


if __name__ == "__main__":
    main()
