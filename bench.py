"""Benchmark the headline queries; prints one JSON line.

Each query's DataFrame is fully computed with the ``noop`` sink (no collect to the driver).
Warm: one untimed pass over all queries, then per query the median of ``BENCH_REPEAT`` timed runs.
Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_REPEAT (default 3).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tableprep import queries as Q  # noqa: E402
from tableprep.session import local_session  # noqa: E402

HEADLINE = ["basic_stats", "detect_sensitive", "mask_columns", "fill_forward", "quality_report", "pipeline_full",
            "sample_values", "fill_median", "fill_mode", "feat_word_count", "auto_convert", "unique_counts"]


def _run_orders(spark, sf_dir):
    """Whole pipeline with ordered fills and the report on orders_gaps (result checkpointed)."""
    from tableprep.fixtures import fixture
    from tableprep.operators.impute import FillOptions
    from tableprep.plans.options import PrepOptions
    from tableprep.plans.pipeline import run

    opts = PrepOptions(order_by="o_orderkey", max_rows=None, missing_handling=FillOptions(default_strategy="forward_fill"))
    return run(fixture(spark, sf_dir, "orders_gaps"), opts).data


def _run_lineitem(spark, sf_dir):
    """Whole pipeline and report on the largest table (composite order key)."""
    from tableprep.fixtures import table
    from tableprep.plans.options import PrepOptions
    from tableprep.plans.pipeline import run

    opts = PrepOptions(order_by=["l_orderkey", "l_linenumber"], max_rows=None)
    return run(table(spark, sf_dir, "lineitem"), opts).data


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    spark = local_session(cpus, shuffle_partitions=int(cpus) * 2, app="tableprep-bench")
    qs = Q.queries()
    qs = dict(qs)
    qs["run_orders_ffill_report"] = _run_orders
    qs["run_lineitem_report"] = _run_lineitem
    names = HEADLINE + ["run_orders_ffill_report", "run_lineitem_report"]

    def once(name):
        t0 = time.perf_counter()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    for name in names:  # warm-up pass over everything first (JIT, file listing caches)
        once(name)
    times = {name: round(statistics.median(once(name) for _ in range(repeat)), 3) for name in names}
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
