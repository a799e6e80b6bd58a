"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
EXTRA = ("agg_cube", "agg_distinct", "join_mark", "join_range", "join_asof", "win_ranking", "win_groups", "topn_rank", "set_intersect_all", "scan_domain_filter")


def main() -> None:
    from quarry import registry
    from quarry.session import session

    registry.load()
    where = tempfile.mkdtemp(prefix="quarry-bench-")
    spark = session(
        f"local[{CPUS}]",
        "bench",
        **{
            "spark.driver.memory": "20g",
            "spark.sql.shuffle.partitions": CPUS,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": f"file://{where}/shared",
            "spark.sql.warehouse.dir": f"{where}/warehouse",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = [f"tpch_q{i:02d}" for i in range(1, 23)] + list(EXTRA)
    spent = {}
    for name in names:
        times = []
        for _ in range(RUNS + 1):  # the first run compiles
            began = time.perf_counter()
            registry.QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        spent[name] = round(statistics.median(times[1:]), 4)
    spark.stop()
    print(json.dumps({"metric": "median seconds, sum of queries", "value": round(sum(spent.values()), 3), "unit": "sec", "queries": spent, "sf": SF}))


if __name__ == "__main__":
    main()
