"""Times the headline queries over $BENCH_SF_DIR and prints one JSON line."""

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))
HEADLINE = (
    "title_lookup", "sort_by_duration", "resequence_by_duration", "intake_classify", "title_lookup_batch",
    "replay_search", "replay_view", "command_outcomes", "append_batch", "retry_collapse",
)


def main() -> None:
    from shelfwise.plans.queries import queries

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    timed = {}
    for name in HEADLINE:
        runs = []
        for _ in range(3):  # the first compiles; the best of the others counts
            began = time.perf_counter()
            queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        timed[name] = round(min(runs[1:]), 4)
    total = round(sum(timed.values()), 4)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": timed, "sf": Path(sf_dir).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
