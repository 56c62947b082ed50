"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8). One conversion warms the
session up; then every query is timed once, building the plan included.
"""

import json
import os
import time

from foliomill.queries import REGISTRY
from foliomill.session import get_session

HEADLINES = ["page_markdown", "md_to_html", "tree_export_entries", "html_tokens", "filename_dedupe"]


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = get_session("foliomill-bench", master=f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus,
        "spark.driver.memory": "16g",
        # The runs are short and the generated classes many: the first compiler tier pays off sooner.
        "spark.driver.extraJavaOptions": "-XX:TieredStopAtLevel=1 -XX:ReservedCodeCacheSize=512m",
    })
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    REGISTRY["page_markdown"](spark, folder).write.format("noop").mode("overwrite").save()
    for name in HEADLINES:
        start = time.perf_counter()
        REGISTRY[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
