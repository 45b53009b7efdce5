"""Benchmark the headline queries.

Runs each query to completion with the ``noop`` sink (the whole plan
executes, nothing is collected to the driver) at ``$BENCH_SF_DIR``
(default /root/testdata/sf0.1) on ``local[$BENCH_CPUS]`` and prints one
JSON line: {"metric", "value", "unit", "queries", "sf", ...}.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from lectern.plans import catalog  # noqa: E402
from lectern.session import build_session, remove_intermediate  # noqa: E402
from lectern.sources.tables import PARTITIONS_CONF  # noqa: E402

HEADLINE = [
    "vocabulary_report",       # flagship: uncommon words per document
    "study_guide",             # vocabulary + summaries + state joined per paragraph
    "html_clean_paragraphs",   # HTML paragraph extraction
    "cross_page_paragraphs",   # cross-page stitching of layout blocks
    "paragraph_summaries",     # batching, model stand-in, validation, scatter
    "extract_paragraphs",      # format router over all uploads
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=max(8, cpus * 2), app_name="lectern-bench")
    # The driver's tables are one row group each.
    spark.conf.set(PARTITIONS_CONF, str(2 * cpus))
    qs = catalog.queries()
    # JIT/codegen warm-up on the smallest tables (nothing is cached between
    # runs: every timed query reads its Parquet input afresh).
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    for name in names:
        qs[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total_sec",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
    }))
    remove_intermediate(spark)
    spark.stop()


if __name__ == "__main__":
    main()
