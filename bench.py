"""Time the headline queries: one JSON line on the last line of output.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8)
the cores.  Every query runs over its whole input and writes all of its columns to
Spark's no-op sink, so no column can be optimised away and nothing is collected.
"""

from __future__ import annotations

import json
import os
import time

from veilmark.plans.scan import scan_documents
from veilmark.session import build_session
from workload.queries import QUERIES, documents

HEADLINE = [
    "find_regex", "find_rules", "find_dictionary", "detect", "detect_documents",
    "detect_with_names", "resolve_overlaps", "summarize", "corpus_summary", "redact",
    "redact_documents", "highlight_category", "retrieve_rules", "exposure",
    "term_cosine_topk", "cosine_topk", "external_findings", "assemble_pages", "chunk_text",
    "scan_documents",
]


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
            "spark.sql.shuffle.partitions": cpus,
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    todo = {name: QUERIES[name] for name in HEADLINE}
    todo["scan_corpus"] = lambda s, d: scan_documents(documents(s, d))
    # One small run starts the engine, so that the first query is not charged for it.
    QUERIES["detect_documents"](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name, fn in todo.items():
        start = time.time()
        fn(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
