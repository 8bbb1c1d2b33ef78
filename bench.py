"""Time the headline queries; prints one line of JSON.

Every query runs twice over the whole tables and the faster run counts, so that JVM
warm-up does not.
"""

import json
import os
import time

from poolwright.plans.queries import QUERIES
from poolwright.session import local_session

HEADLINES = [
    "paragraph_scores__o36c",
    "select_paragraphs__o36e",
    "leading_text__o37",
    "pack_pool__o38",
    "fold_events__o24",
    "pack_pages__o27",
    "assemble_sections__o34",
    "final_state__o56",
    "fold_graphs__o45",
    "sanitise_edges__o47c",
    "source_keys__o48b",
    "distinct_cables__o48d",
    "sanitise_transcript__o49a",
    "judge_uploads__o51",
    "squeeze_blank_lines__o18",
    "apply_changes__o4",
]


def seconds(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    times = {n: round(min(seconds(spark, n, folder) for _ in range(2)), 3) for n in HEADLINES}
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
