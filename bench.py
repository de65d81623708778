"""Times the headline queries, each on its second run; prints one JSON line."""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from figcorpus.plans.catalog import QUERIES
from figcorpus.session import local_session

HEADLINE = [
    "d03_classification_counts",
    "c05_find_references",
    "b04_split_paragraphs",
    "b09_min_context",
    "b12_trim_to_sentences",
    "d16_build_abbr_table",
    "b14_expand_abbr",
    "d01_histogram_pct",
    "d02_describe_levels",
    "e06_index_within_level",
    "e07_balanced_sample",
    "c16_similar_pairs_cosine",
    "c17_similar_pairs_hamming",
    "g02_duplicate_plan",
    "d10_majority_vote",
    "d21_accuracy_report",
    "h01_leaf_to_root_chains",
    "e12_uct_scores",
    "e01_moving_averages",
    "e02_macd",
    "c19_asof_forward",
    "c13_link_records",
    "a06_context_records",
    "i02_multi_model_answers",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    only = sys.argv[1:]
    seconds = {}
    for name in HEADLINE:
        if only and name not in only:
            continue
        # the first run compiles; both run the whole query, checkpoints included
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name,
            }
        )
    )


if __name__ == "__main__":
    main()
