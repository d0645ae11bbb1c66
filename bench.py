"""Time the headline queries, the better of two runs each; prints one JSON line.

``BENCH_SF_DIR`` is the data folder, ``BENCH_CPUS`` the local cores, and
``BENCH_QUERIES`` a comma-separated choice of queries, or ``all``.
"""

from __future__ import annotations

import json
import os
import time

from millrace.catalog import QUERIES
from millrace.session import local_session


RUNS = 2

# At least one query of every operator family.
HEADLINE = (
    "mean_pass_at_k pass_at_k_by_task rates_over_fixed_quarter rates_over_evaluated stage_funnel success_ids_by_level "
    "last_result_per_key tasks_with_results tasks_by_sample entity_texts_attached members_of_test_list rows_not_done "
    "edit_similarity_by_turn mean_similarity_with_zeros model_leaderboard fenced_code calling_conventions_removed "
    "first_function_renamed includes_hoisted lines_mentioning_function optimized_code_applied conflicts_renamed "
    "target_functions samples_of_bit_width samples_with_real_graph samples_with_real_data prompt_json_columns "
    "observed_outputs_equal folder_parts percent_slices prompt_plain prompt_with_metadata tokenised_samples "
    "rows_within_label_budget packing_plan packing_statistics packed_rows chat_segments chat_turn_limits "
    "chat_training_rows rank_shards resumed_batches padded_to_length padded_to_longest canonical_samples "
    "canonical_samples_stored json_object_files stored_packed_rows stored_success_lists answer_similarity_on_real_code "
    "function_similarity_by_level programs_by_sample corpus_from_raw_lines"
).split()


def timed(spark, sf_dir: str, name: str) -> float:
    """Seconds to build the query and produce all of its rows."""
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    asked = os.environ.get("BENCH_QUERIES", "")
    chosen = list(QUERIES) if asked == "all" else [name for name in asked.split(",") if name] or HEADLINE
    spark = local_session(cores, "millrace-bench", **{"spark.sql.shuffle.partitions": cores})
    seconds, failed = {}, {}
    for name in chosen:
        try:
            seconds[name] = round(min(timed(spark, sf_dir, name) for _ in range(RUNS)), 3)
        except Exception as error:  # noqa: BLE001
            failed[name] = str(error)[:200]
    spark.stop()
    report = {
        "metric": "total_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "runs": RUNS,
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    if failed:
        report["failed"] = failed
    print(json.dumps(report))


if __name__ == "__main__":
    main()
