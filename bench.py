"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs to a sink that discards its rows, so nothing is gathered on the driver. The
first query is preceded by a small warm-up of the session; every query is timed once.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cilake.plans.catalog import QUERIES  # noqa: E402
from cilake.session import local_session  # noqa: E402

HEADLINE = [
    "l6_classify_lines", "l4_command_props", "w3_echo_state", "w5_log_groups", "j7_mask_lines", "l9_console_view",
    "s1_frame_lines", "s3_parse_kv_files", "a1_final_env", "w6_env_asof_step", "j6_expand_matrix", "p3_loose_eq_ne",
    "p9_lower_keys", "p11_match_rules", "p12_render_templates", "a5_hash_files", "m5_jobs", "w1_step_ids", "w2_executed_steps",
    "a9_job_status", "v_check_documents", "v16_quality_report", "t1_stream_commands", "t4_stream_masking",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), name="cilake-bench")
    spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_orderstatus").count().write.format("noop").mode("overwrite").save()
    names = sys.argv[1:] or HEADLINE
    seconds: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
