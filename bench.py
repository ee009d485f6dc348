"""Benchmark the headline queries.

Runs each query in full through Spark's ``noop`` sink (every row computed,
nothing collected to the driver) at ``$BENCH_SF_DIR`` (default sf0.1) on
``local[$BENCH_CPUS]`` and prints one JSON line. Each query is timed twice and
the faster run is kept, so JVM warm-up does not dominate small inputs.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from glossa.plans.catalog import QUERIES  # noqa: E402
from glossa.session import build_session  # noqa: E402

HEADLINE = [
    "render_variants",    # prompts rendered: v_pairs x 2 templates
    "sweep_dedupe",       # v_pairs x 4 models, request keys, dedupe
    "cache_misses",       # warm cache written, anti-join
    "score_stub",         # full sweep: misses scored in Arrow batches, cache write-through, attach
    "judge_score",        # judge responses parsed
    "system_score",
    "judge_generate",
    "segment_scores",
    "answers_long",       # 25 answers per row: parse, explode, tallies
    "qa_score",
    "triplet_metrics",
    "assign_batches",
    "pad_encode",
    "eval_split",
    "score_rollup",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    extra = {"spark.driver.memory": "16g"}
    if os.environ.get("BENCH_EVENT_LOG"):          # a folder for Spark's event log (stage / task times)
        extra.update({"spark.eventLog.enabled": "true", "spark.eventLog.dir": os.environ["BENCH_EVENT_LOG"]})
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = build_session(f"local[{cpus}]", shuffle_partitions=cpus * 2, app="glossa-bench", extra=extra)
    spark.read.parquet(f"{sf_dir}/events.parquet").write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    errors: dict[str, str] = {}
    for name in only or HEADLINE:
        best = None
        try:
            for _ in range(repeats):
                t0 = time.perf_counter()
                QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
                dt = time.perf_counter() - t0
                best = dt if best is None else min(best, dt)
            times[name] = round(best, 3)
        except Exception as e:  # noqa: BLE001 - one failing query must not lose the others' timings
            errors[name] = f"{type(e).__name__}: {str(e)[:200]}"
    counts = {
        "pairs": spark.read.parquet(f"{sf_dir}/documents.parquet").count(),
        "events": spark.read.parquet(f"{sf_dir}/events.parquet").count(),
    }
    per_row = {"render_variants": ("prompts_rendered_per_sec", 2 * counts["pairs"]),
               "sweep_dedupe": ("requests_keyed_per_sec", 4 * counts["pairs"]),
               "score_stub": ("requests_answered_per_sec", 4 * counts["pairs"]),
               "judge_score": ("judge_responses_parsed_per_sec", counts["events"]),
               "answers_long": ("answers_exploded_per_sec", 25 * counts["events"])}
    rates = {label: round(n / times[q], 1) for q, (label, n) in per_row.items() if q in times}
    # calls saved (not timed): rows x models vs distinct requests vs cache misses
    sweep = {}
    try:
        exp = QUERIES["sweep_expand"](spark, sf_dir).collect()
        rep = QUERIES["cache_report"](spark, sf_dir).collect()
        rows_total = sum(r.n_rows for r in exp)
        keys_total = sum(r.n_keys for r in exp)
        misses = sum(r.misses for r in rep)
        sweep = {"rows": rows_total, "distinct_requests": keys_total, "warm_cache_misses": misses,
                 "saved_by_dedupe": round(1 - keys_total / rows_total, 4),
                 "saved_by_warm_cache": round(1 - misses / keys_total, 4)}
    except Exception as e:  # noqa: BLE001
        errors["sweep_counts"] = f"{type(e).__name__}: {str(e)[:200]}"
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "rates": rates, "sweep": sweep, "sf": float(m.group(1)) if m else sf_dir,
           "cpus": cpus}
    if errors:
        out["errors"] = errors
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
