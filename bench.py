"""Headline queries, timed: one JSON line. BENCH_SF_DIR picks the data, BENCH_CPUS the threads."""
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from courtlake.plans import catalog  # noqa: E402
from courtlake.session import local_session  # noqa: E402

HEADLINE = [
    "flight_segments", "split_shots", "merge_overlaps", "timeline", "refine_with_audio", "peaks_in_rallies", "select_for_reel", "nearest_time", "interpolate_asof", "greedy_match",
    "measure_confidence", "hampel", "one_euro", "stable_ids", "court_player_gate", "court_positions", "movement_stats", "heatmap", "corner_consensus", "shuttle_quality",
    "path_smoothness", "shot_gates", "shuttle_f1", "find_peaks", "rms_series", "canonical_shuttle", "student_profile", "job_state", "eval_camera_plan",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, **{"spark.driver.memory": "16g"})
    for t in ("events", "orders", "lineitem"):                       # warm the JVM and the file cache
        spark.read.parquet(f"{sf_dir}/{t}.parquet").count()
    times = {}
    for name in HEADLINE:
        t0 = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
