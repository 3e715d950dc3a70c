"""Plans stay free of cross joins, and single-task exchanges appear only for global aggregates."""
import pytest

import __spark_entry__ as entry

NAMES = ["flight_segments", "nearest_time", "interpolate_asof", "peaks_in_rallies", "map_reel_to_source", "greedy_match", "court_player_gate", "court_positions", "heatmap",
         "shuttle_quality", "count_metrics", "corner_consensus", "student_profile", "school_overview", "assignable", "movement_stats", "slice_keyframes", "gate_report"]


@pytest.mark.parametrize("name", NAMES)
def test_no_cross_join(name, spark, sf_dir):
    plan = entry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "SinglePartition"):
        assert bad not in plan


def test_scan_is_pruned(spark, sf_dir):
    plan = entry.queries()["timeline_shares"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in plan


def test_filter_reaches_the_scan(spark, sf_dir):
    from courtlake.plans.adapters import table

    d = table(spark, sf_dir, "events").filter("user_id = 3").select("event_id")
    assert "EqualTo(user_id,3)" in d._jdf.queryExecution().executedPlan().toString()


def test_corner_medians_ship_counts_instead_of_frames(spark):
    from courtlake.operators.court import corner_medians

    quads = [[[0.1, 0.1], [0.9, 0.1], [0.9, 0.9], [0.1, 0.9]], [[0.2, 0.1], [0.9, 0.1], [0.9, 0.9], [0.1, 0.9]], [[0.3, 0.1], [0.9, 0.1], [0.9, 0.9], [0.1, 0.8]]]
    got = corner_medians(spark.createDataFrame([(1, q) for q in quads], "job_id long, corners array<array<double>>"))
    lines = got._jdf.queryExecution().optimizedPlan().toString().split("\n")
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    for i, line in enumerate(lines):
        if "RepartitionByExpression" in line:
            below = next((n for n, x in enumerate(lines[i + 1:], i + 1) if depth(x) <= depth(line)), len(lines))
            assert any("Aggregate" in x for x in lines[i + 1:below])
    r = got.first()
    assert (r.corners[0][0], r.corners[3][1], r.found) == (0.2, 0.9, 3)


def test_match_reports_are_computed_once_for_all_their_writes(spark, sf_dir, monkeypatch):
    from __spark_entry__ import queries
    from courtlake.sources import tables

    given = []
    real = tables.write_reports
    monkeypatch.setattr(tables, "write_reports", lambda df, *a, **b: (given.append(df), real(df, *a, **b))[1])
    queries()["match_reports"](spark, sf_dir)
    assert len(given) == 3 and not any("RepartitionByExpression" in d._jdf.queryExecution().optimizedPlan().toString() for d in given)
