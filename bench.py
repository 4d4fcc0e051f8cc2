"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores.  JSON is parsed
once, into typed tables that the queries read; that time is ``parse_sec``.  Every query is
run once to warm up and then timed; the result goes to Spark's noop sink.
``health_small`` is the health report at sf0.001 (about the size of published figures).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from railbird.plans import registry  # noqa: E402
from railbird.plans.base import Tables  # noqa: E402
from railbird.session import local_session, run_folder  # noqa: E402

HEADLINE = [
    "v_hand_conservation", "v_cross_hand_stack_continuity", "v_player_timing_stats", "v_showdown_physical_check",
    "v_player_net_winnings", "v_player_position_matrix", "v_ring_beam_pot_gaps", "v_ring_beam_active_per_street",
    "v_ring_beam_card_uniqueness", "v_ring_beam_allin_followups", "v_ring_beam_stack_cross_hand", "recent_hands",
    "classified_players", "situation_rates", "player_situational_stats", "judged_actions", "nearest_fingerprints",
    "health_warnings", "tick_stats", "latency_summary", "drift_report", "debounced_events",
]
REPEATS = int(os.environ.get("BENCH_REPEATS", "2"))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "railbird-bench")
    available = registry.queries()
    times: dict[str, float] = {}

    def timed(name: str, folder: str) -> float:
        runs = []
        for i in range(REPEATS + 1):
            with run_folder(spark):
                start = time.perf_counter()
                available[name](spark, folder).write.format("noop").mode("overwrite").save()
                if i:
                    runs.append(time.perf_counter() - start)
        return round(statistics.median(runs), 3)

    with run_folder(spark) as folder:
        start = time.perf_counter()
        Tables(spark, sf_dir).write_silver(f"{folder}/silver")
        parse_sec = round(time.perf_counter() - start, 3)
        for name in HEADLINE:
            times[name] = timed(name, sf_dir)
        small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
        if os.path.isdir(small):
            Tables(spark, small).write_silver(f"{folder}/small")
            health_small = timed("health_warnings", small)
        else:
            health_small = None
    spark.stop()
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "parse_sec": parse_sec, "health_small": health_small, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
