"""Streams cut into several batches give the batch result."""

import random
import time
import json
from datetime import datetime, timedelta

from test_literals import events

from railbird.functions import steps
from railbird.operators import derive
from railbird.sources import tables
from railbird.streaming import jobs

T0 = datetime(2024, 1, 1)
SCHEMA = "table_id string, tick int, ts timestamp, seat int, kind string, text string, value double, phash bigint"


def _observations(n=240):
    rnd = random.Random(11)
    kinds = ["action", "stack", "pot", "timer", "community", "hero"]
    rows = []
    for i in range(n):
        kind = rnd.choice(kinds)
        text = rnd.choice(["FOLD", "CALL 5", " CALL 5 ", "", "ALL-IN"]) if kind == "action" else None
        value = {"stack": rnd.choice([100.0, 95.0, 9.0, 0.0, 1000.0]), "pot": float(rnd.randrange(10, 90)),
                 "timer": rnd.choice([10.0, 9.0, 25.0, None]), "community": float(rnd.choice([0, 3, 4, 5]))}.get(kind)
        rows.append((f"T{rnd.randrange(2)}", i, T0 + timedelta(seconds=i), rnd.randrange(3), kind, text, value,
                     rnd.choice([0, (1 << 20) - 1]) if kind == "hero" else None))
    return rows


def _as_stream(spark, rows, schema, folder, parts=4):
    size = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * size:(i + 1) * size], schema).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _drain(spark, df, folder):
    q = jobs.to_table(df, f"{folder}/out", f"{folder}/ckpt").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/out")


def _equal(a, b, cols):
    a, b = a.select(*cols), b.select(*cols)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_stream_equals_batch(spark, tmp_path):
    rows = _observations()
    batch = spark.createDataFrame(rows, SCHEMA)
    stream = _as_stream(spark, rows, SCHEMA, str(tmp_path / "in"))
    key = ["table_id", "seat"]
    pairs = {
        "segment": (jobs.segmented(stream, pot_label=None), derive.segment_hands(batch, pot_label=None, width="1 minute"),
                    ["tick", "boundary", "pot_latest", "pot_peak"]),
        "changes": (jobs.changed_actions(stream, key), derive.action_changes(batch, key, width="1 minute"), ["tick", "cleaned", "prev_text"]),
        "stacks": (jobs.cleaned_stacks(stream, key), derive.cleaned_stacks(batch, key, width="1 minute"), ["tick", "stack", "replaced"]),
        "pots": (jobs.cleaned_pots(stream, ["table_id"]), derive.cleaned_pots(batch, ["table_id"], width="1 minute"),
                 ["tick", "accepted", "pot_before", "pot"]),
        "timer": (jobs.decision_times(stream, key), derive.decision_times(batch, key, width="1 minute"),
                  ["tick", "decision_time_ms", "used_timebank"]),
    }
    for name, (live, want, cols) in pairs.items():
        got = _drain(spark, live, str(tmp_path / name))
        assert got.where("late").isEmpty() and _equal(got, want, cols), name


def test_spaces_gaps_and_missing_values_agree(spark, tmp_path):
    schema = "table_id string, tick int, ts timestamp, seat int, kind string, text string, value double"
    texts = ["CALL", "\u3000CALL", "CALL\x1c", "\xa0 CALL \x85", "FOLD", " ", None, "\u2003FOLD"]
    rows = [("A", i, T0 + timedelta(seconds=i), 1, "action", t, None) for i, t in enumerate(texts)]
    stream, key = _as_stream(spark, rows, schema, str(tmp_path / "in")), ["table_id", "seat"]
    got = _drain(spark, jobs.changed_actions(stream, key), str(tmp_path / "c"))
    assert _equal(got, derive.action_changes(spark.createDataFrame(rows, schema), key), ["tick", "cleaned", "prev_text"])
    assert got.count() == 2

    # Gaps of half a hundredth of a second round the same way; a row without a time is late.
    at = [0, 1.005, 2.01, 3.025, 5.04]
    scans = [("A", i, T0 + timedelta(seconds=s), 1 if i % 2 == 0 else None, 10) for i, s in enumerate(at)] + [("A", 9, None, 1, 10)]
    schema = "table_id string, tick int, ts timestamp, seat int, value int"
    stream = _as_stream(spark, scans, schema, str(tmp_path / "in2"), parts=1)
    got = _drain(spark, jobs.pointer_events(stream, ["table_id"]), str(tmp_path / "p"))
    assert got.where("late").count() == 1
    want = derive.pointer_events(spark.createDataFrame(scans[:-1], schema), ["table_id"])
    assert _equal(got.where("not late"), want, ["tick", "tag", "of_seat", "time_since_timer"])


def test_late_rows_change_nothing(spark, tmp_path):
    rows = [("A", "e0", T0), ("A", "e7", T0 + timedelta(seconds=7)), ("A", "e3", T0 + timedelta(seconds=3)), ("A", "e13", T0 + timedelta(seconds=13))]
    stream = _as_stream(spark, rows, "player_name string, id string, ts timestamp", str(tmp_path / "in"))
    got = _drain(spark, jobs.debounced(stream, keys=["player_name"]), str(tmp_path)).collect()
    assert {r.id: (r.late, r.accepted) for r in got} == {
        "e0": (False, True), "e7": (False, True), "e3": (True, None), "e13": (False, True)}


def test_routing_batches(spark, tmp_path):
    ev = events(spark, [{"hand_id": 1, "action": "call", "conf": c} for c in (0.9, 0.2, 0.8, 0.1)])
    ev.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "in"))
    jobs.routing(stream, str(tmp_path / "o"), str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "o/action_events")).count() == 2
    assert tables.read_table(spark, str(tmp_path / "o"), "diagnostic_events").count() == 2


def test_event_alerts(spark, tmp_path):
    ev = events(spark, [{"hand_id": 1, "action": "call", "override_reason": "x", "ts": T0 + timedelta(minutes=m)}
                        for m in [*range(12), 300]])
    ev.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "in"))
    got = _drain(spark, jobs.event_alerts(jobs.event_windows(stream), baseline_conf=1.0), str(tmp_path)).collect()
    assert {r.tag for r in got} == {"health.override_spike", "health.stack_ocr_degraded"}
    assert all(r.window_start == T0 for r in got)


def test_silence_is_told(spark, tmp_path):
    """Windows without a hand come out as soon as anything else moves the time on."""
    minute = lambda m: T0 + timedelta(minutes=m)
    hands = _as_stream(spark, [(f"h{m}", "t", minute(m)) for m in (0, 5, 9, 12, 20, 21, 95)] + [("u", "u", minute(2))], "id string, table_name string, started_at timestamp", str(tmp_path / "h"), parts=1)
    beats = _as_stream(spark, [("t", minute(m)) for m in range(0, 200, 7)], "table_name string, at timestamp", str(tmp_path / "b"), parts=1)
    windows = jobs.hand_windows(hands, beats, key="table_name")
    got = _drain(spark, jobs.hand_alerts(windows), str(tmp_path)).collect()
    # T0 lies on a window's border; the newest reading is at minute 196, so windows up to 180 are over.
    assert {(r.feed, r.window_start) for r in got} == {("t", minute(m)) for m in (30, 60, 90, 120, 150)} | {("u", minute(m)) for m in range(0, 180, 30)}
    assert {json.loads(r.payload)["hands_last_30min"] for r in got if r.feed == "t"} == {0, 1}


def test_late_rows_go_to_a_side_table(spark, tmp_path):
    """Each part is a batch of its own; what comes behind its window is kept beside the sums, and all adds up."""
    minute = lambda m: T0 + timedelta(minutes=m)
    rows = [(m, "WARN", minute(m)) for m in range(40)] + [(100, "WARN", minute(100)), (3, "ERROR", minute(3)), (101, "INFO", minute(101)), (150, "WARN", minute(150)),
                                                          (88, "WARN", minute(88)), (95, "ERROR", minute(95)), (260, "WARN", minute(260))]
    schema = "id int, level string, occurred_at timestamp"
    folder = tmp_path / "in"
    for n, part in enumerate((rows[:40], rows[40:41], rows[41:44], rows[44:46], rows[46:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder / f"p{n}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "p*"))
    job = jobs.split_late(jobs.diagnostic_windows(stream), str(tmp_path / "o"), str(tmp_path / "c"))
    job.trigger(availableNow=True).start().awaitTermination()
    windows, late = (spark.read.parquet(str(tmp_path / "o" / k)).drop("batch").collect() for k in ("windows", "late"))
    starts = [r.window_start for r in windows]
    assert len(starts) == len(set(starts)) and set(starts) == {minute(m) for m in range(0, 240, 30)}
    told = sum(r.n for r in windows)
    assert late and told + sum(r.n for r in late) == sum(level != "INFO" for _, level, at in rows if at < minute(240))
    assert {r.window_start for r in late} <= {minute(0), minute(60), minute(90)}


def test_live_table(spark, tmp_path):
    schema = "id bigint, table_name string, started_at timestamp, seats map<string,string>"
    rows = [(1, "t", T0, {"BB": "A"}), (2, "t", T0 + timedelta(minutes=1), {"BB": "B"}), (3, "u", T0, {"SB": "A"})]
    stream = _as_stream(spark, rows, schema, str(tmp_path / "in"), parts=3)
    cache = spark.createDataFrame([("B", 5, 40.0, 20.0, 1.5)], "player_name string, total_hands int, vpip double, pfr double, af double")
    timing = spark.createDataFrame([("B", 33.0)], "player_name string, snap_pct double")
    job = jobs.live_table(stream, cache, timing, str(tmp_path / "o"), str(tmp_path / "c"))
    job.trigger(availableNow=True).start().awaitTermination()
    got = {(r.table_name, r.position): (r.player_name, r.vpip, r.snap_pct) for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    assert got == {("t", "BB"): ("B", 40.0, 33.0), ("u", "SB"): ("A", None, None)}


def test_stream_fallback_join(spark, tmp_path):
    schema = "hand_id int, tick int, seat int, ts timestamp, text string"
    a = _as_stream(spark, [(1, i, 2, T0 + timedelta(seconds=i), "" if i % 2 else "FOLD") for i in range(40)], schema, str(tmp_path / "a"))
    b = _as_stream(spark, [(1, i, 2, T0 + timedelta(seconds=i), "CALL") for i in range(40)], schema, str(tmp_path / "b"))
    got = _drain(spark, jobs.merged_readings(a, b), str(tmp_path)).collect()
    assert got and all(r.text == ("CALL" if r.tick % 2 else "FOLD") and r.fell_back == bool(r.tick % 2) for r in got)


def test_rules_are_shared():
    assert {"segment", "debounce", "stack_jump", "pot_monotone", "timer", "seat_lifecycle", "showdown_gate"} <= set(steps.STEPS)
