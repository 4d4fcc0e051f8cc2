"""Parsing, sidecars, versions and sinks."""

import json
from datetime import datetime, timedelta

from test_literals import events

from railbird.operators import derive
from railbird.sources import sidecars, silver, tables

T0 = datetime(2024, 1, 1)


def test_hand_json(spark):
    raw = {"player_stacks_initial": {"0": 100, "1": "200", "2": None, "3": "x"}, "showdown_cards": {"1": ["Ah", "Kd"]},
           "blind_level": {"sb": 1, "bb": "2"}, "button_seat_index": 3,
           "insurance_inferred": [{"seat": 1, "player_name": "A", "gain": "5.5", "classification": "rebuy"}]}
    row = (1, "t", T0, None, 5.0, '["Ah","Kd"]', '{"flop":["2c"]}', '{"BB":"B"}', json.dumps(raw))
    df = spark.createDataFrame([row], """id int, table_name string, started_at timestamp, ended_at timestamp, pot_size_final double,
        hero_cards string, community_cards string, seats string, raw_data string""")
    h = silver.parse_hands(df).first()
    assert h.stacks_initial == {"0": 100.0, "1": 200.0, "2": None, "3": None} and h.stacks_final is None
    assert (h.blind_sb, h.blind_bb, h.button_seat_index, h.num_seats) == (1.0, 2.0, 3, None)
    assert h.showdown_cards == {"1": ["Ah", "Kd"]} and h.insurance_inferred[0].gain == 5.5 and h.seats == {"BB": "B"}


def test_event_json(spark):
    df = spark.createDataFrame([("e", '{"stack_delta":"7.5","synthetic":true,"decision_time_ms":12}'), ("f", None)], "id string, raw_data string")
    a, b = silver.parse_action_events(df).orderBy("id").collect()
    assert (a.raw.stack_delta, a.raw.synthetic, a.raw.decision_time_ms) == (7.5, True, 12)
    assert b.raw is None or b.raw.stack_delta is None


def test_sidecars_in_both_encodings(spark, tmp_path):
    (tmp_path / "h1").mkdir()
    doc = {"event_id": "e1", "player_name": "小雨", "confidence_score": 0.5}
    (tmp_path / "h1" / "a_meta.json").write_bytes(json.dumps(doc, ensure_ascii=False).encode("utf-8"))
    (tmp_path / "h1" / "b_meta.json").write_bytes(json.dumps({**doc, "event_id": "e2"}, ensure_ascii=False).encode("gbk"))
    got = sidecars.read_sidecars(spark, str(tmp_path), sidecars.REVIEW, pattern="*_meta.json").collect()
    assert sorted((r.event_id, r.player_name) for r in got) == [("e1", "小雨"), ("e2", "小雨")]


def test_versions_keep_start_and_take_latest_end(spark):
    df = spark.createDataFrame([(1, 0, "t", None), (1, 2, None, 9.0), (1, 1, None, 5.0), (2, 0, "u", None)],
                               "id int, version int, table_name string, pot_size_final double")
    got = {r.id: (r.table_name, r.pot_size_final) for r in tables.current_hands(df).collect()}
    assert got == {1: ("t", 9.0), 2: ("u", None)}


def test_routing_and_reading_back(spark, tmp_path):
    ev = events(spark, [{"hand_id": 1, "action": "call", "conf": c, "amount": 5.0} for c in (0.7, 0.69, 1.0)])
    tables.write_routed(ev, str(tmp_path))
    kept = tables.hand_events(tables.read_table(spark, str(tmp_path), "action_events"), "1").collect()
    low = tables.read_table(spark, str(tmp_path), "diagnostic_events").collect()
    assert [r.sequence_number for r in kept] == [1, 3] and len(low) == 1
    assert low[0].tag == "action.low_tier_skip" and json.loads(low[0].payload)["confidence"] == 0.69


def test_corrections_accept_known_actions_only(spark):
    df = spark.createDataFrame([("e1", "fold", "check", "", T0), ("e2", "fold", "jump", "n", T0)],
                               "event_id string, action_type string, corrected_action string, notes string, corrected_at timestamp")
    (row,) = tables.event_corrections(df).collect()
    assert (row.event_id, row.original_action, row.notes) == ("e1", "fold", None)


def test_csv_report(spark, tmp_path):
    tables.write_csv(spark.createDataFrame([("a", 1)], "x string, y int"), str(tmp_path / "r"))
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).first().asDict() == {"x": "a", "y": "1"}


def test_registry_latest_name(spark):
    old = spark.createDataFrame([(1, "a", T0), (2, "b", T0)], "phash long, name string, seen_at timestamp")
    new = spark.createDataFrame([(1, "z", T0 + timedelta(1))], old.schema)
    assert {r.phash: r.name for r in tables.merged_registry(old, new).collect()} == {1: "z", 2: "b"}


def test_fallback_diagnostics(spark):
    a = spark.createDataFrame([(1, 1, 2, ""), (1, 1, 3, "")], "hand_id int, tick int, seat int, text string")
    b = spark.createDataFrame([(1, 1, 2, "CALL"), (1, 1, 3, "FOLD")], a.schema)
    focus = spark.createDataFrame([(1, 1, 2)], "hand_id int, tick int, seat int")
    merged = derive.merged_readings(a, b, focus)
    assert {r.seat: (r.text, r.fell_back) for r in merged.collect()} == {2: ("CALL", True), 3: ("", False)}
    assert derive.fallback_diagnostics(merged).count() == 1


def test_run_folder_is_removed(spark):
    import os

    from railbird.session import run_folder, written

    with run_folder(spark) as folder:
        assert written(spark.range(10)).count() == 10
        path = folder.removeprefix("file:")
        assert os.path.isdir(path)
    assert not os.path.exists(path)
    outside = written(spark.range(3))
    assert outside.count() == 3


def test_queries_agree_over_parsed_tables(spark, con, tmp_path):
    import compare
    from conftest import DATA

    from railbird.plans.base import Tables

    Tables(spark, DATA).write_silver(str(tmp_path))
    try:
        for name in ("v_hand_conservation", "v_player_timing_stats", "health_warnings", "action_changes"):
            ok, message = compare.compare(spark, con, DATA, name)
            assert ok, message
    finally:
        Tables.silver.clear()


def test_first_real_name_behind_other_placeholders(spark):
    from railbird.operators import identity

    rows = [("t", 1, T0 + timedelta(minutes=70 * i), n) for i, n in enumerate(["TempUser_1", "TempUser_2", "TempUser_1", "Ann", "Bob"])]
    df = spark.createDataFrame(rows, "table_id string, seat int, at timestamp, player_name string")
    assert {r.player_name: r.canonical for r in identity.placeholder_upgrades(df).collect()} == {"TempUser_1": "Ann", "TempUser_2": "Ann"}
