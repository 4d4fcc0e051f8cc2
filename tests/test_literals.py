"""Hand-written cases, most of them around rounding, missing data and word rules."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from railbird import schemas as S
from railbird.functions import actions as A
from railbird.functions import semantics as sem
from railbird.functions import steps
from railbird.operators import decisions, derive, evaluation, event_audits, hand_audits, health, player_audits

T0 = datetime(2024, 1, 1)


def hands(spark, rows):
    names = [c.strip().split(" ")[0] for c in "id,table_name,started_at,pot_size_final,stacks_initial,stacks_final".split(",")]
    schema = "id bigint, table_name string, started_at timestamp, pot_size_final double, stacks_initial map<string,double>, stacks_final map<string,double>"
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def events(spark, rows):
    out = []
    for i, r in enumerate(rows):
        raw = {k: r.get(k) for k in ("stack_before", "stack_after", "stack_delta", "pot_after", "override_reason")}
        out.append((r.get("id", f"e{i}"), r["hand_id"], r.get("player", "A"), r.get("position", "BTN"), r.get("street", "preflop"),
                    r["action"], r.get("seq", i + 1), r.get("amount"), r.get("conf", 1.0), r.get("ts", T0 + timedelta(seconds=i)),
                    r.get("ts", T0), {**dict.fromkeys(["action_text", "pot_before", "pot_delta", "text_derived_action",
                                      "stack_derived_action", "decision_time_ms", "used_timebank", "synthetic"]), **raw}))
    return spark.createDataFrame(out, S.ACTION_EVENTS.replace("hand_id string", "hand_id bigint"))


@pytest.mark.parametrize("text,action,amount", [
    ("FOLD", "fold", None), ("CHECK", "check", None), ("CALL $2.50", "call", 2.5), ("CALL $12.75", "call", 12.75),
    ("BET $5.00", "bet", 5.0), ("RAISE TO $15.00", "raise", 15.0), ("ALL-IN $42.75", "all_in", 42.75),
    ("ALLIN $100", "all_in", 100.0), ("SB $0.05", "post_sb", 0.05), ("BB $0.10", "post_bb", 0.1),
    ("全押", "all_in", None), ("跟注 100", "call", 100.0), ("让牌", "check", None), ("", None, None), ("CALLING", "all_in", None),  # holds ALLIN
    ("all 30", "all_in", 30.0), ("小盲 5", "post_sb", 5.0), ("ante 1.", "post_ante", 1.0), ("  hello ", None, None), (None, None, None),
])
def test_action_words(spark, text, action, amount):
    row = spark.createDataFrame([(text,)], "t string").select(A.parse_action("t").alias("p")).first()["p"]
    assert (row["action_type"], row["amount"]) == (action, amount) if row else action is None


def test_placeholder_patterns(spark):
    df = spark.createDataFrame([("TempUser",), ("TempUser_",), ("TempUserX",), ("Bob",)], "n string")
    assert [r.n for r in df.where(sem.named_player("n")).collect()] == ["TempUser", "Bob"]
    assert [r.n for r in df.where(sem.named_player_prefix("n")).collect()] == ["Bob"]


@pytest.mark.parametrize("delta,status", [(50.0, "OK"), (51.0, "CHECK_REQUIRED"), (100.0, "rebuy"), (150.5, "rebuy"),
                                          (149.5, "rebuy"), (None, "absent_in_next")])
def test_rebuy_rounding(spark, delta, status):
    nxt = {"0": 1000.0} if delta is None else {"1": 7.0 + delta}
    df = hands(spark, [
        {"id": 1, "started_at": T0, "stacks_initial": {"1": 1.0}, "stacks_final": {"1": 7.0}},
        {"id": 2, "started_at": T0, "stacks_initial": nxt, "stacks_final": {}},
    ])
    assert [r.status for r in hand_audits.stack_continuity(df).collect()] == [status]


def test_previous_hand_without_finals_hides_the_next(spark):
    df = hands(spark, [
        {"id": 1, "started_at": T0, "stacks_initial": {"1": 1.0}, "stacks_final": {"1": 90.0}},
        {"id": 2, "started_at": T0 + timedelta(days=2), "stacks_initial": {"1": 95.0, "2": 5.0}},
        {"id": 3, "started_at": T0 + timedelta(days=4), "stacks_initial": {"1": 90.0}, "stacks_final": {"1": 90.0}},
    ])
    got = {(r.hand_id, r.seat_idx): r.status for r in hand_audits.stack_cross_hand(df).collect()}
    assert got == {(2, "1"): "small_increase_unusual", (2, "2"): "no_prev_data"}


def test_net_winnings_null_total_sorts_last(spark):
    rows = [{"hand_id": h, "player": p, "action": "call", "seq": 1, "stack_after": s, "ts": T0 + timedelta(hours=h)}
            for p, stacks in {"rebuyer": [100, 300], "winner": [100, 130], "loser": [100, 60]}.items()
            for h, s in enumerate(map(float, stacks))]
    out = player_audits.net_winnings(events(spark, rows)).collect()
    assert [(r["玩家"], r["net_excl_rebuy"]) for r in out] == [("winner", 30.0), ("loser", -40.0), ("rebuyer", None)]


def test_insurance_signature_branches(spark):
    ev = events(spark, [{"hand_id": 1, "player": p, "action": "all_in", "stack_after": s}
                        for p, s in [("A", 5.0), ("B", 0.0), ("C", 9.0), ("D", None)]] + [{"hand_id": 2, "action": "all_in"}])
    h = spark.createDataFrame([(1, "A"), (2, None)], "id bigint, winner_player_name string")
    got = {(r.hand_id, r.player_name): r.insurance_status for r in event_audits.insurance_signature(h, ev).collect()}
    assert got == {(1, "A"): "allin_won", (1, "B"): "allin_lost_no_insurance", (1, "C"): "allin_lost_with_insurance",
                   (1, "D"): "unclear", (2, "A"): "winner_unknown"}


def test_all_in_lists_keep_unknown_sizes(spark):
    ev = events(spark, [{"hand_id": 1, "player": p, "action": "all_in", "stack_delta": d}
                        for p, d in [("A", None), ("B", 50.0), ("C", 20.0)]])
    row = event_audits.allin_amounts_per_hand(ev).first()
    assert row.allin_amounts_sorted == [20.0, 50.0, None] and row.allin_players_sorted == ["C", "B", "A"]


def test_three_bet_and_continuation(spark):
    line = [("A", "preflop", "raise"), ("B", "preflop", "raise"), ("A", "preflop", "call"),
            ("A", "flop", "check"), ("B", "flop", "bet"), ("A", "flop", "raise"), ("B", "flop", "call"),
            ("A", "turn", "bet"), ("B", "turn", "fold")]
    ev = events(spark, [{"hand_id": 1, "player": p, "street": s, "action": a, "position": "CO"} for p, s, a in line])
    got = {r.player_name: r for r in decisions.situation_counts(ev).collect()}
    a, b = got["A"], got["B"]
    assert (b.three_bet_opp, b.three_bet_did, a.fold_to_three_bet_opp, a.fold_to_three_bet_did) == (1, 1, 1, 0)
    assert (b.cbet_opp, b.cbet_did, a.raise_cbet_did, a.check_raise_did, a.steal_did) == (1, 1, 1, 1, 1)
    assert (b.double_barrel_opp, a.donk_bet_opp, a.donk_bet_did) == (0, 1, 0)


def test_board_texture(spark):
    df = spark.createDataFrame([(["Ah", "Kh", "2h"],), (["2c", "2d", "2s", "9c"],), (["9c", "3d", "4c"],), (["9c", "3d"],)], "c array<string>")
    got = [r.t and tuple(r.t) for r in df.select(A.board_texture(F.col("c")).alias("t")).collect()]
    assert got == [(False, False, True, False, "K", False), (True, True, False, False, "9", True),
                   (False, False, False, False, "9", True), None]


def test_confidence_table(spark):
    cases = [("fold", None, None, 0.85), ("check", 1.0, None, 1.0), ("fold", 9.0, 9.0, 0.3), ("bet", None, None, 0.5),
             ("bet", 5.0, None, 0.7), ("call", 1.0, 0.0, 0.3), ("call", 10.0, 11.0, 1.0), ("raise", 10.0, 30.0, 0.9),
             ("raise", 30.0, 10.0, 0.7)]
    df = spark.createDataFrame(cases, "a string, s double, p double, want double")
    assert df.where(A.confidence(F.col("a"), F.col("s"), F.col("p")) != F.col("want")).isEmpty()


def test_arbitration(spark):
    cases = [("fold", "call", 20.0, "call", True), ("call", "raise", 20.0, "call", False), ("call", "all_in", 20.0, "all_in", True),
             ("check", "fold", 0.0, "check", False), ("fold", None, None, "fold", False)]
    df = spark.createDataFrame(cases, "t string, s string, d double, want string, wins boolean")
    v = A.arbitrate(F.col("t"), F.col("s"), F.col("d"), F.lit(None).cast("double"))
    got = df.select("*", v.alias("v")).collect()
    assert all(r.v.action_type == r.want and (r.v.override_reason is not None) == r.wins for r in got)
    assert got[0].v.override_reason == "stack-derived call overrode text-derived fold" and got[0].v.confidence_score == 0.7
    assert got[1].v.text_preserved and not got[4].v.text_preserved


def test_debounce_is_anchored(spark):
    df = spark.createDataFrame([(f"e{s}", "A", "flop", "call", T0 + timedelta(seconds=s)) for s in (0, 3, 6, 9)],
                               "id string, player_name string, street string, action_type string, ts timestamp")
    got = derive.debounced(df, width="1 second").where("accepted").collect()
    assert sorted(r.id for r in got) == ["e0", "e6"]


def test_timer(spark):
    seen = [10.0, 9.0, 8.0, 25.0, 24.0, None]
    rows = [(1, 1, i, T0 + timedelta(seconds=i), "timer", v) for i, v in enumerate(seen)]
    rows += [(1, 1, 6, T0 + timedelta(seconds=6), "action", None), (1, 1, 7, T0 + timedelta(seconds=7), "action", None)]
    df = spark.createDataFrame(rows, "hand_id int, seat int, tick int, ts timestamp, kind string, value double")
    got = derive.decision_times(df, ["hand_id", "seat"], width="2 seconds").orderBy("tick").collect()
    assert [(r.decision_time_ms, r.used_timebank) for r in got] == [(5000, True), (None, False)]


def test_showdown_gate():
    gate, st = steps.ShowdownGate(), {"memory": None}
    base = {"hand_id": 1, "board": "2c,3d,4h,5s,9c", "live_seats": 2, "is_hero": False, "hash_distance": 9, "brightness": 200.0,
            "texture": 70.0, "conf1": 0.95, "conf2": 0.95}
    n = [0]

    def show(seat, c1, c2, **over):
        n[0] += 2_000_000
        return gate(st, {**base, "seat": seat, "card1": c1, "card2": c2, "at": n[0], **over})[0]["reason"]

    assert show(1, "2c", "Kd") == "gate6c_on_board"
    assert show(1, "2c", "Kd") == "gate6c_on_board"
    assert show(1, "2c", "Kd") == "gate6b_repeated"
    assert show(2, "As", "Kd") == "accepted" and show(2, "As", "Kd") == "already_accepted"
    assert show(3, "As", "Qd") == "gate6c_other_seat" and show(3, "Qd", "Qd") == "gate6a_same_card"
    assert show(4, "Jd", "Th", conf1=0.5) == "gate5_low_conf" and show(4, "Jd", None) == "incomplete"
    assert show(4, "Jd", "Th", at=n[0]) == "throttled" and show(5, "Jd", "Th", brightness=80.0) == "dark_cards_area"
    assert show(5, "Jd", "Th", texture=20.0) == "uniform_back" and show(5, "Jd", "Th", hash_distance=5) == "no_overlay"
    assert show(5, "Jd", "Th", live_seats=1) == "gate2_live" and show(5, "Jd", "Th", board="2c,3d") == "gate1_board"
    assert show(5, "Jd", "Th", is_hero=True) == "hero_seat" and show(3, "As", "Qd", hand_id=2) == "accepted"


@pytest.mark.parametrize("path,states,legal", [
    (["active", "folded", "new_hand"], ["active", "folded", "active"], [True] * 3),
    (["folded", "active"], ["folded", "active"], [True, True]),
    (["sitting_out", "folded", "all_in"], ["sitting_out"] * 3, [True, False, False]),
    (["active", "empty", "leaving", "empty"], ["active", "active", "leaving", "empty"], [True, False, True, True]),
])
def test_seat_lifecycle(path, states, legal):
    st, rule = {"seat_state": None}, steps.SeatLifecycle()
    got = [rule(st, {"target": p})[0] for p in path]
    assert [g["effective_state"] for g in got] == states and [g["legal"] for g in got] == legal


def test_phase_order():
    nxt = derive.phase_transitions()
    assert nxt["preflop_acting"] == ["dealing_flop", "settling"] and nxt["settling"] == ["between_hands"]
    assert nxt["showdown"] == ["settling"] and len(nxt) == 12


def test_segment_rules():
    rule = steps.Segment()
    st = dict.fromkeys(["hero", "hero2", "board", "pot", "peak"])
    feed = [("hero", None, 0, None), ("hero", None, 0b111, None), ("hero", None, (1 << 12) - 1, None), ("community", 3.0, None, None),
            ("community", 0.0, None, None), ("pot", 100.0, None, None), ("pot", 85.0, None, None), ("pot", 40.0, None, None),
            ("pot", 40.0, None, "总底池 40"), ("pot", 60.0, None, None)]
    got = [rule(st, {"kind": k, "value": v, "phash": p, "text": t})[0] for k, v, p, t in feed]
    assert [g["boundary"] for g in got] == [None, None, "hero_change", None, "community_reset", None, None, None, "pot_label", None]
    assert [g["pot_latest"] for g in got][5:] == [100.0, 100.0, 100.0, 40.0, 60.0]


def test_health_warning_payload(spark):
    h = spark.createDataFrame([(1, T0)], "id bigint, started_at timestamp")
    ev = events(spark, [{"hand_id": 1, "action": "fold", "override_reason": "x", "conf": 0.5} for _ in range(12)])
    d = spark.createDataFrame([(None, "t", "WARN", "{}", T0)] * 21, S.DIAGNOSTICS)
    out = {r.tag: r.payload for r in health.health_warnings(h, ev, d, as_of=T0 + timedelta(minutes=10)).collect()}
    assert set(out) == {"health.low_hand_rate", "health.override_spike", "health.diag_burst", "health.stack_ocr_degraded"}
    assert '"rate_pct":100.0' in out["health.override_spike"]
    empty = health.health_warnings(h.limit(0), ev.limit(0), d.limit(0), as_of=T0).collect()
    assert [r.tag for r in empty] == ["health.low_hand_rate"]


def test_drift_of_a_group_with_itself(spark):
    rows = [(i, g, float(i * 3 % 256), float(i * 5 % 256), float(i * 7 % 256)) for i in range(200) for g in "xy"]
    df = spark.createDataFrame(rows, "sample_id int, grp string, r double, g double, b double")
    row = evaluation.drift_report(df, groups=("x", "y"), max_per_group=150).first()
    assert (row.chi_square, row.mean_distance, row.verdict, row.a_n) == (0.0, 0.0, "match", 150)


def test_two_hero_cards():
    rule = steps.Segment()
    st = dict.fromkeys(["hero", "hero2", "board", "pot", "peak"])
    far = (1 << 20) - 1
    feed = [(0, None), (0, 0), (1, 3), (0, far), (0, far), (far, far), (far, None), (far, 0)]
    got = [rule(st, {"kind": "hero", "value": None, "phash": a, "phash2": b})[0]["boundary"] for a, b in feed]
    assert got == [None, None, None, "hero_change", None, "hero_change", None, "hero_change"]
