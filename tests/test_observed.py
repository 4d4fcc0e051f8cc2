"""One short hand through the whole flow."""

import random
from datetime import datetime, timedelta

from railbird.operators import derive
from railbird.operators.observed import observed_events
from railbird.sources import tables
from railbird.sources.tables import skipped, trusted

T0 = datetime(2024, 1, 1)


def test_hand_from_observations(spark):
    o = lambda tick, seat, kind, text=None, value=None: ("T", tick, T0 + timedelta(seconds=tick), seat, kind, text, value)
    rows = [
        o(1, None, "pot", "10", 10.0), o(1, 1, "stack", None, 100.0), o(1, 2, "stack", None, 200.0), o(1, None, "community", None, 0.0),
        o(2, 1, "stack", None, 9.0),                                        # a digit short: replaced
        o(3, None, "pot", "30", 30.0), o(3, 1, "action", "BET 20"), o(3, 1, "stack", None, 80.0),
        o(3, 2, "timer", None, 10.0), o(4, 2, "timer", None, 9.0),
        o(6, None, "pot", "50", 50.0), o(6, 2, "action", "CALL 20"), o(6, 2, "stack", None, 180.0),
        o(7, 2, "action", "CALL 20"),                                       # still on screen
        o(8, None, "community", None, 3.0),
        o(9, 1, "action", "CHECK"), o(9, 1, "stack", None, 20.0),           # chips moved: the text loses
        o(20, 2, "action", "RAISE 90"), o(20, 2, "stack", None, 180.0),     # nothing moved: not believed
        o(30, None, "community", None, 0.0), o(31, 1, "action", "CHECK"),
    ]
    obs = spark.createDataFrame(rows, "table_id string, tick int, ts timestamp, seat int, kind string, text string, value double")
    players = spark.createDataFrame([("T", 1, "Ann", "SB")], "table_id string, seat int, player_name string, position string")
    out = observed_events(obs, players=players, width="3 seconds")
    got = [(r.hand_id, r.sequence_number, r.player_name, r.street, r.action_type, r.amount, r.confidence_score,
            r.raw.stack_before, r.raw.stack_delta, r.raw.pot_delta, r.raw.decision_time_ms)
           for r in out.orderBy("hand_id", "sequence_number").collect()]
    assert got == [
        ("T-0", 3, "Ann", "preflop", "bet", 20.0, 1.0, 100.0, 20.0, 20.0, None),
        ("T-0", 4, "Player_2", "preflop", "call", 20.0, 1.0, 200.0, 20.0, 20.0, 3000),
        ("T-0", 5, "Ann", "flop", "bet", None, 0.7, 80.0, 60.0, 0.0, None),
        ("T-0", 6, "Player_2", "flop", "raise", 90.0, 0.3, 180.0, 0.0, 0.0, None),
        ("T-1", 3, "Ann", "preflop", "check", None, 0.85, None, None, None, None),
    ]
    assert trusted(out).count() == 4 and skipped(out).count() == 1


SCHEMA = "table_id string, tick int, ts timestamp, seat int, kind string, text string, value double"


def _o(table, tick, seat, kind, text=None, value=None, at=None):
    return (table, tick, T0 + timedelta(seconds=tick if at is None else at), seat, kind, text, value)


def _feed(table):
    return [
        _o(table, 1, None, "pot", "10", 10.0), _o(table, 1, None, "community", None, 0.0), _o(table, 1, 1, "stack", None, 100.0),
        _o(table, 1, 2, "stack", None, 200.0), _o(table, 1, 3, "stack", None, 50.0),
        _o(table, 20, 1, "action", "FOLD"), _o(table, 21, 2, "action", "CALL 20"), _o(table, 21, 2, "stack", None, 180.0),
        _o(table, 30, 3, "action", "ALL-IN 50"), _o(table, 30, 3, "stack", None, 0.0), _o(table, 40, 1, "action", "CALL 20"),
        _o(table, 50, 3, "action", "CHECK"), _o(table, 60, None, "community", None, 3.0), _o(table, 60, None, "pot", "90", 90.0),
        _o(table, 90, None, "community", None, 0.0), _o(table, 90, None, "pot", "5", 5.0), _o(table, 91, 1, "action", "CALL 20"),
    ]


def _events(spark, rows, **options):
    out = observed_events(spark.createDataFrame(rows, SCHEMA), pot_label=None, width="7 seconds", **options)
    return sorted((r.hand_id, r.sequence_number, r.player_name, r.action_type, r.amount) for r in out.collect())


def test_tables_do_not_silence_each_other(spark):
    one = _events(spark, _feed("A"))
    both = _events(spark, _feed("A") + _feed("B"))
    assert [e for e in both if e[0].startswith("A")] == one
    assert [(e[0].replace("B", "A"), *e[1:]) for e in both if e[0].startswith("B")] == one


def test_seats_that_are_out_are_not_read(spark):
    legacy, attention = _events(spark, _feed("A")), _events(spark, _feed("A"), attention=True)
    assert [(e[2], e[3]) for e in legacy if e[0] == "A-0"] == [
        ("Player_1", "fold"), ("Player_2", "call"), ("Player_3", "all_in"), ("Player_3", "check")]
    assert [(e[2], e[3]) for e in attention if e[0] == "A-0"] == [("Player_1", "fold"), ("Player_2", "call"), ("Player_3", "all_in")]
    assert [e[2] for e in legacy if e[0] == "A-1"] == ["Player_1"]


def test_input_order_and_missing_times_change_nothing(spark):
    rows = _feed("A")
    want = _events(spark, rows)
    lost = ("A", 33, None, 2, "action", "RAISE 99", None)
    shuffled = rows[::-1] + [lost]
    random.Random(3).shuffle(shuffled)
    assert _events(spark, shuffled) == want


def test_own_events_can_be_read_back(spark, tmp_path):
    out = observed_events(spark.createDataFrame(_feed("A"), SCHEMA), pot_label=None)
    tables.write_routed(out, str(tmp_path))
    kept = tables.read_table(spark, str(tmp_path), "action_events")
    low = tables.read_table(spark, str(tmp_path), "diagnostic_events")
    assert kept.count() + low.count() == out.count() and kept.count() > 0
    assert {r.hand_id for r in kept.collect()} <= {"A-0", "A-1"}


def test_rounds_do_not_follow_the_feed(spark):
    """A periodic feed of any length takes the same number of jobs."""
    def jobs_of(n):
        rows = [("p", "s", "call", i, T0 + timedelta(seconds=i)) for i in range(n)]
        df = spark.createDataFrame(rows, "player_name string, street string, action_type string, id int, ts timestamp")
        group = f"fold-{n}"
        spark.sparkContext.setJobGroup(group, group)
        got = derive.debounced(df, seconds=7, width="1 minute").where("accepted").count()
        spark.sparkContext.setJobGroup("", "")
        assert got == -(-n // 7)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs_of(300) == jobs_of(3000)
