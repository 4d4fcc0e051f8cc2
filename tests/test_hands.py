"""Hands, names and posts out of a small feed, read by read."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from railbird import schemas as S
from railbird.operators import hands as H

T0 = datetime(2024, 1, 1)
SCHEMA = "table_id string, tick long, ts timestamp, seat int, kind string, text string, value double, phash long"


def at(n):
    return T0 + timedelta(seconds=n)


def row(tick, kind, seat=None, text=None, value=None, phash=None, table="T"):
    return (table, tick, at(tick), seat, kind, text, value, phash)


FEED = [
    # Hand 0: no button is read; seat 0 has an avatar but no name, seat 1 a name, seat 2 only an action word.
    row(1, "id", 0, "", phash=7), row(1, "id", 1, "ann", phash=1), row(1, "id", 2, "CALL"), row(2, "community", value=0.0),
    row(3, "stack", 1, value=100.0), row(4, "action", 1, "RAISE 10"), row(5, "stack", 1, value=90.0), row(6, "pot", value=12.0),
    row(7, "showdown_card", 1, "Ah,Kd"), row(8, "community", value=3.0),
    # Hand 1: the board is gone.  The button is at seat 0, blinds lie before seats 1 and 2; seat 1 is read as bob, which a lock keeps out.
    row(10, "community", value=0.0), row(10, "button", 0, "D", 120.0), row(10, "amount", 1, "$1"), row(10, "amount", 2, "$2"),
    row(10, "id", 1, "bob", phash=1), row(10, "id", 0, "cy", phash=7), row(11, "hero", text="Qs,Qd"), row(11, "stack", 1, value=80.0),
    row(12, "action", 1, "CALL 2"), row(13, "community", value=4.0),
    # Hand 2 is open: another avatar sits at seat 1.
    row(20, "community", value=0.0), row(20, "id", 1, "bob", phash=-1), row(20, "button", 1, "d", 100.0), row(21, "action", 2, "FOLD"),
]


def made(spark, rows=FEED):
    return H.feed_hands(spark.createDataFrame(rows, SCHEMA).repartition(3), pot_label=None, num_seats=6, width="10 seconds")


def test_hands_of_a_feed(spark):
    feed = made(spark)
    hands = {r.id: r for r in feed.hands.collect()}
    assert feed.hands.columns == [f.name for f in spark.createDataFrame([], S.HANDS).schema]
    assert {i: (h.started_at, h.ended_at, h.button_seat_index) for i, h in hands.items()} == {
        "T-0": (at(1), at(8), 0), "T-1": (at(10), at(13), 0), "T-2": (at(20), None, 1)}
    zero, one, two = (hands[f"T-{n}"] for n in range(3))
    assert zero.stacks_initial == {"1": 100.0} and zero.stacks_final == {"1": 90.0} and zero.pot_size_final == 12.0
    assert zero.showdown_cards == {"1": ["Ah", "Kd"]} and one.hero_cards == ["Qs", "Qd"] and one.showdown_cards is None
    assert zero.seats["SB"] == "ann" and zero.seats["BB"] == "Player_2" and zero.seats["BTN"].startswith("TempUser_")
    assert one.seats["BTN"] == "cy" and one.seats["SB"] == "ann" and two.seats["BTN"] == "bob" and two.seats["CO"] == "cy"
    assert (one.blind_sb, one.blind_bb, zero.blind_sb, one.num_seats) == (1.0, 2.0, None, 6)


def test_names_are_dated(spark):
    got = sorted((r.seat, r.player_name[:8], r.since, r.until) for r in made(spark).names.collect())
    assert got == [(0, "TempUser", at(1), at(10)), (0, "cy", at(10), None), (1, "ann", at(1), at(20)), (1, "bob", at(20), None)]


def test_events_are_numbered_behind_real_posts(spark):
    feed = made(spark)
    posts = {(r.hand_id, r.action_type): r.skip_reason for r in H.feed_posts(feed).collect()}
    assert posts == {("T-0", None): "blind_level_missing", ("T-1", "post_sb"): None, ("T-1", "post_bb"): "player_unknown", ("T-2", None): "blind_level_missing"}
    got = {r.hand_id: [] for r in feed.hands.select(F.col("id").alias("hand_id")).collect()}
    for r in H.feed_events(feed, width="10 seconds").orderBy("hand_id", "sequence_number").collect():
        got[r.hand_id].append((r.sequence_number, r.player_name, r.position, r.action_type, r.raw.synthetic))
    assert got == {"T-0": [(1, "ann", "SB", "raise", False)], "T-1": [(1, "ann", "SB", "post_sb", True), (2, "ann", "SB", "call", False)],
                   "T-2": [(1, "Player_2", "SB", "fold", False)]}


def test_empty_seats_are_not_read(spark):
    rows = [*FEED, row(10, "id", 4, "", phash=0), row(11, "action", 4, "RAISE 9"), row(10, "id", 3, "eve", phash=99), row(10, "id", 5, "", phash=99), row(12, "action", 3, "FOLD")]
    feed = made(spark, rows)
    assert sorted((r.hand_id, r.seat, r.reason[:9]) for r in feed.empty.collect()) == [("T-1", 3, "duplicate"), ("T-1", 4, "avatar_ze"), ("T-1", 5, "duplicate")]
    got = [(r.player_name, r.action_type) for r in H.feed_events(feed, width="10 seconds").where("hand_id = 'T-1'").orderBy("sequence_number").collect()]
    assert got == [("ann", "post_sb"), ("ann", "call")]


def test_no_readings(spark):
    feed = made(spark, [])
    assert feed.hands.count() == feed.seats.count() == feed.names.count() == H.feed_events(feed).count() == 0
