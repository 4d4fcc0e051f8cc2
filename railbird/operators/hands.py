"""Hands out of observations: who sat where, with what, from when, and the two versions of every hand.

All functions take ``rows``, the result of ``observed.observed_hands``.  A hand starts with its first reading; what
is read of a seat first in a hand is its start, what is read last its end.  The open hand of a table has no end version.

Kinds read here beside those of the events: ``id`` (a seat's name in ``text``, its avatar in ``phash``), ``button``
(``text`` and brightness in ``value``), ``amount`` (chips in front of a seat, ``text``), ``hero`` and ``community``
(cards in ``text``, comma separated) and ``showdown_card`` (a seat's cards in ``text``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railbird.functions import actions as A
from railbird.functions import steps
from railbird.functions.ordered import running, shifted, time_split
from railbird.operators import derive as D
from railbird.operators import observed
from railbird.session import written
from railbird.sources.tables import current_hands

NUM_SEATS = 9
_STATE = ["button_seat_index", "num_seats", "blind_sb", "blind_bb", "stacks_initial", "stacks_final", "showdown_cards"]


def name_intervals(rows: DataFrame, *, width: str | None = D.WIDTH) -> DataFrame:
    """From when to when a seat had which name: table_id, seat, player_name, since, since_tick, until (none: still).

    A name that has changed within a session so is dated; the readings themselves are not needed any more.
    """
    text = A.clean("text")
    readable = F.when((text != "") & A.action_of(text).isNull(), text)
    ids = rows.where(F.col("kind") == "id").select("table_id", "seat", "ts", "tick", "phash", readable.alias("readable"))
    named = D.apply_step(ids, ["table_id", "seat"], ["ts", "tick", "readable", "phash"], steps.SeatName(), width=width)
    changes = named.where("renamed").select("table_id", "seat", "player_name", F.col("ts").alias("since"), F.col("tick").alias("since_tick"))
    split = None if width is None else time_split("since", width)
    return shifted(changes, ["table_id", "seat"], ["since", "since_tick"], {"until": F.col("since")}, split=split, forward=True)


def hand_starts(rows: DataFrame) -> DataFrame:
    """hand_id, table_id, hand_no, started_at, start_tick, last_at and whether the hand is over, one row each."""
    at = F.struct("ts", "tick")
    hands = rows.groupBy("hand_id", "table_id", "hand_no").agg(F.min(at).alias("a"), F.max("ts").alias("last_at"))
    newest = hands.groupBy("table_id").agg(F.max("hand_no").alias("newest"))
    return hands.join(newest, "table_id").select(
        "hand_id", "table_id", "hand_no", F.col("a.ts").alias("started_at"), F.col("a.tick").alias("start_tick"), "last_at",
        (F.col("hand_no") < F.col("newest")).alias("over"))


def hand_buttons(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """hand_id, button_seat_index and button_detection_method; a hand without readings has the fallback."""
    readings = rows.where(F.col("kind") == "button").select("hand_id", "seat", "tick", "text", F.col("value").alias("brightness"))
    found = D.button_choice(readings)
    return starts.select("hand_id").join(found, "hand_id", "left").select(
        "hand_id", F.coalesce("button_seat_index", F.lit(0)).cast("int").alias("button_seat_index"),
        F.coalesce("button_detection_method", F.lit("L3-fallback")).alias("button_detection_method"))


def hand_seats(
    starts: DataFrame, buttons: DataFrame, names: DataFrame, *, num_seats: int = NUM_SEATS, width: str | None = D.WIDTH,
) -> DataFrame:
    """hand_id, table_id, seat, player_name (none where unknown) and position of every seat at the start of every hand.

    The name is the one whose interval holds the hand's first tick: starts and changes are laid in one order, and every
    start takes the last change before it, over splits of ``width``, so that no seat's whole session is one task.
    """
    seats = starts.select(
        "table_id", F.explode(F.sequence(F.lit(0), F.lit(num_seats - 1))).alias("seat"), F.col("started_at").alias("ts"),
        F.col("start_tick").alias("tick"), F.lit(1).alias("rank"), "hand_id", F.lit(None).cast("string").alias("name"))
    changes = names.select(
        "table_id", "seat", F.col("since").alias("ts"), F.col("since_tick").alias("tick"), F.lit(0).alias("rank"),
        F.lit(None).cast("string").alias("hand_id"), F.col("player_name").alias("name"))
    split = None if width is None else time_split("ts", width)
    known = running(seats.unionByName(changes), ["table_id", "seat"], ["ts", "tick", "rank"], {"player_name": ("last", F.col("name"))}, split=split)
    known = known.where("rank = 1").join(buttons.select("hand_id", "button_seat_index"), "hand_id")
    position = A.seat_position(F.col("seat"), F.col("button_seat_index"), F.lit(num_seats))
    return known.select("hand_id", "table_id", "seat", "player_name", position.alias("position"))


def _cards(text: Column) -> Column:
    return F.filter(F.split(text, ","), lambda c: c != "")


def hand_versions(
    rows: DataFrame, starts: DataFrame, buttons: DataFrame, seats: DataFrame, *, num_seats: int = NUM_SEATS,
) -> DataFrame:
    """The rows that a hand's start and end would append: id, version, table_name, started_at, hero_cards, seats,
    community_cards, ended_at, pot_size_final and raw_data (button, blinds, stacks, shown cards).

    ``sources.tables.current_hands`` merges them; version 2 comes with the hand's end only.
    """
    at = F.struct("ts", "tick")
    pick = lambda kind, value: F.when(F.col("kind") == kind, value)
    facts = rows.groupBy("hand_id").agg(
        F.min_by(pick("hero", F.col("text")), pick("hero", at)).alias("hero"),
        F.max_by("pot_after", F.when(F.col("pot_after").isNotNull(), at)).alias("pot_size_final"),
        F.min_by("street", at).alias("first_street"))

    stacks = D.cleaned_stacks(rows.select("hand_id", "seat", "ts", "tick", "kind", "value"), ["hand_id", "seat"], width=None).where("stack is not null and seat is not null")
    stacks = stacks.groupBy("hand_id", "seat").agg(F.min_by("stack", at).alias("a"), F.max_by("stack", at).alias("z"))
    shown = rows.where((F.col("kind") == "showdown_card") & (F.size(_cards(F.col("text"))) == 2)).groupBy("hand_id", "seat").agg(
        F.min_by(_cards(F.col("text")), at).alias("cards"))
    filled = lambda k, v: F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(k).cast("string").alias("k"), F.col(v).alias("v")))))
    stacks = stacks.groupBy("hand_id").agg(filled("seat", "a").alias("stacks_initial"), filled("seat", "z").alias("stacks_final"))
    shown = shown.groupBy("hand_id").agg(filled("seat", "cards").alias("showdown_cards"))
    boards = rows.where((F.col("kind") == "community") & (F.col("text") != "")).select("hand_id", "ts", "tick", _cards(F.col("text")).alias("cards"))
    boards = D.board_by_street(boards, ["hand_id"]).groupBy("hand_id").agg(filled("street", "cards").alias("community_cards"))

    named = seats.where("position is not null").withColumn("who", F.coalesce("player_name", F.concat(F.lit("Player_"), F.col("seat").cast("string"))))
    named = named.groupBy("hand_id").agg(filled("position", "who").alias("seats"))
    sized = starts.join(buttons, "hand_id").join(facts, "hand_id").withColumn("num_seats", F.lit(num_seats))
    chips = rows.where((F.col("kind") == "amount") & (F.col("street") == "preflop")).select("hand_id", "seat", "tick", "text")
    blinds = D.blind_levels(sized.select(
        F.col("hand_id").alias("id"), "button_seat_index", "num_seats", (F.col("first_street") != "preflop").alias("board_dealt")), chips)

    whole = sized.join(blinds.select("hand_id", "blind_sb", "blind_bb"), "hand_id", "left")
    for part in (stacks, shown, boards, named):
        whole = whole.join(part, "hand_id", "left")
    end = F.col("version") == 2
    only_end = lambda c: F.when(end, F.col(c)).alias(c)
    versions = F.explode(F.when(F.col("over"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("version")
    return whole.select("*", versions).select(
        F.col("hand_id").alias("id"), "version", F.col("table_id").alias("table_name"), "started_at", _cards(F.col("hero")).alias("hero_cards"), "seats",
        only_end("community_cards"), F.when(end, F.col("last_at")).alias("ended_at"), only_end("pot_size_final"),
        F.struct(*[only_end(c) if c in ("stacks_final", "showdown_cards") else F.col(c) for c in _STATE]).alias("raw_data"))


def hands_of(versions: DataFrame) -> DataFrame:
    """The typed hands (``schemas.HANDS``) of their versions."""
    blank = lambda kind, name: F.lit(None).cast(kind).alias(name)
    insurance = "array<struct<seat:int,player_name:string,stack_initial:double,stack_final:double,gain:double,pot:double,premium_inferred:double,classification:string>>"
    return current_hands(versions).select(
        "id", "table_name", "started_at", "ended_at", "pot_size_final", "hero_cards", "community_cards", "seats",
        *[F.col(f"raw_data.{c}").alias(c) for c in ("stacks_initial", "stacks_final", "showdown_cards", "button_seat_index", "num_seats", "blind_sb", "blind_bb")],
        blank("string", "winner_player_name"), blank(insurance, "insurance_inferred"))


def hand_empty_seats(rows: DataFrame) -> DataFrame:
    """hand_id, seat and reason of the seats nobody sits at, by each hand's first avatar and stack readings (``derive.empty_seats``)."""
    at = F.struct("ts", "tick")
    first = lambda kind, c: F.min_by(F.when(F.col("kind") == kind, c), F.when((F.col("kind") == kind) & c.isNotNull(), at))
    shown = F.coalesce(F.col("text"), F.col("value").cast("string"))
    readings = rows.where(F.col("kind").isin("id", "stack") & F.col("seat").isNotNull()).groupBy("hand_id", "seat").agg(
        first("id", F.col("phash")).alias("phash"), first("stack", shown).alias("stack_text"))
    return D.empty_seats(readings).select("hand_id", "seat", "reason")


@dataclass(frozen=True)
class Hands:
    """The hands of a feed and what they were made from."""

    rows: DataFrame
    names: DataFrame
    seats: DataFrame
    empty: DataFrame
    hands: DataFrame


def feed_hands(
    observations: DataFrame, *, num_seats: int = NUM_SEATS, pot_label: str | None = steps.POT_LABEL, width: str = D.WIDTH, merge: bool = False,
) -> Hands:
    """The hands of a feed, with names and positions as of every hand's start.

    ``merge``: the feed has ``fold`` and ``amount`` readings to be merged first (``derive.seat_readings``).
    """
    if merge:
        observations = D.seat_readings(observations)
    rows = observed.observed_hands(observations, pot_label=pot_label, width=width)
    starts = written(hand_starts(rows))
    buttons = written(hand_buttons(rows, starts))
    names = written(name_intervals(rows, width=width))
    seats = written(hand_seats(starts, buttons, names, num_seats=num_seats, width=width))
    empty = written(hand_empty_seats(rows))
    return Hands(rows, names, seats, empty, hands_of(hand_versions(rows, starts, buttons, seats, num_seats=num_seats)))


def feed_posts(made: Hands) -> DataFrame:
    """The forced posts of a feed's hands.  A post needs a seat that is taken and a name that was read; ``hands.seats`` also lists stand-ins."""
    read = made.seats.where("player_name is not null and position is not null").groupBy("hand_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("position").alias("k"), F.col("player_name").alias("v"))))).alias("read"))
    hands = made.hands.join(read, made.hands["id"] == read["hand_id"], "left").withColumn("seats", F.col("read"))
    empty = made.empty.groupBy("hand_id").agg(F.collect_list("seat").alias("empty_seats"))
    hands = hands.drop("read", "hand_id").join(empty, F.col("id") == empty["hand_id"], "left").drop("hand_id")
    return D.blind_posts(hands)


def feed_events(made: Hands, *, debounce_s: float = steps.DEBOUNCE_SECONDS, width: str = D.WIDTH) -> DataFrame:
    """The posts and the scored events of a feed; events are numbered behind the posts that their hand really has.

    Empty seats are not read: neither posts nor events come from them.
    """
    posts = written(feed_posts(made))
    posted = posts.where("skip_reason is null").groupBy("hand_id").agg(F.count("*").cast("int").alias("posted"))
    taken = made.rows.join(made.empty.select("hand_id", "seat"), ["hand_id", "seat"], "left_anti").select(*made.rows.columns)
    events = observed.events_of(taken, seats=made.seats, posted=posted, debounce_s=debounce_s, width=width)
    return D.post_events(posts).unionByName(events, allowMissingColumns=True)
