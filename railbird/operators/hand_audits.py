"""Checks over whole hands: chips, durations, cards, seats, rake.

Maps are summed, filtered and matched inside the row with higher-order
functions, so apart from the two cross-hand checks nothing here shuffles.
``ordered`` adds the display order; it costs a range shuffle of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railbird import schemas as S
from railbird.functions.ordered import shifted, time_split
from railbird.functions.semantics import (
    chain, count_if, lookup, map_total, newest_first, round_half_away, seconds_between, shanghai, to_int,
)

HAND_ORDER = ["started_at", "id"]


def _with_stack_totals(hands: DataFrame, *keep: Column | str) -> DataFrame:
    both = F.col("stacks_initial").isNotNull() & F.col("stacks_final").isNotNull()
    return hands.where(both).select(
        F.col("id").alias("hand_id"), *keep, F.col("pot_size_final").alias("pot"),
        map_total("stacks_initial").alias("sum_init"), map_total("stacks_final").alias("sum_final"),
    )


def hand_conservation(hands: DataFrame) -> DataFrame:
    """Chips that left all stacks, against what rake can explain."""
    moved = F.col("sum_init") - F.col("sum_final")
    pot = F.col("pot")
    return (
        _with_stack_totals(hands, shanghai("started_at").alias("started_cn"))
        .withColumn("chip_movement", moved)
        .withColumn("status", chain(
            (pot.isNull() | (pot == 0), "NULL_POT"),
            (moved.between(F.lit(-10), pot * 0.10 + 30), "OK"),
            default="CHECK_REQUIRED",
        ))
        .select("hand_id", "started_cn", "pot", "sum_init", "sum_final", "chip_movement", "status")
    )


def hand_duration_sanity(hands: DataFrame, *, ordered: bool = False) -> DataFrame:
    secs = seconds_between("started_at", "ended_at")
    done = hands.where(F.col("ended_at").isNotNull())
    if ordered:
        done = done.orderBy(newest_first("started_at"))
    return done.select(
        F.col("id").alias("hand_id"),
        shanghai("started_at").alias("started_cn"),
        (F.col("ended_at") - F.col("started_at")).alias("duration"),
        to_int(secs).cast("int").alias("dur_sec"),
        F.col("pot_size_final").alias("pot"),
        chain((secs < 10, "TOO_FAST"), (secs > 300, "TOO_SLOW"), default="OK").alias("status"),
    )


def stack_continuity(
    hands: DataFrame, *, split: Column | None = None, per_table: bool = False, ordered: bool = False,
) -> DataFrame:
    """Final stacks of a hand against the initial stacks of the next one.

    Hands without finals are left out before looking ahead.  By default "next"
    is over all hands, whatever the table, as the audited rule has it.
    """
    split = time_split("started_at") if split is None else split
    finals = hands.where(F.col("stacks_final").isNotNull()).select(
        "id", "table_name", "started_at", "stacks_initial", "stacks_final")
    ahead = shifted(
        finals, ["table_name"] if per_table else [], HAND_ORDER,
        {"next_hand_id": F.col("id"), "next_init": F.col("stacks_initial")},
        split=split, forward=True,
    )
    seats = ahead.where(F.col("next_init").isNotNull()).select(
        F.col("id").alias("hand_id"), "next_hand_id", "started_at", "next_init",
        F.explode("stacks_final").alias("seat", "stack_final_n"),
    )
    nxt = F.try_element_at("next_init", F.col("seat"))
    delta = nxt - F.col("stack_final_n")
    if ordered:
        seats = seats.orderBy(newest_first("started_at"), "seat")
    return seats.select(
        "hand_id", "next_hand_id", shanghai("started_at").alias("hand_ts"), "seat", "stack_final_n",
        nxt.alias("stack_initial_n_plus_1"), delta.alias("delta"),
        chain(
            (nxt.isNull(), "absent_in_next"),
            (F.abs(delta) <= 50, "OK"),
            ((delta > 50) & ((to_int(delta) % 50 == 0) | nxt.isin(S.CONTINUITY_PRESETS)), "rebuy"),
            default="CHECK_REQUIRED",
        ).alias("status"),
    )


def stack_cross_hand(
    hands: DataFrame, *, split: Column | None = None, per_table: bool = False,
) -> DataFrame:
    """Initial stacks of a hand against the finals of the one before it, over
    all hands; a predecessor without finals hides the hand."""
    split = time_split("started_at") if split is None else split
    cols = hands.select("id", "table_name", "started_at", "stacks_initial", "stacks_final", "pot_size_final")
    behind = shifted(
        cols, ["table_name"] if per_table else [], HAND_ORDER,
        {"prev_hand_id": F.col("id"), "prev_final": F.col("stacks_final")}, split=split,
    )
    seats = behind.where(F.col("prev_final").isNotNull()).select(
        F.col("id").alias("hand_id"), "prev_hand_id", "prev_final", "pot_size_final",
        F.explode("stacks_initial").alias("seat_idx", "this_init_stack"),
    )
    prev = F.try_element_at("prev_final", F.col("seat_idx"))
    delta = F.col("this_init_stack") - prev
    pot = F.col("pot_size_final")
    loss_floor = -F.greatest(F.lit(30.0), pot * 0.10)
    return seats.select(
        "hand_id", "prev_hand_id", "seat_idx", prev.alias("prev_final_stack"), "this_init_stack",
        delta.alias("delta"), F.greatest(F.lit(2.0), pot * 0.05 + 30).alias("tolerance_rake_aware"),
        chain(
            (prev.isNull(), "no_prev_data"),
            (F.abs(delta) <= 2, "continuous"),
            (delta.between(loss_floor, F.lit(-2)), "rake_or_noise_loss"),
            (delta > 100, "rebuy_or_topup"),
            (delta > 2, "small_increase_unusual"),
            default="discontinuity_check",
        ).alias("status"),
        F.lit(0.8).alias("joint_confidence"),
    )


def _rake(hands: DataFrame) -> DataFrame:
    rake, pot = F.col("sum_init") - F.col("sum_final"), F.col("pot")
    return _with_stack_totals(hands, "table_name").select(
        "*", rake.alias("rake_observed"),
        F.when(pot.isNull() | (pot == 0), None).otherwise(F.try_divide(rake, pot)).alias("rake_pct"),
        chain(
            (pot.isNull(), "no_pot"),
            (rake < -10, "rebuy_likely"),
            ((pot > 0) & (rake > pot * 0.10 + 30), "rake_high"),
            (F.abs(rake) <= 10, "no_flop_no_drop_or_tiny"),
            default="normal_rake",
        ).alias("status"),
    )


def rake_observed(hands: DataFrame) -> DataFrame:
    return _rake(hands).select("hand_id", "pot", "sum_init", "sum_final", "rake_observed", "rake_pct", "status")


def rake_baseline(hands: DataFrame, *, min_hands: int = 20) -> DataFrame:
    """Typical rake per table over hands with an ordinary rake.

    The status selects inside the aggregates: as a filter it would be pushed
    below the projection and all sums worked out again for it.
    """
    normal = F.col("status") == "normal_rake"
    share = F.when(normal, F.col("rake_pct"))
    return (
        _rake(hands).groupBy("table_name")
        .agg(
            count_if(normal).alias("n_normal_hands"),
            round_half_away(F.avg(share), 4).alias("avg_rake_pct"),
            round_half_away(F.stddev_samp(share), 4).alias("std_rake_pct"),
            F.max(F.when(normal, F.col("rake_observed"))).alias("max_rake_observed"),
        )
        .where(F.col("n_normal_hands") >= min_hands)
    )


def showdown_physical_check(hands: DataFrame, *, ordered: bool = False) -> DataFrame:
    """Shown cards that cannot be real: a pair of the same card, or a card that
    another seat of the hand shows too."""
    seats = hands.where(F.col("showdown_cards").isNotNull()).select(
        F.col("id").alias("hand_id"), "showdown_cards", F.explode("showdown_cards").alias("seat_idx", "cards"),
    )
    if ordered:
        seats = seats.orderBy("hand_id", F.col("seat_idx").try_cast("int"))
    same = F.get("cards", F.lit(0)) == F.get("cards", F.lit(1))
    others = F.size(F.filter(
        F.map_entries("showdown_cards"),
        lambda e: (e["key"] != F.col("seat_idx")) & F.arrays_overlap(e["value"], F.col("cards")),
    ))
    return seats.select(
        "hand_id", "seat_idx", "cards", same.alias("gate6a_same_pair"),
        F.lit(None).cast("array<string>").alias("community_final"),
        others.cast("bigint").alias("cross_seat_dup_count"),
        (others + F.when(same, 1).otherwise(0)).cast("bigint").alias("violation_count"),
    )


def card_uniqueness(hands: DataFrame, *, street: str = "turn") -> DataFrame:
    """Every card of a hand with where it was seen.

    A hand is one row, so its cards are gathered and counted inside the row.
    """
    def tagged(cards: Column, source: str) -> Column:
        pairs = F.transform(cards, lambda c: F.struct(c.alias("card"), F.lit(source).alias("source")))
        return F.coalesce(pairs, F.array().cast("array<struct<card:string,source:string>>"))

    gathered = F.concat(
        tagged(F.col("hero_cards"), "hero"),
        tagged(F.try_element_at("community_cards", F.lit(street)), "community"),
        tagged(F.flatten(F.map_values("showdown_cards")), "showdown"),
    )
    per_card = (
        hands.select(F.col("id").alias("hand_id"), gathered.alias("seen"))
        .select("hand_id", "seen", F.explode(F.array_distinct("seen.card")).alias("card"))
    )
    hits = F.filter("seen", lambda s: s["card"] == F.col("card"))
    return (
        per_card.select("hand_id", "card", hits.alias("hits"))
        .select(
            "hand_id", "card", F.size("hits").cast("bigint").alias("occurrences"),
            F.array_sort("hits.source").alias("sources"),
            F.when(F.size("hits") > 1, "duplicate_violation").otherwise("unique").alias("status"),
        )
    )


def postflop_order(hands: DataFrame, *, ordered: bool = False) -> DataFrame:
    seats = hands.select(F.col("id").alias("hand_id"), F.explode("seats").alias("position", "player_name"))
    rank = {p: i + 1 for i, p in enumerate(S.POSTFLOP_ORDER)}
    out = seats.withColumn("post_flop_order", F.try_element_at(lookup(rank), F.col("position")))
    return out.orderBy("hand_id", F.col("post_flop_order").asc_nulls_last()) if ordered else out


def showdown_flag(hands: DataFrame) -> DataFrame:
    """One row per shown seat.  A hand that shows nothing has no row at all."""
    return hands.select(
        F.col("id").alias("hand_id"), F.col("showdown_cards").isNotNull().alias("has_showdown"),
        F.explode(F.map_keys("showdown_cards")).alias("showdown_seat"),
    )


def showdown_by_seat(hands: DataFrame, *, seat_map: str = "fixed") -> DataFrame:
    """Shown seats mapped to position and player by their distance from the button.

    ``seat_map="by_size"`` uses the seat mapper's table for the hand's own size
    instead of the fixed nine-seat one.
    """
    size = F.coalesce("num_seats", F.lit(9))
    seats = hands.where(F.col("button_seat_index").isNotNull()).select(
        F.col("id").alias("hand_id"), "button_seat_index", size.alias("n"), "seats",
        F.explode("showdown_cards").alias("key", "cards"),
    ).withColumn("seat_idx", F.col("key").try_cast("int"))
    # The remainder keeps the sign of the dividend, as in the audited rule.
    offset = (F.col("seat_idx") - F.col("button_seat_index") + F.col("n")) % F.col("n")
    if seat_map == "by_size":
        tables = F.create_map(*[
            x for n, names in S.SEAT_OFFSETS.items() for x in (F.lit(n), F.array(*map(F.lit, names)))
        ])
        names = F.try_element_at(tables, F.col("n"))
    else:
        names = F.array(*map(F.lit, S.AUDIT_OFFSETS))
    out = (
        seats.withColumn("pos_offset", offset)
        .withColumn("position", F.when(F.col("pos_offset") >= 0, F.get(names, F.col("pos_offset"))))
        .withColumn("player_name", F.try_element_at("seats", F.col("position")))
    )
    return out.where(F.col("player_name").isNotNull()).select(
        "hand_id", "seat_idx", "pos_offset", "position", "cards", "player_name",
        F.lit(0.9).alias("joint_confidence"), F.lit("reach_showdown_all_streets_active").alias("implication"),
    )


def last_aggressor(hands: DataFrame) -> DataFrame:
    """The first shown seat (as text order has it) is taken for the last aggressor."""
    return hands.where(F.size("showdown_cards") > 0).select(
        F.col("id").alias("hand_id"),
        F.array_min(F.map_keys("showdown_cards")).alias("last_aggressor_seat_candidate"),
        F.lit(0.85).alias("joint_confidence"),
    )
