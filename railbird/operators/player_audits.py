"""Per-player profiles: insurance habits, timing, net result, position matrix.

A single player may own a large share of all rows.  Every aggregate below is
reduced on a finer key first (player and hand, player and value), and the one
ordered step runs per player and hour.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railbird import schemas as S
from railbird.functions.ordered import shifted, time_split
from railbird.functions.semantics import (
    chain, count_if, flag, int_pct, named_player, pct, round_half_away, to_int,
)

VOLUNTARY = ["call", "bet", "raise", "all_in"]
AGGRESSIVE = ["bet", "raise", "all_in"]


def insurance_stats(hands: DataFrame) -> DataFrame:
    """How often a player buys insurance when all in."""
    each = hands.select(F.explode("insurance_inferred").alias("i")).select("i.player_name", "i.classification")
    of = lambda kind: count_if(F.col("classification") == kind)
    return (
        each.where(named_player()).groupBy("player_name")
        .agg(
            F.count("*").alias("all_in_hands"), of("insurance_payout").alias("bought_insurance"),
            of("lost_no_insurance").alias("lost_no_ins"), of("rebuy").alias("rebuy"),
            pct(of("insurance_payout"), F.count("*")).alias("insurance_buy_rate_pct"),
        )
        .orderBy(F.desc("all_in_hands"))
    )


def timing_stats(events: DataFrame, *, min_timed: int = 3, snap_ms: int = 3000) -> DataFrame:
    """Decision times per player.

    Counted per (player, milliseconds) first: distinct decision times are
    bounded, so a player with any number of events arrives at the second step
    as a short weighted list, from which median and spread are exact.
    """
    ms, n = F.col("ms"), F.col("n")
    counted = (
        events.where(named_player())
        .select("player_name", F.col("raw.decision_time_ms").alias("ms"), F.col("raw.used_timebank").alias("tb"))
        .groupBy("player_name", "ms").agg(F.count("*").alias("n"), count_if(F.col("tb")).alias("n_tb"))
    )
    wide = "decimal(38,0)"
    timed = F.when(ms.isNotNull(), n)
    total = F.sum(ms.cast(wide) * timed.cast("decimal(18,0)"))
    squares = F.sum((ms * ms).cast("decimal(20,0)") * timed.cast("decimal(18,0)"))
    stats = counted.groupBy("player_name").agg(
        F.coalesce(F.sum(timed), F.lit(0)).alias("n_timed"), total.cast("double").alias("total"),
        squares.cast("double").alias("squares"),
        F.expr("percentile(ms, 0.5, n)").alias("median"),
        F.sum(F.when(ms < snap_ms, n).otherwise(0)).alias("n_snap"),
        F.sum("n_tb").alias("n_timebank"),
    )
    k = F.col("n_timed")
    variance = F.try_divide(F.col("squares") - F.col("total") * F.col("total") / k, k - 1)
    return (
        stats.where(k >= min_timed)
        .select(
            "player_name", "n_timed", round_half_away(F.col("total") / k).alias("avg_ms"),
            round_half_away("median").alias("median_ms"),
            round_half_away(F.sqrt(F.greatest(variance, F.lit(0.0)))).alias("std_ms"),
            "n_snap", "n_timebank", pct(F.col("n_snap"), k).alias("snap_pct"),
            pct(F.col("n_timebank"), k).alias("timebank_pct"),
        )
        .orderBy(F.desc("n_timed"))
    )


def _last_stacks(events: DataFrame) -> DataFrame:
    known = events.where(F.col("raw.stack_after").isNotNull())
    # Two plain columns rather than one struct: the aggregation can stay hashed.
    last = lambda c: F.max_by(c, "sequence_number")
    return known.groupBy("player_name", "hand_id").agg(
        last("timestamp").alias("timestamp"), last(F.col("raw.stack_after")).alias("stack_after"))


def hand_deltas(events: DataFrame, *, split: Column | None = None) -> DataFrame:
    """Change of a player's stack from one hand to the next, with rebuys told apart."""
    split = time_split("timestamp") if split is None else split
    linked = shifted(_last_stacks(events), ["player_name"], ["timestamp", "hand_id"],
                     {"prev_hand_stack": F.col("stack_after")}, split=split)
    delta = F.col("stack_after") - F.col("prev_hand_stack")
    whole = to_int(delta)
    return linked.where(F.col("prev_hand_stack").isNotNull()).select(
        "player_name", "hand_id", "timestamp", "stack_after", "prev_hand_stack", delta.alias("delta_chips"),
        chain(
            ((delta > 50) & ((whole % 50 == 0) | whole.isin(S.WINNINGS_PRESETS)), "REBUY"),
            (F.abs(delta) <= 10, "OK"), default="NORMAL",
        ).alias("classification"),
    )


def net_winnings(events: DataFrame, *, split: Column | None = None, player_column: str = "玩家") -> DataFrame:
    rebuy = F.col("classification") == "REBUY"
    delta = F.col("delta_chips")
    return (
        hand_deltas(events, split=split).groupBy(F.col("player_name").alias(player_column))
        .agg(
            F.count("*").alias("hands_traced"), count_if(rebuy).alias("rebuy_count"),
            round_half_away(F.coalesce(F.sum(F.when(rebuy, delta)), F.lit(0.0))).alias("rebuy_total"),
            round_half_away(F.sum(F.when(~rebuy, delta))).alias("net_excl_rebuy"),
            round_half_away(F.sum(delta)).alias("net_naive"),
            round_half_away(F.min("stack_after")).alias("min_stack"),
            round_half_away(F.max("stack_after")).alias("max_stack"),
        )
        .orderBy(F.desc_nulls_last("net_excl_rebuy"))
    )


def hand_flags(events: DataFrame, *keys: str, also: list[Column] | None = None) -> DataFrame:
    """One row per (keys, hand): did the player put chips in, did they raise, before the flop."""
    preflop = F.col("street") == "preflop"
    return events.groupBy(*keys, "hand_id").agg(
        F.max(flag(preflop & F.col("action_type").isin(VOLUNTARY))).alias("vpip"),
        F.max(flag(preflop & F.col("action_type").isin(AGGRESSIVE))).alias("pfr"),
        *(also or []),
    )


def position_matrix(events: DataFrame) -> DataFrame:
    seated = events.where(F.col("position").isNotNull())
    return hand_flags(seated, "player_name", "position").groupBy("player_name", "position").agg(
        F.count("hand_id").alias("hands"),
        int_pct(F.sum("vpip"), F.count("hand_id")).alias("vpip_pct"),
        int_pct(F.sum("pfr"), F.count("hand_id")).alias("pfr_pct"),
    )
