"""The players' cached statistics, kept by period and merged.

A hand belongs to the period in which it started, so per player and period everything the cache needs is a
sum, distinct hands included.  A refresh reads and replaces the periods it is told of; the cache is the sum
over all periods.  Replacing a period is idempotent: a replay, or late events of an old hand, recompute it whole.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railbird.functions.semantics import count_if, int_pct, pct, round_half_away
from railbird.operators.decisions import STATS, flagged_decisions, hand_flags, seen_showdowns

#: A hand's events may last this long beyond the period in which it started.
LONGEST_HAND = timedelta(days=1)
_BASE = ["n_hands", "vpip", "pfr", "aggr", "passive"]
_ENDS = ["n_saw_flop", "n_showdowns", "n_decided", "n_won"]
_SITUATIONS = [f"{s}_{k}" for s in STATS for k in ("opp", "did")]


def period_of(ts: str, unit: str = "day"):
    return F.to_date(F.date_trunc(unit, ts))


def period_states(hands: DataFrame, events: DataFrame, *, unit: str = "day") -> DataFrame:
    """player_name, period, the sums of the period's hands and last_seen.

    Three sums of their own, each by player and period before they meet.
    """
    periods = hands.select(F.col("id").alias("hand_id"), period_of("started_at", unit).alias("period"))
    keys = ["player_name", "period"]
    flags = hand_flags(events, "player_name", also=[
        count_if(F.col("action_type").isin("bet", "raise")).alias("aggr"),
        count_if(F.col("action_type") == "call").alias("passive"), F.max("timestamp").alias("seen")])
    base = flags.join(periods, "hand_id").groupBy(*keys).agg(
        F.count("*").alias("n_hands"), *[F.sum(c).cast("bigint").alias(c) for c in _BASE[1:]], F.max("seen").alias("last_seen"))
    situations = flagged_decisions(events).join(periods, "hand_id").groupBy(*keys).agg(*[F.sum(c).alias(c) for c in _SITUATIONS])
    ends = seen_showdowns(hands, events).join(periods, "hand_id")
    went, known = F.col("shown").isNotNull(), F.col("winner").isNotNull()
    ends = ends.groupBy(*keys).agg(
        F.count("*").alias("n_saw_flop"), count_if(went).alias("n_showdowns"), count_if(went & known).alias("n_decided"),
        count_if(went & (F.col("winner") == F.col("player_name"))).alias("n_won"))
    both = base.unionByName(situations, allowMissingColumns=True).unionByName(ends, allowMissingColumns=True)
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (*_BASE, *_SITUATIONS, *_ENDS)]
    return both.groupBy(*keys).agg(*sums, F.max("last_seen").alias("last_seen"))


def write_states(states: DataFrame, path: str) -> None:
    """Replaces the periods of ``states`` and no others."""
    (states.repartition("period").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("period").parquet(path))


def refresh(hands: DataFrame, events: DataFrame, path: str, *, since: datetime, until: datetime, unit: str = "day") -> None:
    """Recomputes the periods from ``since`` to before ``until`` (both period borders), reading their hands and events alone."""
    own = hands.where((F.col("started_at") >= F.lit(since)) & (F.col("started_at") < F.lit(until)))
    near = events.where((F.col("timestamp") >= F.lit(since)) & (F.col("timestamp") < F.lit(until + LONGEST_HAND)))
    near = near.join(own.select(F.col("id").alias("hand_id")), "hand_id", "left_semi")
    write_states(period_states(own, near, unit=unit), path)


def merged_cache(states: DataFrame, *, as_of: datetime) -> DataFrame:
    """One row per player: the statistics of ``decisions.stats_cache``, last_updated and stats_json (the sums behind the rates)."""
    c = F.col
    sums = states.groupBy("player_name").agg(*[F.sum(x).alias(x) for x in (*_BASE, *_SITUATIONS, *_ENDS)], F.max("last_seen").alias("last_seen"))
    rates = [pct(c(f"{s}_did"), c(f"{s}_opp")).alias(name) for s, name in STATS.items()]
    return sums.where("n_hands > 0").select(
        "player_name", c("n_hands").alias("total_hands"), int_pct(c("vpip"), c("n_hands")).cast("double").alias("vpip"),
        int_pct(c("pfr"), c("n_hands")).cast("double").alias("pfr"), round_half_away(F.try_divide("aggr", "passive"), 2).alias("af"), *rates,
        pct(c("n_showdowns"), c("n_saw_flop")).alias("wtsd_pct"), pct(c("n_won"), c("n_decided")).alias("wsd_pct"),
        F.lit(as_of).cast("timestamp").alias("last_updated"),
        F.to_json(F.struct(*_BASE, *_ENDS, *_SITUATIONS, "last_seen")).alias("stats_json"))
