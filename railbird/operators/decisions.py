"""Player statistics from one shared decision table.

A decision is one voluntary action with what the player knew at that moment.
It is flagged once for every statistic (``*_opp``, ``*_did``); all statistics
of all players are then sums of flags in a single aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railbird import schemas as S
from railbird.functions.semantics import chain, count_if, flag, int_pct, pct, round_half_away
from railbird.operators.hand_audits import showdown_by_seat
from railbird.operators.player_audits import (
    AGGRESSIVE, VOLUNTARY, hand_deltas, hand_flags, insurance_stats, position_matrix, timing_stats,
)

# Statistic -> cache column
STATS = {
    "three_bet": "three_bet_pct", "fold_to_three_bet": "fold_to_three_bet_pct", "steal": "ats",
    "call_open": "call_open_pct", "cbet": "cbet_pct", "fold_to_cbet": "fold_to_cbet_pct",
    "raise_cbet": "raise_cbet_pct", "double_barrel": "double_barrel_pct",
    "check_raise": "check_raise_pct", "donk_bet": "donk_bet_pct",
}
STEAL_SEATS = ["CO", "BTN", "SB"]


def decision_table(events: DataFrame) -> DataFrame:
    """One row per voluntary action with its context.

    The windows go from the hand to its streets to its players, so the shuffle
    on ``hand_id`` made for the first one serves them all.
    """
    acts = events.where(~F.col("action_type").isin([*S.POSTS, "post_ante"])).select(
        "hand_id", "sequence_number", "player_name", "position", "street", "action_type", "amount",
        "timestamp", F.col("raw.stack_before").alias("stack_before"), F.col("raw.pot_after").alias("pot_after"),
    )
    aggressive = F.col("action_type").isin(AGGRESSIVE)
    street_is = lambda s: F.col("street") == s

    hand = Window.partitionBy("hand_id")
    last_raise = F.max(F.when(street_is("preflop") & aggressive, F.struct("sequence_number", "player_name")))
    acts = acts.withColumn("preflop_aggressor", last_raise.over(hand)["player_name"])

    seq = Window.partitionBy("hand_id", "street").orderBy("sequence_number")
    before = seq.rowsBetween(Window.unboundedPreceding, -1)
    who = F.when(aggressive, F.col("player_name"))
    seen = lambda cond: F.coalesce(F.sum(flag(cond)).over(before), F.lit(0))
    acts = acts.select(
        "*",
        seen(aggressive).alias("raises_before"), seen(F.col("action_type") == "call").alias("calls_before"),
        seen(F.col("action_type").isin(VOLUNTARY)).alias("entries_before"),
        seen(F.col("player_name") == F.col("preflop_aggressor")).alias("aggressor_acts_before"),
        F.first(who, ignorenulls=True).over(before).alias("first_aggressor"),
        F.last(who, ignorenulls=True).over(before).alias("last_aggressor"),
        F.max(F.when(aggressive, F.col("amount"))).over(before).alias("to_call"),
    )
    own = Window.partitionBy("hand_id", "street", "player_name").orderBy("sequence_number")
    mine = F.lag(F.struct("action_type", "raises_before")).over(own)
    acts = acts.select("*", mine["action_type"].alias("own_prev_action"), mine["raises_before"].alias("own_prev_raises"))
    did_cbet = (
        street_is("flop") & (F.col("player_name") == F.col("preflop_aggressor")) & aggressive
        & (F.col("raises_before") == 0) & F.col("own_prev_action").isNull()
    )
    return acts.select("*", F.max(flag(did_cbet)).over(hand).alias("flop_cbet"))


def _conditions() -> dict[str, tuple[Column, Column]]:
    c = F.col
    action, raises = c("action_type"), c("raises_before")
    raising, aggressive = action.isin("raise", "all_in"), action.isin(AGGRESSIVE)
    pre, flop, turn = (c("street") == s for s in ("preflop", "flop", "turn"))
    first_move = c("own_prev_action").isNull()
    is_pfa = c("player_name") == c("preflop_aggressor")
    others_bet = c("last_aggressor") != c("player_name")
    facing_open = pre & (raises == 1) & others_bet
    facing_cbet = (
        flop & (raises == 1) & (c("first_aggressor") == c("preflop_aggressor")) & ~is_pfa
        & (c("flop_cbet") == 1) & (first_move | (c("own_prev_raises") == 0))
    )
    reraised = (
        pre & (raises >= 2) & c("own_prev_action").isin(AGGRESSIVE) & (c("own_prev_raises") == 0) & others_bet
    )
    return {
        "three_bet": (facing_open, raising),
        "fold_to_three_bet": (reraised, action == "fold"),
        "steal": (pre & c("position").isin(STEAL_SEATS) & (c("entries_before") == 0) & first_move, aggressive),
        "call_open": (facing_open, action == "call"),
        "cbet": (flop & is_pfa & (raises == 0) & first_move, aggressive),
        "fold_to_cbet": (facing_cbet, action == "fold"),
        "raise_cbet": (facing_cbet, raising),
        "double_barrel": (turn & is_pfa & (c("flop_cbet") == 1) & (raises == 0) & first_move, aggressive),
        "check_raise": ((c("own_prev_action") == "check") & (raises >= 1) & others_bet, raising),
        "donk_bet": (flop & ~is_pfa & (raises == 0) & (c("aggressor_acts_before") == 0) & first_move, aggressive),
    }


def flagged_decisions(events: DataFrame) -> DataFrame:
    out = []
    for name, (opp, did) in _conditions().items():
        out += [flag(opp).alias(f"{name}_opp"), flag(opp & did).alias(f"{name}_did")]
    return decision_table(events).select("*", *out)


def situation_counts(events: DataFrame) -> DataFrame:
    """Opportunities and actions per player for every situational statistic."""
    sums = [F.sum(f"{s}_{k}").alias(f"{s}_{k}") for s in STATS for k in ("opp", "did")]
    return flagged_decisions(events).groupBy("player_name").agg(*sums)


def vpip_pfr_af(events: DataFrame) -> DataFrame:
    per_hand = hand_flags(events, "player_name", also=[
        count_if(F.col("action_type").isin("bet", "raise")).alias("aggr"),
        count_if(F.col("action_type") == "call").alias("passive"),
        F.count("*").alias("acts"), F.max("timestamp").alias("seen"),
    ])
    hands = F.count("hand_id")
    return per_hand.groupBy("player_name").agg(
        hands.alias("n_hands"), int_pct(F.sum("vpip"), hands).alias("vpip_pct"),
        int_pct(F.sum("pfr"), hands).alias("pfr_pct"),
        round_half_away(F.try_divide(F.sum("aggr"), F.sum("passive")), 2).alias("af"),
        F.sum("acts").alias("n_actions"), F.max("seen").alias("last_seen"))


def three_bet(events: DataFrame) -> DataFrame:
    return situation_counts(events).select(
        "player_name", F.col("three_bet_opp").alias("n_3bet_opps"), F.col("three_bet_did").alias("n_3bet_actual"),
        pct(F.col("three_bet_did"), F.col("three_bet_opp")).alias("three_bet_pct"))


def situation_rates(events: DataFrame) -> DataFrame:
    """Every situational rate with both of its counts."""
    rates = [pct(F.col(f"{s}_did"), F.col(f"{s}_opp")).alias(col) for s, col in STATS.items()]
    return situation_counts(events).select("*", *rates)


def position_stats(events: DataFrame) -> DataFrame:
    return position_matrix(events).select(
        "player_name", "position", F.col("vpip_pct").alias("vpip_pct_at_pos"),
        F.col("pfr_pct").alias("pfr_pct_at_pos"), F.col("hands").alias("n_hands_at_pos"))


def winnings_summary(hands: DataFrame, events: DataFrame, *, split: Column | None = None) -> DataFrame:
    """Net result per player in chips and in big blinds per hundred hands."""
    blinds = hands.select(F.col("id").alias("hand_id"), "blind_bb")
    rebuy, delta = F.col("classification") == "REBUY", F.col("delta_chips")
    in_bb = F.when(~rebuy, F.try_divide(delta, F.col("blind_bb")))
    per_player = hand_deltas(events, split=split).join(blinds, "hand_id", "left").groupBy("player_name").agg(
        F.count("*").alias("n_hands"), F.coalesce(F.sum(F.when(~rebuy, delta)), F.lit(0.0)).alias("sum_winnings"),
        F.coalesce(F.sum(F.when(rebuy, delta)), F.lit(0.0)).alias("sum_buyins_inferred"),
        round_half_away(F.avg(in_bb) * 100, 2).alias("bb_per_100"))
    payouts = insurance_stats(hands).select("player_name", F.col("bought_insurance").alias("n"))
    return per_player.join(payouts, "player_name", "left").select(
        "player_name", "n_hands", "sum_winnings", "sum_buyins_inferred", "bb_per_100",
        F.coalesce("n", F.lit(0)).alias("n_insurance_payouts"))


def insurance_full(hands: DataFrame, confirmed: DataFrame | None = None) -> DataFrame:
    """Insurance inferred from stacks beside insurance confirmed by another source
    (``player_name, all_in_hands, bought_insurance``), where there is one."""
    mine = insurance_stats(hands).select(
        "player_name", F.col("all_in_hands").alias("a1"), F.col("bought_insurance").alias("bought_insurance_inferred"))
    if confirmed is None:
        both = mine.withColumns({"a2": F.lit(None).cast("bigint"),
                                 "bought_insurance_confirmed": F.lit(None).cast("bigint")})
    else:
        theirs = confirmed.select("player_name", F.col("all_in_hands").alias("a2"),
                                  F.col("bought_insurance").alias("bought_insurance_confirmed"))
        both = mine.join(theirs, "player_name", "full_outer")
    yes, guess = F.col("bought_insurance_confirmed"), F.col("bought_insurance_inferred")
    return both.select(
        "player_name", F.coalesce("a2", "a1").alias("all_in_hands"), "bought_insurance_confirmed",
        "bought_insurance_inferred", pct(yes, F.col("a2")).alias("insurance_buy_rate_confirmed_pct"),
        pct(guess, F.col("a1")).alias("insurance_buy_rate_inferred_pct"), (yes == guess).alias("signals_agree"))


def seen_showdowns(hands: DataFrame, events: DataFrame) -> DataFrame:
    """hand_id, player_name, shown (1 where the player showed) and winner of everyone who saw a flop."""
    saw = events.where(F.col("street").isin("flop", "turn", "river")).select("hand_id", "player_name").distinct()
    shown = showdown_by_seat(hands).select("hand_id", "player_name", F.lit(1).alias("shown")).distinct()
    winners = hands.where(F.col("winner_player_name").isNotNull()).select(
        F.col("id").alias("hand_id"), F.col("winner_player_name").alias("winner"))
    return saw.join(shown, ["hand_id", "player_name"], "left").join(winners, "hand_id", "left")


def showdown_rates(hands: DataFrame, events: DataFrame) -> DataFrame:
    """Went to showdown after seeing a flop, and won there where the winner is known."""
    went = F.col("shown").isNotNull()
    return seen_showdowns(hands, events).groupBy("player_name").agg(
        F.count("*").alias("n_saw_flop"), count_if(went).alias("n_showdowns"),
        count_if(went & F.col("winner").isNotNull()).alias("n_decided"),
        count_if(went & (F.col("winner") == F.col("player_name"))).alias("n_won"),
    ).select(
        "*", pct(F.col("n_showdowns"), F.col("n_saw_flop")).alias("wtsd_pct"),
        pct(F.col("n_won"), F.col("n_decided")).alias("wsd_pct"))


def stats_cache(hands: DataFrame, events: DataFrame) -> DataFrame:
    """One row per player with every cached statistic."""
    rates = situation_rates(events).select("player_name", *STATS.values())
    ends = showdown_rates(hands, events).select("player_name", "wtsd_pct", "wsd_pct")
    base = vpip_pfr_af(events).select(
        "player_name", F.col("n_hands").alias("total_hands"), F.col("vpip_pct").cast("double").alias("vpip"),
        F.col("pfr_pct").cast("double").alias("pfr"), "af")
    return base.join(rates, "player_name", "left").join(ends, "player_name", "left")


DIMENSIONS = ["stack_depth", "players_in_pot", "position_vs", "board_texture", "bet_size_bucket"]


def _situation_dimensions(decisions: DataFrame, hands: DataFrame) -> DataFrame:
    from railbird.functions.actions import board_texture

    facts = hands.select(
        F.col("id").alias("hand_id"), F.coalesce("blind_bb", F.lit(1.0)).alias("bb"), F.size("seats").alias("n_seats"),
        board_texture(F.slice(F.try_element_at("community_cards", F.lit("turn")), 1, 3)).alias("bt"))
    folded = Window.partitionBy("hand_id").orderBy("sequence_number").rowsBetween(Window.unboundedPreceding, -1)
    out = F.coalesce(F.sum(flag(F.col("action_type") == "fold")).over(folded), F.lit(0))
    rows = decisions.withColumn("folds_before", out).join(facts, "hand_id", "left")
    depth = F.try_divide(F.col("stack_before"), F.col("bb"))
    live = F.col("n_seats") - F.col("folds_before")
    size = F.try_divide(F.col("to_call"), F.col("pot_after"))
    rank = F.create_map(*[x for i, p in enumerate(S.POSTFLOP_ORDER) for x in (F.lit(p), F.lit(i))])
    last = F.try_element_at(rank, F.col("position"))
    return rows.select(
        "*",
        chain((depth.isNull(), "unknown"), (depth < 40, "short"), (depth < 100, "medium"), default="deep")
        .alias("stack_depth"),
        chain((live.isNull(), "unknown"), (live <= 2, "heads_up"), default="multiway").alias("players_in_pot"),
        chain((last.isNull(), "unknown"), (last >= 7, "IP"), default="OOP").alias("position_vs"),
        chain((F.col("bt.wet").isNull(), "none"), (F.col("bt.wet"), "wet"), default="dry").alias("board_texture"),
        chain((size.isNull(), "none"), (size < 0.4, "small"), (size < 0.8, "medium"), default="large")
        .alias("bet_size_bucket"))


def situational_stats(hands: DataFrame, events: DataFrame, *, min_sample: int = 1) -> DataFrame:
    """Every statistic by the five situation dimensions: all of them, each alone, and overall.

    Rows are summed at the finest grain first; the grouping sets then expand
    those few sums, not the decisions.
    """
    rows = _situation_dimensions(flagged_decisions(events), hands)
    # Chances and takes are summed side by side; only these sums become rows of their own.
    sums = [F.sum(F.when(F.col(f"{s}_opp") == 1, F.col(f"{s}_{x}"))).alias(f"{s}_{x}") for s in STATS for x in ("opp", "did")]
    wide = rows.groupBy("player_name", *DIMENSIONS).agg(*sums)
    stats = F.array(*[
        F.struct(F.lit(s).alias("stat_type"), F.col(f"{s}_did").alias("did"), F.col(f"{s}_opp").alias("n")) for s in STATS])
    fine = wide.select("player_name", *DIMENSIONS, F.inline(F.filter(stats, lambda s: s["n"] > 0)))
    keys = [F.col("player_name"), F.col("stat_type")]
    dims = [F.col(d) for d in DIMENSIONS]
    sets = [[*keys, *dims], *[[*keys, d] for d in dims], keys]
    level = F.grouping_id(*keys, *dims)
    grouped = fine.groupingSets(sets, *keys, *dims).agg(
        F.sum("did").alias("did"), F.sum("n").alias("sample_size"), level.alias("level"))
    entries = F.filter(
        F.array(*[F.struct(F.lit(d).alias("key"), F.col(d).alias("value")) for d in DIMENSIONS]),
        lambda e: e["value"].isNotNull())
    return grouped.where(F.col("sample_size") >= min_sample).select(
        "player_name", "stat_type", F.map_from_entries(entries).alias("dimensions"),
        round_half_away(F.try_divide("did", "sample_size"), 4).alias("value"), "sample_size")


def last_hands(events: DataFrame, *, lookback: int = 50) -> DataFrame:
    """Only the events of each player's newest ``lookback`` hands.

    A row-number limit is applied before the shuffle as well as after it, so a
    player with very many hands sends at most ``lookback`` rows per task.
    """
    hands = events.groupBy("player_name", "hand_id").agg(F.max("timestamp").alias("seen"))
    newest = Window.partitionBy("player_name").orderBy(F.desc_nulls_last("seen"), F.desc("hand_id"))
    keep = hands.withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= lookback)
    return events.join(keep.select("player_name", "hand_id"), ["player_name", "hand_id"], "left_semi")


def live_seats(hands: DataFrame, cache: DataFrame, timing: DataFrame) -> DataFrame:
    """The seats of every table's latest hand with each player's profile."""
    latest = hands.groupBy("table_name").agg(
        F.max_by(F.struct("id", "started_at", "seats"), F.struct("started_at", "id")).alias("h"))
    seats = latest.select("table_name", F.col("h.id").alias("hand_id"), "h.started_at",
                          F.explode("h.seats").alias("position", "player_name"))
    return (
        seats.join(cache.select("player_name", "total_hands", "vpip", "pfr", "af"), "player_name", "left")
        .join(timing.select("player_name", "snap_pct"), "player_name", "left"))


def live_table(hands: DataFrame, events: DataFrame) -> DataFrame:
    """The live seats with profiles; only events of players who are seated are summed up."""
    latest = hands.groupBy("table_name").agg(F.max_by("seats", F.struct("started_at", "id")).alias("seats"))
    seated = latest.select(F.explode(F.map_values("seats")).alias("player_name")).distinct()
    events = events.join(seated, "player_name", "left_semi")
    base = vpip_pfr_af(events).select(
        "player_name", F.col("n_hands").alias("total_hands"), F.col("vpip_pct").alias("vpip"),
        F.col("pfr_pct").alias("pfr"), "af")
    return live_seats(hands, base, timing_stats(events))
