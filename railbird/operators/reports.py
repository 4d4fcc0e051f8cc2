"""Dashboard, review and ad-hoc report queries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railbird import schemas as S
from railbird.functions.semantics import (
    chain, count_if, lookup, named_player, named_player_prefix, newest_first, pct, round_half_away, to_int,
)
from railbird.operators.decisions import vpip_pfr_af
from railbird.operators.event_audits import handend_fold_inference
from railbird.operators.hand_audits import showdown_by_seat
from railbird.operators.player_audits import AGGRESSIVE, position_matrix

def _real(events: DataFrame) -> DataFrame:
    return events.where(~F.coalesce("raw.synthetic", F.lit(False)))


def total_hands(hands: DataFrame) -> DataFrame:
    return hands.agg(F.count("*").alias("n"))


def total_events(events: DataFrame) -> DataFrame:
    """Captured events; injected blind posts do not count."""
    return _real(events).agg(F.count("*").alias("n"))


def unique_players(events: DataFrame, *, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    return events.where(named_player()).agg(count("player_name").alias("n"))


def recent_hands(hands: DataFrame, events: DataFrame, *, limit: int = 20) -> DataFrame:
    """The newest hands with their number of events.

    The limit comes first, so only events of those few hands are counted.
    """
    newest = [newest_first("started_at"), F.desc("id")]
    top = hands.select("id", "started_at", "ended_at", "pot_size_final", "hero_cards").orderBy(*newest).limit(limit)
    ids = top.select(F.col("id").alias("hand_id"))
    counts = events.join(ids, "hand_id", "left_semi").groupBy("hand_id").agg(F.count("*").alias("n_events"))
    return (
        top.join(counts, top["id"] == counts["hand_id"], "left").drop("hand_id")
        .withColumn("n_events", F.coalesce("n_events", F.lit(0))).orderBy(*newest)
    )


def overall_stats(events: DataFrame) -> DataFrame:
    """Hands, entry rate, raise rate and aggression factor of every player."""
    stats = vpip_pfr_af(events)
    return stats.select(
        "player_name", F.col("n_hands").alias("hands"), F.col("vpip_pct").alias("vpip"),
        F.col("pfr_pct").alias("pfr"), "af")


# fixed values: labels and advice shown for each player type
PLAYER_TYPES = {
    "unknown": ("❓", "数据不足"),
    "whale": ("🐟 大鱼", "啥都跟,几乎不主动加,**狠 value**"),
    "maniac": ("🐗 Maniac", "啥都玩还猛加,**等好牌 trap**"),
    "lag": ("🦈 LAG 真凶", "范围广 + 主动施压,**惹不起,避开**"),
    "station": ("🐠 跟池站", "中等水货,**有牌就 value**"),
    "tag": ("🦅 TAG", "**职业型** — 范围紧 + 主动激进"),
    "nit": ("🪨 Nit/Rock", "极紧,**他 raise = 真品强牌,直接弃**"),
    "mixed": ("🤷 混合型", "stat 不极端,综合判断"),
}


def player_type(vpip: Column, pfr: Column, af: Column) -> Column:
    pfr, af = F.coalesce(pfr, F.lit(0)), F.coalesce(af, F.lit(0.0))
    return chain(
        (vpip.isNull(), "unknown"),
        ((vpip >= 70) & (af < 1), "whale"),
        (vpip >= 70, "maniac"),
        ((vpip >= 40) & (pfr >= 25) & (af > 1.5), "lag"),
        ((vpip >= 40) & (af < 1), "station"),
        (vpip.between(20, 35) & (pfr >= 15) & (af >= 1), "tag"),
        (vpip < 20, "nit"),
        default="mixed",
    )


def classified_players(events: DataFrame) -> DataFrame:
    kind = player_type(F.col("vpip"), F.col("pfr"), F.col("af"))
    labels = lookup({k: v[0] for k, v in PLAYER_TYPES.items()})
    advice = lookup({k: v[1] for k, v in PLAYER_TYPES.items()})
    return (
        overall_stats(events).withColumn("kind", kind)
        .select("player_name", "hands", "vpip", "pfr", "af", F.try_element_at(labels, F.col("kind")).alias("label"),
                F.try_element_at(advice, F.col("kind")).alias("advice"))
    )


def frequent_players(events: DataFrame, *, min_hands: int = 10) -> DataFrame:
    pairs = events.where(named_player_prefix()).select("player_name", "hand_id").distinct()
    return (
        pairs.groupBy("player_name").agg(F.count("hand_id").alias("hands"))
        .where(F.col("hands") >= min_hands).orderBy(F.desc("hands"), "player_name")
    )


def player_position_matrix(events: DataFrame, player: str) -> DataFrame:
    """One player's positions in page order; positions the page does not know come last, unnamed."""
    own = position_matrix(events.where(F.col("player_name") == player))
    rank = F.try_element_at(lookup({p: i for i, p in enumerate(S.PROFILE_POSITIONS)}), F.col("position"))
    return own.withColumn("rank", rank).orderBy(F.asc_nulls_last("rank"), "position").select(
        F.when(F.col("rank").isNotNull(), F.col("position")).alias("position"), "hands", "vpip_pct", "pfr_pct")


def street_actions(events: DataFrame, player: str | None = None) -> DataFrame:
    """Actions by street, one column per action; a street without any action keeps an empty row."""
    own = events if player is None else events.where(F.col("player_name") == player)
    counts = own.groupBy("street").pivot("action_type", S.ACTION_TYPES).agg(F.count(F.lit(1))).fillna(0)
    names = F.array(*map(F.lit, S.BETTING_STREETS))
    streets = events.sparkSession.range(len(S.BETTING_STREETS)).select(
        F.get(names, F.col("id").cast("int")).alias("street"), F.col("id").alias("ord"))
    return streets.join(counts, "street", "left").orderBy("ord").drop("ord")


def action_summary(events: DataFrame, *, min_events: int = 5, limit: int = 30) -> DataFrame:
    return (
        _real(events).where(named_player()).groupBy("player_name")
        .agg(
            F.count("*").alias("n_events"), count_if(F.col("action_type") == "fold").alias("n_fold"),
            count_if(F.col("action_type").isin(AGGRESSIVE)).alias("n_aggressive"),
        )
        .where(F.col("n_events") >= min_events).orderBy(F.desc("n_events"), "player_name").limit(limit)
    )


def latest_events(events: DataFrame, *, limit: int = 50) -> DataFrame:
    return events.select(
        "id", "player_name", "position", "action_type", "amount", "confidence_score",
        F.coalesce("timestamp", "created_at").alias("event_time"),
    ).orderBy(newest_first("event_time"), F.desc("id")).limit(limit)


def table_counts(hands: DataFrame, events: DataFrame, diagnostics: DataFrame) -> DataFrame:
    tables = [("hands", hands), ("action_events", events), ("diagnostic_events", diagnostics)]
    parts = [df.agg(F.count("*").cast("string").alias("n")).select(F.lit(name).alias("t"), "n") for name, df in tables]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def review_queue(events: DataFrame, *, threshold: float = 0.7, limit: int = 20) -> DataFrame:
    """The newest events that still need a reviewer."""
    return (
        events.where(F.col("confidence_score") < threshold)
        .select("id", "hand_id", "player_name", "position", "street", "action_type", "amount", "confidence_score",
                F.col("raw").alias("raw_data"), "timestamp")
        .orderBy(newest_first("timestamp"), F.desc("id")).limit(limit)
    )


def _within(ts: str, since: datetime | None, until: datetime | None) -> Column:
    cond = F.lit(True)
    if since is not None:
        cond = cond & (F.col(ts) >= F.lit(since))
    if until is not None:
        cond = cond & (F.col(ts) < F.lit(until))
    return cond


def confidence_buckets(
    events: DataFrame, *, since: datetime | None = None, until: datetime | None = None,
) -> DataFrame:
    return (
        events.where(_within("timestamp", since, until))
        .groupBy(round_half_away("confidence_score", 1).alias("conf_bucket"), "action_type")
        .agg(F.count("*").alias("n")).orderBy("conf_bucket", "action_type")
    )


def phase_means(
    diagnostics: DataFrame, phase: str, *, tag: str = "pipeline.tick_stats",
    since: datetime | None = None, until: datetime | None = None,
) -> DataFrame:
    """Mean duration and executions of one phase over the telemetry rows."""
    field = lambda name: F.try_variant_get("v", f"$.phases.{phase}.{name}", "double")
    rows = diagnostics.where((F.col("tag") == tag) & _within("occurred_at", since, until))
    return rows.select(F.try_parse_json("payload").alias("v")).agg(
        F.avg(field("avg_ms")).alias("avg_ms"), F.avg(to_int(field("exec_count"))).alias("exec_count"))


def fallback_counts(
    diagnostics: DataFrame, pattern: str = "pattern_d.ocr2_%", *,
    since: datetime | None = None, until: datetime | None = None,
) -> DataFrame:
    rows = diagnostics.where(F.col("tag").like(pattern) & _within("occurred_at", since, until))
    seat = F.try_variant_get(F.try_parse_json("payload"), "$.seat", "string")
    return rows.groupBy("tag").agg(F.count("*").alias("n"), F.count_distinct(seat).alias("distinct_seats"))


def showdown_coverage(hands: DataFrame, events: DataFrame) -> DataFrame:
    """How many seats a showdown hand shows on average."""
    shown = showdown_by_seat(hands).select("hand_id", "seat_idx").distinct().groupBy("hand_id").agg(
        F.count("*").alias("cards_captured"))
    finals = handend_fold_inference(hands, events).where("has_showdown").select("hand_id")
    return shown.join(finals, "hand_id").agg(
        F.count("*").alias("n_hands"), round_half_away(F.avg("cards_captured"), 4).alias("avg_cards_captured"))


def silent_fold_rate(
    hands: DataFrame, events: DataFrame, *, eras: list[tuple[str, datetime | None]] | None = None,
) -> DataFrame:
    """Share of folds nobody captured, by capture era and overall.

    ``eras`` lists (name, first moment) in time order; each lasts until the next.
    Eras are summed before they are rolled up, so the total costs nothing extra.
    """
    label = F.lit("all_time")
    for i, (name, since) in enumerate(eras or []):
        label = F.lit(name) if i == 0 else F.when(F.col("started_at") >= F.lit(since), name).otherwise(label)
    when = hands.select(F.col("id").alias("hand_id"), label.alias("era"))
    per_era = handend_fold_inference(hands, events).join(when, "hand_id").groupBy("era").agg(
        F.count("*").alias("hands"), F.sum("folds_captured").alias("captured"),
        F.sum("silent_folds_inferred").alias("silent"))
    total = per_era.rollup("era").agg(
        F.grouping("era").alias("is_total"), F.sum("hands").alias("hands"),
        F.sum("captured").alias("captured"), F.sum("silent").alias("silent"))
    return total.select(
        F.when(F.col("is_total") == 1, "overall").otherwise(F.col("era")).alias("era"), "hands", "captured",
        "silent", pct(F.col("silent"), F.col("captured") + F.col("silent")).alias("silent_pct"))
