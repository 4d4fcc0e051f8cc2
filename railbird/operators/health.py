"""Feed health and latency telemetry.  Time always comes in as ``as_of``."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railbird.functions.ordered import numbered, running, time_split
from railbird.functions.semantics import count_if, minutes, round_half_away

WINDOW_MINUTES = 30

#: What may be behind each warning; stored with it for whoever reads it.
HINTS = {
    "health.low_hand_rate": "feed stopped, or no table is playing",
    "health.conf_dropped": "readings got worse: check regions, fonts and the kind of table",
    "health.override_spike": "stacks contradict action texts unusually often: check both readers",
    "health.diag_burst": "many warnings and errors at once: look at the diagnostics of this window",
    "health.stack_ocr_degraded": "stacks are mostly unread: check the stack regions",
}


def health_metrics(
    hands: DataFrame, events: DataFrame, diagnostics: DataFrame, *, as_of: datetime,
    window_minutes: float = WINDOW_MINUTES,
) -> DataFrame:
    """All measures in one row, in one aggregation by hand and one over all.

    Hands, events and diagnostics are laid in one table of narrow rows, each with its own measures; those of
    a hand and its events meet under its id, already summed by every task, and diagnostics under none.
    """
    now = F.lit(as_of).cast("timestamp")
    since = now - minutes(window_minutes)
    c, zero = F.col, F.lit(0)
    id_type = hands.schema["id"].dataType
    bad = diagnostics.where(c("level").isin("WARN", "ERROR") & (c("occurred_at") > since))
    flags = lambda cond: F.when(cond, 1).otherwise(0)
    rows = hands.select(c("id").alias("hand_id"), c("started_at").alias("at"), F.lit(1).alias("hand"))
    rows = rows.unionByName(events.select(
        c("hand_id").cast(id_type).alias("hand_id"), F.lit(1).alias("n"), c("confidence_score").alias("conf"),
        flags(c("raw.override_reason").isNotNull()).alias("over"), flags(c("raw.stack_delta").isNull()).alias("no_delta")), allowMissingColumns=True)
    rows = rows.unionByName(bad.select(F.lit(1).alias("warned")), allowMissingColumns=True)
    per = rows.groupBy("hand_id").agg(
        F.max("at").alias("at"), F.sum("conf").alias("conf"), F.count("conf").alias("n_conf"),
        *[F.coalesce(F.sum(x), zero).alias(x) for x in ("hand", "n", "over", "no_delta", "warned")])
    # A hand without events still counts as a hand; events without a hand have no time.
    inside, older = c("at") > since, c("at") < since
    add = lambda x, cond: F.sum(F.when(cond, c(x)))
    count = lambda x: F.coalesce(add(x, inside), zero)
    return per.agg(
        count("hand").alias("hands_recent"), F.try_divide(add("conf", inside), add("n_conf", inside)).alias("recent_conf"),
        F.try_divide(add("conf", older), add("n_conf", older)).alias("historic_conf"), count("n").alias("events_recent"),
        count("over").alias("overridden_recent"), count("no_delta").alias("no_delta_recent"), F.coalesce(F.sum("warned"), zero).alias("warnings_recent"))


def health_warnings(
    hands: DataFrame, events: DataFrame, diagnostics: DataFrame, *, as_of: datetime,
    window_minutes: float = WINDOW_MINUTES,
) -> DataFrame:
    """Diagnostic rows for the checks that fail."""
    m = health_metrics(hands, events, diagnostics, as_of=as_of, window_minutes=window_minutes)
    c = F.col
    drop = F.try_divide((c("historic_conf") - c("recent_conf")) * 100, c("historic_conf"))
    rate = lambda part: F.try_divide(c(part) * 100.0, c("events_recent"))
    enough = c("events_recent") > 10

    def warn(tag: str, failed: Column, **payload: Column) -> Column:
        body = F.to_json(F.struct(*[v.alias(k) for k, v in payload.items()], F.lit(HINTS[tag]).alias("guess")))
        return F.when(failed, F.struct(F.lit(tag).alias("tag"), F.lit("WARN").alias("level"), body.alias("payload")))

    checks = F.array(
        warn("health.low_hand_rate", c("hands_recent") < 5, hands_last_30min=c("hands_recent"), threshold=F.lit(5)),
        warn("health.conf_dropped", (c("historic_conf") > 0) & (drop > 10),
             recent_avg_conf=round_half_away("recent_conf", 3), historic_avg_conf=round_half_away("historic_conf", 3),
             drop_pct=round_half_away(drop, 1)),
        warn("health.override_spike", enough & (rate("overridden_recent") > 10),
             recent_override_count=c("overridden_recent"), recent_total=c("events_recent"),
             rate_pct=round_half_away(rate("overridden_recent"), 1)),
        warn("health.diag_burst", c("warnings_recent") > 20, warn_error_count=c("warnings_recent"), threshold=F.lit(20)),
        warn("health.stack_ocr_degraded", enough & (rate("no_delta_recent") > 50),
             stack_null_count=c("no_delta_recent"), total=c("events_recent"),
             rate_pct=round_half_away(rate("no_delta_recent"), 1)),
    )
    failed = m.select(F.inline(F.filter(checks, lambda w: w.isNotNull())))
    return failed.select(
        F.lit(None).cast("string").alias("hand_id"), "tag", "level", "payload",
        F.lit(as_of).cast("timestamp").alias("occurred_at"))


def _batches(ticks: DataFrame, size: int, width: str) -> DataFrame:
    """Full batches of ``size`` consecutive ticks per session."""
    rows = numbered(ticks, ["session"], ["ts", "tick"], "rn", split=time_split("ts", width))
    return rows.withColumn("batch", F.floor((F.col("rn") - 1) / size)).drop("rn")


def tick_stats(ticks: DataFrame, *, size: int = 20, sleep_ms: float = 250.0, width: str = "1 hour") -> DataFrame:
    """Latency of every full batch of ticks (``session, tick, ts, tick_ms, db_ms``)."""
    sorted_of = lambda c: F.array_sort(F.collect_list(c))
    per = _batches(ticks, size, width).groupBy("session", "batch").agg(
        F.count("*").alias("n"), sorted_of("tick_ms").alias("t"), sorted_of("db_ms").alias("d"),
        F.avg("tick_ms").alias("avg"), F.avg("db_ms").alias("db_avg"))
    # Nearest rank, as the telemetry has it: element n/2 and element 0.95 n.
    at = lambda a, frac: F.get(a, F.floor(F.col("n") * frac).cast("int"))
    r1 = lambda c: round_half_away(c, 1)
    avg, db = F.col("avg"), F.col("db_avg")
    return per.where(F.col("n") == size).select(
        "session", "batch", "n", r1(F.get("t", F.lit(0))).alias("min_ms"), r1(at("t", 0.5)).alias("median_ms"),
        r1(at("t", 0.95)).alias("p95_ms"), r1(F.array_max("t")).alias("max_ms"), r1(avg).alias("avg_ms"),
        F.lit(sleep_ms).alias("sleep_ms"), round_half_away(F.lit(1000.0) / (avg + sleep_ms), 2).alias("effective_hz"),
        r1(db).alias("db_avg_ms"), r1(at("d", 0.5)).alias("db_median_ms"), r1(at("d", 0.95)).alias("db_p95_ms"),
        r1(F.array_max("d")).alias("db_max_ms"),
        F.when(avg > 0, r1(F.try_divide(db * 100, avg))).otherwise(0.0).alias("db_pct_of_tick"))


def phase_stats(ticks: DataFrame, *, size: int = 20, top: int | None = None, width: str = "1 hour") -> DataFrame:
    """Share of every phase in full batches (``phases`` map<string,double>); a phase
    that did not run in a tick counts as 0 there.  ``top`` keeps the largest shares."""
    rows = _batches(ticks, size, width)
    whole = F.struct(F.lit(None).cast("string").alias("key"), F.col("tick_ms").alias("value"))
    entries = F.concat(F.map_entries("phases"), F.array(whole))
    # The tick itself travels as the phase without a name.
    per = rows.select("session", "batch", F.inline(entries)).groupBy("session", "batch", "key").agg(
        F.sum("value").alias("total"), F.max("value").alias("max"), count_if(F.col("value") > 0).alias("exec_count"),
        F.count("*").alias("n"))
    item = F.struct("key", "total", "max", "exec_count")
    packed = per.groupBy("session", "batch").agg(
        F.max(F.when(F.col("key").isNull(), F.col("n"))).alias("n"),
        F.max(F.when(F.col("key").isNull(), F.col("total"))).alias("tick_total"),
        F.collect_list(F.when(F.col("key").isNotNull(), item)).alias("items"))
    share = F.when(F.col("tick_total") > 0, round_half_away(F.try_divide(F.col("total") * 100, F.col("tick_total")), 1)
                   ).otherwise(0.0)
    out = packed.where(F.col("n") == size).select("session", "batch", "tick_total", F.inline("items")).select(
        "session", "batch", F.col("key").alias("phase"), round_half_away(F.col("total") / size, 1).alias("avg_ms"),
        round_half_away("max", 1).alias("max_ms"), "exec_count", share.alias("pct_of_tick"))
    if top is None:
        return out
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("pct_of_tick")).alias("r"), "phase", "avg_ms", "max_ms",
                                                  "exec_count", "pct_of_tick")))
    return out.groupBy("session", "batch").agg(F.slice(ranked, 1, top).alias("t")).select(
        "session", "batch", F.inline("t")).drop("r")


def latency_summary(samples: DataFrame) -> DataFrame:
    """Min, nearest-rank median and p95, max and mean per label (``label, ms``).

    Equal times are counted before anything moves.  What is ordered per label is its
    different values with their counts, in blocks of equal width.
    """
    rows = samples.where(F.col("ms").isNotNull()).select("label", "ms")
    counts = rows.groupBy("label", "ms").agg(F.count("*").alias("n"))
    upto = running(counts, ["label"], ["ms"], {"upto": ("sum", F.col("n"))}, split=F.floor("ms").cast("bigint"))
    totals = counts.groupBy("label").agg(
        F.sum("n").alias("n_runs"), F.min("ms").alias("lo"), F.max("ms").alias("hi"),
        (F.sum(F.col("ms") * F.col("n")) / F.sum("n")).alias("mean"))
    rank = lambda p: F.least(F.floor(F.col("n_runs") * p), F.col("n_runs") - 1) + 1
    held = lambda p: (F.col("upto") - F.col("n") < rank(p)) & (rank(p) <= F.col("upto"))
    picks = upto.join(totals.select("label", "n_runs"), "label").groupBy("label").agg(
        F.max(F.when(held(0.5), F.col("ms"))).alias("median"), F.max(F.when(held(0.95), F.col("ms"))).alias("p95"))
    r2 = lambda c: round_half_away(c, 2)
    return totals.join(picks, "label").select(
        "label", "n_runs", r2("lo").alias("min_ms"), r2("median").alias("median_ms"), r2("p95").alias("p95_ms"),
        r2("hi").alias("max_ms"), r2("mean").alias("avg_ms"))
