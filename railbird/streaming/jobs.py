"""Streaming jobs: rules, routing, health alerts, live table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from railbird.functions import actions as A
from railbird.functions import steps
from railbird.functions.semantics import round_half_away
from railbird.operators.decisions import live_seats
from railbird.operators.derive import debounce_keys, read_rank
from railbird.operators.health import HINTS
from railbird.sources.tables import write_routed
from railbird.streaming.processors import stateful, windowed_sums

WATERMARK = "1 minute"


# ------------------------------------------------------------ rules

def segmented(observations: DataFrame, *, pot_label: str | None = steps.POT_LABEL) -> DataFrame:
    rows = observations.withColumn("read_rank", read_rank())
    return stateful(rows, ["table_id"], ["ts", "tick", "read_rank", "seat", "kind", "value", "text"], steps.Segment(label=pot_label)).drop("read_rank")


def changed_actions(observations: DataFrame, keys: list[str]) -> DataFrame:
    return stateful(observations.where(F.col("kind") == "action"), keys, ["ts", "tick"], steps.Changed())


def debounced(
    events: DataFrame, *, keys: list[str] | None = None, order: list[str] | None = None,
    seconds: float = steps.DEBOUNCE_SECONDS, ttl_ms: int | None = None,
) -> DataFrame:
    """Anchored debounce.  Dropping duplicates within a watermark would not do:
    a dropped repeat must not extend the window."""
    return stateful(events, keys or debounce_keys(events), order or ["ts", "id"],
                    steps.Debounce(seconds), ttl_ms=ttl_ms)


def cleaned_stacks(observations: DataFrame, keys: list[str]) -> DataFrame:
    return stateful(observations.where(F.col("kind") == "stack"), keys, ["ts", "tick", "value"], steps.StackJump())


def cleaned_pots(observations: DataFrame, keys: list[str]) -> DataFrame:
    return stateful(observations.where(F.col("kind") == "pot"), keys, ["ts", "tick", "value"], steps.PotMonotone())


def decision_times(observations: DataFrame, keys: list[str]) -> DataFrame:
    rows = observations.where(F.col("kind").isin("timer", "action")).withColumn("read_rank", read_rank())
    return stateful(rows, keys, ["ts", "tick", "read_rank", "value"], steps.Timer()).drop("read_rank")


def pointer_events(scans: DataFrame, keys: list[str], *, recent_s: float = 5.0) -> DataFrame:
    return stateful(scans, keys, ["ts", "tick"], steps.Pointer(recent_s))


def showdown_decisions(candidates: DataFrame, **limits: float) -> DataFrame:
    return stateful(candidates, ["table_id"], ["ts", "tick", "seat", "card1", "card2"], steps.ShowdownGate(**limits))


def seat_lifecycle(changes: DataFrame) -> DataFrame:
    return stateful(changes, ["table_id", "seat"], ["ts", "tick", "target"], steps.SeatLifecycle())


def hand_phases(phases: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return stateful(phases, keys or ["hand_id"], ["ts", "tick"], steps.Phase())


def betting_state(events: DataFrame) -> DataFrame:
    """What every action faces on its street; events carry ``stack_delta``."""
    return stateful(events, ["hand_id", "street"], ["ts", "sequence_number"], steps.Betting())


def boards_by_street(readings: DataFrame, keys: list[str]) -> DataFrame:
    """The first clean board of every street; ``board`` is comma separated."""
    return stateful(readings, keys, ["ts", "tick"], steps.Board())


def sequence_numbers(events: DataFrame, *, posted: int = 2) -> DataFrame:
    """A hand's events numbered as they come, after its posts."""
    return stateful(events, ["hand_id"], ["ts", "id"], steps.Numbering(posted))


def parsed_actions(observations: DataFrame) -> DataFrame:
    """Stateless: the batch expression as it is."""
    return observations.where(F.col("kind") == "action").withColumn("p", A.parse_action("text")).select(
        "*", "p.*").drop("p")


def merged_readings(primary: DataFrame, secondary: DataFrame, *, delay: str = "10 seconds") -> DataFrame:
    """Fills empty readings from a second stream of the focused seat.

    Both streams carry hand_id, tick, seat, ts and text; the join keeps a
    reading only as long as its partner may still come.
    """
    a = primary.withWatermark("ts", delay).alias("a")
    b = secondary.where(F.col("text") != "").withWatermark("ts", delay).alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("hand_id", "tick", "seat")]
    near = F.col("b.ts").between(F.col("a.ts") - F.expr(f"interval {delay}"), F.col("a.ts") + F.expr(f"interval {delay}"))
    joined = a.join(b, same[0] & same[1] & same[2] & near, "left_outer")
    own = F.nullif(F.col("a.text"), F.lit(""))
    return joined.select(
        "a.hand_id", "a.tick", "a.seat", "a.ts", F.coalesce(own, F.col("b.text"), F.lit("")).alias("text"),
        (own.isNull() & F.col("b.text").isNotNull()).alias("fell_back"))


# ------------------------------------------------------------ sinks

def routing(events: DataFrame, root: str, checkpoint: str, *, threshold: float = 0.7) -> DataStreamWriter:
    """Trusted events to one table, the rest to diagnostics; late rows to a side table.

    Every batch owns a folder in each sink, named by its query's id and its number: a replayed
    batch replaces itself, and another query or a new checkpoint never meets its folders.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        own = f"{query}-{batch_id}"
        if "late" in batch.columns:
            batch = batch.persist()
            batch.where("late").write.mode("overwrite").parquet(f"{root}/late_events/batch={own}")
            write_routed(batch.where("not late").drop("late"), root, threshold=threshold, batch=own)
            batch.unpersist()
        else:
            write_routed(batch, root, threshold=threshold, batch=own)

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def to_table(df: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)


# ------------------------------------------------------------ health windows

def _alert(tag: str, failed: Column, **payload: Column) -> Column:
    body = F.to_json(F.struct(*[v.alias(k) for k, v in payload.items()], F.lit(HINTS[tag]).alias("guess")))
    return F.when(failed, F.struct(F.lit(tag).alias("tag"), F.lit("WARN").alias("level"), body.alias("payload")))


def _alerts(windows: DataFrame, *alerts: Column) -> DataFrame:
    return windows.where("not late").select(
        "feed", "window_start", F.inline(F.filter(F.array(*alerts), lambda a: a.isNotNull())))


def hand_windows(hands: DataFrame, beats: DataFrame | None = None, *, key: str | None = None, window: str = "30 minutes", delay: str = WATERMARK) -> DataFrame:
    """Hands started in every window, silent ones included, and late rows.

    ``beats`` (a timestamp ``at``, and ``key``) tell that time goes on while no hand starts: any stream of the
    pipeline will do.  Without them a silence is told once the next hand comes.  ``key`` counts apart, by table say.
    """
    named = lambda df: df.withColumn("feed", F.col(key) if key else F.lit("all"))
    rows = named(hands).select("feed", F.col("started_at").alias("ts"), F.lit(1).alias("n"))
    if beats is not None:
        rows = rows.unionByName(named(beats).select("feed", F.col("at").alias("ts"), F.lit(0).alias("n")))
    return windowed_sums(rows, ["feed"], ["n"], ts="ts", window=window, delay=delay)


def hand_alerts(windows: DataFrame, *, at_least: int = 5) -> DataFrame:
    """Windows of ``hand_windows`` with too few hands, or none."""
    n = F.col("n").cast("bigint")
    return _alerts(windows, _alert("health.low_hand_rate", n < at_least, hands_last_30min=n, threshold=F.lit(at_least)))


def event_windows(events: DataFrame, *, key: str | None = None, window: str = "30 minutes", delay: str = WATERMARK) -> DataFrame:
    """What the event alerts need of every window: counts and the sum of the confidence, and late rows."""
    c, one = F.col, lambda cond: F.when(cond, 1).otherwise(0)
    rows = events.select(
        (c(key) if key else F.lit("all")).alias("feed"), "timestamp", F.lit(1).alias("n"), c("confidence_score").alias("conf"),
        one(c("confidence_score").isNotNull()).alias("n_conf"), one(c("raw.override_reason").isNotNull()).alias("over"), one(c("raw.stack_delta").isNull()).alias("nulls"))
    return windowed_sums(rows, ["feed"], ["n", "conf", "n_conf", "over", "nulls"], ts="timestamp", window=window, delay=delay)


def event_alerts(windows: DataFrame, *, baseline_conf: float | None = None) -> DataFrame:
    """Windows of ``event_windows`` with many overrides, many unread stacks, or confidence well under the baseline."""
    c, whole = F.col, lambda x: F.col(x).cast("bigint")
    rate = lambda x: F.try_divide(c(x) * 100.0, c("n"))
    base, mean = F.lit(baseline_conf).cast("double"), F.try_divide("conf", "n_conf")
    drop = F.try_divide((base - mean) * 100, base)
    return _alerts(
        windows,
        _alert("health.conf_dropped", drop > 10, recent_avg_conf=round_half_away(mean, 3),
               historic_avg_conf=base, drop_pct=round_half_away(drop, 1)),
        _alert("health.override_spike", (c("n") > 10) & (rate("over") > 10), recent_override_count=whole("over"),
               recent_total=whole("n"), rate_pct=round_half_away(rate("over"), 1)),
        _alert("health.stack_ocr_degraded", (c("n") > 10) & (rate("nulls") > 50), stack_null_count=whole("nulls"),
               total=whole("n"), rate_pct=round_half_away(rate("nulls"), 1)))


def diagnostic_windows(diagnostics: DataFrame, *, key: str | None = None, window: str = "30 minutes", delay: str = WATERMARK) -> DataFrame:
    """Warnings and errors of every window, and late rows; other diagnostics only move the time on."""
    bad = F.col("level").isin("WARN", "ERROR")
    rows = diagnostics.select((F.col(key) if key else F.lit("all")).alias("feed"), "occurred_at", F.when(bad, 1).otherwise(0).alias("n"))
    return windowed_sums(rows, ["feed"], ["n"], ts="occurred_at", window=window, delay=delay)


def diagnostic_alerts(windows: DataFrame, *, at_most: int = 20) -> DataFrame:
    n = F.col("n").cast("bigint")
    return _alerts(windows, _alert("health.diag_burst", n > at_most, warn_error_count=n, threshold=F.lit(at_most)))


def split_late(windows: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Windows to one table and the rows that came behind their window to another, so that none is lost and counts add up.

    Every batch owns a folder in each, named by its query's id and its number: a replayed batch replaces itself.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        batch = batch.persist()
        for name, rows in (("windows", batch.where("not late")), ("late", batch.where("late"))):
            rows.drop("late").write.mode("overwrite").parquet(f"{path}/{name}/batch={query}-{batch_id}")
        batch.unpersist()

    return windows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


# ------------------------------------------------------------ live table

def live_table(hands: DataFrame, cache: DataFrame, timing: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Keeps the current seats of every table with each player's profile.

    The latest hand per table is Spark's state; every batch rewrites the seats of
    the tables that changed, each table in its own folder.
    """
    latest = hands.groupBy("table_name").agg(
        F.max_by(F.struct("id", "started_at", "seats"), F.struct("started_at", "id")).alias("h"))

    def write(batch: DataFrame, batch_id: int) -> None:
        changed = batch.select("table_name", "h.*")
        seats = live_seats(changed, cache, timing)
        (seats.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("table_name").parquet(path))

    return latest.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
