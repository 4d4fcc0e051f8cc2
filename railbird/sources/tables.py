"""Reading and appending the engine's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from railbird import schemas as S
from railbird.sources.silver import valid_action

SCHEMAS = {
    "hands": S.HANDS, "action_events": S.ACTION_EVENTS, "diagnostic_events": S.DIAGNOSTICS,
    "observations": S.OBSERVATIONS, "predictions": S.PREDICTIONS,
}
HAND_START = ["table_name", "game_type", "stakes", "hero_name", "hero_position", "hero_cards", "started_at"]
HAND_END = ["community_cards", "seats", "ended_at", "result", "raw_data", "pot_size_final"]


# ------------------------------------------------------------ readers

def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A typed table; the schema is fixed, so nothing is read to infer it.  Ids are text, whatever made them."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{root}/{name}")


def read_stream(spark: SparkSession, root: str, name: str, *, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(SCHEMAS[name])
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{root}/{name}")


def read_database(
    spark: SparkSession, url: str, table: str, *, partition_column: str, lower: str, upper: str,
    partitions: int, properties: dict[str, str] | None = None,
) -> DataFrame:
    """Imports a database table in parallel ranges of one column (never one connection)."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for key, value in (properties or {}).items():
        reader = reader.option(key, value)
    return (
        reader.option("partitionColumn", partition_column).option("lowerBound", lower)
        .option("upperBound", upper).option("numPartitions", partitions).load())


def write_bucketed(events: DataFrame, table: str, *, buckets: int) -> None:
    """Events laid out by hand, so that hand-level windows and joins need no shuffle."""
    (events.write.mode("overwrite").bucketBy(buckets, "hand_id").sortBy("hand_id", "sequence_number")
     .format("parquet").saveAsTable(table))


# ------------------------------------------------------------ hands in versions

def current_hands(versions: DataFrame) -> DataFrame:
    """The state of every hand: what it started with, and the end columns of its latest version."""
    have = set(versions.columns)
    start, end = [c for c in HAND_START if c in have], [c for c in HAND_END if c in have]
    return versions.groupBy("id").agg(
        F.min_by(F.struct(*start), "version").alias("s"), F.max_by(F.struct(*end), "version").alias("e"),
    ).select("id", "s.*", "e.*")


# ------------------------------------------------------------ appends

def append(df: DataFrame, root: str, name: str) -> None:
    df.write.mode("append").parquet(f"{root}/{name}")


def append_by_day(df: DataFrame, root: str, name: str, ts: str) -> None:
    """Append in one folder per day, which later time filters prune."""
    df.withColumn("day", F.to_date(ts)).write.mode("append").partitionBy("day").parquet(f"{root}/{name}")


def hand_events(events: DataFrame, hand_id) -> DataFrame:
    """One hand's events in order."""
    return events.where(F.col("hand_id") == hand_id).orderBy("sequence_number")


def diagnostics(rows: DataFrame, tag: Column | str, payload: list[str], *, level: Column | str = "INFO",
                occurred_at: Column | str = "ts") -> DataFrame:
    """Diagnostic rows with the named columns as JSON (times and ids become text)."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    at = F.col(occurred_at) if isinstance(occurred_at, str) else occurred_at
    hand = F.col("hand_id").cast("string") if "hand_id" in rows.columns else F.lit(None).cast("string")
    return rows.select(
        hand.alias("hand_id"), lit(tag).alias("tag"), lit(level).alias("level"),
        F.to_json(F.struct(*payload)).alias("payload"), at.alias("occurred_at"))


def event_corrections(reviews: DataFrame) -> DataFrame:
    """Reviewed actions to append; only known actions are accepted.

    ``reviews``: event_id, action_type, corrected_action, notes, corrected_at.
    """
    return reviews.where(valid_action(F.col("corrected_action"))).select(
        "event_id", F.col("action_type").alias("original_action"), "corrected_action", "corrected_at",
        F.nullif(F.col("notes"), F.lit("")).alias("notes"))


def replay_corrections(reviews: DataFrame) -> DataFrame:
    """Changes of action or amount, original and new value as JSON, one row per change.

    ``reviews``: hand_id, event_id, action_type, amount, confidence_score,
    new_action, new_amount, corrected_at.
    """
    note = F.concat(F.lit("reviewer override; original conf="), F.col("confidence_score").cast("string"))
    text = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    number = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    change = lambda kind, ok, old, new: F.when(ok, F.struct(
        F.lit(kind).alias("correction_type"), old.alias("original_value"), new.alias("corrected_value")))
    new_action = F.lower(F.trim("new_action"))
    changes = F.array(
        change("action_type", valid_action(new_action), text(F.col("action_type")), text(new_action)),
        change("amount", F.col("new_amount").isNotNull(), number(F.col("amount")), number(F.col("new_amount"))))
    return reviews.select(
        "hand_id", "event_id", note.alias("notes"), "corrected_at", F.inline(F.filter(changes, lambda c: c.isNotNull())))


# ------------------------------------------------------------ reports and registry

def write_csv(report: DataFrame, path: str) -> None:
    """A report as CSV parts with headers."""
    report.write.mode("overwrite").option("header", True).csv(path)


def merged_registry(*parts: DataFrame) -> DataFrame:
    """Fingerprint registry after new sightings (``phash, name, seen_at``); the latest name wins."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    latest = F.max(F.struct("seen_at", "name"))
    return rows.groupBy("phash").agg(latest.alias("l")).select("phash", "l.name", "l.seen_at")


# ------------------------------------------------------------ trust ladder

LADDER = 0.7


def trusted(events: DataFrame, *, threshold: float = LADDER) -> DataFrame:
    return events.where(F.col("confidence_score") >= threshold)


def skipped(events: DataFrame, *, threshold: float = LADDER) -> DataFrame:
    """Low-confidence events as diagnostics carrying their evidence."""
    low = events.where(F.col("confidence_score") < threshold).withColumns({
        "player": F.col("player_name"), "action": F.col("action_type"), "confidence": F.col("confidence_score"),
        **{n: F.col(f"raw.{n}") for n in ("stack_before", "stack_after", "stack_delta", "pot_delta", "action_text",
                                          "override_reason")}})
    return diagnostics(low, "action.low_tier_skip", [
        "player", "position", "street", "action", "amount", "confidence", "stack_before", "stack_after", "stack_delta",
        "pot_delta", "action_text", "override_reason"], occurred_at="timestamp")


def write_routed(events: DataFrame, root: str, *, threshold: float = LADDER, batch: str | None = None) -> None:
    """Writes both sinks from one pass over the events.

    A streaming batch writes to its own folder, named by its query and number, which a replay overwrites.
    """
    events = events.withColumns({c: F.col(c).cast("string") for c in ("id", "hand_id")}).persist()
    try:
        for name, rows in (("action_events", trusted(events, threshold=threshold)),
                           ("diagnostic_events", skipped(events, threshold=threshold))):
            if batch is None:
                append(rows, root, name)
            else:
                rows.write.mode("overwrite").parquet(f"{root}/{name}/batch={batch}")
    finally:
        events.unpersist()
