"""The whole way from table observations to scored action events as one stream.

Five stateful operators follow one another in one query, each keyed as finely as its rule allows: hands by table,
seats' readings by hand and seat, numbers and bets by hand, the debounce by player and action, decision times by
hand and seat again.  A reading is an event within the batch it comes in.  Timer readings travel along, so that the
last operator meets them in order with the events that were kept; nothing is read or kept twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railbird.functions import actions as A
from railbird.functions import steps
from railbird.operators.derive import judged_actions, read_rank
from railbird.streaming.processors import stateful


def _stage(df: DataFrame, keys: list[str], order: list[str], rule, *kinds: str, ttl_ms: int | None = None) -> DataFrame:
    """A rule for some kinds of rows.  Rows that come behind what a key has seen go on marked ``was_late`` to the end."""
    out = stateful(df, keys, order, steps.Passing(rule, *kinds) if kinds else rule, ttl_ms=ttl_ms)
    return out.withColumn("was_late", F.col("was_late") | F.col("late")).drop("late")


def observed_events(
    observations: DataFrame, *, seats: DataFrame | None = None, pot_label: str | None = steps.POT_LABEL,
    debounce_s: float = steps.DEBOUNCE_SECONDS, posted: int = 2, ttl_ms: int | None = None,
) -> DataFrame:
    """The events of ``operators.observed.observed_events`` over a stream, and ``late`` rows, which are no events.

    A tick's readings have to come in one batch.  ``seats`` (a table: table_id, seat, player_name, position) names
    players; ``ttl_ms`` drops the state of hands and players that stay silent.
    """
    number = lambda c, kind: F.lit(None).cast(kind).alias(c)
    have = [c if c in observations.columns else number(c, "bigint") for c in ("phash", "phash2")]
    rows = observations.select("table_id", "tick", "ts", "seat", "kind", "text", "value", *have)
    rows = rows.withColumns({"read": read_rank(), "was_late": F.lit(False)})
    rows = _stage(rows, ["table_id"], ["ts", "tick", "read", "seat", "kind", "value", "text"], steps.HandTicks(steps.Segment(label=pot_label)))

    parsed = A.parse_action("text")
    rows = rows.where(F.col("kind").isin("action", "stack", "timer") | F.col("was_late")).select(
        F.concat_ws("-", "table_id", F.col("hand_no").cast("string")).alias("hand_id"), "table_id", "seat", "ts", "tick", "kind", "text", "value", "street",
        "pot_before", "pot_after", F.when(F.col("kind") == "action", parsed["action_type"]).alias("text_action"),
        F.when(F.col("kind") == "action", parsed["amount"]).alias("amount"), (F.col("kind") == "action").cast("int").alias("read"), "was_late")
    # A seat's stack before its action; its timer passes.
    rows = _stage(rows, ["hand_id", "seat"], ["ts", "tick", "read", "value"], steps.SeatActions(), "action", "stack", ttl_ms=ttl_ms)
    rows = rows.withColumn("moved", F.col("stack_before") - A.settled_stack(F.col("text_action"), F.col("stack_after")))
    rows = _stage(rows, ["hand_id"], ["ts", "tick", "seat"], steps.Facing(), "action", ttl_ms=ttl_ms)

    rows = judged_actions(rows.drop("moved"))
    rows = rows.withColumn("player_name", F.concat(F.lit("Player_"), F.col("seat").cast("string"))).withColumn("position", F.lit("UTG"))
    if seats is not None:
        known = seats.select("table_id", "seat", F.col("player_name").alias("who"), F.col("position").alias("where"))
        rows = rows.join(known, ["table_id", "seat"], "left").withColumns({
            "player_name": F.coalesce("who", "player_name"), "position": F.coalesce("where", "position")}).drop("who", "where")
    rows = _stage(rows, ["table_id", "player_name", "street", "action_type"], ["ts", "tick", "seat"], steps.Debounce(debounce_s), "action", ttl_ms=ttl_ms)
    rows = rows.where((F.col("kind") != "action") | F.col("accepted") | F.col("was_late")).drop("accepted", "since_s")
    rows = _stage(rows.withColumn("read", (F.col("kind") == "action").cast("int")), ["hand_id", "seat"], ["ts", "tick", "read", "value"], steps.Timer(), ttl_ms=ttl_ms)

    return rows.where((F.col("kind") == "action") | F.col("was_late")).select(
        F.concat_ws("-", "hand_id", F.col("sequence_number").cast("string")).alias("id"), "hand_id", "player_name", "position", "street", "action_type",
        (F.col("sequence_number") + posted).cast("int").alias("sequence_number"), "amount", "confidence_score",
        F.col("ts").alias("timestamp"), F.col("ts").alias("created_at"),
        F.struct(
            F.col("text").alias("action_text"), "stack_before", "stack_after", "stack_delta", "pot_before", "pot_after", "pot_delta",
            F.col("text_action").alias("text_derived_action"), F.col("stack_action").alias("stack_derived_action"), "override_reason",
            "decision_time_ms", "used_timebank", F.lit(False).alias("synthetic"), "current_to_call", "is_first_bet_this_street").alias("raw"),
        F.col("was_late").alias("late"))
