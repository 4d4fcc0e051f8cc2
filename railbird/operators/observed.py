"""The whole way from table observations to scored action events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railbird.functions import actions as A
from railbird.functions import steps
from railbird.functions.ordered import numbered, running, shifted, time_split
from railbird.operators import derive as D
from railbird.session import written


def observed_hands(observations: DataFrame, *, pot_label: str | None = steps.POT_LABEL, width: str = D.WIDTH) -> DataFrame:
    """Observations with their hand, street and the pot before and after their tick.

    The result is written to the checkpoint folder: every later rule reads it,
    and a fold reads its input more than once.
    """
    split = time_split("ts", width)
    order = ["ts", "tick", "read", "seat", "kind", "value", "text"]
    rows = D.segment_hands(observations, pot_label=pot_label, width=width).withColumn("read", D.read_rank())
    rows = rows.withColumn("hand_id", F.concat_ws("-", "table_id", F.col("hand_no").cast("string")))
    board = F.when(F.col("kind") == "community", A.street_of_count(F.col("value")))
    rows = running(rows, ["hand_id"], order, {"street": ("last", board)}, split=split)
    rows = written(rows.withColumn("street", F.coalesce("street", F.lit("preflop"))))

    ticks = rows.groupBy("hand_id", "ts", "tick").agg(
        F.max_by("pot_latest", F.struct("read", F.coalesce("seat", F.lit(-1)), "kind", F.coalesce("value", F.lit(0.0)))).alias("pot_after"))
    ticks = shifted(ticks, ["hand_id"], ["ts", "tick"], {"pot_before": F.col("pot_after")}, split=split)
    return written(rows.join(ticks, ["hand_id", "ts", "tick"]).select(*rows.columns, "pot_after", "pot_before"))


def _seat_actions(rows: DataFrame, width: str) -> DataFrame:
    """Changed, readable action texts with the seat's stack before and at their tick."""
    stacks = D.cleaned_stacks(rows.select("hand_id", "seat", "ts", "tick", "kind", "value"), ["hand_id", "seat"], width=None)
    acts = D.action_changes(rows, ["hand_id", "seat"], width=width).withColumn("p", A.parse_action("text"))
    facts = F.struct("table_id", "text", "street", "pot_before", "pot_after", "p")
    key = ["hand_id", "seat", "ts", "tick"]
    both = acts.select(*key, facts.alias("act"), F.lit(None).cast("double").alias("stack")).unionByName(
        stacks.select(*key, "stack"), allowMissingColumns=True)
    per_tick = both.groupBy(*key).agg(F.first("act", ignorenulls=True).alias("act"), F.max("stack").alias("stack_after"))
    known = running(per_tick, ["hand_id", "seat"], ["ts", "tick"], {"stack_before": ("last", F.col("stack_after"))},
                    split=time_split("ts", width), inclusive=False)
    return known.where(F.col("act.p").isNotNull()).select(
        *key, "stack_before", "stack_after", "act.table_id", F.col("act.text").alias("action_text"), "act.street",
        "act.pot_before", "act.pot_after", F.col("act.p.action_type").alias("text_action"),
        F.col("act.p.amount").alias("amount"))


def observed_events(
    observations: DataFrame, *, players: DataFrame | None = None, pot_label: str | None = steps.POT_LABEL,
    debounce_s: float = steps.DEBOUNCE_SECONDS, width: str = D.WIDTH, posted: int = 2, attention: bool = False,
) -> DataFrame:
    """Scored action events.  ``players``: table_id, seat, player_name and position, where known and always the same;
    ``operators.hands.feed`` finds names, positions and posts of every hand instead.

    A seat that has folded is not read again in its hand; with ``attention`` neither is one that is all in.

    Low-confidence events are included; ``sources.tables`` routes them.
    """
    rows = observed_hands(observations, pot_label=pot_label, width=width)
    return events_of(rows, seats=players, posted=posted, debounce_s=debounce_s, width=width, attention=attention)


def scored_actions(
    rows: DataFrame, *, seats: DataFrame | None = None, debounce_s: float = steps.DEBOUNCE_SECONDS, width: str = D.WIDTH, attention: bool = False,
) -> DataFrame:
    """The judged and named actions of ``observed_hands``, those that the debounce drops included (``accepted``), as a written table.

    ``seats``: player_name and position by table_id and seat, or by hand_id and seat.
    """
    split: Column = time_split("ts", width)
    acts = _seat_actions(rows, width)
    out_of_it = F.col("text_action").isin(["fold", "all_in"] if attention else ["fold"])
    acts = running(acts, ["hand_id", "seat"], ["ts", "tick"], {"_out": ("max", out_of_it)}, split=split, inclusive=False)
    acts = acts.where(~F.coalesce("_out", F.lit(False))).drop("_out")
    acts = numbered(acts, ["hand_id"], ["ts", "tick", "seat"], "sequence_number", split=split)
    delta = F.col("stack_before") - A.settled_stack(F.col("text_action"), F.col("stack_after"))
    facing = running(acts, ["hand_id", "street"], ["ts", "tick", "seat"],
                     {"_top": ("max", F.when(delta > A.TOLERANCE, delta))}, split=split, inclusive=False)
    judged = D.judged_actions(facing.select(
        "*", F.coalesce("_top", F.lit(0.0)).alias("current_to_call"),
        F.col("_top").isNull().alias("is_first_bet_this_street")).drop("_top"))
    judged = written(judged)

    seat = F.concat(F.lit("Player_"), F.col("seat").cast("string"))
    if seats is None:
        named = judged.withColumns({"player_name": seat, "position": F.lit("UTG")})
    else:
        of = "hand_id" if "hand_id" in seats.columns else "table_id"
        named = judged.join(seats.select(of, "seat", "player_name", "position"), [of, "seat"], "left").withColumns({
            "player_name": F.coalesce("player_name", seat), "position": F.coalesce("position", F.lit("UTG"))})
    return written(D.debounced(named, order=["ts", "tick", "seat"], seconds=debounce_s))


def action_diagnostics(scored: DataFrame) -> DataFrame:
    """What the flow notes about its actions: text that was kept against the stack, all-ins and texts that only
    sound like one, repeats that were dropped.  Rows as in ``schemas.DIAGNOSTICS``."""
    c = F.col
    sounds = F.lower("action_text").rlike("all in|all-in|allin|全押")
    note = lambda when, tag, level, *fields: F.when(when, F.struct(
        F.lit(tag).alias("tag"), F.lit(level).alias("level"), F.to_json(F.struct(*fields)).alias("payload")))
    stacks = ["stack_before", "stack_after", "stack_delta", "action_text"]
    all_in = ["seat", c("player_name").alias("player"), c("action_type").alias("final_action"), *stacks]
    found = F.array(
        note(c("text_preserved"), "p3.text_priority_preserved", "INFO", *_PRESERVED),
        note(c("action_type") == "all_in", "all_in.detected", "INFO", *all_in),
        note((c("action_type") != "all_in") & sounds, "all_in.text_only_candidate", "WARN", *all_in),
        note(~c("accepted"), "action.dedup_skip", "INFO", c("player_name").alias("player"), "street", c("action_type").alias("action"),
             F.round("since_s", 2).alias("ts_delta_sec")))
    return scored.select("hand_id", F.inline(F.filter(found, lambda x: x.isNotNull())), c("ts").alias("occurred_at"))


#: What a note about a text that was kept against the stack says.
_PRESERVED = ["seat", "text_action", "stack_action", "stack_delta", "stack_after", "current_to_call"]


def events_of(
    rows: DataFrame, *, seats: DataFrame | None = None, posted: int | DataFrame = 2, debounce_s: float = steps.DEBOUNCE_SECONDS,
    width: str = D.WIDTH, attention: bool = False, scored: DataFrame | None = None,
) -> DataFrame:
    """Scored action events of ``observed_hands``.

    ``seats``: player_name and position by table_id and seat, or by hand_id and seat.  ``posted``: how many
    posts come before a hand's events, one number or a table of hand_id and posted (none: no posts).
    ``scored``: the actions, where they have been made already.
    """
    if scored is None:
        scored = scored_actions(rows, seats=seats, debounce_s=debounce_s, width=width, attention=attention)
    kept = scored.where("accepted")

    clock = rows.where(F.col("kind") == "timer").select("hand_id", "seat", "ts", "tick", "kind", "value").unionByName(
        kept.select("hand_id", "seat", "ts", "tick", F.lit("action").alias("kind"), F.lit(None).cast("double").alias("value")))
    times = D.decision_times(clock, ["hand_id", "seat"], width=None).select(
        "hand_id", "seat", "tick", "decision_time_ms", "used_timebank")
    out = kept.join(times, ["hand_id", "seat", "tick"], "left")
    if isinstance(posted, DataFrame):
        out = out.join(posted, "hand_id", "left").withColumn("posted", F.coalesce("posted", F.lit(0)))
    else:
        out = out.withColumn("posted", F.lit(posted))
    return out.select(
        F.concat_ws("-", "hand_id", F.col("sequence_number").cast("string")).alias("id"), "hand_id", "player_name",
        "position", "street", "action_type", (F.col("sequence_number") + F.col("posted")).cast("int").alias("sequence_number"),
        "amount", "confidence_score", F.col("ts").alias("timestamp"), F.col("ts").alias("created_at"),
        F.struct(
            "action_text", "stack_before", "stack_after", "stack_delta", "pot_before", "pot_after", "pot_delta",
            F.col("text_action").alias("text_derived_action"), F.col("stack_action").alias("stack_derived_action"),
            "override_reason", "decision_time_ms", "used_timebank", F.lit(False).alias("synthetic"),
            "current_to_call", "is_first_bet_this_street",
        ).alias("raw"))
