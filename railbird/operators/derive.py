"""From table observations to validated action events.

Rules that look one step back are windows cut at time splits.  Rules that look
back to the last *accepted* reading are folds (``functions.steps``) run in
pieces.  Both give the result of one pass over the whole key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from railbird import schemas as S
from railbird.functions import actions as A
from railbird.functions import steps
from railbird.functions.ordered import carried_fold, numbered, running, shifted, time_split
from railbird.functions.prefix import prefix_fold
from railbird.functions.semantics import chain, count_if, lookup
from railbird.session import written

WIDTH = "1 hour"
# Within a tick the board and the pot are read before the seats.
READ_ORDER = {"hero": 0, "community": 1, "pot": 2, "timer": 3}


def ddl(df: DataFrame, *, extra: str = "", without: tuple[str, ...] = ()) -> str:
    cols = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in without]
    return ", ".join([*cols, extra] if extra else cols)


def apply_step(
    df: DataFrame, keys: list[str], order: list[str], step, *, ts: str = "ts", forgets: Column | None = None,
    split: Column | None = None, width: str | None = None,
) -> DataFrame:
    """Runs a step over each key in order; its columns come after the input's.

    With ``width`` (for rules that have ``maps``) a key's splits of that width are folded side by side.

    Rows without a time have no place in the order and are left out; ``untimed`` gives them.
    """
    rows = df.where(F.col(ts).isNotNull()).withColumn("at", F.unix_micros(ts))
    if width is not None:
        out = prefix_fold(rows, keys, order, step, step.maps(rows.columns), ddl(rows, extra=step.extra), time_split(ts, width))
        return out.drop("at")
    out = carried_fold(
        rows, keys, order, step=step, state_schema=step.state, output_schema=ddl(rows, extra=step.extra),
        forgets=forgets, split=split)
    return out.drop("at")


def untimed(df: DataFrame, *, ts: str = "ts") -> DataFrame:
    """The rows that ordered rules leave out: the side output of those without a time."""
    return df.where(F.col(ts).isNull())


def read_rank() -> Column:
    """The order of readings within a tick: the table before the seats, a seat's timer before its action."""
    return chain(*[(F.col("kind") == k, i) for k, i in READ_ORDER.items()], default=len(READ_ORDER))


# ------------------------------------------------------------ single readings

def parse_actions(observations: DataFrame) -> DataFrame:
    """Action readings with the action and amount their text names."""
    rows = observations.where(F.col("kind") == "action")
    return rows.withColumn("p", A.parse_action("text")).select(
        *observations.columns, F.col("p.action_type").alias("action_type"), F.col("p.amount").alias("amount"))


def judged_actions(readings: DataFrame) -> DataFrame:
    """Action, confidence and override of readings that carry the chips around them.

    Needs ``text_action, stack_before, stack_after, pot_before, pot_after,
    current_to_call, is_first_bet_this_street``.
    """
    after = A.settled_stack(F.col("text_action"), F.col("stack_after"))
    rows = readings.withColumn("stack_after", after).withColumns({
        "stack_delta": F.col("stack_before") - F.col("stack_after"),
        "pot_delta": F.col("pot_after") - F.col("pot_before"),
    })
    inferred = A.infer_action(
        F.col("stack_delta"), F.col("current_to_call"), F.col("is_first_bet_this_street"), F.col("stack_after"))
    rows = rows.withColumn("stack_action", inferred)
    verdict = A.arbitrate(F.col("text_action"), F.col("stack_action"), F.col("stack_delta"), F.col("pot_delta"))
    return rows.withColumn("v", verdict).select(
        *rows.columns, F.col("v.action_type").alias("action_type"), F.col("v.override_reason").alias("override_reason"),
        F.col("v.confidence_score").alias("confidence_score"), F.col("v.text_preserved").alias("text_preserved"))


def preserved_diagnostics(judged: DataFrame, *, occurred_at: Column) -> DataFrame:
    """A note for every action whose text was kept although the stack said otherwise (``judged_actions`` with a ``seat``)."""
    payload = F.to_json(F.struct("seat", "text_action", "stack_action", "stack_delta", "stack_after", "current_to_call"))
    return judged.where("text_preserved").select(
        "hand_id", F.lit("p3.text_priority_preserved").alias("tag"), F.lit("INFO").alias("level"), payload.alias("payload"), occurred_at.alias("occurred_at"))


def seat_positions(hands: DataFrame, seats: DataFrame) -> DataFrame:
    """Position of every seat (``hand_id, seat``) from the hand's button and size."""
    facts = hands.select(F.col("id").alias("hand_id"), "button_seat_index", "num_seats")
    pos = A.seat_position(F.col("seat"), F.col("button_seat_index"), F.col("num_seats"))
    return seats.join(facts, "hand_id").withColumn("position", pos).where(F.col("position").isNotNull())


def button_choice(
    readings: DataFrame, *, min_ratio: float = 1.3, min_brightness: float = 150.0,
) -> DataFrame:
    """Dealer button per hand from readings ``hand_id, seat, tick, text, brightness``.

    The text wins; otherwise the brightest seat if it stands out; otherwise seat 0.
    Seats are reduced to their first reading, so a hand brings a handful of rows.
    """
    per_seat = readings.groupBy("hand_id", "seat").agg(
        F.min_by(F.struct("text", "brightness"), "tick").alias("r"))
    marked = F.upper(F.coalesce("r.text", F.lit(""))).contains("D")
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("r.brightness")).alias("neg"), "seat")))
    per_hand = per_seat.groupBy("hand_id").agg(
        F.min(F.when(marked, F.col("seat"))).alias("by_text"), ranked.alias("b"), F.count("*").alias("n"))
    top, second = -F.col("b")[0]["neg"], -F.get("b", F.lit(1))["neg"]
    stands_out = (F.col("n") >= 2) & (
        ((second > 0) & (F.try_divide(top, second) >= min_ratio)) | (top >= min_brightness))
    return per_hand.select(
        "hand_id",
        chain((F.col("by_text").isNotNull(), F.col("by_text")), (stands_out, F.col("b")[0]["seat"]), default=F.lit(0))
        .alias("button_seat_index"),
        chain((F.col("by_text").isNotNull(), "L1-ocr"), (stands_out, "L2-brightness"), default="L3-fallback")
        .alias("button_detection_method"))


def blind_levels(hands: DataFrame, readings: DataFrame, *, limit: float = 100_000.0) -> DataFrame:
    """Blinds per hand from the first amount reading of the two blind seats.

    ``hands``: id, button_seat_index, num_seats, board_dealt.  ``readings``:
    hand_id, seat, tick, text.  Hands whose board is out already are skipped:
    later bets have overwritten the blinds.
    """
    n = F.col("num_seats")
    usable = hands.where(
        F.col("button_seat_index").isNotNull() & (n >= 2) & ~F.coalesce("board_dealt", F.lit(False)))
    seats = usable.select(
        F.col("id").alias("hand_id"), F.pmod(F.col("button_seat_index") + 1, n).alias("sb_seat"),
        F.pmod(F.col("button_seat_index") + 2, n).alias("bb_seat"))
    value = A.first_number("text")
    first = readings.groupBy("hand_id", "seat").agg(F.min_by("text", "tick").alias("text")).select(
        "hand_id", "seat", F.when((value > 0) & (value < limit), value).alias("v"))
    joined = seats.join(first, "hand_id", "left")
    out = joined.groupBy("hand_id", "sb_seat", "bb_seat").agg(
        F.max(F.when(F.col("seat") == F.col("sb_seat"), F.col("v"))).alias("blind_sb"),
        F.max(F.when(F.col("seat") == F.col("bb_seat"), F.col("v"))).alias("blind_bb"))
    return out.where(F.col("blind_sb").isNotNull() | F.col("blind_bb").isNotNull())


def blind_posts(hands: DataFrame) -> DataFrame:
    """The two forced posts of every hand, each either an event or a skip reason.

    Uses ``empty_seats`` (array<int>) where the hands have it.  A hand with a
    hand-level reason yields one row without an action.
    """
    empty = F.col("empty_seats") if "empty_seats" in hands.columns else F.lit(None).cast("array<int>")
    n = F.coalesce("num_seats", F.lit(9))
    hand_reason = chain(
        (F.col("button_seat_index").isNull(), "button_seat_index_none"),
        (F.col("blind_sb").isNull() | F.col("blind_bb").isNull(), "blind_level_missing"),
        (n < 3, "heads_up_unsupported"))
    sb, bb = F.col("blind_sb"), F.col("blind_bb")

    def post(kind: str, pos: str, offset: int, amount: Column, pot_before: Column, pot_after: Column) -> Column:
        seat = F.pmod(F.col("button_seat_index") + offset, n)
        player = F.try_element_at("seats", F.lit(pos))
        before = F.try_element_at("stacks_initial", seat.cast("string"))
        reason = chain(
            (F.coalesce(F.array_contains(empty, seat), F.lit(False)), "seat_empty"),
            (player.isNull() | (player == ""), "player_unknown"))
        return F.struct(
            F.lit(kind).alias("action_type"), F.lit(pos).alias("position"), seat.alias("seat"),
            player.alias("player_name"), amount.alias("amount"), before.alias("stack_before"),
            (before - amount).alias("stack_after"), pot_before.alias("pot_before"), pot_after.alias("pot_after"),
            reason.alias("skip_reason"))

    both = F.array(post("post_sb", "SB", 1, sb, F.lit(0.0), sb), post("post_bb", "BB", 2, bb, sb, sb + bb))
    posts = hands.select(F.col("id").alias("hand_id"), "started_at", hand_reason.alias("hand_reason"), both.alias("p"))
    made = F.filter("p", lambda x: x["skip_reason"].isNull())
    rows = posts.select(
        "hand_id", "started_at", "hand_reason", made.alias("made"),
        F.explode(F.when(F.col("hand_reason").isNull(), F.col("p")).otherwise(F.slice("p", 1, 1))).alias("x"))
    whole = F.col("hand_reason").isNull()
    keep = lambda name: F.when(whole, F.col(f"x.{name}")).alias(name)
    seq = F.array_position(F.transform("made", lambda m: m["action_type"]), F.col("x.action_type")).cast("int")
    ok = whole & F.col("x.skip_reason").isNull()
    return rows.select(
        "hand_id", F.when(ok, seq).alias("sequence_number"), keep("action_type"), keep("position"), keep("seat"),
        keep("player_name"), keep("amount"), keep("stack_before"), keep("stack_after"), keep("pot_before"),
        keep("pot_after"), F.when(ok, F.lit(0.9)).alias("confidence_score"),
        F.coalesce("hand_reason", "x.skip_reason").alias("skip_reason"), F.col("started_at").alias("timestamp"))


def post_events(posts: DataFrame) -> DataFrame:
    """The posts as action events marked synthetic."""
    blank = lambda kind: F.lit(None).cast(kind)
    ts = F.col("timestamp")
    return posts.where(F.col("skip_reason").isNull()).select(
        F.concat_ws("-", F.col("hand_id").cast("string"), "action_type").alias("id"), "hand_id", "player_name",
        "position", F.lit("preflop").alias("street"), "action_type", "sequence_number", "amount",
        "confidence_score", ts.alias("timestamp"), ts.alias("created_at"),
        F.struct(
            blank("string").alias("action_text"), "stack_before", "stack_after", F.col("amount").alias("stack_delta"),
            "pot_before", "pot_after", F.col("amount").alias("pot_delta"),
            blank("string").alias("text_derived_action"), blank("string").alias("stack_derived_action"),
            blank("string").alias("override_reason"), blank("bigint").alias("decision_time_ms"),
            blank("boolean").alias("used_timebank"), F.lit(True).alias("synthetic"),
        ).alias("raw"))


def post_diagnostics(posts: DataFrame) -> DataFrame:
    done = F.col("skip_reason").isNull()
    payload = F.to_json(F.struct(
        F.col("skip_reason").alias("reason"), "seat", F.col("player_name").alias("player"),
        F.col("action_type").alias("action"), "amount"))
    return posts.select(
        "hand_id", F.when(done, "post.injection_done").otherwise("post.injection_skipped").alias("tag"),
        F.lit("INFO").alias("level"), payload.alias("payload"), F.col("timestamp").alias("occurred_at"))


def inferred_insurance(hands: DataFrame, allins: DataFrame) -> DataFrame:
    """What each all-in seat's stacks say about insurance.  ``allins``: hand_id, seat, player_name."""
    facts = hands.select(
        F.col("id").alias("hand_id"), F.coalesce("pot_size_final", F.lit(0.0)).alias("pot"),
        "stacks_initial", "stacks_final")
    seat = F.col("seat").cast("string")
    rows = allins.join(facts, "hand_id").select(
        "hand_id", "seat",
        F.coalesce("player_name", F.concat(F.lit("Player_"), seat)).alias("player_name"),
        F.coalesce(F.try_element_at("stacks_initial", seat), F.lit(0.0)).alias("stack_initial"),
        F.coalesce(F.try_element_at("stacks_final", seat), F.lit(0.0)).alias("stack_final"), "pot",
    ).withColumn("gain", F.col("stack_final") - F.col("stack_initial"))
    kind = A.insurance_class(F.col("gain"), F.col("stack_final"), F.col("pot"))
    return rows.withColumn("classification", kind).withColumn(
        "premium_inferred",
        F.when(F.col("classification") == "insurance_payout", A.inferred_premium(F.col("gain"), F.col("pot"))))


def empty_seats(readings: DataFrame) -> DataFrame:
    """Seats nobody sits at: blank avatar without a stack, or an avatar seen twice.

    ``readings``: hand_id, seat, phash, stack_text, one row per seat at hand start.
    """
    blank = (F.col("phash") == 0) & A.first_number("stack_text").isNull()
    same = F.count("phash").over(Window.partitionBy("hand_id", "phash"))
    rows = readings.withColumn("occurrences", F.when(F.col("phash").isNotNull(), same))
    reason = chain((blank, "avatar_zero_hash + stack_no_digit"),
                   (F.col("occurrences") >= 2, "duplicate_phash_minimum_guard"))
    return rows.select("hand_id", "seat", reason.alias("reason"), "occurrences").where(F.col("reason").isNotNull())


SEAT_TEXTS = ["action", "fold", "amount"]


def seat_readings(observations: DataFrame) -> DataFrame:
    """Observations whose ``fold`` and ``amount`` readings have become what the flow knows: actions and timers.

    A seat's fold area shows a countdown (two digits up to 60 and no action word: a timer reading, and no action at that tick), a
    fold or all-in (the tick's action, whatever else was read) or nothing; the last two end a countdown.  Chips read beside
    an action are put behind its text.  ``amount`` readings stay besides, for the blinds.
    """
    at = ["table_id", "seat", "ts", "tick"]
    text = lambda kind: F.max(F.when(F.col("kind") == kind, A.clean("text")))
    own = observations.where(F.col("kind").isin(SEAT_TEXTS)).groupBy(*at).agg(*[text(k).alias(k) for k in SEAT_TEXTS])
    digits = F.regexp_extract("fold", r"\b(\d{1,2})\b", 1)
    word = A.action_of("fold")
    counts = F.coalesce((digits != "") & (digits.try_cast("int") <= 60) & word.isNull(), F.lit(False))
    takes = F.coalesce(word.isin("fold", "all_in"), F.lit(False))
    ends = F.coalesce(takes | (F.col("fold") == ""), F.lit(False))
    said = F.when(takes, F.col("fold")).when((F.col("action") != "") & (F.coalesce("amount", F.lit("")) != ""), F.concat_ws(" ", "action", "amount")).otherwise(F.col("action"))
    new = lambda when, kind, words, value: F.when(when, F.struct(
        F.lit(kind).alias("kind"), words.cast("string").alias("text"), value.cast("double").alias("value")))
    rows = F.array(
        new(counts, "timer", F.lit(None), digits.try_cast("double")), new(ends, "timer", F.lit(None), F.lit(None)),
        new(~counts & said.isNotNull(), "action", said, F.lit(None)))
    made = own.select(*at, F.inline(F.filter(rows, lambda r: r.isNotNull())))
    return observations.where(~F.col("kind").isin("action", "fold")).unionByName(made, allowMissingColumns=True).select(*observations.columns)


# ------------------------------------------------------------ along the order

def segment_hands(
    observations: DataFrame, *, threshold: int = steps.HERO_HASH_THRESHOLD, pot_label: str | None = steps.POT_LABEL,
    width: str = WIDTH,
) -> DataFrame:
    """Numbers the hands of every table and names what began each one.

    The readings of a tick have a fixed order (``read_rank``, seat, kind, then what was read), so the
    result does not depend on how rows arrive.
    """
    if "phash" not in observations.columns:
        observations = observations.withColumn("phash", F.lit(None).cast("bigint"))
    order = ["ts", "tick", "read_rank", "seat", "kind", "value", "text"]
    rows = observations.withColumn("read_rank", read_rank())
    # Written, since the count reads it twice and a fold would run as often.
    marked = written(apply_step(rows, ["table_id"], order, steps.Segment(threshold, pot_label), width=width))
    return running(
        marked, ["table_id"], order, {"hand_no": ("count", F.col("boundary"))}, split=time_split("ts", width)).drop("read_rank")


def action_changes(observations: DataFrame, keys: list[str], *, width: str = WIDTH) -> DataFrame:
    """Action readings whose text differs from the seat's last non-empty one."""
    rows = observations.where(F.col("kind") == "action").withColumn("cleaned", A.clean("text"))
    rows = rows.where(F.col("cleaned") != "")
    out = shifted(rows, keys, ["ts", "tick"], {"prev_text": F.col("cleaned")}, split=time_split("ts", width))
    return out.where(F.col("prev_text").isNull() | (F.col("prev_text") != F.col("cleaned")))


def debounce_keys(events: DataFrame) -> list[str]:
    """A table remembers its own players' actions: the same name elsewhere is another one's."""
    table = ["table_id"] if "table_id" in events.columns else []
    return [*table, "player_name", "street", "action_type"]


def debounced(
    events: DataFrame, *, keys: list[str] | None = None, order: list[str] | None = None, ts: str = "ts",
    seconds: float = steps.DEBOUNCE_SECONDS, width: str | None = None,
) -> DataFrame:
    """Accepts an action unless the same one was accepted less than ``seconds`` ago.

    One shuffle and one pass.  With ``width`` (much more than ``seconds``) a key's splits are folded side by side; give it where a
    key may hold a large share of the rows.
    """
    return apply_step(events, keys or debounce_keys(events), order or [ts, "id"], steps.Debounce(seconds), ts=ts, width=width)


def cleaned_stacks(
    observations: DataFrame, keys: list[str], *, factor: float = steps.STACK_JUMP, width: str | None = WIDTH,
) -> DataFrame:
    """Stack readings without digit jumps.  ``width=None``: keys are small (a seat's hand)."""
    rows = observations.where(F.col("kind") == "stack")
    return apply_step(rows, keys, ["ts", "tick", "value"], steps.StackJump(factor), width=width)


def cleaned_pots(observations: DataFrame, keys: list[str], *, width: str = WIDTH) -> DataFrame:
    """Pot readings with the accepted pot and its peak so far.

    A peak never forgets, so it is a running maximum outside the fold.
    """
    rows = observations.where(F.col("kind") == "pot")
    out = apply_step(rows, keys, ["ts", "tick", "value"], steps.PotMonotone(), width=width)
    return running(out, keys, ["ts", "tick"], {"peak": ("max", F.col("pot"))}, split=time_split("ts", width))


def betting_state(events: DataFrame, *, split: Column | None = None) -> DataFrame:
    """What every action faces: the largest chip move before it on its street."""
    delta = F.col("raw.stack_delta") if "raw" in events.columns else F.col("stack_delta")
    moved = F.when(delta > A.TOLERANCE, delta)
    out = running(events, ["hand_id", "street"], ["sequence_number"], {"_top": ("max", moved)},
                  split=split, inclusive=False)
    return out.select(
        *events.columns, F.coalesce("_top", F.lit(0.0)).alias("current_to_call"),
        F.col("_top").isNull().alias("is_first_bet_this_street"))


def decision_times(observations: DataFrame, keys: list[str], *, width: str | None = WIDTH) -> DataFrame:
    """Decision time and timebank of every action reading.

    An action ends all that the rule remembers, so long keys are cut behind actions; ``width=None``: keys are small.
    """
    order = ["ts", "tick", "read_rank", "value"]
    rows = observations.where(F.col("kind").isin("timer", "action")).withColumn("read_rank", read_rank())
    if width is None:
        return apply_step(rows, keys, order, steps.Timer()).drop("read_rank")
    split = time_split("ts", width)
    rows = shifted(rows.where(F.col("ts").isNotNull()), keys, order, {"_before": F.col("kind")}, split=split)
    out = apply_step(rows, keys, order, steps.Timer(), forgets=F.col("_before") == "action", split=split)
    return out.drop("read_rank", "_before")


def pointer_events(scans: DataFrame, keys: list[str], *, recent_s: float = 5.0, width: str = WIDTH) -> DataFrame:
    """What the moving decision timer says about who acted.

    ``scans`` has one row per tick: the seat showing a timer (or none) and its value.
    """
    out = shifted(scans, keys, ["ts", "tick"], {
        "last_seat": F.col("seat"), "last_value": F.col("value"), "last_ts": F.col("ts"),
    }, split=time_split("ts", width))
    gap = (F.unix_micros("ts") - F.unix_micros("last_ts")) / 1e6
    seat, last = F.col("seat"), F.col("last_seat")
    moved = seat.isNotNull() & (last.isNull() | (last != seat))
    event = lambda tag, of, reason, nxt, since: F.struct(
        F.lit(tag).alias("tag"), of.alias("of_seat"), F.col("last_value").alias("last_timer_value"),
        F.lit(reason).cast("string").alias("reason"), nxt.cast("int").alias("next_seat"),
        since.cast("double").alias("time_since_timer"))
    none = F.lit(None)
    found = F.array(
        F.when(moved & last.isNotNull(), event("pointer.action_inferred", last, "timer_moved_to_next", seat, none)),
        F.when(moved, event("pointer.timer_moved", last, None, seat, none)),
        F.when(seat.isNull() & last.isNotNull() & (gap < recent_s),
               event("pointer.action_inferred", last, None, none, F.round(gap, 2))),
    )
    return out.select(*keys, "tick", "ts", F.inline(F.filter(found, lambda e: e.isNotNull())))


def showdown_decisions(candidates: DataFrame, *, width: str = WIDTH, **limits: float) -> DataFrame:
    """Accepts or rejects readings of shown cards, with the reason.

    ``candidates``: table_id, hand_id, tick, ts, seat, board (comma separated),
    live_seats, is_hero, hash_distance, brightness, texture, card1, conf1, card2,
    conf2; a card's confidence is the lower one of rank and suit.

    Most readings are decided by themselves and by the clock of their hand's stretch, side by side; only those
    that pass, one a second and seat at most, go through their table's history.
    """
    gate, order, split = steps.ShowdownGate(**limits), ["ts", "tick", "seat", "card1", "card2"], time_split("ts", width)
    rows = shifted(candidates.where(F.col("ts").isNotNull()), ["table_id"], order, {"_hand": F.col("hand_id"), "_any": F.lit(1)}, split=split)
    new = F.col("_any").isNull() | ~F.col("_hand").eqNullSafe(F.col("hand_id"))
    rows = running(rows, ["table_id"], order, {"stretch": ("sum", new.cast("bigint"))}, split=split).drop("_hand", "_any")
    gated = written(apply_step(rows, ["table_id", "stretch"], order, steps.ShowdownThrottle(gate)))
    weighed = apply_step(gated.where("reason is null"), ["table_id"], order, steps.ShowdownHistory(gate))
    out = gated.where("reason is not null").unionByName(weighed).drop("stretch")
    return out.withColumn("accepted", F.col("reason") == "accepted")


def showdown_summary(boards: DataFrame, events: DataFrame, shown: DataFrame) -> DataFrame:
    """How every hand's showdown ended: skipped for its board, for its players, or entered.

    ``boards``: hand_id, river_count.  ``shown``: hand_id, seat (accepted shows).
    """
    per_player = events.groupBy("hand_id", "player_name").agg(
        F.max(F.when(F.col("action_type") == "fold", 1).otherwise(0)).alias("folded"))
    live = per_player.groupBy("hand_id").agg(
        count_if(F.col("folded") == 0).alias("active"), F.sum("folded").alias("n_folded"))
    taken = shown.groupBy("hand_id").agg(F.count_distinct("seat").alias("captured"))
    rows = boards.join(live, "hand_id", "left").join(taken, "hand_id", "left")
    active = F.coalesce("active", F.lit(0))
    return rows.select(
        "hand_id",
        chain((F.coalesce("river_count", F.lit(0)) < 5, "showdown.gate1_skip"), (active < 2, "showdown.gate2_skip"),
              default="showdown.enter").alias("tag"),
        "river_count", active.alias("active_count"), F.coalesce("captured", F.lit(0)).alias("captured_count"))


def seat_lifecycle(changes: DataFrame, *, width: str = WIDTH) -> DataFrame:
    """Effective seat states from observed ones (``table_id, seat, tick, ts, target``)."""
    return apply_step(changes, ["table_id", "seat"], ["ts", "tick", "target"], steps.SeatLifecycle(), width=width)


def phase_transitions() -> dict[str, list[str]]:
    nxt = dict(zip(S.HAND_PHASES, [*S.HAND_PHASES[1:], S.HAND_PHASES[0]]))
    return {p: sorted({n} | ({"settling"} if p in S.ACTING_PHASES else set())) for p, n in nxt.items()}


def hand_phases(phases: DataFrame, *, keys: list[str] | None = None, width: str = WIDTH) -> DataFrame:
    """Observed phases checked against the legal order, with what each phase implies."""
    out = shifted(phases, keys or ["hand_id"], ["ts", "tick"], {"prev_phase": F.col("phase")},
                  split=time_split("ts", width))
    before = F.coalesce("prev_phase", F.lit("between_hands"))
    allowed = F.create_map(*[
        x for p, to in phase_transitions().items() for x in (F.lit(p), F.array(*map(F.lit, to)))])
    phase = F.col("phase")
    return out.select(
        *phases.columns, before.alias("from_phase"),
        (F.array_contains(F.try_element_at(allowed, before), phase) | (before == phase)).alias("legal"),
        phase.isin(S.ACTING_PHASES).alias("stack_delta_is_action"), phase.isin(S.DEALING_PHASES).alias("ocr_should_idle"),
        F.try_element_at(lookup(S.PHASE_STREET), phase).alias("street"))


def board_by_street(readings: DataFrame, keys: list[str]) -> DataFrame:
    """The first clean board of every street (``cards`` array); one with a repeated card is ignored."""
    cards = F.filter("cards", lambda c: c.isNotNull() & (c != ""))
    rows = readings.withColumn("board", cards).where(F.size("board") == F.size(F.array_distinct("board")))
    rows = rows.withColumn("street", A.street_of_count(F.size("board"))).where(
        F.col("street").isNotNull() & (F.size("board") > 0))
    return rows.groupBy(*keys, "street").agg(F.min_by("board", F.struct("ts", "tick")).alias("cards"))


def street_states(counts: DataFrame, keys: list[str], *, width: str = WIDTH) -> DataFrame:
    """Street at every board reading; sizes that name no street keep the one before."""
    named = counts.withColumn("_s", A.street_of_count(F.col("value")))
    out = running(named, keys, ["ts", "tick"], {"street": ("last", F.col("_s"))}, split=time_split("ts", width))
    return out.drop("_s").withColumn("street", F.coalesce("street", F.lit("preflop")))


def merged_readings(primary: DataFrame, secondary: DataFrame, focus: DataFrame) -> DataFrame:
    """Fills an empty reading of the focused seat from a second reader.

    All three share hand_id and tick; primary and secondary add seat and text,
    focus names the seat.
    """
    second = secondary.select("hand_id", "tick", "seat", F.nullif(F.col("text"), F.lit("")).alias("second_text"))
    wanted = second.join(focus.select("hand_id", "tick", "seat"), ["hand_id", "tick", "seat"], "left_semi")
    rows = primary.join(wanted, ["hand_id", "tick", "seat"], "left")
    own = F.nullif(F.col("text"), F.lit(""))
    return rows.select(
        *[c for c in primary.columns if c != "text"], F.coalesce(own, "second_text", F.lit("")).alias("text"),
        (own.isNull() & F.col("second_text").isNotNull()).alias("fell_back"))


def fallback_diagnostics(merged: DataFrame, *, tag: str = "pattern_d.ocr2_action_fallback") -> DataFrame:
    payload = F.to_json(F.struct("seat", F.col("text").alias("action_text"), F.lit("ocr_focus").alias("source")))
    return merged.where("fell_back").select(
        "hand_id", F.lit(tag).alias("tag"), F.lit("INFO").alias("level"), payload.alias("payload"))


def sequence_numbers(events: DataFrame, *, posted: int = 2, split: Column | None = None) -> DataFrame:
    """Numbers a hand's events by time, after the injected posts."""
    out = numbered(events, ["hand_id"], ["timestamp", "id"], "_n", split=split)
    return out.withColumn("sequence_number", (F.col("_n") + posted).cast("int")).drop("_n")
