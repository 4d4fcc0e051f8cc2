"""Sinks, versions, the whole observation flow, and the streaming rules.

A streaming query reads the given file as a stream until it is exhausted, writes
to the checkpoint folder and returns what it wrote; it is checked against the
same SQL as its batch form.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railbird.operators import derive as d
from railbird.operators import observed
from railbird.plans import derive_queries as dq
from railbird.plans.base import Tables, query, rnd, sql, ts
from railbird.session import ensure_checkpoint_dir, new_folder
from railbird.sources import derivations, tables, upsert
from railbird.streaming import flow, jobs, processors

SIX_HOURS = dq.SIX_HOURS
VERSIONS = """select o_orderkey as id, cast(s.i as int) as version, o_orderpriority as table_name, o_orderdate as started_at,
  case when s.i > 0 then cast(o_totalprice as double) + s.i end as pot_size_final,
  case when s.i = 2 then o_orderstatus end as result
from orders EACH_OF_3 where s.i < 2 or o_orderkey % 3 = 0"""
SIGHTINGS = """select user_id % 500 as phash, 'P' || cast(event_id % 90 as string) as name, ts as seen_at from events"""


def _stream(t: Tables, text: str) -> DataFrame:
    processors.use_rocksdb(t.spark)
    schema = t.read("events").schema
    # The source lists folders or patterns, so the one file is named by a pattern.
    source = t.spark.readStream.schema(schema).parquet(f"{t.sf_dir}/events.parque[t]")
    df = t.spark.sql(text.replace("from events", "from {ev}"), ev=source)
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def _drain(t: Tables, df: DataFrame) -> DataFrame:
    folder = f"{ensure_checkpoint_dir(t.spark)}/stream-{uuid.uuid4().hex}"
    q = jobs.to_table(df, f"{folder}/rows", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return t.spark.read.schema(df.schema).parquet(f"{folder}/rows")


def _corrections(t: Tables) -> DataFrame:
    reviews = t.events.where(F.col("confidence_score") < 0.6).select(
        "hand_id", F.col("id").alias("event_id"), "action_type", "amount", "confidence_score",
        F.when(F.col("sequence_number") == 1, " Fold ").when(F.col("sequence_number") == 2, "oops").alias("new_action"),
        F.when(F.col("sequence_number") == 3, F.col("amount") * 2).alias("new_amount"), F.col("timestamp").alias("corrected_at"))
    return tables.replay_corrections(reviews)


def _routed(t: Tables) -> DataFrame:
    ev = t.events
    kept = tables.trusted(ev).select("hand_id", F.lit("action_events").alias("sink"), "player_name")
    low = tables.skipped(ev).select("hand_id", F.col("tag").alias("sink"), F.get_json_object("payload", "$.player").alias("player_name"))
    return kept.unionByName(low).groupBy("hand_id", "sink", "player_name").agg(F.count("*").alias("n"))


def _alert_windows(t: Tables, alerts: DataFrame, *fields: str) -> DataFrame:
    out = _drain(t, alerts).select("feed", "window_start", "tag", "level", *[
        F.get_json_object("payload", f"$.{f}").cast("double").alias(f) for f in fields])
    return out.withColumn("window_start", F.col("window_start").cast("timestamp"))


def _diagnostic_alerts(t: Tables) -> DataFrame:
    """Health windows over the diagnostics the events stand for, six hours each."""
    diag = _stream(t, EVENTS).select(
        F.when(F.col("event_type") == "error", "WARN").otherwise("INFO").alias("level"), F.col("ts").alias("occurred_at"))
    return _alert_windows(t, jobs.diagnostic_alerts(jobs.diagnostic_windows(diag, window="6 hours"), at_most=20), "warn_error_count")


def _hand_alerts(t: Tables) -> DataFrame:
    """A hand starts at every purchase of a few users; all other events tell that time goes on."""
    rows = _stream(t, EVENTS).withColumn("feed_of", F.concat(F.lit("F"), F.col("user_id") % 3))
    hands = rows.where("event_type = 'purchase' and user_id % 10 < 3").withColumnRenamed("ts", "started_at")
    beats = rows.where("not (event_type = 'purchase' and user_id % 10 < 3)").withColumnRenamed("ts", "at")
    windows = jobs.hand_windows(hands, beats, key="feed_of", window="1 hour")
    return _alert_windows(t, jobs.hand_alerts(windows, at_least=2), "hands_last_30min")


def _event_alerts(t: Tables) -> DataFrame:
    rows = _stream(t, EVENTS).select(
        F.col("ts").alias("timestamp"), (F.lit(0.5) + F.col("user_id") % 3 / 8).alias("confidence_score"), F.struct(
            F.when(F.col("event_type") == "click", "x").alias("override_reason"), F.when(F.col("event_id") % 9 < 4, 1.0).alias("stack_delta")).alias("raw"))
    return _alert_windows(t, jobs.event_alerts(jobs.event_windows(rows, window="1 hour"), baseline_conf=0.7),
                          "drop_pct", "recent_override_count", "stack_null_count", "rate_pct")


def _streamed_boards(t: Tables) -> DataFrame:
    pairs = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.substring(F.col("shown"), i * 2 + 1, F.lit(2)))
    readings = _stream(t, dq.CARD_READINGS).withColumn("board", F.array_join(F.filter(pairs, lambda c: c != ""), ",")).drop("shown")
    return _drain(t, jobs.boards_by_street(readings, ["table_id", "hand_id"])).select("table_id", "hand_id", "street", F.col("board").alias("cards"))


def _flow_notes(t: Tables) -> DataFrame:
    rows = observed.observed_hands(t.observations, pot_label=None, width=dq.DAY)
    notes = observed.action_diagnostics(observed.scored_actions(rows, debounce_s=7200.0, width=dq.DAY))
    text = lambda f: F.get_json_object("payload", f"$.{f}").alias(f)
    return notes.select("hand_id", "tag", "level", "occurred_at", text("player"), text("final_action"), text("action"), text("street"),
                        *[text(f).cast("double").alias(f) for f in ("seat", "stack_before", "stack_after", "ts_delta_sec")])


def _preserved(t: Tables) -> DataFrame:
    judged = dq._judged(t).withColumn("seat", F.col("sequence_number") % 9)
    notes = d.preserved_diagnostics(judged, occurred_at=F.lit(None).cast("timestamp"))
    text = lambda f: F.get_json_object("payload", f"$.{f}").alias(f)
    return notes.select("hand_id", "tag", "level", text("text_action"), text("stack_action"), *[
        text(f).cast("double").alias(f) for f in ("seat", "stack_delta", "stack_after", "current_to_call")])


def _evidence(t: Tables) -> DataFrame:
    """What is kept of events that are not trusted."""
    text = lambda f: F.get_json_object("payload", f"$.{f}").alias(f)
    return tables.skipped(t.events).select("hand_id", "tag", "level", "occurred_at", *map(text, ("player", "position", "street", "action", "override_reason")), *[
        text(f).cast("double").alias(f) for f in ("amount", "confidence", "stack_before", "stack_after", "stack_delta")])


def _upserted(t: Tables, text: str, keys: list[str], reduce) -> DataFrame:
    """A table after three batches of upserts and the replay of the second."""
    rows, path = dq.run(t, text), new_folder(t.spark, "upserted")
    parts = [rows.where(F.pmod(F.xxhash64(*rows.columns), F.lit(3)) == n) for n in range(3)]
    for n in (0, 1, 2, 1):
        upsert.upsert(parts[n], path, keys, reduce, buckets=8)
    return upsert.read_upserted(t.spark, path, rows.schema)


def _upserted_hands(t: Tables) -> DataFrame:
    out = _upserted(t, VERSIONS.replace("as started_at", "as begun"), ["id"], upsert.first_and_last_version)
    return tables.current_hands(out.withColumn("started_at", F.col("begun").cast("timestamp")).drop("begun"))


KEYS = dq.KEYS
EVENTS = "select event_id, ts, user_id, event_type from events"
MOVES = """select user_id as hand_id, cast(event_id as string) as id, event_id as sequence_number, ts,
  case event_type when 'click' then 'preflop' when 'view' then 'flop' when 'purchase' then 'turn' else 'river' end as street,
  case when event_id % 4 = 0 then null else cast(event_id % 37 as double) end as stack_delta from events"""

QUERIES = {
    "current_hands": query(lambda t: tables.current_hands(dq.run(t, VERSIONS))),
    "player_registry": query(lambda t: tables.merged_registry(dq.run(t, SIGHTINGS))),
    "upserted_registry": query(lambda t: _upserted(t, SIGHTINGS.replace("ts as seen_at", "cast(ts as timestamp) as seen_at"), ["phash"], tables.merged_registry)
                               .withColumn("seen_at", F.col("seen_at").cast("timestamp"))),
    "upserted_hands": query(_upserted_hands),
    "replay_corrections": query(_corrections),
    "routed_events": query(_routed),
    "skipped_evidence": query(_evidence),
    "flow_diagnostics": query(_flow_notes),
    "preserved_diagnostics": query(_preserved),
    "post_events": query(lambda t: d.post_events(d.blind_posts(t.hands)).select(
        "id", "hand_id", "player_name", "position", "action_type", "sequence_number", "amount",
        F.col("raw.stack_after").alias("stack_after"), F.col("raw.synthetic").alias("synthetic"))),
    "observed_events": query(lambda t: observed.observed_events(
        t.observations, pot_label=None, debounce_s=60.0, width=dq.DAY).select("*", "raw.*").drop("raw")),
    "stream_action_changes": query(lambda t: _drain(t, jobs.changed_actions(_stream(t, derivations.OBSERVATIONS), KEYS)).drop("late")),
    "stream_debounced_events": query(lambda t: _drain(t, jobs.debounced(
        _stream(t, EVENTS), keys=["user_id", "event_type"], order=["ts", "event_id"], seconds=SIX_HOURS)).drop("late")),
    "stream_cleaned_stacks": query(lambda t: _drain(t, jobs.cleaned_stacks(_stream(t, derivations.OBSERVATIONS), KEYS)).select(
        *KEYS, "tick", "value", "stack", "replaced")),
    "stream_segment_hands": query(lambda t: _drain(t, jobs.segmented(_stream(t, derivations.OBSERVATIONS), pot_label=None)).select(
        "table_id", "tick", "kind", "boundary", "pot_latest", "pot_peak")),
    "stream_cleaned_pots": query(lambda t: _drain(t, jobs.cleaned_pots(_stream(t, derivations.OBSERVATIONS), ["table_id"])).select(
        "table_id", "tick", "value", "accepted", "pot_before", "pot")),
    "stream_showdown_decisions": query(lambda t: _drain(t, jobs.showdown_decisions(_stream(t, dq.CANDIDATES))).drop("late")),
    "post_diagnostics": query(lambda t: d.post_diagnostics(d.blind_posts(t.hands)).groupBy("tag", "level").agg(
        F.count("*").alias("n"), F.count(F.get_json_object("payload", "$.amount")).alias("amounts"))),
    "event_corrections": query(lambda t: tables.event_corrections(t.events.select(
        F.col("id").alias("event_id"), "action_type", F.when(F.col("sequence_number") == 1, "fold").otherwise("jump").alias("corrected_action"),
        F.when(F.col("sequence_number") == 1, "").alias("notes"), F.col("timestamp").alias("corrected_at")))),
    "stream_decision_times": query(lambda t: _drain(t, jobs.decision_times(_stream(t, derivations.OBSERVATIONS), KEYS)).select(
        *KEYS, "tick", "decision_time_ms", "used_timebank")),
    "stream_pointer_events": query(lambda t: _drain(t, jobs.pointer_events(
        _stream(t, dq.SCANS), ["table_id"], recent_s=SIX_HOURS)).drop("late", "seat", "value")),
    "stream_seat_lifecycle": query(lambda t: _drain(t, jobs.seat_lifecycle(_stream(t, dq.TARGETS))).drop("late")),
    "stream_hand_phases": query(lambda t: _drain(t, jobs.hand_phases(_stream(t, dq.PHASES))).drop("late")),
    "stream_parsed_actions": query(lambda t: _drain(t, jobs.parsed_actions(_stream(t, derivations.OBSERVATIONS)))),
    "stream_diagnostic_alerts": query(_diagnostic_alerts),
    "stream_betting_state": query(lambda t: _drain(t, jobs.betting_state(_stream(t, MOVES))).select(
        "hand_id", "street", "sequence_number", "current_to_call", "is_first_bet_this_street")),
    "stream_board_by_street": query(_streamed_boards),
    "stream_sequence_numbers": query(lambda t: _drain(t, jobs.sequence_numbers(
        _stream(t, MOVES).drop("sequence_number"))).select("id", "hand_id", "sequence_number")),
    "stream_observed_events": query(lambda t: _drain(t, flow.observed_events(
        _stream(t, derivations.OBSERVATIONS), pot_label=None, debounce_s=60.0)).where("not late").select("*", "raw.*").drop("raw", "late")),
    "stream_hand_alerts": query(_hand_alerts),
    "stream_event_alerts": query(_event_alerts),
}


def flow_sql(named: bool = False, told: str | None = None) -> str:
    """The observation flow in SQL.  ``told``: what to select of its steps instead of the events.  ``named``: inside a statement that has the rows of a feed in ``r`` who sits where in ``seats`` and where nobody sits in ``empty_``."""
    if named:
        rows = "with rows0 as (select * exclude (street) from r where kind in ('action', 'stack', 'timer', 'pot', 'community')),"
        taken = "where kind in ('pot', 'community') or not exists (select 1 from empty_ e where e.hand_id = w.hand_id and e.seat = w.seat)"
        people = "judged as (select j.*, coalesce(p.player_name, 'Player_' || j.seat) as player_name, coalesce(p.position, 'UTG') as position from scored j left join seats p using (hand_id, seat)),"
    else:
        rows = f"""with seg as ({dq._SEGMENT}),
  rows0 as (select o.*, o.table_id || '-' || s.hand_no as hand_id, s.pot_latest as pot_after from obs o
    join seg s on s.table_id = o.table_id and s.tick = o.tick),"""
        taken = ""
        people = "judged as (select *, 'Player_' || seat as player_name, 'UTG' as position from scored),"
    events = f"""select hand_id || '-' || nr as id, hand_id, player_name, position, street, action_type,
    nr + 2 as sequence_number, amount, confidence_score, {ts('ts')} as timestamp, {ts('ts')} as created_at, text as action_text,
    stack_before, stack_after, stack_delta, pot_before, pot_after, pot_delta, text_action as text_derived_action,
    stack_action as stack_derived_action, override_reason, epoch_us(e - s) // 1000 as decision_time_ms, up > 0 as used_timebank,
    false as synthetic, current_to_call, is_first_bet_this_street
  from taken left join times using (hand_id, seat, tick)"""
    return f"""
  {rows}
  rows1w as (select *, lag(pot_after) over w as pot_before, coalesce(last_value(case when kind = 'community' then
        case when value = 0 then 'preflop' when value = 3 then 'flop' when value = 4 then 'turn' when value >= 5 then 'river' end end
        ignore nulls) over (partition by hand_id order by ts, tick rows unbounded preceding), 'preflop') as street
    from rows0 window w as (partition by hand_id order by ts, tick)),
  rows1 as (select * from rows1w w {taken}),
  texts as (select *, lag(trim(text)) over (partition by hand_id, seat order by ts, tick) as prev, upper(trim(text)) as u
    from rows1 where kind = 'action' and trim(coalesce(text, '')) <> ''),
  named as (select *, {dq._ACT} as text_action from texts where prev is distinct from trim(text)),
  acts as (select *, case when text_action not in ('fold', 'check') then
      try_cast(nullif(regexp_extract(u, '(\\d+\\.?\\d*)', 1), '') as double) end as amount from named where text_action is not null),
  seen as (select hand_id, seat, list({{'t': tick, 's': ts, 'v': value}} order by ts, tick) as xs from rows1 where kind = 'stack' group by all),
  stacks as (select hand_id, seat, unnest(list_reduce(xs, lambda a, x:
      if(coalesce(x.v > 0 and a.p > 0 and (x.v > a.p * 9 or x.v * 9 < a.p), false),
         {{'p': a.p, 'o': list_append(a.o, {{'t': x.t, 's': x.s, 'v': a.p}})}},
         {{'p': coalesce(x.v, a.p), 'o': list_append(a.o, {{'t': x.t, 's': x.s, 'v': x.v}})}}),
      {{'p': null::double, 'o': []::struct(t bigint, s timestamp, v double)[]}}).o) as r from seen),
  moves as (select hand_id, seat, r.s as ts, r.t as tick, r.v as stack from stacks union all select hand_id, seat, ts, tick, null from acts),
  held as (select *, last_value(stack ignore nulls) over (partition by hand_id, seat order by ts, tick
      rows between unbounded preceding and 1 preceding) as stack_before from moves),
  live as (select a.*, h.stack_before, max((text_action = 'fold')::int) over (partition by a.hand_id, a.seat order by a.ts, a.tick
      rows between unbounded preceding and 1 preceding) as gone from acts a join held h using (hand_id, seat, tick)),
  numbered as (select *, row_number() over (partition by hand_id order by ts, tick, seat) as nr,
      case when text_action = 'all_in' then 0 end::double as stack_after from live where gone is distinct from 1),
  faced as (select *, coalesce(max(stack_before - stack_after) filter (stack_before - stack_after > 2) over (partition by hand_id, street
      order by ts, tick, seat rows between unbounded preceding and 1 preceding), 0)::double as current_to_call from numbered),
  b as (select *, current_to_call = 0 as is_first_bet_this_street, (stack_before - stack_after)::double as stack_delta,
      pot_after - pot_before as pot_delta from faced),
  scored as (with {dq._JUDGED[dq._JUDGED.index("  c as (select"):].strip()}),
  {people}
  lists as (select table_id, player_name, street, action_type, list({{'h': hand_id, 'n': nr, 's': ts}} order by ts, tick) as xs from judged group by all),
  kept as (select unnest(list_reduce(xs, lambda a, x: if(a.l is null or x.s - a.l >= interval 60 second,
      {{'l': x.s, 'o': list_append(a.o, {{'h': x.h, 'n': x.n}})}}, a),
      {{'l': null::timestamp, 'o': []::struct(h varchar, n bigint)[]}}).o) as k from lists),
  taken as (select j.* from judged j join kept on k.h = j.hand_id and k.n = j.nr),
  clock as (select hand_id, seat, ts, tick, 'timer' as kind, value from rows1 where kind = 'timer'
    union all select hand_id, seat, ts, tick, 'action', null from taken),
  runs as (select *, count(*) filter (kind = 'action') over (partition by hand_id, seat order by ts, tick
      rows between unbounded preceding and 1 preceding) as run from clock),
  jumps as (select *, lag(value) over (partition by hand_id, seat, run, kind order by ts, tick) as pv from runs),
  times as (select hand_id, seat, min(ts) filter (kind = 'timer') as s, max(tick) filter (kind = 'action') as tick,
      max(ts) filter (kind = 'action') as e, count(*) filter (kind = 'timer' and value > pv + 2) as up from jumps group by hand_id, seat, run)
  {told or events}"""


_NOTES = f"""select x.* from (
    select hand_id, ts, seat, player_name, street, action_type, text, stack_before, stack_after, text_preserved, k.k is not null as accepted,
      max(case when k.k is not null then ts end) over (partition by table_id, player_name, street, action_type order by ts, tick rows between unbounded preceding and 1 preceding) as taken_at
    from judged j left join kept k on k.k.h = j.hand_id and k.k.n = j.nr) n,
  lateral (
    select n.hand_id as hand_id, 'all_in.detected' as tag, 'INFO' as level, {ts('n.ts')} as occurred_at, n.player_name as player, n.action_type as final_action, null as action, cast(null as varchar) as street,
      n.seat::double as seat, n.stack_before, n.stack_after, null as ts_delta_sec where n.action_type = 'all_in'
    union all select n.hand_id as hand_id, 'all_in.text_only_candidate', 'WARN', {ts('n.ts')}, n.player_name, n.action_type, null, null, n.seat::double, n.stack_before, n.stack_after, null
      where n.action_type <> 'all_in' and regexp_matches(lower(n.text), 'all in|all-in|allin|全押')
    union all select n.hand_id as hand_id, 'action.dedup_skip', 'INFO', {ts('n.ts')}, n.player_name, null, n.action_type, n.street, null, null, null, {rnd('epoch_us(ts - taken_at) / 1e6', 2)} where not n.accepted
  ) x"""


def _columns(name: str, columns: str) -> str:
    return f"select {columns} from ({dq.ORACLE[name]})"


_CURRENT = sql(f"""
        select id, any_value(table_name) as table_name, {ts('any_value(started_at)')} as started_at,
          list(result order by version desc)[1] as result, list(pot_size_final order by version desc)[1] as pot_size_final
        from versions group by id""", versions=VERSIONS)
_REGISTRY = sql(f"""select phash, arg_max(name, seen_at) as name, {ts('max(seen_at)')} as seen_at
        from sightings group by 1""", sightings=SIGHTINGS)

ORACLE = {
    "current_hands": _CURRENT,
    "upserted_hands": _CURRENT,
    "player_registry": _REGISTRY,
    "upserted_registry": _REGISTRY,
    "replay_corrections": sql(f"""
        select hand_id, id as event_id, 'reviewer override; original conf=' || confidence_score as notes,
          {ts('timestamp')} as corrected_at, if(sequence_number = 1, 'action_type', 'amount') as correction_type,
          if(sequence_number = 1, '"' || action_type || '"', coalesce(amount::varchar, 'null')) as original_value,
          if(sequence_number = 1, '"fold"', (amount * 2)::varchar) as corrected_value
        from ev where confidence_score < 0.6 and (sequence_number = 1 or (sequence_number = 3 and amount is not null))"""),
    "routed_events": sql("""select hand_id, if(confidence_score >= 0.7, 'action_events', 'action.low_tier_skip') as sink,
        player_name, count(*) as n from ev group by all"""),
    "post_events": sql("""
        with p as (select id, 'post_sb' as a, 'SB' as pos, blind_sb as amount, (button_seat_index + 1) % 9 as s, seats, si from hand
          union all select id, 'post_bb', 'BB', blind_bb, (button_seat_index + 2) % 9, seats, si from hand)
        select id || '-' || a as id, id as hand_id, seats[pos] as player_name, pos as position, a as action_type,
          if(pos = 'SB', 1, 2) as sequence_number, amount, si[s::varchar] - amount as stack_after, true as synthetic
        from p where amount is not null and seats[pos] is not null"""),
    "skipped_evidence": sql(f"""select hand_id::varchar as hand_id, 'action.low_tier_skip' as tag, 'INFO' as level, {ts('timestamp')} as occurred_at, player_name as player,
        position, street, action_type as action, override_reason, amount::double as amount, confidence_score::double as confidence, stack_before::double as stack_before,
        stack_after::double as stack_after, stack_delta::double as stack_delta from ev where confidence_score < 0.7"""),
    "flow_diagnostics": sql(flow_sql(told=_NOTES).replace("interval 60 second", "interval 7200 second")),
    "preserved_diagnostics": sql(f"""select hand_id, 'p3.text_priority_preserved' as tag, 'INFO' as level, text_action, stack_action, (sequence_number % 9)::double as seat,
        stack_delta, stack_after, current_to_call from ({dq._JUDGED}) where text_preserved"""),
    "observed_events": sql(flow_sql()),
    "stream_betting_state": sql("""select hand_id, street, sequence_number,
        coalesce(max(case when stack_delta > 2 then stack_delta end) over w, 0)::double as current_to_call,
        max(case when stack_delta > 2 then stack_delta end) over w is null as is_first_bet_this_street
        from moves window w as (partition by hand_id, street order by ts, sequence_number rows between unbounded preceding and 1 preceding)""", moves=MOVES),
    "stream_board_by_street": dq.ORACLE["board_by_street"],
    "stream_sequence_numbers": sql("""select id, hand_id, (row_number() over (partition by hand_id order by ts, id) + 2)::int as sequence_number from moves""", moves=MOVES),
    "stream_observed_events": sql(flow_sql()),
    "stream_action_changes": dq.ORACLE["action_changes"],
    "stream_debounced_events": dq.ORACLE["debounced_events"],
    "stream_cleaned_stacks": dq.ORACLE["cleaned_stacks"],
    "stream_segment_hands": _columns("segment_hands", "table_id, tick, kind, boundary, pot_latest, pot_peak"),
    "stream_cleaned_pots": _columns("cleaned_pots", "table_id, tick, value, accepted, pot_before, pot"),
    "stream_showdown_decisions": dq.ORACLE["showdown_decisions"],
    "post_diagnostics": sql("""
        with p as (select seats['SB'] as name, blind_sb as amount from hand union all select seats['BB'], blind_bb from hand where blind_sb is not null and blind_bb is not null)
        select if(amount is not null and name is not null, 'post.injection_done', 'post.injection_skipped') as tag, 'INFO' as level,
          count(*) as n, count(amount) as amounts from p group by 1"""),
    "event_corrections": sql(f"""select id as event_id, action_type as original_action, 'fold' as corrected_action,
        {ts('timestamp')} as corrected_at, null::varchar as notes from ev where sequence_number = 1"""),
    "stream_decision_times": dq.ORACLE["decision_times"],
    "stream_pointer_events": dq.ORACLE["pointer_events"],
    "stream_seat_lifecycle": dq.ORACLE["seat_lifecycle"],
    "stream_hand_phases": _columns("hand_phases", "hand_id, tick, ts, phase, from_phase, legal"),
    "stream_parsed_actions": dq.ORACLE["parse_actions"],
    # A window is told once its end lies a minute (the allowed delay) behind the newest reading.
    "stream_diagnostic_alerts": sql(f"""
        with w as (select time_bucket(interval 6 hour, ts) as b, count(*) filter (event_type = 'error') as n from events group by 1)
        select 'all' as feed, {ts('b')} as window_start, 'health.diag_burst' as tag, 'WARN' as level, n::double as warn_error_count
        from w where n > 20 and b + interval 6 hour <= (select max(ts) - interval 1 minute from events)"""),
    "stream_hand_alerts": sql(f"""
        with e as (select *, 'F' || user_id % 3 as feed, event_type = 'purchase' and user_id % 10 < 3 as hand from events),
        f as (select feed, time_bucket(interval 1 hour, min(ts)) as a from e group by 1),
        w as (select feed, unnest(generate_series(a, (select max(ts) - interval 61 minute from events), interval 1 hour)) as b from f),
        c as (select feed, time_bucket(interval 1 hour, ts) as b, count(*) filter (hand) as n from e group by all)
        select feed, {ts('b')} as window_start, 'health.low_hand_rate' as tag, 'WARN' as level, coalesce(n, 0)::double as hands_last_30min
        from w left join c using (feed, b) where coalesce(n, 0) < 2"""),
    "stream_event_alerts": sql(f"""
        with e as (select time_bucket(interval 1 hour, ts) as b, count(*) as n, avg(0.5 + user_id % 3 / 8) as conf, count(*) filter (event_type = 'click') as o,
            count(*) filter (event_id % 9 >= 4) as u from events group by 1),
        w as (select *, (0.7::double - conf) * 100 / 0.7::double as d from e where b + interval 1 hour <= (select max(ts) - interval 1 minute from events)),
        a as (select b, 'health.conf_dropped' as tag, {rnd('d', 1)} as drop_pct, null as o, null as u, null as rate from w where d > 10
          union all select b, 'health.override_spike', null, o, null, {rnd('o * 100.0 / n', 1)} from w where n > 10 and o * 100.0 / n > 10
          union all select b, 'health.stack_ocr_degraded', null, null, u, {rnd('u * 100.0 / n', 1)} from w where n > 10 and u * 100.0 / n > 50)
        select 'all' as feed, {ts('b')} as window_start, tag, 'WARN' as level, drop_pct::double as drop_pct, o::double as recent_override_count,
          u::double as stack_null_count, rate::double as rate_pct from a"""),
}
