"""Observation to event rules, each over the whole derived tables.

Where a rule needs readings the shared derivations lack, a statement both
engines understand derives them from the given tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from railbird.operators import derive as d
from railbird.plans.base import Tables, query, sql, ts
from railbird.sources.testdata import run_derivation

SIX_HOURS = 6 * 3600.0
DAY = "6 days"
KEYS = ["table_id", "seat"]

# ------------------------------------------------------------ derived readings
BUTTON = """select o_orderkey as hand_id, cast(s.i as int) as seat, o_orderkey * 10 + s.i as tick,
  case when o_orderkey % 3 = 0 and s.i = o_orderkey % 6 then 'D' else '' end as text,
  cast(100 + (o_orderkey * 7 + s.i * 13) % (case when o_orderkey % 5 = 0 then 20 else 90 end) as double) as brightness
from orders EACH_OF_6"""
BLINDS = """select o_orderkey as hand_id, cast(s.i as int) as seat, o_orderkey * 10 + s.i as tick,
  case when (o_orderkey + s.i) % 11 = 0 then '' when (o_orderkey + s.i) % 13 = 0 then '$100000'
       else '$' || cast((o_orderkey * 3 + s.i) % 40 as string) || '.' end as text
from orders EACH_OF_6"""
BLIND_HANDS = """select o_orderkey as id, cast(o_orderkey % 6 as int) as button_seat_index,
  case when o_orderkey % 17 = 0 then 1 else 6 end as num_seats, o_orderkey % 4 = 0 as board_dealt from orders"""
AVATARS = """select o_orderkey as hand_id, cast(s.i as int) as seat,
  cast(case when (o_orderkey + s.i) % 7 = 0 then 0 else (o_orderkey * (s.i + 1)) % 23 + 1 end as bigint) as phash,
  case when (o_orderkey + s.i) % 2 = 0 then '' else cast(o_orderkey % 500 as string) end as stack_text
from orders EACH_OF_6"""
SIZED = """select o_orderkey as id, cast(o_orderkey % 5 as int) as button_seat_index,
  case o_orderkey % 4 when 0 then 6 when 1 then 8 when 2 then 9 else 7 end as num_seats from orders"""
SEATS = """select o_orderkey as hand_id, cast(s.i as int) as seat
from orders EACH_OF_6"""
TARGETS = """select 'T' || cast(user_id % 10 as string) as table_id, cast(user_id % 9 as int) as seat, event_id as tick, ts,
  case (event_id * 5 + user_id) % 7 when 0 then 'empty' when 1 then 'sitting_out' when 2 then 'active' when 3 then 'folded'
    when 4 then 'all_in' when 5 then 'leaving' else 'new_hand' end as target from events"""
PHASES = """select user_id as hand_id, event_id as tick, ts,
  case (event_id + case when event_id % 3 = 0 then user_id else 0 end) % 12 when 0 then 'between_hands' when 1 then 'dealing_cards'
    when 2 then 'blind_posting' when 3 then 'preflop_acting' when 4 then 'dealing_flop' when 5 then 'flop_acting'
    when 6 then 'dealing_turn' when 7 then 'turn_acting' when 8 then 'dealing_river' when 9 then 'river_acting'
    when 10 then 'showdown' else 'settling' end as phase from events"""
SCANS = """select 'T' || cast(user_id % 10 as string) as table_id, event_id as tick, ts,
  case when event_id % 4 = 0 then null else cast(user_id % 9 as int) end as seat,
  case when event_id % 4 = 0 then null else cast(event_id % 30 as int) end as value from events"""
SECOND = """select user_id as hand_id, event_id as tick, cast(user_id % 9 as int) as seat,
  case event_id % 3 when 0 then '' when 1 then 'CALL' else 'RAISE' end as text from events"""
PRIMARY = """select user_id as hand_id, event_id as tick, cast(user_id % 9 as int) as seat,
  case when event_id % 2 = 0 then '' else 'FOLD' end as text from events"""
FOCUS = """select user_id as hand_id, event_id as tick,
  cast(case when event_id % 5 = 0 then 9 else user_id % 9 end as int) as seat from events"""
CANDIDATES = """select 'T' || cast(user_id % 10 as string) as table_id, cast(floor(event_id / 40) as bigint) as hand_id,
  event_id as tick, ts, cast(user_id % 9 as int) as seat,
  case when event_id % 9 = 0 then '2c,3d,4h,5s' else '2c,3d,4h,5s,9c' end as board,
  case when event_id % 13 = 0 then 1 else 3 end as live_seats, user_id % 9 = 0 as is_hero,
  cast(event_id % 24 as int) as hash_distance, cast(100 + event_id % 97 as double) as brightness,
  cast(40 + event_id % 50 as double) as texture,
  substr('23456789TJQKA', cast(user_id % 13 + 1 as int), 1) || substr('cdhs', cast(user_id % 4 + 1 as int), 1) as card1,
  cast(1 - (event_id % 8) / 40.0 as double) as conf1,
  substr('23456789TJQKA', cast((user_id * 5) % 13 + 1 as int), 1) || substr('cdhs', cast((user_id + 1) % 4 + 1 as int), 1) as card2,
  cast(1 - (event_id % 5) / 60.0 as double) as conf2 from events"""
CARD_READINGS = """select 'T' || cast(user_id % 10 as string) as table_id, cast(floor(event_id / 40) as bigint) as hand_id, event_id as tick, ts,
  substr('2c3d4h5s9c', 1, cast(2 * (event_id % 6) as int)) || case when event_id % 7 = 0 then '2c' else '' end as shown from events"""


SEAT_TEXTS = """select 'T' || cast(user_id % 10 as string) as table_id, event_id as tick, ts, cast(user_id % 9 as int) as seat,
  case s.i when 0 then 'action' when 1 then 'fold' when 2 then 'amount' else 'stack' end as kind,
  case s.i when 0 then case event_id % 5 when 0 then 'CALL' when 1 then 'RAISE TO $20' when 2 then '' when 3 then 'CHECK' else 'ALL-IN' end
    when 1 then case event_id % 7 when 0 then 'FOLD' when 1 then ' 15 sec' when 2 then '' when 3 then 'ALL IN' when 4 then '99' when 5 then 'CALL 30' else 'hm' end
    when 2 then case event_id % 3 when 0 then '' when 1 then '12.5' else '7' end end as text,
  case when s.i = 3 then cast(event_id % 400 as double) end as value
from events EACH_OF_4 where (event_id + s.i * 3) % 4 <> 0"""


def run(t: Tables, text: str):
    out = run_derivation(t.spark, t.sf_dir, text)
    return out.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in out.columns else out


def _judged(t: Tables):
    ev = d.betting_state(t.events)
    gap = F.when(F.col("sequence_number") % 3 == 0, F.lit(0.0)).otherwise(F.coalesce("raw.stack_delta", F.lit(0.0)))
    readings = ev.select(
        "id", "hand_id", "sequence_number", F.col("raw.text_derived_action").alias("text_action"),
        F.col("raw.stack_before").alias("stack_before"),
        F.when(F.col("raw.stack_delta").isNotNull(), F.col("raw.stack_after")).alias("stack_after"),
        F.when(F.col("sequence_number") % 5 != 0, F.col("raw.pot_after") - gap).alias("pot_before"),
        F.col("raw.pot_after").alias("pot_after"), "current_to_call", "is_first_bet_this_street")
    return d.judged_actions(readings)


def _debounced(t: Tables):
    ev = t.read("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    return d.debounced(ev, keys=["user_id", "event_type"], order=["ts", "event_id"], seconds=SIX_HOURS, width="10 days")


def _boards(t: Tables):
    readings = run(t, CARD_READINGS)
    pairs = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.substring(F.col("shown"), i * 2 + 1, F.lit(2)))
    return d.board_by_street(readings.withColumn("cards", pairs), ["table_id", "hand_id"])


def _summary(t: Tables):
    hands = t.hands
    boards = hands.select(F.col("id").alias("hand_id"), F.when(F.col("id") % 3 == 0, 4).otherwise(5).alias("river_count"))
    shown = hands.select(F.col("id").alias("hand_id"), F.explode(F.map_keys("showdown_cards")).alias("seat"))
    return d.showdown_summary(boards, t.events, shown)


def _insurance(t: Tables):
    allins = t.events.where(F.col("action_type") == "all_in").select(
        "hand_id", (F.col("sequence_number") % 3).alias("seat"), "player_name")
    return d.inferred_insurance(t.hands, allins)


QUERIES = {
    "seat_readings": query(lambda t: d.seat_readings(run(t, SEAT_TEXTS))),
    "parse_actions": query(lambda t: d.parse_actions(t.observations)),
    "judged_actions": query(_judged),
    "seat_positions": query(lambda t: d.seat_positions(run(t, SIZED), run(t, SEATS))),
    "button_choice": query(lambda t: d.button_choice(run(t, BUTTON))),
    "blind_levels": query(lambda t: d.blind_levels(run(t, BLIND_HANDS), run(t, BLINDS))),
    "blind_posts": query(lambda t: d.blind_posts(t.hands)),
    "inferred_insurance": query(_insurance),
    "empty_seats": query(lambda t: d.empty_seats(run(t, AVATARS))),
    "segment_hands": query(lambda t: d.segment_hands(t.observations, pot_label=None, width=DAY).select(
        "table_id", "tick", "kind", "boundary", "hand_no", "pot_latest", "pot_peak")),
    "action_changes": query(lambda t: d.action_changes(t.observations, KEYS, width=DAY)),
    "debounced_events": query(_debounced),
    "cleaned_stacks": query(lambda t: d.cleaned_stacks(t.observations, KEYS, width=DAY).select(
        *KEYS, "tick", "value", "stack", "replaced")),
    "cleaned_pots": query(lambda t: d.cleaned_pots(t.observations, ["table_id"], width=DAY).select(
        "table_id", "tick", "value", "accepted", "pot_before", "pot", "peak")),
    "betting_state": query(lambda t: d.betting_state(t.events).select(
        "hand_id", "sequence_number", "street", "current_to_call", "is_first_bet_this_street")),
    "decision_times": query(lambda t: d.decision_times(t.observations, KEYS, width=DAY).select(
        *KEYS, "tick", "decision_time_ms", "used_timebank")),
    "pointer_events": query(lambda t: d.pointer_events(run(t, SCANS), ["table_id"], recent_s=SIX_HOURS, width=DAY)),
    "showdown_decisions": query(lambda t: d.showdown_decisions(run(t, CANDIDATES), width=DAY)),
    "showdown_summary": query(_summary),
    "seat_lifecycle": query(lambda t: d.seat_lifecycle(run(t, TARGETS), width=DAY)),
    "hand_phases": query(lambda t: d.hand_phases(run(t, PHASES), width=DAY)),
    "board_by_street": query(_boards),
    "street_states": query(lambda t: d.street_states(
        t.observations.where(F.col("kind") == "community").select("table_id", "tick", "ts", "value"), ["table_id"], width=DAY)),
    "merged_readings": query(lambda t: d.merged_readings(run(t, PRIMARY), run(t, SECOND), run(t, FOCUS))),
    "sequence_numbers": query(lambda t: d.sequence_numbers(t.events).select("id", "hand_id", "sequence_number")),
}

# ------------------------------------------------------------ checking SQL
_ACT = """case when regexp_matches(u, 'ALL-IN|ALLIN|ALL IN|全下|全押|全压') then 'all_in'
  when regexp_matches(u, '\\bALL\\b') and not contains(u, 'CALL') then 'all_in'
  when regexp_matches(u, 'RAISE|加注') then 'raise' when regexp_matches(u, 'BET|下注') then 'bet'
  when regexp_matches(u, 'CALL|跟注') then 'call' when regexp_matches(u, 'CHECK|过牌|让牌|看牌') then 'check'
  when regexp_matches(u, 'FOLD|弃牌|盖牌') then 'fold' end"""

_TO_CALL = """coalesce(max(stack_delta) filter (stack_delta > 2) over (partition by hand_id, street order by sequence_number
  rows between unbounded preceding and 1 preceding), 0)"""

_JUDGED = f"""
  with a as (select id, hand_id, sequence_number, text_derived_action as text_action, stack_before,
      case when stack_delta is not null then stack_after when text_derived_action = 'all_in' then 0 end as stack_after,
      case when sequence_number % 5 <> 0 then pot_after - if(sequence_number % 3 = 0, 0, coalesce(stack_delta, 0)) end::double as pot_before,
      pot_after::double as pot_after, {_TO_CALL}::double as current_to_call, {_TO_CALL} = 0 as is_first_bet_this_street from ev),
  b as (select *, (stack_before - stack_after)::double as stack_delta, pot_after - pot_before as pot_delta from a),
  c as (select *, case when stack_delta is null then null
      when abs(stack_delta) <= 2 then if(current_to_call > 2, 'fold', 'check')
      when stack_after <= 5 then 'all_in'
      when current_to_call > 0 and abs(abs(stack_delta) - current_to_call) <= 2 then 'call'
      when is_first_bet_this_street then 'bet' else 'raise' end as stack_action from b),
  w as (select *, coalesce(stack_action <> text_action and ((text_action in ('fold', 'check') and abs(stack_delta) > 2)
      or (text_action <> 'all_in' and stack_action = 'all_in')), false) as won from c),
  f as (select *, if(won, stack_action, text_action) as action_type from w)
  select * exclude (won), if(won, 'stack-derived ' || stack_action || ' overrode text-derived ' || text_action, null) as override_reason,
    (case when won then 0.7
      when action_type in ('fold', 'check') then case when stack_delta is null then 0.85 when abs(stack_delta) <= 2 then 1 else 0.3 end
      when stack_delta is null then if(pot_delta is null, 0.5, 0.7) when pot_delta is null then 0.7
      when abs(stack_delta) <= 2 and abs(pot_delta) <= 2 then 0.3
      when abs(pot_delta - stack_delta) <= 2 then 1 when pot_delta > stack_delta then 0.9 else 0.7 end)::double as confidence_score,
    not won and coalesce(stack_action <> text_action, false) as text_preserved
  from f"""

_POSTS = """
  with h as (select *, case when blind_sb is null then 'blind_level_missing' end as why,
      (button_seat_index + 1) % 9 as s1, (button_seat_index + 2) % 9 as s2 from hand),
  p as (select id, started_at, why, 'post_sb' as a, 'SB' as pos, s1 as s, seats['SB'] as who, blind_sb as amt, si[s1::varchar] as sb,
        0::double as pb, blind_sb as pa, 1 as nr from h
      union all select id, started_at, why, 'post_bb', 'BB', s2, seats['BB'], blind_bb, si[s2::varchar], blind_sb, blind_sb + blind_bb,
        1 + (seats['SB'] is not null)::int from h where why is null)
  select id as hand_id, case when why is null and who is not null then nr end as sequence_number,
    if(why is null, a, null) as action_type, if(why is null, pos, null) as position, if(why is null, s, null) as seat,
    if(why is null, who, null) as player_name, amt as amount, if(why is null, sb, null) as stack_before,
    if(why is null, sb - amt, null) as stack_after, if(why is null, pb, null) as pot_before, if(why is null, pa, null) as pot_after,
    case when why is null and who is not null then 0.9::double end as confidence_score,
    coalesce(why, case when who is null then 'player_unknown' end) as skip_reason, """ + ts("started_at") + """ as timestamp
  from p"""

_GAIN = """
  with a as (select hand_id, sequence_number % 3 as seat, player_name from ev where action_type = 'all_in'),
  v as (select hand_id, seat, player_name, coalesce(si[seat::varchar], 0) as stack_initial, coalesce(sf[seat::varchar], 0) as stack_final,
      coalesce(pot_size_final, 0) as pot from a join hand on hand.id = a.hand_id),
  g as (select *, stack_final - stack_initial as gain from v),
  c as (select *, case when pot > 0 and gain >= pot / 2 then 'won_main_pot' when stack_final < 1 then 'lost_no_insurance'
      when stack_final = 800 or (stack_final > 0 and stack_final % 50 = 0) then 'rebuy'
      when pot > 0 and gain > 0 then 'insurance_payout' else 'unknown' end as classification from g)
  select *, case when classification = 'insurance_payout' then greatest(0, pot - pot * 0.05 - gain)::double end as premium_inferred from c"""


def _folded(source: str, keys: str, fields: str, init: str, body: str, out: str, order: str = "ts, tick") -> str:
    """A sequential fold in SQL: list per key, reduced left to right, one result row per element."""
    return f"""
      with l as (select {keys}, list({fields} order by {order}) as xs from {source} group by all),
      f as (select {keys}, unnest(list_reduce(xs, lambda a, x: {body}, {init}).o) as r from l)
      select {keys}, {out} from f"""


_SEGMENT = """
  with l as (select table_id, list({'t': tick, 'k': kind, 'v': value} order by ts, tick) as xs from obs group by all),
  f as (select table_id, unnest(list_reduce(xs, lambda a, x:
      list_transform([if(x.k = 'community' and a.b > 0 and x.v = 0, 'community_reset',
                         if(x.k = 'pot' and a.pk is not null and x.v < a.pk * 0.5, 'pot_label', null))],
        lambda w: list_transform([{'b': if(w is not null, 0, if(x.k = 'community', x.v::int, a.b)),
             'p': if(w is not null, null, a.p), 'pk': if(w is not null, null, a.pk)}],
          lambda s: list_transform([x.k = 'pot' and (s.p is null or x.v >= s.p * 0.9)],
            lambda ok: list_transform([{'b': s.b, 'p': if(ok, x.v, s.p), 'pk': if(ok, greatest(x.v, s.pk), s.pk),
                 'n': a.n + (w is not null)::int, 'w': w}],
              lambda z: {'b': z.b, 'p': z.p, 'pk': z.pk, 'n': z.n, 'o': list_append(a.o,
                {'t': x.t, 'k': x.k, 'w': z.w, 'n': z.n, 'p': z.p, 'pk': z.pk})})[1])[1])[1])[1],
      {'b': 0, 'p': null::double, 'pk': null::double, 'n': 0,
       'o': []::struct(t bigint, k varchar, w varchar, n int, p double, pk double)[]}).o) as r from l)
  select table_id, r.t as tick, r.k as kind, r.w as boundary, r.n as hand_no, r.p as pot_latest, r.pk as pot_peak from f"""

_TRANS = ("map {'empty': ['sitting_out', 'active'], 'sitting_out': ['active', 'leaving', 'empty'], "
          "'active': ['folded', 'all_in', 'sitting_out', 'leaving'], 'folded': ['active', 'sitting_out', 'leaving', 'empty'], "
          "'all_in': ['active', 'sitting_out', 'leaving', 'empty'], 'leaving': ['empty']}")

_LIFE = f"""
  with l as (select table_id, seat, list({{'t': tick, 'g': target, 's': ts}} order by ts, tick) as xs from targets group by all),
  f as (select table_id, seat, unnest(list_reduce(xs, lambda a, x:
      list_transform([{{'pro': a.s = 'empty' and x.g in ('folded', 'all_in', 'leaving')}}],
        lambda p: list_transform([if(p.pro, 'active', a.s)],
          lambda c: list_transform([x.g = 'new_hand' or x.g = c or list_contains({_TRANS}[c], x.g)],
            lambda ok: list_transform([case when x.g = 'new_hand' then if(c in ('folded', 'all_in'), 'active', c)
                                            when ok then x.g else c end],
              lambda e: {{'s': e, 'o': list_append(a.o, {{'t': x.t, 's': x.s, 'g': x.g, 'f': a.s, 'e': e, 'l': ok, 'p': p.pro}})}})[1])[1])[1])[1],
      {{'s': 'empty', 'o': []::struct(t bigint, s timestamp, g varchar, f varchar, e varchar, l boolean, p boolean)[]}}).o) as r from l)
  select table_id, seat, r.t as tick, {ts('r.s')} as ts, r.g as target, r.f as from_state, r.e as effective_state, r.l as legal,
    r.p as promoted, r.e in ('sitting_out', 'folded', 'all_in', 'leaving') as skippable from f"""

# What may follow each phase, written out.
_NEXT = """('between_hands', ['dealing_cards']), ('dealing_cards', ['blind_posting']), ('blind_posting', ['preflop_acting']), ('preflop_acting', ['dealing_flop', 'settling']),
  ('dealing_flop', ['flop_acting']), ('flop_acting', ['dealing_turn', 'settling']), ('dealing_turn', ['turn_acting']),
  ('turn_acting', ['dealing_river', 'settling']), ('dealing_river', ['river_acting']), ('river_acting', ['showdown', 'settling']),
  ('showdown', ['settling']), ('settling', ['between_hands'])"""

_LET = lambda name, value, body: f"list_transform([{value}], lambda {name}: {body})[1]"
_PAIR = "x.c1 || x.c2"
_BEFORE = """case when len(list_filter(string_split(coalesce(x.b, ''), ','), lambda c: c <> '')) < 5 then 'gate1_board'
  when coalesce(x.l, 0) < 2 then 'gate2_live' when x.r then 'hero_seat'
  when x.a - list_filter(at0, lambda e: e.s = x.s)[-1].t < interval 1 second then 'throttled'
  when x.d is null or x.d < 6 then 'no_overlay' when coalesce(x.br, 0) < 120 then 'dark_cards_area'
  when coalesce(x.tx, 0) < 50 then 'uniform_back' end"""
_CARDS = """case when pre is not null then pre when len(list_filter(sh0, lambda e: e.s = x.s)) > 0 then 'already_accepted'
  when coalesce(x.q1, 1) < 0.9 or coalesce(x.q2, 1) < 0.9 then 'gate5_low_conf' when x.c1 = x.c2 then 'gate6a_same_card' end"""
_LAST = f"""case when post is not null then post
  when len(list_filter(list_filter(hi1, lambda e: e.s = x.s)[-5:], lambda e: e.k = {_PAIR})) >= 3 then 'gate6b_repeated'
  when list_contains(string_split(x.b, ','), x.c1) or list_contains(string_split(x.b, ','), x.c2) then 'gate6c_on_board'
  when len(list_filter(sh0, lambda e: e.c1 in (x.c1, x.c2) or e.c2 in (x.c1, x.c2))) > 0 then 'gate6c_other_seat' else 'accepted' end"""
_GATE = f"""
  with l as (select table_id, list({{'i': tick, 'h': hand_id, 's': seat, 'b': board, 'l': live_seats, 'r': is_hero, 'd': hash_distance,
      'br': brightness, 'tx': texture, 'c1': card1, 'q1': conf1, 'c2': card2, 'q2': conf2, 'a': ts}} order by ts, tick, seat) as xs
    from candidates group by all),
  f as (select table_id, unnest(list_reduce(xs, lambda a, x: {
      _LET('same', 'a.h is not distinct from x.h', _LET('at0', "if(same, a.at, [])", _LET('sh0', "if(same, a.sh, [])",
      _LET('pre', _BEFORE, _LET('post', _CARDS, _LET('hi1', f"if(post is null, list_append(a.hi, {{'s': x.s, 'k': {_PAIR}}}), a.hi)",
      _LET('why', _LAST, """{'h': x.h, 'at': if(pre is null, list_append(at0, {'s': x.s, 't': x.a}), at0),
        'sh': if(why = 'accepted', list_append(sh0, {'s': x.s, 'c1': x.c1, 'c2': x.c2}), sh0), 'hi': hi1,
        'o': list_append(a.o, {'i': x.i, 'w': why})}""")))))))},
      {{'h': null::bigint, 'at': []::struct(s int, t timestamp)[], 'sh': []::struct(s int, c1 varchar, c2 varchar)[],
        'hi': []::struct(s int, k varchar)[], 'o': []::struct(i bigint, w varchar)[]}}).o) as r from l)
  select c.* exclude (ts), {ts('c.ts')} as ts, r.w as reason, r.w = 'accepted' as accepted
  from candidates c join f on f.table_id = c.table_id and f.r.i = c.tick"""

ORACLE = {
    "seat_readings": sql(f"""
        with g as (select table_id, seat, ts, tick, max(trim(text)) filter (kind = 'action') as a, max(trim(text)) filter (kind = 'fold') as f,
            max(trim(text)) filter (kind = 'amount') as m from readings where kind <> 'stack' group by all),
        w as (select *, {_ACT} as word, regexp_extract(f, '\\b(\\d{{1,2}})\\b', 1) as n from (select *, upper(f) as u from g)),
        s as (select *, coalesce(n <> '' and try_cast(nullif(n, '') as int) <= 60 and word is null, false) as counts, coalesce(word in ('fold', 'all_in'), false) as takes from w),
        r as (select table_id, seat, ts, tick, 'timer' as kind, null as text, n::double as value from s where counts
          union all select table_id, seat, ts, tick, 'timer', null, null from s where takes or f = ''
          union all select table_id, seat, ts, tick, 'action', case when takes then f when a <> '' and coalesce(m, '') <> '' then a || ' ' || m else a end, null
            from s where not counts and (takes or a is not null)
          union all select table_id, seat, ts, tick, kind, text, value from readings where kind in ('amount', 'stack'))
        select table_id, tick, {ts('ts')} as ts, seat, kind, text, value from r""", readings=SEAT_TEXTS),
    "parse_actions": sql(f"""
        with a as (select *, upper(trim(text)) as u from obs where kind = 'action'), p as (select *, {_ACT} as act from a)
        select table_id, tick, {ts('ts')} as ts, seat, kind, text, value, act as action_type,
          case when act not in ('fold', 'check') then try_cast(nullif(regexp_extract(u, '(\\d+\\.?\\d*)', 1), '') as double) end as amount
        from p"""),
    "judged_actions": sql(_JUDGED),
    "seat_positions": sql("""
        select hand_id, seat, button_seat_index, num_seats, pos as position from (
          select *, case num_seats when 6 then ['BTN','SB','BB','UTG','MP','CO'] when 8 then ['BTN','SB','BB','UTG','UTG+1','MP','HJ','CO']
            when 9 then ['BTN','SB','BB','UTG','UTG+1','MP','MP+1','CO','HJ'] end[(seat - button_seat_index + num_seats) % num_seats + 1] as pos
          from seats join sized on sized.id = seats.hand_id) where pos is not null""", seats=SEATS, sized=SIZED),
    "button_choice": sql("""
        with r as (select hand_id, min(seat) filter (text = 'D') as d, list(brightness order by brightness desc, seat) as b,
            list(seat order by brightness desc, seat) as s from readings group by 1)
        select hand_id, coalesce(d, if(b[1] >= 150 or b[1] / b[2] >= 1.3, s[1], 0)) as button_seat_index,
          case when d is not null then 'L1-ocr' when b[1] >= 150 or b[1] / b[2] >= 1.3 then 'L2-brightness'
               else 'L3-fallback' end as button_detection_method from r""", readings=BUTTON),
    "blind_levels": sql("""
        with h as (select *, (button_seat_index + 1) % 6 as sb_seat, (button_seat_index + 2) % 6 as bb_seat
                   from bhands where not board_dealt and num_seats >= 2),
        v as (select hand_id, seat, try_cast(nullif(regexp_extract(text, '(\\d+\\.?\\d*)', 1), '') as double) as x from readings),
        g as (select h.id as hand_id, sb_seat, bb_seat, (select x from v where hand_id = h.id and seat = sb_seat and x > 0 and x < 100000) as blind_sb,
              (select x from v where hand_id = h.id and seat = bb_seat and x > 0 and x < 100000) as blind_bb from h)
        select * from g where blind_sb is not null or blind_bb is not null""", bhands=BLIND_HANDS, readings=BLINDS),
    "blind_posts": sql(_POSTS),
    "inferred_insurance": sql(_GAIN),
    "empty_seats": sql("""
        with n as (select *, count(*) over (partition by hand_id, phash) as occurrences from readings)
        select hand_id, seat, if(phash = 0 and stack_text = '', 'avatar_zero_hash + stack_no_digit',
          'duplicate_phash_minimum_guard') as reason, occurrences from n
        where (phash = 0 and stack_text = '') or occurrences >= 2""", readings=AVATARS),
    "segment_hands": sql(_SEGMENT),
    "action_changes": sql(f"""
        with a as (select *, trim(text) as cleaned from obs where kind = 'action' and trim(coalesce(text, '')) <> ''),
        l as (select *, lag(cleaned) over (partition by table_id, seat order by ts, tick) as prev_text from a)
        select table_id, tick, {ts('ts')} as ts, seat, kind, text, value, cleaned, prev_text from l
        where prev_text is null or prev_text <> cleaned"""),
    "debounced_events": sql("""
        with l as (select user_id, event_type, list({'i': event_id, 's': ts} order by ts, event_id) as xs from events group by all),
        f as (select user_id, event_type, unnest(list_reduce(xs, lambda a, x:
            if(a.l is null or x.s - a.l >= interval 6 hour,
               {'l': x.s, 'o': list_append(a.o, {'i': x.i, 's': x.s, 'k': true, 'g': x.s - a.l})},
               {'l': a.l, 'o': list_append(a.o, {'i': x.i, 's': x.s, 'k': false, 'g': x.s - a.l})}),
            {'l': null::timestamp, 'o': []::struct(i bigint, s timestamp, k boolean, g interval)[]}).o) as r from l)
        select r.i as event_id, """ + ts("r.s") + """ as ts, user_id, event_type, r.k as accepted,
          epoch_us(r.g) / 1e6 as since_s from f"""),
    "cleaned_stacks": sql(_folded(
        "obs where kind = 'stack'", "table_id, seat", "{'t': tick, 'v': value}",
        "{'p': null::double, 'o': []::struct(t bigint, v double, s double, j boolean)[]}",
        """if(coalesce(x.v > 0 and a.p > 0 and (x.v > a.p * 9 or x.v * 9 < a.p), false),
             {'p': a.p, 'o': list_append(a.o, {'t': x.t, 'v': x.v, 's': a.p, 'j': true})},
             {'p': coalesce(x.v, a.p), 'o': list_append(a.o, {'t': x.t, 'v': x.v, 's': x.v, 'j': false})})""",
        "r.t as tick, r.v as value, r.s as stack, r.j as replaced")),
    "cleaned_pots": sql(_folded(
        "obs where kind = 'pot'", "table_id", "{'t': tick, 'v': value}",
        "{'p': null::double, 'k': null::double, 'o': []::struct(t bigint, v double, ok boolean, b double, p double, k double)[]}",
        """if(a.p is null or x.v >= a.p * 0.9,
             {'p': x.v, 'k': greatest(a.k, x.v), 'o': list_append(a.o, {'t': x.t, 'v': x.v, 'ok': true, 'b': a.p, 'p': x.v, 'k': greatest(a.k, x.v)})},
             {'p': a.p, 'k': a.k, 'o': list_append(a.o, {'t': x.t, 'v': x.v, 'ok': false, 'b': a.p, 'p': a.p, 'k': a.k})})""",
        "r.t as tick, r.v as value, r.ok as accepted, r.b as pot_before, r.p as pot, r.k as peak")),
    "betting_state": sql(f"""select hand_id, sequence_number, street, {_TO_CALL}::double as current_to_call,
        {_TO_CALL} = 0 as is_first_bet_this_street from ev"""),
    "decision_times": sql("""
        with r as (select *, count(*) filter (kind = 'action') over (partition by table_id, seat order by ts, tick
              rows between unbounded preceding and 1 preceding) as run from obs where kind in ('timer', 'action')),
        c as (select *, lag(value) over (partition by table_id, seat, run, kind order by ts, tick) as pv from r),
        g as (select table_id, seat, run, min(ts) filter (kind = 'timer') as s, max(tick) filter (kind = 'action') as tick,
              max(ts) filter (kind = 'action') as e, count(*) filter (kind = 'timer' and value > pv + 2) as up from c group by 1, 2, 3)
        select table_id, seat, tick, epoch_us(e - s) // 1000 as decision_time_ms, up > 0 as used_timebank from g where tick is not null"""),
    "pointer_events": sql(f"""
        with l as (select *, lag(seat) over w as ls, lag(value) over w as lv, lag(ts) over w as lt from scans
                   window w as (partition by table_id order by ts, tick)),
        e as (select table_id, tick, ts, 'pointer.action_inferred' as tag, ls as of_seat, lv as last_timer_value,
                'timer_moved_to_next' as reason, seat as next_seat, null::double as time_since_timer from l where ls <> seat
          union all select table_id, tick, ts, 'pointer.timer_moved', ls, lv, null, seat, null from l
              where seat is not null and seat is distinct from ls
          union all select table_id, tick, ts, 'pointer.action_inferred', ls, lv, null, null, round(epoch_us(ts - lt) / 1e6, 2) from l
              where seat is null and ls is not null and ts - lt < interval 6 hour)
        select table_id, tick, {ts('ts')} as ts, tag, of_seat, last_timer_value, reason, next_seat, time_since_timer from e""",
        scans=SCANS),
    "showdown_summary": sql("""
        with p as (select hand_id, count(distinct player_name) - count(distinct player_name) filter (action_type = 'fold') as n from ev group by 1)
        select id as hand_id, case when id % 3 = 0 then 'showdown.gate1_skip' when coalesce(n, 0) < 2 then 'showdown.gate2_skip'
            else 'showdown.enter' end as tag, if(id % 3 = 0, 4, 5) as river_count, coalesce(n, 0) as active_count,
          coalesce(cardinality(shown), 0) as captured_count from hand left join p on p.hand_id = hand.id"""),
    "showdown_decisions": sql(_GATE, candidates=CANDIDATES),
    "seat_lifecycle": sql(_LIFE, targets=TARGETS),
    "hand_phases": sql(f"""
        with l as (select *, coalesce(lag(phase) over (partition by hand_id order by ts, tick), 'between_hands') as from_phase from phases),
        n as (select * from (values {_NEXT}) v(p, nxt))
        select hand_id, tick, {ts('ts')} as ts, phase, from_phase, list_contains(nxt, phase) or phase = from_phase as legal,
          phase in ('preflop_acting', 'flop_acting', 'turn_acting', 'river_acting') as stack_delta_is_action,
          starts_with(phase, 'dealing') as ocr_should_idle,
          case when contains(phase, 'flop') and not contains(phase, 'pre') then 'flop' when contains(phase, 'turn') then 'turn'
               when contains(phase, 'river') then 'river' when phase in ('blind_posting', 'preflop_acting') then 'preflop'
               when phase = 'showdown' then 'showdown' end as street
        from l join n on n.p = from_phase""", phases=PHASES),
    "board_by_street": sql("""
        with c as (select *, len(shown) // 2 as n, list_transform(range(0, len(shown) // 2), lambda i: shown[2 * i + 1:2 * i + 2]) as b from readings),
        s as (select *, case when n = 3 then 'flop' when n = 4 then 'turn' when n >= 5 then 'river' end as street from c
              where len(list_distinct(b)) = n)
        select table_id, hand_id, street, array_to_string(arg_min(b, ts), ',') as cards from s where street is not null group by 1, 2, 3""",
        readings=CARD_READINGS),
    "street_states": sql(f"""
        select table_id, tick, {ts('ts')} as ts, value, coalesce(last_value(case value when 0 then 'preflop' when 3 then 'flop'
            when 4 then 'turn' when 5 then 'river' end ignore nulls) over (partition by table_id order by ts, tick), 'preflop') as street
        from obs where kind = 'community'"""),
    "merged_readings": sql("""
        select p.hand_id, p.tick, p.seat, case when p.text <> '' then p.text when f.seat is null then '' else s.text end as text,
          p.text = '' and f.seat is not null and s.text <> '' as fell_back
        from prim p left join sec s using (hand_id, tick, seat) left join foc f using (hand_id, tick, seat)""",
        prim=PRIMARY, sec=SECOND, foc=FOCUS),
    "sequence_numbers": sql("""select id, hand_id, 2 + row_number() over (partition by hand_id order by timestamp, id) as sequence_number from ev"""),
}
