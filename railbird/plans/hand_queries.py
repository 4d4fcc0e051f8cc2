"""Hands, names, positions and events composed from a feed of observations, and audits of what comes out."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railbird.operators import hand_audits
from railbird.operators import hands as H
from railbird.plans import derive_queries as dq
from railbird.plans import flow_queries as fq
from railbird.plans import view_queries as vq
from railbird.plans.base import Tables, query, sql, ts
from railbird.session import written
from railbird.sources import derivations

# ------------------------------------------------------------ derived readings
_AT = "select 'T' || cast(user_id % 10 as string) as table_id, event_id as tick, ts, cast(user_id % 9 as int) as seat"
_NONE = "cast(null as double) as value, cast(null as bigint) as phash from events"
#: The observations and, beside them (hero cards only at action readings, since they are read before what may end a hand), names, avatars, buttons, chips, hero cards and shown cards at some of their ticks.
FEED = f"""
select table_id, tick, ts, seat, kind, text, value, cast(null as bigint) as phash from ({derivations.OBSERVATIONS}) o
union all
{_AT}, 'id' as kind, case when event_id % 4 = 0 then '' when event_id % 13 = 0 then 'CALL'
    else 'N' || cast(user_id % 9 as string) || '_' || cast(cast(floor(event_id / 700) as bigint) as string) end as text,
  cast(null as double) as value, cast(case when event_id % 29 = 0 then null when cast(floor(event_id / 1500) as bigint) % 2 = 0 then user_id % 9
    else 1152921504606846975 - user_id % 9 end as bigint) as phash from events where event_id % 6 = 1
union all
{_AT}, 'button' as kind, case when event_id % 20 = 3 then 'D' else '' end as text, cast(100 + event_id % 70 as double) as value,
  cast(null as bigint) as phash from events where event_id % 10 = 3
union all
{_AT}, 'amount' as kind, case event_id % 5 when 0 then '' when 1 then '$' || cast(event_id % 40 as string) || '.' else '$2' end as text,
  {_NONE} where event_id % 2 = 0
union all
{_AT}, 'hero' as kind, 'Kh,Qd' as text, {_NONE} where event_id % 20 = 7 and event_type = 'click'
union all
{_AT}, 'showdown_card' as kind, case when event_id % 3 = 0 then 'Ah' else 'Ah,K' || substr('cdhs', cast(event_id % 4 + 1 as int), 1) end as text,
  {_NONE} where event_id % 31 = 5"""


def _made(t: Tables) -> H.Hands:
    return H.feed_hands(dq.run(t, FEED), pot_label=None, width=dq.DAY)


def _listed(name: str):
    """A map as text: ``0=200 1=180``."""
    value = lambda x: x["value"].cast("bigint").cast("string") if name.startswith("stacks") else (
        F.array_join(x["value"], "") if name == "showdown_cards" else x["value"])
    return F.array_join(F.array_sort(F.transform(F.map_entries(name), lambda x: F.concat(x["key"], F.lit("="), value(x)))), " ").alias(name)


def _hands(t: Tables) -> DataFrame:
    return _made(t).hands.select(
        "id", "table_name", "started_at", "ended_at", "pot_size_final", "hero_cards", "button_seat_index", "num_seats", "blind_sb", "blind_bb",
        *[_listed(c) for c in ("seats", "stacks_initial", "stacks_final", "showdown_cards")])


def _audits(t: Tables) -> DataFrame:
    """Four audits of the composed hands in one table."""
    hands = written(_made(t).hands)
    none = F.lit(None).cast("string")
    parts = [
        hand_audits.hand_conservation(hands).select(F.lit("V01").alias("audit"), "hand_id", none.alias("seat"), "status"),
        hand_audits.stack_continuity(hands).select(F.lit("V04").alias("audit"), "hand_id", F.col("seat").cast("string").alias("seat"), "status"),
        hand_audits.showdown_by_seat(hands).select(F.lit("V23").alias("audit"), "hand_id", F.col("seat_idx").cast("string").alias("seat"), F.col("player_name").alias("status")),
        hand_audits.stack_cross_hand(hands).select(F.lit("V32").alias("audit"), "hand_id", F.col("seat_idx").cast("string").alias("seat"), "status"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


QUERIES = {
    "feed_names": query(lambda t: _made(t).names.drop("since_tick")),
    "feed_seats": query(lambda t: _made(t).seats),
    "feed_empty_seats": query(lambda t: _made(t).empty),
    "feed_hands": query(_hands),
    "feed_audits": query(_audits),
    "feed_events": query(lambda t: H.feed_events(_made(t), debounce_s=60.0, width=dq.DAY).select(
        "id", "hand_id", "player_name", "position", "street", "action_type", "sequence_number", "amount", "confidence_score",
        "timestamp", F.col("raw.stack_before").alias("stack_before"), F.col("raw.synthetic").alias("synthetic"))),
}

# ------------------------------------------------------------ checking SQL
_POSITION = "['BTN','SB','BB','UTG','UTG+1','MP','MP+1','CO','HJ'][(seat - button + 9) % 9 + 1]"

_SEATS = f"""
  seg as ({dq._SEGMENT}),
  r0 as (select f.*, f.table_id || '-' || s.hand_no as hand_id, s.hand_no, s.pot_latest as pot_after from feed f
    join seg s on s.table_id = f.table_id and s.tick = f.tick),
  r as (select *, coalesce(last_value(case when kind = 'community' then case when value = 0 then 'preflop' when value = 3 then 'flop'
      when value = 4 then 'turn' when value >= 5 then 'river' end end ignore nulls) over (partition by hand_id order by ts, tick), 'preflop') as street from r0),
  starts as (select *, hand_no < max(hand_no) over (partition by table_id) as over_ from (
    select hand_id, table_id, hand_no, min(ts) as started_at, arg_min(tick, ts) as start_tick, max(ts) as last_at,
      arg_min(street, ts) as first_street, arg_max(pot_after, ts) filter (pot_after is not null) as pot, arg_min(text, ts) filter (kind = 'hero') as hero
    from r group by all)),
  b1 as (select hand_id, seat, arg_min(text, tick) as t, arg_min(value, tick) as b from r where kind = 'button' group by all),
  b2 as (select hand_id, min(seat) filter (t like '%D%') as bt, count(*) as n, list({{'b': b, 's': seat}} order by -b, seat) as l from b1 group by 1),
  buttons as (select hand_id, case when bt is not null then bt when n >= 2 and (l[1].b >= 150 or (l[2].b > 0 and l[1].b / l[2].b >= 1.3)) then l[1].s
    else 0 end as button from starts left join b2 using (hand_id)),
  ids as (select table_id, seat, list({{'s': ts, 't': tick, 'r': if(text in ('', 'CALL'), null, text), 'p': phash}} order by ts, tick) as xs
    from r where kind = 'id' group by all),
  folded as (select table_id, seat, unnest(list_reduce(xs, lambda a, x:
      list_transform([{{'w': coalesce(a.n is not null and bit_count(xor(a.p, x.p)) > 12, false)}}], lambda q:
        list_transform([if((a.n is null or q.w or starts_with(a.n, 'TempUser_')) and (x.r is not null or a.n is null or q.w),
            coalesce(x.r, 'TempUser_' || substr(lpad(bin(x.p), 64, '0'), 1, 8)), null)], lambda w:
          {{'n': coalesce(w, a.n), 'p': if(w is not null, x.p, coalesce(a.p, x.p)),
            'o': if(w is not null and w is distinct from a.n, list_append(a.o, {{'s': x.s, 't': x.t, 'n': w}}), a.o)}})[1])[1],
      {{'n': null::varchar, 'p': null::bigint, 'o': []::struct(s timestamp, t bigint, n varchar)[]}}).o) as c from ids),
  names as (select table_id, seat, c.n as player_name, c.s as since, lead(c.s) over (partition by table_id, seat order by c.s, c.t) as until, c.t as tick from folded),
  asof0 as (select table_id, unnest(range(0, 9)) as seat, started_at as ts, start_tick as tick, 1 as rank, hand_id, null as name from starts
    union all select table_id, seat, since, tick, 0, null, player_name from names),
  asof1 as (select *, last_value(name ignore nulls) over (partition by table_id, seat order by ts, tick, rank) as player_name from asof0),
  seats as (select hand_id, table_id, seat::int as seat, player_name, {_POSITION} as position from asof1 join buttons using (hand_id) where rank = 1)"""

_FEED_HANDS = _SEATS + """,
  seen as (select hand_id, seat, list({'s': ts, 't': tick, 'v': value} order by ts, tick) as xs from r where kind = 'stack' group by all),
  moves as (select hand_id, seat, unnest(list_reduce(xs, lambda a, x:
      if(coalesce(x.v > 0 and a.p > 0 and (x.v > a.p * 9 or x.v * 9 < a.p), false),
         {'p': a.p, 'o': list_append(a.o, {'s': x.s, 't': x.t, 'v': a.p})}, {'p': coalesce(x.v, a.p), 'o': list_append(a.o, {'s': x.s, 't': x.t, 'v': x.v})}),
      {'p': null::double, 'o': []::struct(s timestamp, t bigint, v double)[]}).o) as m from seen),
  ends as (select hand_id, seat, arg_min(m.v, m.s) as a, arg_max(m.v, m.s) as z from moves where m.v is not null group by all),
  stacks as (select hand_id, map(list(seat::varchar order by seat), list(a order by seat)) as si, map(list(seat::varchar order by seat), list(z order by seat)) as sf from ends group by 1),
  cards as (select hand_id, seat, arg_min(text, ts) as c from r where kind = 'showdown_card' and text like '%,%' group by all),
  shown as (select hand_id, map(list(seat::varchar order by seat), list(string_split(c, ',') order by seat)) as shown from cards group by 1),
  chips as (select hand_id, seat, arg_min(text, tick) as t from r where kind = 'amount' and street = 'preflop' group by all),
  chip as (select hand_id, seat, nullif(regexp_extract(t, '(\\d+\\.?\\d*)', 1), '')::double as v from chips),
  blinds as (select b.hand_id, max(v) filter (seat = (button + 1) % 9 and v > 0 and v < 100000) as sb, max(v) filter (seat = (button + 2) % 9 and v > 0 and v < 100000) as bb
    from buttons b join starts s on s.hand_id = b.hand_id and s.first_street = 'preflop' join chip c on c.hand_id = b.hand_id group by 1),
  avatars as (select hand_id, seat, arg_min(phash, ts) filter (kind = 'id' and phash is not null) as p, count(*) filter (kind = 'stack' and value is not null) as n
    from r where kind in ('id', 'stack') group by all),
  empty_ as (select hand_id, seat from (select *, count(*) over (partition by hand_id, p) as same from avatars) where p is not null and ((p = 0 and n = 0) or same >= 2)),
  people as (select hand_id, map(list(position order by position), list(coalesce(player_name, 'Player_' || seat) order by position)) as seats,
      map(list(position) filter (player_name is not null), list(player_name) filter (player_name is not null)) as known from seats group by 1),
  fhand as (select s.hand_id as id, s.table_id as table_name, s.started_at, if(s.over_, s.last_at, null) as ended_at, if(s.over_, s.pot, null) as pot_size_final,
      s.hero, b.button as button_seat_index, bl.sb as blind_sb, bl.bb as blind_bb, p.seats, p.known, k.si, if(s.over_, k.sf, null) as sf, if(s.over_, h.shown, null) as shown
    from starts s join buttons b using (hand_id) left join blinds bl using (hand_id) left join stacks k using (hand_id) left join shown h using (hand_id)
      left join people p using (hand_id))"""

_LIST = "array_to_string(list_sort(list_transform(map_entries({0}), lambda x: x.key || '=' || {1})), ' ')"


def _audit(name: str, body: str, seat: str, status: str) -> str:
    text = re.sub(r"\bhand\b", "fhand", body)
    return f"select '{name}' as audit, hand_id, {seat} as seat, {status} as status from ({text})"


_EVENTS = fq.flow_sql(named=True).strip()

ORACLE = {
    "feed_names": sql(f"with {_SEATS}\n select table_id, seat, player_name, {ts('since')} as since, {ts('until')} as until from names", feed=FEED),
    "feed_seats": sql(f"with {_SEATS}\n select * from seats", feed=FEED),
    "feed_hands": sql(f"""with {_FEED_HANDS}
        select id, table_name, {ts('started_at')} as started_at, {ts('ended_at')} as ended_at, pot_size_final, hero as hero_cards, button_seat_index, 9 as num_seats,
          blind_sb, blind_bb, {_LIST.format('seats', 'x.value')} as seats, {_LIST.format('si', 'x.value::bigint')} as stacks_initial,
          {_LIST.format('sf', 'x.value::bigint')} as stacks_final, {_LIST.format('shown', "array_to_string(x.value, '')")} as showdown_cards from fhand""", feed=FEED),
    "feed_empty_seats": sql(f"""with {_FEED_HANDS}
        select e.*, if(a.p = 0 and a.n = 0, 'avatar_zero_hash + stack_no_digit', 'duplicate_phash_minimum_guard') as reason
        from empty_ e join avatars a using (hand_id, seat)""", feed=FEED),
    "feed_audits": sql(f"with {_FEED_HANDS}\n" + " union all ".join([
        _audit("V01", vq.CONSERVATION, "null", "status"), _audit("V04", vq.CONTINUITY, "seat", "status"),
        _audit("V23", vq.SHOWDOWN_BY_SEAT, "seat_idx::varchar", "player_name"), _audit("V32", vq.CROSS_HAND, "seat_idx", "status")]), feed=FEED),
    "feed_events": sql(f"""with {_FEED_HANDS},
        post as (select id as hand_id, started_at, 'SB' as pos, 1 as off, blind_sb as amount, known, si, button_seat_index as b from fhand where blind_sb is not null and blind_bb is not null
          union all select id, started_at, 'BB', 2, blind_bb, known, si, button_seat_index from fhand where blind_sb is not null and blind_bb is not null),
        posts as (select *, row_number() over (partition by hand_id order by off) as nr, count(*) over (partition by hand_id) as posted from post where known[pos] is not null
            and not exists (select 1 from empty_ e where e.hand_id = post.hand_id and e.seat = (post.b + post.off) % 9)),
        flow as ({_EVENTS}),
        told as (select f.*, coalesce(p.posted, 0) as posted from flow f left join (select distinct hand_id, posted from posts) p using (hand_id))
        select hand_id || '-post_' || lower(pos) as id, hand_id, known[pos] as player_name, pos as position, 'preflop' as street, 'post_' || lower(pos) as action_type,
          nr::int as sequence_number, amount, 0.9::double as confidence_score, {ts('started_at')} as timestamp, si[((b + off) % 9)::varchar] as stack_before, true as synthetic from posts
        union all select hand_id || '-' || (sequence_number - 2), hand_id, player_name, position, street, action_type, (sequence_number - 2 + posted)::int, amount,
          confidence_score, timestamp, stack_before, synthetic from told""", feed=FEED),
}
