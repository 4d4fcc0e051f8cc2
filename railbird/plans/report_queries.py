"""Dashboard, review and ad-hoc reports."""

from __future__ import annotations

from datetime import datetime

from railbird.operators import reports as r
from railbird.plans.base import query, rnd, sql, ts

PLAYER = "P7"
SINCE, UNTIL = datetime(1996, 1, 1), datetime(1998, 1, 1)
TICKS_SINCE = datetime(2024, 1, 5)
ERAS = [("early", None), ("middle", datetime(1997, 1, 1)), ("late", datetime(2000, 1, 1))]

QUERIES = {
    "total_hands": query(lambda t: r.total_hands(t.hands)),
    "total_events": query(lambda t: r.total_events(t.events)),
    "unique_players": query(lambda t: r.unique_players(t.events)),
    "recent_hands": query(lambda t: r.recent_hands(t.hands, t.events)),
    "overall_stats": query(lambda t: r.overall_stats(t.events)),
    "classified_players": query(lambda t: r.classified_players(t.events)),
    "frequent_players": query(lambda t: r.frequent_players(t.events)),
    "player_position_matrix": query(lambda t: r.player_position_matrix(t.events, PLAYER)),
    "street_actions": query(lambda t: r.street_actions(t.events, PLAYER)),
    "action_summary": query(lambda t: r.action_summary(t.events)),
    "latest_events": query(lambda t: r.latest_events(t.events)),
    "table_counts": query(lambda t: r.table_counts(t.hands, t.events, t.diagnostics)),
    "review_queue": query(lambda t: r.review_queue(t.events).drop("raw_data")),
    "confidence_buckets": query(lambda t: r.confidence_buckets(t.events, since=SINCE, until=UNTIL)),
    "phase_means": query(lambda t: r.phase_means(t.diagnostics, "attention_focus_ocr", since=TICKS_SINCE)),
    "fallback_counts": query(lambda t: r.fallback_counts(t.diagnostics, since=TICKS_SINCE)),
    "showdown_coverage": query(lambda t: r.showdown_coverage(t.hands, t.events)),
    "silent_fold_rate": query(lambda t: r.silent_fold_rate(t.hands, t.events, eras=ERAS)),
}

OVERALL = f"""select player_name, count(distinct hand_id) as hands,
  {rnd("100.0 * count(distinct hand_id) filter (street = 'preflop' and action_type in ('call', 'bet', 'raise', 'all_in')) / count(distinct hand_id)")}::int as vpip,
  {rnd("100.0 * count(distinct hand_id) filter (street = 'preflop' and action_type in ('bet', 'raise', 'all_in')) / count(distinct hand_id)")}::int as pfr,
  {rnd("count(*) filter (action_type in ('bet', 'raise')) / nullif(count(*) filter (action_type = 'call'), 0)", 2)} as af
from ev group by 1"""

_LABEL = {k: v for k, v in r.PLAYER_TYPES.items()}


def _typed(field: int) -> str:
    t = {k: f"'{v[field]}'" for k, v in _LABEL.items()}
    return f"""case when vpip >= 70 then if(coalesce(af, 0) < 1, {t['whale']}, {t['maniac']})
      when vpip >= 40 and pfr >= 25 and af > 1.5 then {t['lag']}
      when vpip >= 40 and coalesce(af, 0) < 1 then {t['station']}
      when vpip <= 35 and vpip >= 20 and pfr >= 15 and af >= 1 then {t['tag']}
      when vpip < 20 then {t['nit']} else {t['mixed']} end"""


_ACTIONS = ["post_sb", "post_bb", "post_ante", "fold", "check", "call", "bet", "raise", "all_in"]
_COUNTS = ", ".join(
    f"case when count(*) > 0 then count(*) filter (action_type = '{a}') end as {a}" for a in _ACTIONS)
_SILENT = """select id, started_at, coalesce(n, 0) as captured, cardinality(seats)::bigint - 1 - coalesce(n, 0) as silent
  from hand left join (select hand_id, count(distinct player_name) as n from ev where action_type = 'fold' group by 1) f
  on f.hand_id = hand.id"""

ORACLE = {
    "total_hands": sql("select count(*) as n from hand"),
    "total_events": sql("select count(*) as n from ev"),
    "unique_players": sql("select count(distinct player_name) as n from ev where player_name not like 'TempUser_%'"),
    "recent_hands": sql(f"""
        select id, {ts('started_at')} as started_at, {ts('ended_at')} as ended_at, pot_size_final,
          array_to_string(hero, ',') as hero_cards, (select count(*) from ev where hand_id = hand.id) as n_events
        from hand order by hand.started_at desc, id desc limit 20"""),
    "overall_stats": sql(OVERALL),
    "classified_players": sql(f"select *, {_typed(0)} as label, {_typed(1)} as advice from ({OVERALL})"),
    "frequent_players": sql("""select player_name, count(distinct hand_id) as hands from ev
        where not starts_with(player_name, 'TempUser') group by 1 having count(distinct hand_id) >= 10"""),
    "player_position_matrix": sql(f"""
        select if(position in ('UTG','UTG+1','MP','HJ','CO','BTN','SB','BB'), position, null) as position,
          count(distinct hand_id) as hands,
          {rnd("100.0 * count(distinct hand_id) filter (street = 'preflop' and action_type in ('call', 'bet', 'raise', 'all_in')) / count(distinct hand_id)")}::int as vpip_pct,
          {rnd("100.0 * count(distinct hand_id) filter (street = 'preflop' and action_type in ('bet', 'raise', 'all_in')) / count(distinct hand_id)")}::int as pfr_pct
        from ev where player_name = '{PLAYER}' group by ev.position"""),
    "street_actions": sql(f"""
        with s as (select unnest(['preflop', 'flop', 'turn', 'river']) as street),
        c as (select street, {_COUNTS} from ev where player_name = '{PLAYER}' group by 1)
        select * from s left join c using (street)"""),
    "action_summary": sql("""select player_name, count(*) as n_events, count(*) filter (action_type = 'fold') as n_fold,
          count(*) filter (action_type in ('bet', 'raise', 'all_in')) as n_aggressive
        from ev where player_name not like 'TempUser_%' group by 1 having count(*) >= 5
        order by n_events desc, player_name limit 30"""),
    "latest_events": sql(f"""select id, player_name, position, action_type, amount, confidence_score,
        {ts('timestamp')} as event_time from ev order by timestamp desc, id desc limit 50"""),
    "table_counts": sql("""select 'hands' as t, count(*)::varchar as n from hand
        union all select 'action_events', count(*)::varchar from ev
        union all select 'diagnostic_events', count(*)::varchar from diag"""),
    "review_queue": sql(f"""select id, hand_id, player_name, position, street, action_type, amount, confidence_score,
        {ts('timestamp')} as timestamp from ev where confidence_score < 0.7 order by ev.timestamp desc, id desc limit 20"""),
    "confidence_buckets": sql(f"""select {rnd('confidence_score', 1)} as conf_bucket, action_type, count(*) as n from ev
        where timestamp >= timestamp '1996-01-01' and timestamp < timestamp '1998-01-01' group by 1, 2"""),
    "phase_means": sql("""select avg((payload ->> '$.phases.attention_focus_ocr.avg_ms')::double) as avg_ms,
          avg((payload ->> '$.phases.attention_focus_ocr.exec_count')::int) as exec_count
        from diag where tag = 'pipeline.tick_stats' and occurred_at >= timestamp '2024-01-05'"""),
    "fallback_counts": sql("""select tag, count(*) as n, count(distinct payload ->> '$.seat') as distinct_seats
        from diag where starts_with(tag, 'pattern_d.ocr2') and occurred_at >= timestamp '2024-01-05' group by 1"""),
    "showdown_coverage": sql(f"""
        with s as (select id, button_seat_index as b, seats, unnest(map_keys(shown))::int as k from hand where shown is not null),
        p as (select id, k, seats[['BTN','SB','BB','UTG','UTG+1','MP','MP+1','HJ','CO'][(k - b + 9) % 9 + 1]] as who from s),
        c as (select id, count(distinct k) as n from p where who is not null group by 1)
        select count(*) as n_hands, {rnd('avg(n)', 4)} as avg_cards_captured from c"""),
    "silent_fold_rate": sql(f"""
        with f as ({_SILENT}),
        e as (select *, case when started_at >= timestamp '2000-01-01' then 'late'
                when started_at >= timestamp '1997-01-01' then 'middle' else 'early' end as era from f)
        select if(grouping(era) = 1, 'overall', era) as era, count(*) as hands, sum(captured)::bigint as captured,
          sum(silent)::bigint as silent, {rnd('100.0 * sum(silent) / (sum(captured) + sum(silent))', 1)} as silent_pct
        from e group by rollup(era)"""),
}
