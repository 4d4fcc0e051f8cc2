"""Player statistics from the decision table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railbird.operators import cache
from railbird.operators import decisions as d
from railbird.plans.base import Tables, query, rnd, sql, ts
from railbird.plans.report_queries import OVERALL
from railbird.session import new_folder, written

LOOKBACK = 20
AS_OF, CUT = datetime(2002, 1, 1), datetime(2000, 6, 1)


def _refreshed(t: Tables) -> DataFrame:
    """The cache after a first fill and two refreshes, of which one is a replay."""
    path = new_folder(t.spark, "cache")
    hands, events = written(t.hands), written(t.events)
    old = hands.where(F.col("started_at") < F.lit(CUT))
    cache.write_states(cache.period_states(old, events.join(old.select(F.col("id").alias("hand_id")), "hand_id", "left_semi"), unit="month"), path)
    for _ in range(2):
        cache.refresh(hands, events, path, since=CUT, until=AS_OF, unit="month")
    return cache.merged_cache(t.spark.read.parquet(path), as_of=AS_OF)

def _confirmed(t: Tables) -> DataFrame:
    """Insurance confirmed by another source, for some of the players and for some others."""
    return t.read("customer").select(
        F.concat(F.lit("P"), F.col("c_custkey") % 70).alias("player_name"), (F.col("c_custkey") % 5 + 1).alias("all_in_hands"),
        (F.col("c_custkey") % 5).alias("bought_insurance")).groupBy("player_name").agg(
        F.sum("all_in_hands").alias("all_in_hands"), F.sum("bought_insurance").alias("bought_insurance"))


QUERIES = {
    "decision_table": query(lambda t: d.decision_table(t.events).drop("timestamp")),
    "v_player_vpip_pfr_af": query(lambda t: d.vpip_pfr_af(t.events)),
    "v_player_3bet": query(lambda t: d.three_bet(t.events)),
    "v_player_position_stats": query(lambda t: d.position_stats(t.events)),
    "player_winnings_summary": query(lambda t: d.winnings_summary(t.hands, t.events)),
    "v_player_insurance_full": query(lambda t: d.insurance_full(t.hands)),
    "confirmed_insurance": query(lambda t: d.insurance_full(t.hands, _confirmed(t))),
    "situation_rates": query(lambda t: d.situation_rates(t.events)),
    "showdown_rates": query(lambda t: d.showdown_rates(t.hands, t.events)),
    "player_stats_cache": query(lambda t: d.stats_cache(t.hands, t.events)),
    "refreshed_stats_cache": query(lambda t: _refreshed(t).select(
        "*", F.get_json_object("stats_json", "$.n_saw_flop").cast("bigint").alias("n_saw_flop"),
        F.get_json_object("stats_json", "$.three_bet_opp").cast("bigint").alias("three_bet_opp")).drop("stats_json")),
    "player_situational_stats": query(lambda t: d.situational_stats(t.hands, t.events).select(
        "player_name", "stat_type", *[F.try_element_at("dimensions", F.lit(k)).alias(k) for k in d.DIMENSIONS],
        "value", "sample_size")),
    "lookback_vpip_pfr_af": query(lambda t: d.vpip_pfr_af(d.last_hands(t.events, lookback=LOOKBACK))),
    "live_table": query(lambda t: d.live_table(t.hands, t.events)),
}

_RAISING = "action_type in ('bet', 'raise', 'all_in')"
_PRIOR = "partition by hand_id, street order by sequence_number rows between unbounded preceding and 1 preceding"

DEC = f"""select a.*, lag(action_type) over o as own_prev_action, lag(raises_before) over o as own_prev_raises,
    coalesce(max((street = 'flop' and player_name = pfa and {_RAISING} and raises_before = 0 and nth = 1)::int)
      over (partition by hand_id), 0) as flop_cbet
  from (select b.*,
      count(*) filter ({_RAISING}) over p as raises_before,
      count(*) filter (action_type = 'call') over p as calls_before,
      count(*) filter (action_type not in ('fold', 'check')) over p as entries_before,
      count(*) filter (player_name = pfa) over p as aggressor_acts_before,
      (list(player_name) filter ({_RAISING}) over p)[1] as first_aggressor,
      (list(player_name) filter ({_RAISING}) over p)[-1] as last_aggressor,
      max(amount) filter ({_RAISING}) over p as to_call,
      row_number() over (partition by hand_id, street, player_name order by sequence_number) as nth
    from (select hand_id, sequence_number, player_name, position, street, action_type, amount, stack_before,
        pot_after::double as pot_after, timestamp,
        arg_max(player_name, sequence_number) filter (street = 'preflop' and {_RAISING}) over (partition by hand_id) as pfa
      from ev) b window p as ({_PRIOR})) a
  window o as (partition by hand_id, street, player_name order by sequence_number)"""

_BET_BY_OTHER = "last_aggressor <> player_name"
_COND = {
    "three_bet": (f"street = 'preflop' and raises_before = 1 and {_BET_BY_OTHER}", "action_type in ('raise', 'all_in')"),
    "fold_to_three_bet": (
        f"street = 'preflop' and raises_before > 1 and own_prev_raises = 0 and {_BET_BY_OTHER} and "
        "own_prev_action in ('bet', 'raise', 'all_in')", "action_type = 'fold'"),
    "steal": ("street = 'preflop' and position in ('CO', 'BTN', 'SB') and entries_before = 0 and nth = 1", _RAISING),
    "call_open": (f"street = 'preflop' and raises_before = 1 and {_BET_BY_OTHER}", "action_type = 'call'"),
    "cbet": ("street = 'flop' and player_name = pfa and raises_before = 0 and nth = 1", _RAISING),
    "fold_to_cbet": (
        "street = 'flop' and raises_before = 1 and first_aggressor = pfa and player_name <> pfa and flop_cbet = 1 "
        "and coalesce(own_prev_raises, 0) = 0", "action_type = 'fold'"),
    "raise_cbet": (
        "street = 'flop' and raises_before = 1 and first_aggressor = pfa and player_name <> pfa and flop_cbet = 1 "
        "and coalesce(own_prev_raises, 0) = 0", "action_type in ('raise', 'all_in')"),
    "double_barrel": (
        "street = 'turn' and player_name = pfa and flop_cbet = 1 and raises_before = 0 and nth = 1", _RAISING),
    "check_raise": (f"own_prev_action = 'check' and raises_before > 0 and {_BET_BY_OTHER}",
                    "action_type in ('raise', 'all_in')"),
    "donk_bet": ("street = 'flop' and player_name <> pfa and raises_before = 0 and aggressor_acts_before = 0 and nth = 1",
                 _RAISING),
}
_COUNTED = ", ".join(
    f"count(*) filter ({o}) as {k}_opp, count(*) filter ({o} and {did}) as {k}_did" for k, (o, did) in _COND.items())
_RATES = ", ".join(f"{rnd(f'100.0 * {k}_did / nullif({k}_opp, 0)', 1)} as {c}" for k, c in d.STATS.items())
SITUATIONS = f"select player_name, {_COUNTED} from ({DEC}) group by 1"

SHOWDOWN = f"""select player_name, count(*) as n_saw_flop, count(*) filter (w) as n_showdowns,
    count(*) filter (w and winner is not null) as n_decided, count(*) filter (w and winner = player_name) as n_won,
    {rnd('100.0 * count(*) filter (w) / count(*)', 1)} as wtsd_pct,
    {rnd('100.0 * count(*) filter (w and winner = player_name) / nullif(count(*) filter (w and winner is not null), 0)', 1)} as wsd_pct
  from (select distinct f.hand_id, f.player_name, winner_player_name as winner, s.who is not null as w
    from (select distinct hand_id, player_name from ev where street <> 'preflop') f
    left join hand on hand.id = f.hand_id
    left join (select distinct id, seats[['BTN','SB','BB','UTG','UTG+1','MP','MP+1','HJ','CO'][(k - b + 9) % 9 + 1]] as who
      from (select id, seats, button_seat_index as b, unnest(map_keys(shown))::int as k from hand where shown is not null)) s
    on s.id = f.hand_id and s.who = f.player_name) group by 1"""

VPIP = """select o.player_name, hands as n_hands, vpip as vpip_pct, pfr as pfr_pct, af, n_actions, last_seen
  from ({overall}) o join (select player_name, count(*) as n_actions, strftime(max(timestamp), '%Y-%m-%d %H:%M:%S.%f') as last_seen
    from ev group by 1) c on c.player_name = o.player_name"""

LATEST = """select player_name, hand_id from (select player_name, hand_id, row_number() over (partition by player_name
    order by max(timestamp) desc, hand_id desc) as rn from ev group by 1, 2) where rn <= 20"""

_WINNINGS = f"""
  with last as (select player_name, hand_id, arg_max(stack_after, sequence_number) as s,
      arg_max(timestamp, sequence_number) as t from ev where stack_after is not null group by 1, 2),
  dl as (select *, s - lag(s) over (partition by player_name order by t, hand_id) as delta from last),
  k as (select *, delta > 50 and (round_even(delta, 0)::bigint % 50 = 0 or delta in
      (100, 200, 300, 500, 800, 1000, 1500, 2000, 3000, 5000, 10000)) as rebuy from dl where delta is not null),
  i as (select x.player_name as p, count(*) filter (x.classification = 'insurance_payout') as n
        from (select unnest(cast(json(insurance_json) as struct(player_name varchar, classification varchar)[])) as x from hand)
        group by 1)
  select player_name, count(*) as n_hands, coalesce(sum(delta) filter (not rebuy), 0) as sum_winnings,
    coalesce(sum(delta) filter (rebuy), 0) as sum_buyins_inferred,
    {rnd('avg(delta / blind_bb) filter (not rebuy) * 100', 2)} as bb_per_100,
    coalesce(any_value(n) filter (player_name not like 'TempUser_%'), 0) as n_insurance_payouts
  from k left join hand on hand.id = k.hand_id left join i on i.p = player_name group by 1"""

_BANDS = """
  case when depth is null then 'unknown' when depth < 40 then 'short' when depth < 100 then 'medium' else 'deep' end as stack_depth,
  case when live is null then 'unknown' when live <= 2 then 'heads_up' else 'multiway' end as players_in_pot,
  case when position in ('CO', 'BTN') then 'IP' else 'OOP' end as position_vs,
  case when flop is null then 'none' when list_max(list_transform(flop, lambda c: len(list_filter(flop, lambda x: x[2] = c[2])))) = 2
       then 'wet' else 'dry' end as board_texture,
  case when size is null then 'none' when size < 0.4 then 'small' when size < 0.8 then 'medium' else 'large' end as bet_size_bucket"""

_SIT = f"""
  with x as (select d.*, cardinality(seats) - count(*) filter (action_type = 'fold') over (partition by hand_id
        order by sequence_number rows between unbounded preceding and 1 preceding) as live,
      stack_before / coalesce(blind_bb, 1) as depth, to_call / nullif(pot_after, 0) as size, turn[1:3] as flop
    from ({DEC}) d left join hand on hand.id = d.hand_id),
  y as (select x.*, {_BANDS} from x),
  z as ({' union all '.join(
      f"select player_name, '{k}' as stat_type, {', '.join(d.DIMENSIONS)}, ({did})::int as did from y where {o}"
      for k, (o, did) in _COND.items())})
  select player_name, stat_type, {', '.join(d.DIMENSIONS)}, {rnd('avg(did)', 4)} as value, count(*) as sample_size
  from z group by grouping sets ((player_name, stat_type, {', '.join(d.DIMENSIONS)}),
    {', '.join(f'(player_name, stat_type, {k})' for k in d.DIMENSIONS)}, (player_name, stat_type))"""

_TIMED = f"""select player_name, {rnd('100.0 * count(*) filter (decision_time_ms < 3000) / count(decision_time_ms)', 1)} as snap_pct
  from ev where player_name not like 'TempUser_%' group by 1 having count(decision_time_ms) >= 3"""

ORACLE = {
    "decision_table": sql(f"""select hand_id, sequence_number, player_name, position, street, action_type, amount,
        stack_before, pot_after, pfa as preflop_aggressor, raises_before, calls_before, entries_before,
        aggressor_acts_before, first_aggressor, last_aggressor, to_call, own_prev_action, own_prev_raises, flop_cbet
        from ({DEC})"""),
    "v_player_vpip_pfr_af": sql(VPIP.format(overall=OVERALL)),
    "v_player_3bet": sql(f"""select player_name, three_bet_opp as n_3bet_opps, three_bet_did as n_3bet_actual,
        {rnd('100.0 * three_bet_did / nullif(three_bet_opp, 0)', 1)} as three_bet_pct from ({SITUATIONS})"""),
    "v_player_position_stats": sql(f"""select player_name, position, count(*) as n_hands_at_pos,
          {rnd('100.0 * sum(v) / count(*)')}::int as vpip_pct_at_pos, {rnd('100.0 * sum(p) / count(*)')}::int as pfr_pct_at_pos
        from (select player_name, position, hand_id,
                max((street = 'preflop' and action_type not in ('fold', 'check'))::int) as v,
                max((street = 'preflop' and {_RAISING})::int) as p from ev group by 1, 2, 3) group by 1, 2"""),
    "player_winnings_summary": sql(_WINNINGS),
    "v_player_insurance_full": sql(f"""
        with i as (select unnest(cast(json(insurance_json) as struct(player_name varchar, classification varchar)[])) as x from hand)
        select x.player_name as player_name, count(*) as all_in_hands, null::bigint as bought_insurance_confirmed,
          count(*) filter (x.classification = 'insurance_payout') as bought_insurance_inferred,
          null::double as insurance_buy_rate_confirmed_pct,
          {rnd("100.0 * count(*) filter (x.classification = 'insurance_payout') / count(*)", 1)} as insurance_buy_rate_inferred_pct,
          null::boolean as signals_agree
        from i where x.player_name not like 'TempUser_%' group by 1"""),
    "confirmed_insurance": sql(f"""
        with i as (select unnest(cast(json(insurance_json) as struct(player_name varchar, classification varchar)[])) as x from hand),
        a as (select x.player_name as player_name, count(*) as n, count(*) filter (x.classification = 'insurance_payout') as b from i
          where x.player_name not like 'TempUser_%' group by 1),
        k as (select 'P' || c_custkey % 70 as player_name, sum(c_custkey % 5 + 1)::bigint as n, sum(c_custkey % 5)::bigint as b from customer group by 1)
        select player_name, coalesce(k.n, a.n) as all_in_hands, k.b as bought_insurance_confirmed, a.b as bought_insurance_inferred,
          {rnd('100.0 * k.b / k.n', 1)} as insurance_buy_rate_confirmed_pct, {rnd('100.0 * a.b / a.n', 1)} as insurance_buy_rate_inferred_pct, k.b = a.b as signals_agree
        from a full join k using (player_name)"""),
    "situation_rates": sql(f"select *, {_RATES} from ({SITUATIONS})"),
    "showdown_rates": sql(SHOWDOWN),
    "player_stats_cache": sql(f"""
        select o.player_name, hands as total_hands, vpip::double as vpip, pfr::double as pfr, af,
          {', '.join(d.STATS.values())}, wtsd_pct, wsd_pct
        from ({OVERALL}) o left join (select player_name, {_RATES} from ({SITUATIONS})) s on s.player_name = o.player_name
        left join ({SHOWDOWN}) w on w.player_name = o.player_name"""),
    "refreshed_stats_cache": sql(f"""
        select o.player_name, hands as total_hands, vpip::double as vpip, pfr::double as pfr, af,
          {', '.join(d.STATS.values())}, wtsd_pct, wsd_pct, '{AS_OF} 00:00:00.000000' as last_updated, coalesce(n_saw_flop, 0) as n_saw_flop,
          coalesce(three_bet_opp, 0) as three_bet_opp
        from ({OVERALL}) o left join (select player_name, three_bet_opp, {_RATES} from ({SITUATIONS})) s on s.player_name = o.player_name
        left join ({SHOWDOWN}) w on w.player_name = o.player_name""".replace(" 00:00:00 00:", " 00:")),
    "player_situational_stats": sql(_SIT),
    "lookback_vpip_pfr_af": sql(
        f"""select o.player_name, hands as n_hands, vpip as vpip_pct, pfr as pfr_pct, af, n_actions, last_seen
        from ({OVERALL.replace('from ev', f'from (select ev.* from ev semi join ({LATEST}) using (player_name, hand_id))')}) o
        join (select player_name, count(*) as n_actions, {ts('max(timestamp)')} as last_seen
              from ev semi join ({LATEST}) using (player_name, hand_id) group by 1) c on c.player_name = o.player_name"""),
    "live_table": sql(f"""
        with l as (select arg_max(id, (started_at, id)) as hand_id, table_name from hand group by 2),
        s as (select l.table_name, l.hand_id, started_at, unnest(map_entries(seats)) as x from l join hand on hand.id = l.hand_id)
        select s.table_name, s.hand_id, {ts('started_at')} as started_at, x.key as position, x.value as player_name,
          hands as total_hands, vpip, pfr, af, snap_pct
        from s left join ({OVERALL}) o on o.player_name = x.value left join ({_TIMED}) m on m.player_name = x.value"""),
}
