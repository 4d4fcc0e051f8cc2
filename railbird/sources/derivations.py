"""How hands, events, diagnostics and observations are derived from the test tables.

The text is valid in both Spark SQL and DuckDB, so the same statement feeds the
Spark queries and the checking SQL.
"""

HANDS = r"""
select o_orderkey as id,
       o_orderpriority as table_name,
       o_orderdate + cast(o_orderkey % 86400 as int) * interval '1' second as started_at,
       case when o_orderkey % 40 = 0 then null
            else o_orderdate + cast(o_orderkey % 86400 + (o_orderkey * 37) % 400 as int) * interval '1' second
       end as ended_at,
       case when o_orderkey % 31 = 0 then null
            when o_orderkey % 37 = 0 then cast(0 as double)
            else cast((o_orderkey * 13) % 900 + 20 as double) end as pot_size_final,
       cast(o_orderkey % 9 as int) as button_seat_index,
       '{"BTN":"P' || cast((o_orderkey * 7) % 50 as string)
         || '","SB":"P' || cast((o_orderkey * 7 + 11) % 50 as string)
         || case when o_orderkey % 13 = 0 then ''
                 else '","BB":"P' || cast((o_orderkey * 7 + 22) % 50 as string) end
         || '","UTG":"P' || cast((o_orderkey * 7 + 33) % 50 as string)
         || '","CO":"P' || cast((o_orderkey * 7 + 44) % 50 as string) || '"}' as seats_json,
       '{"0":' || cast(200 + (o_orderkey * 3) % 300 as string)
         || ',"1":' || cast(200 + (o_orderkey * 3 + 29) % 300 as string)
         || ',"2":' || cast(200 + (o_orderkey * 3 + 58) % 300 as string) || '}' as stacks_initial_json,
       case when o_orderkey % 17 = 0 then null else
       '{"0":' || cast(165 + (o_orderkey * 3) % 300 + (o_orderkey * 5) % 61 as string)
         || ',"1":' || cast(165 + (o_orderkey * 3 + 29) % 300 + (o_orderkey * 5 + 17) % 61 as string)
         || ',"2":' || cast(165 + (o_orderkey * 3 + 58) % 300 + (o_orderkey * 5 + 34) % 61
                            + case when o_orderkey % 11 = 0 then 500 else 0 end as string) || '}'
       end as stacks_final_json,
       case when o_orderkey % 3 = 0 then
       '{"1":["' || substr('23456789TJQKA', cast(o_orderkey % 13 + 1 as int), 1)
                 || substr('cdhs', cast(o_orderkey % 4 + 1 as int), 1)
         || '","' || substr('23456789TJQKA', cast((o_orderkey * 5) % 13 + 1 as int), 1)
                 || substr('cdhs', cast((o_orderkey * 3) % 4 + 1 as int), 1)
         || '"],"4":["' || substr('23456789TJQKA', cast((o_orderkey + 4) % 13 + 1 as int), 1)
                 || substr('cdhs', cast((o_orderkey * 7) % 4 + 1 as int), 1)
         || '","' || substr('23456789TJQKA', cast((o_orderkey * 2) % 13 + 1 as int), 1)
                 || substr('cdhs', cast((o_orderkey + 1) % 4 + 1 as int), 1) || '"]}'
       end as showdown_json,
       '["' || substr('23456789TJQKA', cast((o_orderkey * 3) % 13 + 1 as int), 1)
            || substr('cdhs', cast(o_orderkey % 4 + 1 as int), 1)
         || '","' || substr('23456789TJQKA', cast((o_orderkey * 3 + 1) % 13 + 1 as int), 1)
            || substr('cdhs', cast((o_orderkey + 2) % 4 + 1 as int), 1) || '"]' as hero_cards_json,
       case when o_orderkey % 4 = 0 then
       '["' || substr('23456789TJQKA', cast((o_orderkey * 6) % 13 + 1 as int), 1)
            || substr('cdhs', cast(o_orderkey % 4 + 1 as int), 1)
         || '","' || substr('23456789TJQKA', cast((o_orderkey * 6 + 3) % 13 + 1 as int), 1) || 'h'
         || '","' || substr('23456789TJQKA', cast((o_orderkey * 6 + 5) % 13 + 1 as int), 1) || 'c'
         || '","' || substr('23456789TJQKA', cast((o_orderkey * 6 + 7) % 13 + 1 as int), 1) || 'd"]'
       end as turn_cards_json,
       case when o_orderkey % 7 = 0 then
       '[{"player_name":"' || case when o_orderkey % 91 = 0 then 'TempUser_1' else 'P' || cast((o_orderkey * 7) % 50 as string) end
         || '","classification":"'
         || case o_orderkey % 4 when 0 then 'insurance_payout' when 1 then 'lost_no_insurance'
                               when 2 then 'rebuy' else 'won_main_pot' end || '"}]'
       end as insurance_json,
       case when o_orderkey % 5 = 0 then 'P' || cast((o_orderkey * 7) % 50 as string) end as winner_player_name,
       case when o_orderkey % 19 = 0 then null else cast(1 as double) end as blind_sb,
       case when o_orderkey % 19 = 0 then null else cast(2 as double) end as blind_bb
from orders
"""

ACTION_EVENTS = r"""
select l_orderkey as hand_id, seq as sequence_number,
       case when l_partkey % 29 = 0 then 'TempUser_' || cast(l_suppkey as string)
            else 'P' || cast((l_orderkey * 7 + (l_partkey % 5) * 11) % 50 as string) end as player_name,
       case l_partkey % 5 when 0 then 'BTN' when 1 then 'SB' when 2 then 'BB' when 3 then 'UTG' else 'CO' end as position,
       case when seq <= 2 then 'preflop' when seq <= 4 then 'flop' when seq <= 6 then 'turn' else 'river' end as street,
       action_type,
       case when action_type in ('fold', 'check') then null else chips end as amount,
       cast(100 - 5 * cast(round(l_discount * 100) as int) as double) / 100 as confidence_score,
       o_orderdate + cast(l_orderkey % 86400 + 7 * seq as int) * interval '1' second as timestamp,
       cast(40 + (l_partkey * 11) % 400 as double) as stack_before,
       case when action_type in ('fold', 'check') then cast(0 as double)
            when l_partkey % 19 = 0 then null else chips end as stack_delta,
       cast(40 + (l_partkey * 11) % 400 as double)
         - case when action_type in ('fold', 'check') then 0 else chips end as stack_after,
       6 + sum(case when action_type in ('fold', 'check') then 0 else chips end)
             over (partition by l_orderkey order by seq rows between unbounded preceding and current row)
         + case when l_partkey % 23 = 0 then 30 else 0 end as pot_after,
       case when l_returnflag = 'N' then null else cast(floor(l_extendedprice) as bigint) % 20000 end as decision_time_ms,
       l_returnflag = 'R' as used_timebank,
       case when l_suppkey % 7 = 0 and action_type = 'check' then 'fold' else action_type end as text_derived_action,
       case when l_partkey % 31 = 0 then 'stack-derived' end as override_reason
from (select l.*, o.o_orderdate,
             cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey,
                                     l_quantity, l_extendedprice) as int) as seq,
             case when l_quantity <= 10 then 'fold' when l_quantity <= 18 then 'check'
                  when l_quantity <= 30 then 'call' when l_quantity <= 38 then 'bet'
                  when l_quantity <= 46 then 'raise' else 'all_in' end as action_type,
             cast(10 + 10 * (cast(l_quantity as int) % 7) as double) as chips
      from lineitem l join orders o on l.l_orderkey = o.o_orderkey) t
"""

DIAGNOSTIC_EVENTS = r"""
select user_id as hand_id,
       case event_type when 'click' then 'pointer.action_inferred' when 'view' then 'pipeline.tick_stats'
                       when 'error' then 'showdown.gate5_low_conf' when 'purchase' then 'showdown.accepted'
                       else 'pattern_d.ocr2_action_fallback' end as tag,
       case when event_type = 'error' then 'WARN' else 'INFO' end as level,
       '{"seat":' || cast(user_id % 9 as string)
         || ',"last_timer_value":' || cast(event_id % 20 as string)
         || case when event_id % 3 = 0 then ',"time_since_timer":1.5'
                 else ',"reason":"timer_moved_to_next","next_seat":' || cast((user_id + 1) % 9 as string) end
         || ',"phases":{"attention_focus_ocr":{"avg_ms":' || cast(event_id % 15 as string)
         || ',"exec_count":' || cast(event_id % 10 as string) || '}}}' as payload,
       ts as occurred_at
from events
"""

OBSERVATIONS = r"""
select 'T' || cast(user_id % 10 as string) as table_id, event_id as tick, ts,
       cast(user_id % 9 as int) as seat,
       case event_type when 'click' then 'action' when 'view' then 'stack' when 'purchase' then 'pot'
                       when 'signup' then 'timer' else 'community' end as kind,
       case when event_type = 'click' then
            case event_id % 6 when 0 then 'FOLD' when 1 then 'CHECK' when 2 then 'CALL $' || cast(event_id % 90 as string)
                 when 3 then 'RAISE TO $' || cast(event_id % 300 as string) when 4 then 'ALL-IN' else '' end end as text,
       case event_type when 'view' then cast(event_id % 400 as double) when 'purchase' then cast(event_id % 700 as double)
                       when 'signup' then cast(event_id % 30 as double) when 'error' then cast(event_id % 6 as double) end as value
from events
"""

