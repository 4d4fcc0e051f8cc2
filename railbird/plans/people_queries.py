"""Names, fingerprints, health, telemetry and evaluation."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from railbird.functions import actions as A
from railbird.operators import evaluation as ev
from railbird.operators import health as h
from railbird.operators import identity as ident
from railbird.plans.base import Tables, query, rnd, sql, ts
from railbird.plans.derive_queries import run

AS_OF, WINDOW = datetime(1998, 6, 1), 1440.0
NAME_CUTOFF = 0.65
WIDE = "6 days"

# ------------------------------------------------------------ derived readings
_BASE = "(user_id % 1000) * 9007199254740881"
AVATARS = f"""select event_id, 'T' || cast(user_id % 10 as string) as table_id, cast(user_id % 9 as int) as seat,
  {_BASE} - ({_BASE}) % 8 + event_id % 8 as phash from events"""
REGISTRY = f"""select distinct {_BASE} as phash,
  case when user_id % 4 = 0 then 'TempUser_' else 'P' end || cast(user_id as string) as name from events where user_id % 3 <> 0"""
SEATED = """select 'T' || cast(user_id % 10 as string) as table_id, cast(user_id % 9 as int) as seat,
  case when max(user_id) % 4 = 0 then 'TempUser_' else 'P' end || cast(max(user_id) as string) as name
from events group by 1, 2"""
READ_NAMES = """select event_id, case event_id % 5 when 0 then '' when 1 then 'CALL 20' else 'Ace' || cast(user_id as string) end as first_text,
  case event_id % 7 when 0 then null when 1 then '弃牌' else 'Ace' || cast(user_id % 100 as string) || ' ' end as second_text,
  case when event_id % 11 = 0 then '' else substr('0110100110010110', cast(event_id % 5 + 1 as int), 10) end as avatar_bits from events"""
SEEN_NAMES = """select 'T' || cast(user_id % 10 as string) as table_id, cast(user_id % 9 as int) as seat, ts as at,
  case when event_id % 3 = 0 then 'TempUser_' || cast(event_id % 50 as string) else 'P' || cast(user_id as string) end as player_name from events"""
TICKS = """select 'S' || cast(user_id % 7 as string) as session, event_id as tick, ts,
  cast(100 + (event_id * 37) % 900 as double) as tick_ms, cast((event_id * 11) % 50 as double) / 4 as db_ms,
  cast((event_id * 3) % 80 as double) as ph_community, cast((event_id * 7) % 300 as double) as ph_seat_actions,
  case when event_id % 3 = 0 then cast(event_id % 40 as double) else cast(0 as double) end as ph_showdown,
  cast((event_id * 5) % 20 as double) as ph_pot from events"""
LABELS = """select action_type as ai_action, case when sequence_number % 10 = 0 then 'skip' else text_derived_action end as user_action,
  confidence_score < 0.7 as has_screenshot from ev"""
SAMPLES = """select l_orderkey * 1000000 + l_partkey as sample_id, l_linestatus as grp, l_returnflag as card,
  cast(l_quantity * 5 as double) as r, cast(floor(l_extendedprice) as bigint) % 256 + cast(0 as double) as g,
  cast(l_partkey % 256 as double) as b from lineitem"""
PREDICTIONS = """select cast(event_id as string) as sample_id,
  case when event_type in ('view', 'click') then 'community' when event_type = 'purchase' then 'showdown' else 'noncard' end as domain,
  event_type in ('view', 'click', 'purchase') as is_card,
  substr('23456789TJQKA', cast(user_id % 13 + 1 as int), 1) as rank, substr('cdhs', cast(user_id % 4 + 1 as int), 1) as suit,
  substr('23456789TJQKA', cast((user_id + case when event_id % 7 = 0 then 1 else 0 end) % 13 + 1 as int), 1) as pred_rank,
  substr('cdhs', cast((user_id + case when event_id % 11 = 0 then 1 else 0 end) % 4 + 1 as int), 1) as pred_suit,
  case when event_id % 17 = 0 then event_type not in ('view', 'click', 'purchase') else event_type in ('view', 'click', 'purchase') end as pred_is_card,
  user_id % 13 = 12 as is_rare, event_id % 19 = 0 as train_only from events"""


def _ticks(t: Tables):
    names = ["community", "seat_actions", "showdown", "pot"]
    phases = F.create_map(*[x for n in names for x in (F.lit(n), F.col(f"ph_{n}"))])
    return run(t, TICKS).withColumn("phases", phases)


def _labels(t: Tables):
    return t.events.select(
        F.col("action_type").alias("ai_action"),
        F.when(F.col("sequence_number") % 10 == 0, "skip").otherwise(F.col("raw.text_derived_action")).alias("user_action"),
        (F.col("confidence_score") < 0.7).alias("has_screenshot"))


def _shorter(t: Tables):
    return t.events.select("player_name", F.substring("player_name", 1, 2).alias("canonical")).distinct().where(
        F.length("player_name") == 3)


def _hash_codes(t: Tables):
    rows = run(t, AVATARS).withColumn("bits", A.hash_to_bits("phash"))
    other = F.reverse("bits")
    return rows.select(
        "event_id", "phash", "bits", A.bits_to_hash("bits").alias("back"),
        A.hash_distance("phash", A.bits_to_hash(other)).alias("distance"),
        A.bit_text_distance(F.col("bits"), other).alias("text_distance"),
        A.bit_text_distance(F.col("bits"), F.substring("bits", 1, 10)).alias("uneven"))


def _recognised(t: Tables):
    p = run(t, PREDICTIONS).where("is_card")
    label = F.concat("pred_rank", "pred_suit")
    return ev.recognition_summary(p.select(
        F.concat("rank", "suit").alias("expected"), F.when(F.col("pred_is_card"), label).alias("recognised")))


#: What the warnings' payloads hold.
WARNED = ["hands_last_30min", "threshold", "recent_avg_conf", "historic_avg_conf", "drop_pct", "recent_override_count", "recent_total", "rate_pct",
          "warn_error_count", "stack_null_count", "total"]

QUERIES = {
    "alias_pairs": query(lambda t: ident.alias_pairs(t.events, cutoff=NAME_CUTOFF)),
    "alias_clusters": query(lambda t: ident.alias_clusters(t.events, cutoff=NAME_CUTOFF)),
    "renamed_events": query(lambda t: ident.renamed(t.events, _shorter(t)).select("id", "player_name")),
    "rename_report": query(lambda t: ident.rename_report(t.events, _shorter(t))),
    "nearest_fingerprints": query(lambda t: ident.nearest_fingerprints(run(t, AVATARS), run(t, REGISTRY))),
    "seat_swaps": query(lambda t: ident.seat_swaps(run(t, AVATARS), run(t, SEATED), run(t, REGISTRY))),
    "seat_names": query(lambda t: ident.seat_names(run(t, READ_NAMES))),
    "placeholder_upgrades": query(lambda t: ident.placeholder_upgrades(
        run(t, SEEN_NAMES).withColumn("at", F.col("at").cast("timestamp")))),
    "hash_codes": query(_hash_codes),
    "health_metrics": query(lambda t: h.health_metrics(
        t.hands, t.events, t.diagnostics, as_of=AS_OF, window_minutes=WINDOW)),
    "health_warnings": query(lambda t: h.health_warnings(
        t.hands, t.events, t.diagnostics, as_of=AS_OF, window_minutes=WINDOW).select(
            "hand_id", "tag", "level", "occurred_at", *[F.get_json_object("payload", f"$.{f}").cast("double").alias(f) for f in WARNED])),
    "tick_stats": query(lambda t: h.tick_stats(_ticks(t), width=WIDE)),
    "phase_stats": query(lambda t: h.phase_stats(_ticks(t), width=WIDE)),
    "top_phases": query(lambda t: h.phase_stats(_ticks(t), top=3, width=WIDE)),
    "latency_summary": query(lambda t: h.latency_summary(
        t.read("events").select(F.col("event_type").alias("label"), F.col("value").alias("ms")))),
    "review_sample": query(lambda t: ev.review_sample(t.events)),
    "agreement_report": query(lambda t: ev.agreement_report(_labels(t))),
    "top_disagreements": query(lambda t: ev.top_disagreements(_labels(t))),
    "drift_report": query(lambda t: ev.drift_report(run(t, SAMPLES), groups=("O", "F"))),
    "drift_by_card": query(lambda t: ev.drift_report(
        run(t, SAMPLES), groups=("O", "F"), keys=["card"])),
    "classifier_report": query(lambda t: ev.classifier_report(run(t, PREDICTIONS))),
    "classifier_score": query(lambda t: ev.classifier_score(run(t, PREDICTIONS))),
    "recognition_summary": query(_recognised),
    "holdout_split": query(lambda t: ev.holdout_split(run(t, PREDICTIONS).select("sample_id", "domain", "train_only"))),
}

# ------------------------------------------------------------ checking SQL
_METRICS = f"""
  with s as (select timestamp '1998-06-01' - interval {int(WINDOW)} minute as since),
  e as (select ev.*, started_at > since as inside, started_at < since as older from ev join hand on hand.id = ev.hand_id, s)
  select (select count(*) from hand, s where started_at > since) as hands_recent,
    avg(confidence_score) filter (inside) as recent_conf, avg(confidence_score) filter (older) as historic_conf,
    count(*) filter (inside) as events_recent, count(*) filter (inside and override_reason is not null) as overridden_recent,
    count(*) filter (inside and stack_delta is null) as no_delta_recent,
    (select count(*) from diag, s where level in ('WARN', 'ERROR') and occurred_at > since) as warnings_recent
  from e"""

_NAMED = """upper(trim(x)) <> '' and not regexp_matches(upper(x), 'CALL|弃牌')"""
_BATCH = "select *, (row_number() over (partition by session order by ts, tick) - 1) // 20 as batch from ticks"
_PHASES = f"""select session, batch, p.phase, {rnd('avg(p.ms)', 1)} as avg_ms, {rnd('max(p.ms)', 1)} as max_ms,
    count(*) filter (p.ms > 0) as exec_count, {rnd('100 * sum(p.ms) / sum(tick_ms)', 1)} as pct_of_tick
  from (select session, batch, tick_ms, unnest([{{'phase': 'community', 'ms': ph_community}}, {{'phase': 'seat_actions', 'ms': ph_seat_actions}},
      {{'phase': 'showdown', 'ms': ph_showdown}}, {{'phase': 'pot', 'ms': ph_pot}}]) as p from ({_BATCH})) group by 1, 2, 3 having count(*) = 20"""


def _drift(keys: str) -> str:
    k = f"{keys}, " if keys else ""
    join = f"a.{keys} = b.{keys} and " if keys else ""
    group = f"a.{keys}" if keys else ""
    gaps = ", ".join(rnd(f"b.{f}{c} - a.{f}{c}", 4) + f" as {n}_gap_{c}" for f, n in (("m", "mean"), ("s", "std")) for c in "rgb")
    moments = ", ".join(f"avg({c}) as m{c}, stddev_pop({c}) as s{c}" for c in "rgb")
    dist = "sqrt((a.mr - b.mr) ** 2 + (a.mg - b.mg) ** 2 + (a.mb - b.mb) ** 2)"
    return f"""
      with x as (select *, least(floor((r * 0.299 + g * 0.587 + b * 0.114) / 8), 31)::int as bin from samples),
      m as (select {k}grp, count(*) as n, {moments}, list(bin) as bins from x group by all),
      hh as (select *, list_transform(range(0, 32), lambda i: len(list_filter(bins, lambda q: q = i)) / n::double) as hist from m),
      j as (select {group + ', ' if keys else ''}a.n as a_n, b.n as b_n, {gaps}, {dist} as dist,
          list_sum(list_transform(range(1, 33), lambda i: (a.hist[i] - b.hist[i]) ** 2 / (a.hist[i] + b.hist[i] + 2e-10))) as chi
        from hh a, hh b where {join}a.grp = 'O' and b.grp = 'F')
      select * exclude (dist, chi), {rnd('chi', 6)} as chi_square, {rnd('dist', 4)} as mean_distance,
        case when chi < 0.05 and dist < 5 then 'match' when chi < 0.2 and dist < 20 then 'moderate' else 'significant' end as verdict from j"""


_POOL = """case when confidence_score < 0.7 then 'screenshot' when override_reason is not null then 'override' else 'clean' end"""

# The names of three or more characters in these tables are P and two digits.  For
# those the matching blocks are P and one more character exactly if they share a
# digit, so the ratio is 2/3 or 1/3.
_ALIASES = """
  p as (select player_name as n, count(distinct hand_id) as h from ev where not starts_with(player_name, 'TempUser')
        and length(player_name) >= 3 group by 1),
  pairs as (select a.n as a, a.h as ah, b.n as b, b.h as bh from p a, p b where (a.h > b.h or (a.h = b.h and a.n < b.n))
        and list_has_any([a.n[2], a.n[3]], [b.n[2], b.n[3]]))"""

ORACLE = {
    "alias_pairs": sql(f"""with {_ALIASES}
        select b as alias, a as canonical, 0.667::double as ratio, bh as alias_hands, ah as canonical_hands,
          b || ' → ' || a as recommend from pairs"""),
    "alias_clusters": sql(f"""with recursive {_ALIASES},
        e as (select a as x, b as y from pairs union select b, a from pairs),
        reach(x, y) as (select x, y from e union select r.x, e.y from reach r join e on e.x = r.y),
        n as (select distinct player_name from ev where not starts_with(player_name, 'TempUser'))
        select player_name, coalesce(least(min(y), player_name), player_name) as canonical
        from n left join reach on x = player_name group by 1"""),
    "renamed_events": sql("""select id, if(length(player_name) = 3, player_name[1:2], player_name) as player_name from ev"""),
    "rename_report": sql("""select player_name as from_name, player_name[1:2] as to_name, count(*) as rows_updated
        from ev where length(player_name) = 3 group by 1, 2"""),
    "nearest_fingerprints": sql("""
        with h as (select distinct phash from avatars),
        c as (select h.phash, min((bit_count(xor(h.phash, registry.phash))::int, name)) as m from h, registry
              where bit_count(xor(h.phash, registry.phash)) <= 6 group by 1)
        select a.*, if(starts_with(m[2], 'TempUser_'), null, m[1]) as distance,
          if(starts_with(m[2], 'TempUser_'), null, m[2]) as matched_name
        from avatars a left join c using (phash)""".replace("m[1]", "struct_extract(m, 1)").replace("m[2]", "struct_extract(m, 2)"),
        avatars=AVATARS, registry=REGISTRY),
    "seat_swaps": sql("""
        with r as (select name, min(phash) as cached_phash from registry group by 1)
        select a.*, name, cached_phash, bit_count(xor(a.phash, cached_phash))::int as distance
        from avatars a join seated using (table_id, seat) join r using (name)
        where bit_count(xor(a.phash, cached_phash)) > 12""", avatars=AVATARS, seated=SEATED, registry=REGISTRY),
    "seat_names": sql(f"""
        with n as (select *, if(length(coalesce(trim(first_text), '')) >= length(coalesce(trim(second_text), '')),
                     trim(first_text), trim(second_text)) as x from names),
        p as (select *, case when {_NAMED} then x when avatar_bits <> '' then 'TempUser_' || avatar_bits[1:8] end as player_name from n)
        select * exclude (x), case when player_name is null then 'none' when starts_with(player_name, 'TempUser_') then 'placeholder'
          else 'text' end as name_source from p""", names=READ_NAMES),
    "placeholder_upgrades": sql("""
        with l as (select *, first_value(if(starts_with(player_name, 'TempUser_'), null, player_name) ignore nulls) over (
            partition by table_id, seat order by "at" rows between 1 following and unbounded following) as nxt from seen)
        select player_name, arg_min(nxt, "at") as canonical from l
        where starts_with(player_name, 'TempUser_') and nxt is not null group by 1""", seen=SEEN_NAMES),
    "hash_codes": sql("""
        with b as (select event_id, phash, lpad(bin(phash), 64, '0') as bits from avatars)
        select *, phash as back, list_sum(list_transform(range(1, 65), lambda i: (bits[i] <> bits[65 - i])::int))::int as distance,
          list_sum(list_transform(range(1, 65), lambda i: (bits[i] <> bits[65 - i])::int))::int as text_distance, 999 as uneven from b""",
        avatars=AVATARS),
    "health_metrics": sql(_METRICS),
    "health_warnings": sql(f"""
        with m as ({_METRICS}),
        d as (select *, (historic_conf - recent_conf) * 100 / historic_conf as drop from m),
        w as (
          select 'health.low_hand_rate' as tag, hands_recent as h, 5 as t, null as rc, null as hc, null as dp, null as o, null as rt, null as r, null as w, null as z, null as n
            from d where hands_recent < 5
          union all select 'health.conf_dropped', null, null, {rnd('recent_conf', 3)}, {rnd('historic_conf', 3)}, {rnd('drop', 1)}, null, null, null, null, null, null
            from d where historic_conf > 0 and drop > 10
          union all select 'health.override_spike', null, null, null, null, null, overridden_recent, events_recent, {rnd('overridden_recent * 100.0 / events_recent', 1)}, null, null, null
            from d where events_recent > 10 and overridden_recent * 10 > events_recent
          union all select 'health.diag_burst', null, 20, null, null, null, null, null, null, warnings_recent, null, null from d where warnings_recent > 20
          union all select 'health.stack_ocr_degraded', null, null, null, null, null, null, null, {rnd('no_delta_recent * 100.0 / events_recent', 1)}, null, no_delta_recent, events_recent
            from d where events_recent > 10 and no_delta_recent * 2 > events_recent)
        select null::bigint as hand_id, tag, 'WARN' as level, '1998-06-01 00:00:00.000000' as occurred_at, h::double as hands_last_30min, t::double as threshold,
          rc::double as recent_avg_conf, hc::double as historic_avg_conf, dp::double as drop_pct, o::double as recent_override_count, rt::double as recent_total,
          r::double as rate_pct, w::double as warn_error_count, z::double as stack_null_count, n::double as total from w"""),
    "tick_stats": sql(f"""
        with g as (select session, batch, count(*) as n, list(tick_ms order by tick_ms) as t, list(db_ms order by db_ms) as d,
              avg(tick_ms) as a, avg(db_ms) as b from ({_BATCH}) group by 1, 2 having count(*) = 20)
        select session, batch, n, {rnd('t[1]', 1)} as min_ms, {rnd('t[11]', 1)} as median_ms, {rnd('t[20]', 1)} as p95_ms,
          {rnd('t[20]', 1)} as max_ms, {rnd('a', 1)} as avg_ms, 250::double as sleep_ms, {rnd('1000 / (a + 250)', 2)} as effective_hz,
          {rnd('b', 1)} as db_avg_ms, {rnd('d[11]', 1)} as db_median_ms, {rnd('d[20]', 1)} as db_p95_ms, {rnd('d[20]', 1)} as db_max_ms,
          {rnd('100 * b / a', 1)} as db_pct_of_tick from g""", ticks=TICKS),
    "phase_stats": sql(_PHASES, ticks=TICKS),
    "top_phases": sql(f"""select * exclude (k) from (select *, row_number() over (partition by session, batch
        order by pct_of_tick desc, phase) as k from ({_PHASES})) where k <= 3""", ticks=TICKS),
    "latency_summary": sql(f"""
        with g as (select event_type as label, list(value order by value) as v, count(*) as n, avg(value) as a from events
                   where value is not null group by 1)
        select label, n as n_runs, {rnd('v[1]', 2)} as min_ms, {rnd('v[least(floor(n * 0.5), n - 1)::int + 1]', 2)} as median_ms,
          {rnd('v[least(floor(n * 0.95), n - 1)::int + 1]', 2)} as p95_ms, {rnd('v[n]', 2)} as max_ms, {rnd('a', 2)} as avg_ms from g"""),
    "review_sample": sql(f"""
        with p as (select *, {_POOL} as pool from ev),
        s as (select *, row_number() over (partition by pool order by md5('0|' || id)) as b from p)
        select id as event_id, hand_id, player_name, position, street, action_type, amount, confidence_score, override_reason,
          {ts('timestamp')} as timestamp, pool from s where b <= case pool when 'screenshot' then 30 else 5 end"""),
    "agreement_report": sql(f"""
        with j as (select *, (ai_action = user_action)::int as ok from labelled where user_action not in ('skip', 'quit')),
        u as (select 'overall' as section, 'all' as value, ok from j union all select 'evidence', has_screenshot::varchar, ok from j
              union all select 'action', ai_action, ok from j)
        select section, value, sum(ok)::bigint as agreed, count(*) as n, {rnd('100.0 * sum(ok) / count(*)', 1)} as agree_pct
        from u group by 1, 2""", labelled=LABELS),
    "top_disagreements": sql("""select ai_action, user_action, count(*) as n from labelled
        where user_action not in ('skip', 'quit') and ai_action <> user_action group by 1, 2
        order by n desc, ai_action, user_action limit 5""", labelled=LABELS),
    "drift_report": sql(_drift(""), samples=SAMPLES),
    "drift_by_card": sql(_drift("card"), samples=SAMPLES),
    "classifier_report": sql(f"""
        select domain, count(*) as n, count(*) filter (is_rare) as rare_n,
          {rnd('count(*) filter (rank = pred_rank) / count(*)::double', 6)} as rank_acc,
          {rnd('count(*) filter (suit = pred_suit) / count(*)::double', 6)} as suit_acc,
          {rnd('count(*) filter (rank || suit = pred_rank || pred_suit) / count(*)::double', 6)} as both_acc,
          {rnd('count(*) filter (is_rare and rank || suit = pred_rank || pred_suit) / nullif(count(*) filter (is_rare), 0)::double', 6)} as rare_acc
        from predictions where is_card and domain <> 'noncard' group by 1""", predictions=PREDICTIONS),
    "classifier_score": sql(f"""
        with a as (select domain, avg((rank || suit = pred_rank || pred_suit)::int) as x from predictions where is_card group by 1)
        select {rnd("avg((not pred_is_card)::int) filter (domain = 'noncard')", 6)} as noncard_recall,
          {rnd('avg(pred_is_card::int) filter (is_card)', 6)} as card_recall,
          {rnd("(select 2 / sum(1 / x) from a)", 6)} as score from predictions""", predictions=PREDICTIONS),
    "recognition_summary": sql(f"""
        with p as (select rank || suit as w, if(pred_is_card, pred_rank || pred_suit, null) as g from predictions where is_card)
        select count(*) as total, count(*) filter (w = g) as correct, count(*) filter (w <> g) as wrong,
          count(*) filter (g is null) as unrecognised, {rnd('100.0 * count(*) filter (w = g) / count(*)', 1)} as accuracy_pct from p""",
        predictions=PREDICTIONS),
    "holdout_split": sql("""
        with r as (select *, row_number() over (partition by domain, train_only order by md5('0|' || sample_id)) as k,
            count(*) over (partition by domain, train_only) as n from predictions)
        select sample_id, domain, train_only, if(not train_only and n >= 5 and k <= greatest(1, floor(n * 0.2)), 'holdout', 'train') as part
        from r""", predictions=PREDICTIONS),
}
