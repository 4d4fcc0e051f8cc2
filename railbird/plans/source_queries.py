"""Reading and writing the engine's tables: JSON parsing, appends, CSV reports, sidecars; and board textures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railbird.functions.actions import board_texture
from railbird.operators import hand_audits, identity, player_audits
from railbird.plans import derive_queries as dq
from railbird.plans import people_queries as pq
from railbird.plans import view_queries as vq
from railbird.plans.base import Tables, query, sql
from railbird.session import new_folder
from railbird.sources import derivations, sidecars, silver, tables

# ------------------------------------------------------------ raw rows with JSON text
RAW_HANDS = f"""select id, table_name, started_at, ended_at, pot_size_final, hero_cards_json as hero_cards,
  case when turn_cards_json is not null then '{{"turn":' || turn_cards_json || '}}' end as community_cards, seats_json as seats,
  '{{"player_stacks_initial":' || replace(stacks_initial_json, ',"1":', ',"9":"x","1":')
    || coalesce(',"player_stacks_final":' || stacks_final_json, '') || coalesce(',"showdown_cards":' || showdown_json, '')
    || ',"button_seat_index":"' || cast(button_seat_index as string) || '"'
    || coalesce(',"blind_level":{{"sb":' || cast(blind_sb as string) || ',"bb":"' || cast(blind_bb as string) || '"}}', '') || '}}' as raw_data
from ({derivations.HANDS}) h"""
RAW_EVENTS = f"""select hand_id, sequence_number, player_name, position, street, action_type, amount, confidence_score, timestamp,
  '{{"stack_before":' || cast(stack_before as string) || coalesce(',"stack_delta":"' || cast(stack_delta as string) || '"', '')
    || coalesce(',"decision_time_ms":' || cast(decision_time_ms as string), '') || ',"used_timebank":' || cast(used_timebank as string) || '}}' as raw_data
from ({derivations.ACTION_EVENTS}) e"""


def _landed(t: Tables, text: str) -> DataFrame:
    """The raw rows as they would lie in a landing folder."""
    folder = new_folder(t.spark, "raw")
    dq.run(t, text).write.parquet(folder)
    return t.spark.read.parquet(folder)


def _appended(t: Tables) -> DataFrame:
    """The events after three appends, read back as the typed table."""
    root = new_folder(t.spark, "appended")
    events = t.events.withColumn("hand_id", F.col("hand_id").cast("string"))
    for n in range(3):
        tables.append(events.where(F.col("sequence_number") % 3 == n), root, "action_events")
    return tables.read_table(t.spark, root, "action_events")


def _last_hand(t: Tables) -> DataFrame:
    """One hand in order: that of the newest event."""
    events = _appended(t)
    newest = events.agg(F.max_by("hand_id", F.struct("timestamp", "hand_id"))).first()[0]
    return tables.hand_events(events, newest).select("id", "sequence_number", "action_type")


def _csv_report(t: Tables) -> DataFrame:
    folder = new_folder(t.spark, "report")
    report = identity.alias_pairs(t.events, cutoff=pq.NAME_CUTOFF)
    tables.write_csv(report, folder)
    return t.spark.read.option("header", True).schema(report.schema).csv(folder)


def _sidecars(t: Tables) -> DataFrame:
    """Reviews of overridden events that nobody trusts, one file each, read back."""
    folder = new_folder(t.spark, "reviews")
    low = t.events.where((F.col("confidence_score") < 0.6) & F.col("raw.override_reason").isNotNull())
    doc = F.to_json(F.struct(F.col("id").alias("event_id"), F.concat(F.lit("小"), "player_name").alias("player_name"), "position", "action_type", "amount", "confidence_score"))
    sidecars.write_sidecars(low.select(doc.alias("value")), folder)
    return sidecars.read_sidecars(t.spark, folder, sidecars.REVIEW, pattern="*.txt").where("event_id is not null").drop("path", "raw_data")


def _textures(t: Tables) -> DataFrame:
    cards = F.try_element_at("community_cards", F.lit("turn"))
    out = t.hands.select("id", board_texture(F.slice(cards, 1, 3)).alias("flop"), board_texture(cards).alias("turn")).where("flop is not null")
    return out.select("id", *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in ("flop", "turn") for c in ("paired", "trips", "monotone", "double_suited", "high_card", "wet")])


QUERIES = {
    "parsed_hand_conservation": query(lambda t: hand_audits.hand_conservation(silver.parse_hands(_landed(t, RAW_HANDS)).withColumn(
        "started_at", F.col("started_at").cast("timestamp")))),
    "parsed_showdown_by_seat": query(lambda t: hand_audits.showdown_by_seat(silver.parse_hands(_landed(t, RAW_HANDS)))),
    "parsed_timing_stats": query(lambda t: player_audits.timing_stats(silver.parse_action_events(_landed(t, RAW_EVENTS)).withColumn(
        "timestamp", F.col("timestamp").cast("timestamp")))),
    "appended_events": query(lambda t: _appended(t).select("id", "hand_id", "player_name", "sequence_number", "action_type", "amount", "confidence_score")),
    "last_hand_events": query(_last_hand),
    "alias_report_csv": query(_csv_report),
    "review_sidecars": query(_sidecars),
    "board_textures": query(_textures),
}


def _texture(name: str, cards: str) -> str:
    ranks, suits = (f"list_transform({cards}, lambda c: c[{n}])" for n in (1, 2))
    most = lambda xs: f"list_max(list_transform(list_distinct({xs}), lambda x: len(list_filter({xs}, lambda y: y = x))))"
    pairs = f"len(list_filter(list_distinct({suits}), lambda x: len(list_filter({suits}, lambda y: y = x)) >= 2)) >= 2"
    high = f"coalesce(list_filter(['T', 'J', 'Q', 'K', 'A'], lambda r: list_contains({ranks}, r))[1], list_max({ranks}))"
    return f"""{most(ranks)} >= 2 as {name}_paired, {most(ranks)} >= 3 as {name}_trips, {most(suits)} >= 3 as {name}_monotone, {pairs} as {name}_double_suited,
      {high} as {name}_high_card, ({pairs}) or ({most(suits)} = 2) as {name}_wet"""


# ------------------------------------------------------------ checking SQL
ORACLE = {
    # The unreadable stack of seat 9 has no value and adds nothing.
    "parsed_hand_conservation": vq.ORACLE["v_hand_conservation"],
    "parsed_showdown_by_seat": vq.ORACLE["v_ring_beam_showdown_by_seat"],
    "parsed_timing_stats": vq.ORACLE["v_player_timing_stats"],
    "appended_events": sql("select id, hand_id::varchar as hand_id, player_name, sequence_number, action_type, amount, confidence_score from ev"),
    "last_hand_events": sql("""select id, sequence_number, action_type from ev
        where hand_id = (select arg_max(hand_id, (timestamp, hand_id::varchar)) from ev)"""),
    "alias_report_csv": pq.ORACLE["alias_pairs"],
    "review_sidecars": sql("""select id as event_id, '小' || player_name as player_name, position, action_type, amount, confidence_score
        from ev where confidence_score < 0.6 and override_reason is not null"""),
    "board_textures": sql(f"""select id, {_texture('flop', 'turn[1:3]')}, {_texture('turn', 'turn')} from hand where turn is not null and len(turn) >= 3"""),
}
