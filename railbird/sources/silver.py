"""Raw rows with JSON text to the typed engine tables.

JSON is parsed once, here.  Stacks may be numbers or quoted numbers; an unreadable
one keeps its seat with no value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railbird import schemas as S
from railbird.functions.semantics import numeric_map

_INSURANCE = """array<struct<seat:string,player_name:string,stack_initial:string,stack_final:string,
  gain:string,pot:string,premium_inferred:string,classification:string>>"""
_HAND_RAW = f"""player_stacks_initial map<string,string>, player_stacks_final map<string,string>,
  showdown_cards map<string,array<string>>, insurance_inferred {_INSURANCE}, button_seat_index string,
  button_detection_method string, blind_level struct<sb:string,bb:string>, num_seats string, winner_player_name string"""
_EVENT_NUMBERS = ["stack_before", "stack_after", "stack_delta", "pot_before", "pot_after", "pot_delta"]
_EVENT_TEXTS = ["action_text", "text_derived_action", "stack_derived_action", "override_reason"]
_EVENT_RAW = ", ".join(
    f"{n} string" for n in [*_EVENT_NUMBERS, *_EVENT_TEXTS, "decision_time_ms", "used_timebank", "synthetic"])


def _number(c: str, kind: str = "double") -> Column:
    return F.col(c).try_cast(kind)


def parse_hands(raw: DataFrame) -> DataFrame:
    """Typed hands from rows whose cards, seats and raw_data are JSON text."""
    rows = raw.withColumn("r", F.from_json("raw_data", _HAND_RAW))
    insurance = F.transform("r.insurance_inferred", lambda i: F.struct(
        i["seat"].try_cast("int").alias("seat"), i["player_name"].alias("player_name"),
        *[i[n].try_cast("double").alias(n) for n in ("stack_initial", "stack_final", "gain", "pot", "premium_inferred")],
        i["classification"].alias("classification")))
    return rows.select(
        "id", "table_name", "started_at", "ended_at", "pot_size_final",
        F.from_json("hero_cards", "array<string>").alias("hero_cards"),
        F.from_json("community_cards", "map<string,array<string>>").alias("community_cards"),
        F.from_json("seats", "map<string,string>").alias("seats"),
        numeric_map(F.col("r.player_stacks_initial")).alias("stacks_initial"),
        numeric_map(F.col("r.player_stacks_final")).alias("stacks_final"),
        F.col("r.showdown_cards").alias("showdown_cards"),
        _number("r.button_seat_index", "int").alias("button_seat_index"), _number("r.num_seats", "int").alias("num_seats"),
        _number("r.blind_level.sb").alias("blind_sb"), _number("r.blind_level.bb").alias("blind_bb"),
        F.col("r.winner_player_name").alias("winner_player_name"), insurance.alias("insurance_inferred"))


def parse_action_events(raw: DataFrame) -> DataFrame:
    """Typed events; columns the engine does not know stay as they are."""
    rows = raw.withColumn("r", F.from_json("raw_data", _EVENT_RAW))
    typed = F.struct(
        F.col("r.action_text").alias("action_text"),
        *[_number(f"r.{n}").alias(n) for n in _EVENT_NUMBERS],
        *[F.col(f"r.{n}").alias(n) for n in _EVENT_TEXTS[1:]],
        _number("r.decision_time_ms", "bigint").alias("decision_time_ms"),
        _number("r.used_timebank", "boolean").alias("used_timebank"), _number("r.synthetic", "boolean").alias("synthetic"))
    return rows.select(*[c for c in raw.columns if c != "raw_data"], typed.alias("raw"))


def valid_action(c: Column) -> Column:
    return c.isin(S.ACTION_TYPES)
