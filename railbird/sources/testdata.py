"""Typed engine tables derived from the given parquet tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railbird.functions.semantics import numeric_map
from railbird.sources import derivations

TABLES = ["orders", "lineitem", "events"]


def run_derivation(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Runs a derivation with its table names bound to the files, without views.

    ``EACH_OF_n`` stands for n copies of every row, numbered s.i from 0.
    """
    text = re.sub(r"\bEACH_OF_(\d+)\b", lambda m: f"lateral view explode(sequence(0, {int(m[1]) - 1})) s as i", text)
    for name in TABLES:
        text = re.sub(rf"\b(from|join) {name}\b", rf"\1 parquet.`{sf_dir}/{name}.parquet`", text)
    return spark.sql(text)


def _text_map(c: str) -> F.Column:
    return F.from_json(F.col(c), "map<string,string>")


def hands(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = run_derivation(spark, sf_dir, derivations.HANDS)
    insurance = """array<struct<seat:int,player_name:string,stack_initial:double,stack_final:double,
                   gain:double,pot:double,premium_inferred:double,classification:string>>"""
    return raw.select(
        "id", "table_name",
        F.col("started_at").cast("timestamp").alias("started_at"),
        F.col("ended_at").cast("timestamp").alias("ended_at"),
        "pot_size_final",
        F.from_json("hero_cards_json", "array<string>").alias("hero_cards"),
        F.when(
            F.col("turn_cards_json").isNotNull(),
            F.create_map(F.lit("turn"), F.from_json("turn_cards_json", "array<string>")),
        ).alias("community_cards"),
        _text_map("seats_json").alias("seats"),
        numeric_map(_text_map("stacks_initial_json")).alias("stacks_initial"),
        numeric_map(_text_map("stacks_final_json")).alias("stacks_final"),
        F.from_json("showdown_json", "map<string,array<string>>").alias("showdown_cards"),
        "button_seat_index",
        F.lit(None).cast("int").alias("num_seats"),
        "blind_sb", "blind_bb", "winner_player_name",
        F.from_json("insurance_json", insurance).alias("insurance_inferred"),
    )


def action_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = run_derivation(spark, sf_dir, derivations.ACTION_EVENTS)
    none = F.lit(None)
    ts = F.col("timestamp").cast("timestamp")
    return raw.select(
        F.concat_ws("-", F.col("hand_id").cast("string"), F.col("sequence_number").cast("string")).alias("id"),
        "hand_id", "player_name", "position", "street", "action_type", "sequence_number",
        "amount", "confidence_score", ts.alias("timestamp"), ts.alias("created_at"),
        F.struct(
            none.cast("string").alias("action_text"),
            "stack_before", "stack_after", "stack_delta",
            none.cast("double").alias("pot_before"),
            F.col("pot_after").cast("double").alias("pot_after"),
            none.cast("double").alias("pot_delta"),
            "text_derived_action",
            none.cast("string").alias("stack_derived_action"),
            "override_reason", "decision_time_ms", "used_timebank",
            F.lit(False).alias("synthetic"),
        ).alias("raw"),
    )


def diagnostic_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = run_derivation(spark, sf_dir, derivations.DIAGNOSTIC_EVENTS)
    return raw.withColumn("occurred_at", F.col("occurred_at").cast("timestamp"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = run_derivation(spark, sf_dir, derivations.OBSERVATIONS)
    return raw.select(
        "table_id", "tick", F.col("ts").cast("timestamp").alias("ts"), "seat", "kind", "text", "value",
    )
