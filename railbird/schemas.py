"""Typed tables of the engine and the small fixed dimensions it joins with."""

from __future__ import annotations

HANDS = """
  id string, table_name string, started_at timestamp, ended_at timestamp,
  pot_size_final double, hero_cards array<string>,
  community_cards map<string,array<string>>, seats map<string,string>,
  stacks_initial map<string,double>, stacks_final map<string,double>,
  showdown_cards map<string,array<string>>, button_seat_index int, num_seats int,
  blind_sb double, blind_bb double, winner_player_name string,
  insurance_inferred array<struct<seat:int,player_name:string,stack_initial:double,
    stack_final:double,gain:double,pot:double,premium_inferred:double,classification:string>>
"""

RAW = """struct<action_text:string,stack_before:double,stack_after:double,
  stack_delta:double,pot_before:double,pot_after:double,pot_delta:double,
  text_derived_action:string,stack_derived_action:string,override_reason:string,
  decision_time_ms:bigint,used_timebank:boolean,synthetic:boolean>"""

ACTION_EVENTS = f"""
  id string, hand_id string, player_name string, position string, street string,
  action_type string, sequence_number int, amount double, confidence_score double,
  timestamp timestamp, created_at timestamp, raw {RAW}
"""

DIAGNOSTICS = "hand_id string, tag string, level string, payload string, occurred_at timestamp"

OBSERVATIONS = """
  table_id string, tick bigint, ts timestamp, seat int, kind string,
  text string, value double, phash bigint, phash2 bigint, conf double
"""

PREDICTIONS = """
  sample_id string, domain string, is_card boolean, rank string, suit string,
  pred_rank string, pred_suit string, pred_is_card boolean, is_rare boolean,
  train_only boolean
"""

# ---------------------------------------------------------------- fixed values
ACTION_TYPES = ["post_sb", "post_bb", "post_ante", "fold", "check", "call", "bet", "raise", "all_in"]
POSTS = ["post_sb", "post_bb"]
STREETS = ["preflop", "flop", "turn", "river", "showdown"]
BETTING_STREETS = STREETS[:4]

# Acting order after the flop, 1-based.
POSTFLOP_ORDER = ["SB", "BB", "UTG", "UTG+1", "MP", "MP+1", "HJ", "CO", "BTN"]

# Clockwise from the button, as the showdown audit counts them (nine seats).
AUDIT_OFFSETS = ["BTN", "SB", "BB", "UTG", "UTG+1", "MP", "MP+1", "HJ", "CO"]

# Clockwise from the button, as the seat mapper counts them, by table size.
SEAT_OFFSETS = {
    6: ["BTN", "SB", "BB", "UTG", "MP", "CO"],
    8: ["BTN", "SB", "BB", "UTG", "UTG+1", "MP", "HJ", "CO"],
    9: ["BTN", "SB", "BB", "UTG", "UTG+1", "MP", "MP+1", "CO", "HJ"],
}

# Row order of the profile page.
PROFILE_POSITIONS = ["UTG", "UTG+1", "MP", "HJ", "CO", "BTN", "SB", "BB"]

# Buy-in presets that count as a rebuy, per rule.
CONTINUITY_PRESETS = [100, 200, 500, 1000, 2000, 5000, 10000]
WINNINGS_PRESETS = [100, 200, 300, 500, 800, 1000, 1500, 2000, 3000, 5000, 10000]
REBUY_PRESETS = [50, 100, 150, 200, 300, 500, 800, 1000, 1500, 2000, 3000, 5000,
                 8000, 10000, 20000, 50000, 100000]

SEAT_TRANSITIONS = {
    "empty": ["sitting_out", "active"],
    "sitting_out": ["active", "leaving", "empty"],
    "active": ["folded", "all_in", "sitting_out", "leaving"],
    "folded": ["active", "sitting_out", "leaving", "empty"],
    "all_in": ["active", "sitting_out", "leaving", "empty"],
    "leaving": ["empty"],
}
SKIPPABLE_STATES = ["sitting_out", "folded", "all_in", "leaving"]

HAND_PHASES = ["between_hands", "dealing_cards", "blind_posting", "preflop_acting",
               "dealing_flop", "flop_acting", "dealing_turn", "turn_acting",
               "dealing_river", "river_acting", "showdown", "settling"]
ACTING_PHASES = ["preflop_acting", "flop_acting", "turn_acting", "river_acting"]
DEALING_PHASES = ["dealing_cards", "dealing_flop", "dealing_turn", "dealing_river"]
PHASE_STREET = {
    "blind_posting": "preflop", "preflop_acting": "preflop",
    "dealing_flop": "flop", "flop_acting": "flop",
    "dealing_turn": "turn", "turn_acting": "turn",
    "dealing_river": "river", "river_acting": "river",
    "showdown": "showdown",
}
