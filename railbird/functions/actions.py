"""What a table reading means, as column expressions.

None of these keeps state, so they run unchanged on batches and on streams.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from railbird import schemas as S
from railbird.functions.semantics import any_of, chain, col

# ---------------------------------------------------------------- fixed values
# Words per action, in the order they are tried.
ALL_IN_WORDS = ["ALL-IN", "ALLIN", "ALL IN", "全下", "全押", "全压"]
ACTION_WORDS = [
    ("raise", ["RAISE", "加注"]),
    ("bet", ["BET", "下注"]),
    ("call", ["CALL", "跟注"]),
    ("check", ["CHECK", "过牌", "让牌", "看牌"]),
    ("fold", ["FOLD", "弃牌", "盖牌"]),
    ("post_sb", ["SMALL BLIND", "小盲"]),
    ("post_bb", ["BIG BLIND", "大盲"]),
]
ANTE_WORDS = ["ANTE", "前注"]
NUMBER = r"(\d+\.?\d*)"
TOLERANCE = 2.0          # chips a reading may be off
NEAR_ZERO_STACK = 5.0    # a stack this small counts as all in
OVERRIDE_CONFIDENCE = 0.7
CHIP_WORDS_LOW = ["all in", "all-in", "allin", "全押"]


def _word(text: Column, word: str) -> Column:
    return text.rlike(rf"(?U)\b{word}\b")


# One class of white space for both engines: ASCII and the Unicode spaces, the ideographic one included.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def first_number(text: Column | str) -> Column:
    """The first number in a reading; NULL when there is none."""
    return F.nullif(F.regexp_extract(col(text), NUMBER, 1), F.lit("")).try_cast("double")


def clean(text: Column | str) -> Column:
    return F.regexp_replace(col(text), f"^{SPACE}+|{SPACE}+$", "")


def action_of(text: Column | str) -> Column:
    """Action named by a reading, NULL when it names none.  All-in goes before
    call because CALL contains ALL."""
    t = F.upper(clean(text))
    has = lambda words: any_of([t.contains(w) for w in words])
    return chain(
        (has(ALL_IN_WORDS), "all_in"),
        (_word(t, "ALL") & ~t.contains("CALL"), "all_in"),
        *[(has(words), action) for action, words in ACTION_WORDS],
        (_word(t, "SB"), "post_sb"),
        (_word(t, "BB"), "post_bb"),
        (has(ANTE_WORDS), "post_ante"),
    )


def parse_action(text: Column | str) -> Column:
    """struct(action_type, amount); NULL when the text names no action."""
    action = action_of(text)
    amount = F.when(~action.isin("check", "fold"), first_number(F.upper(clean(text))))
    return F.when(action.isNotNull(), F.struct(action.alias("action_type"), amount.alias("amount")))


def infer_action(delta: Column, to_call: Column, first_bet: Column, stack_after: Column) -> Column:
    """Action that a change of stack amounts to; NULL when the change is unknown."""
    d = F.abs(delta)
    return F.when(delta.isNotNull(), chain(
        ((d <= TOLERANCE) & (to_call > TOLERANCE), "fold"),
        (d <= TOLERANCE, "check"),
        (stack_after <= NEAR_ZERO_STACK, "all_in"),
        ((to_call > 0) & (F.abs(d - to_call) <= TOLERANCE), "call"),
        (first_bet & (to_call <= TOLERANCE), "bet"),
        default="raise",
    ))


def confidence(action: Column, stack_delta: Column, pot_delta: Column) -> Column:
    """How well the chips support the action, 0.3 to 1.0."""
    passive = action.isin("fold", "check")
    still = F.abs(stack_delta) <= TOLERANCE
    diff = pot_delta - stack_delta
    return chain(
        (passive & stack_delta.isNull(), 0.85),
        (passive & still, 1.0),
        (passive, 0.3),
        (stack_delta.isNull() & pot_delta.isNull(), 0.5),
        (stack_delta.isNull() | pot_delta.isNull(), 0.7),
        (still & (F.abs(pot_delta) <= TOLERANCE), 0.3),
        (F.abs(diff) <= TOLERANCE, 1.0),
        (diff > 0, 0.9),
        default=0.7,
    )


def overrides(text_action: Column, stack_action: Column, stack_delta: Column) -> Column:
    """Chips overrule the text only if the text says no chips moved and they did,
    or if the stack says all-in."""
    moved = F.coalesce(F.abs(stack_delta) > TOLERANCE, F.lit(False))
    differs = F.coalesce(stack_action != text_action, F.lit(False))
    zero_text = text_action.isin("fold", "check") & moved
    allin = (text_action != "all_in") & (stack_action == "all_in")
    return differs & (zero_text | allin)


def arbitrate(text_action: Column, stack_action: Column, stack_delta: Column, pot_delta: Column) -> Column:
    """struct(action_type, override_reason, confidence_score, text_preserved)."""
    wins = overrides(text_action, stack_action, stack_delta)
    final = F.when(wins, stack_action).otherwise(text_action)
    reason = F.when(wins, F.concat(F.lit("stack-derived "), stack_action, F.lit(" overrode text-derived "), text_action))
    score = F.when(wins, F.lit(OVERRIDE_CONFIDENCE)).otherwise(confidence(final, stack_delta, pot_delta))
    kept = ~wins & F.coalesce(stack_action != text_action, F.lit(False))
    return F.struct(final.alias("action_type"), reason.alias("override_reason"),
                    score.alias("confidence_score"), kept.alias("text_preserved"))


def settled_stack(text_action: Column, stack_after: Column) -> Column:
    """An all-in whose stack could not be read left nothing behind."""
    return F.when(stack_after.isNull() & (text_action == "all_in"), F.lit(0.0)).otherwise(stack_after)


def street_of_count(n: Column) -> Column:
    """Street of a board size; one or two cards are a deal in progress and say nothing."""
    return chain((n == 0, "preflop"), (n == 3, "flop"), (n == 4, "turn"), (n >= 5, "river"))


def board_texture(cards: Column) -> Column:
    """struct of texture flags, NULL for fewer than three cards."""
    ranks = F.transform(cards, lambda c: F.substring(c, 1, 1))
    suits = F.transform(cards, lambda c: F.substring(c, 2, 1))
    counts = lambda xs: F.transform(
        F.array_distinct(xs), lambda x: F.size(F.filter(xs, lambda y: y == x)))
    by_rank, by_suit = counts(ranks), counts(suits)
    at_least = lambda xs, k: F.exists(xs, lambda n: n >= k)
    monotone = at_least(by_suit, 3)
    double_suited = F.size(F.filter(by_suit, lambda n: n >= 2)) >= 2
    # The last of A K Q J T that is present, as the tagging rule has it.
    high = F.filter(F.array(*map(F.lit, "TJQKA")), lambda r: F.array_contains(ranks, r))
    return F.when(F.size(cards) >= 3, F.struct(
        at_least(by_rank, 2).alias("paired"), at_least(by_rank, 3).alias("trips"), monotone.alias("monotone"),
        double_suited.alias("double_suited"),
        F.coalesce(F.get(high, F.lit(0)), F.array_max(ranks)).alias("high_card"),
        (double_suited | (~monotone & at_least(by_suit, 2))).alias("wet"),
    ))


def seat_position(seat: Column, button: Column, num_seats: Column) -> Column:
    """Position of a seat at a 6, 8 or 9 seat table; other sizes give none."""
    tables = F.create_map(*[
        x for n, names in S.SEAT_OFFSETS.items() for x in (F.lit(n), F.array(*map(F.lit, names)))
    ])
    return F.when(num_seats > 0, F.get(F.try_element_at(tables, num_seats), F.pmod(seat - button, num_seats)))


def is_round_rebuy(amount: Column) -> Column:
    whole = (amount == F.floor(amount)) & (F.floor(amount) % 50 == 0)
    return (amount > 0) & (amount.isin([float(x) for x in S.REBUY_PRESETS]) | whole)


def insurance_class(gain: Column, final: Column, pot: Column) -> Column:
    """What an all-in player's stack after the hand says about insurance."""
    return chain(
        ((pot > 0) & (gain >= pot * 0.5), "won_main_pot"),
        (final < 1, "lost_no_insurance"),
        (is_round_rebuy(final), "rebuy"),
        ((pot > 0) & (gain > 0) & (gain < pot * 0.5), "insurance_payout"),
        default="unknown",
    )


def inferred_premium(gain: Column, pot: Column) -> Column:
    return F.greatest(F.lit(0.0), pot - pot * 0.05 - gain)


# ---------------------------------------------------------------- fingerprints

def bits_to_hash(bits: Column | str) -> Column:
    """64 characters of 0 and 1 to a bigint; NULL for any other text."""
    b = col(bits)
    half = lambda start: F.conv(F.substring(b, start, 32), 2, 10).cast("bigint")
    value = F.shiftleft(half(1), 32).bitwiseOR(half(33))
    return F.when(b.rlike("^[01]{64}$"), value)


def hash_to_bits(h: Column | str) -> Column:
    return F.lpad(F.bin(col(h)), 64, "0")


def hash_distance(a: Column | str, b: Column | str) -> Column:
    return F.bit_count(col(a).bitwiseXOR(col(b)))


FAR = 999


def bit_text_distance(a: Column, b: Column) -> Column:
    """Differing places of two bit texts, FAR when they cannot be compared."""
    places = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x != y, 1).otherwise(0))
    total = F.aggregate(places, F.lit(0), lambda s, x: s + x)
    usable = (F.length(a) > 0) & (F.length(a) == F.length(b))
    return F.when(usable, total).otherwise(F.lit(FAR))


def name_consensus(first: Column, second: Column) -> Column:
    """The longer of two readings of a name, the first on a tie."""
    a, b = F.coalesce(clean(first), F.lit("")), F.coalesce(clean(second), F.lit(""))
    return F.when(F.length(a) >= F.length(b), a).otherwise(b)


def player_name_of(first: Column, second: Column, avatar_bits: Column) -> Column:
    """Name for a seat: the readings' consensus unless it is empty or an action
    word; then a placeholder from the avatar hash, if there is one."""
    name = name_consensus(first, second)
    usable = (name != "") & action_of(name).isNull()
    temp = F.when(F.length(avatar_bits) > 0, F.concat(F.lit("TempUser_"), F.substring(avatar_bits, 1, 8)))
    return F.when(usable, name).otherwise(temp)
