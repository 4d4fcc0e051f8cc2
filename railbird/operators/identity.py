"""Who is who: drifting names, avatar fingerprints, renames."""

from __future__ import annotations

import math
from difflib import SequenceMatcher
from itertools import combinations

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from railbird.functions.actions import hash_distance, player_name_of
from railbird.functions.semantics import chain, is_placeholder, named_player_prefix
from railbird.session import written

CUTOFF = 0.75
MIN_LENGTH = 3
SHARED_TOKENS = 3


# ------------------------------------------------------------ similar names

def needed_overlap(la: int, lb: int, cutoff: float) -> int:
    """Characters two names must have in common to reach the cutoff."""
    return max(1, math.ceil(cutoff * (la + lb) / 2 - 1e-9))


def signatures(tokens: list[str], cutoff: float) -> list[int]:
    """Keys of which two similar names are sure to share one.

    A ratio of at least ``cutoff`` needs o common characters.  With each name's
    characters in one global order, the first (length - o + k) of both then
    have k in common, so every choice of k of them, for every length the other
    name can have, is a key.
    """
    la, out = len(tokens), set()
    for lb in range(math.ceil(la * cutoff / (2 - cutoff) - 1e-9), int(la * (2 - cutoff) / cutoff + 1e-9) + 1):
        o = needed_overlap(la, lb, cutoff)
        if lb < MIN_LENGTH or o > min(la, lb):
            continue
        k = min(SHARED_TOKENS, o)
        tag = f"{min(la, lb)},{max(la, lb)}|"
        for pick in combinations(tokens[: la - o + k], k):
            out.add(xxhash.xxh64_intdigest(tag + "\x1f".join(pick)) - (1 << 63))
    return sorted(out)


def _signature_udf(cutoff: float):
    @F.pandas_udf(T.ArrayType(T.LongType()))
    def udf(tokens: pd.Series) -> pd.Series:
        return tokens.map(lambda t: signatures(list(t), cutoff))

    return udf


def name_ratio(a: str, b: str) -> float:
    """Ratio of matching blocks of two names, ignoring case."""
    return SequenceMatcher(None, a.lower(), b.lower()).ratio()


def similarity(a: str, b: str) -> Column:
    @F.pandas_udf(T.DoubleType())
    def udf(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([name_ratio(p, q) for p, q in zip(x, y)], dtype="float64")

    return udf(a, b)


def players_by_hands(events: DataFrame, *, min_hands: int = 1) -> DataFrame:
    """Named players with their number of hands."""
    pairs = events.where(named_player_prefix()).select("player_name", "hand_id").distinct()
    return pairs.groupBy("player_name").agg(F.count("hand_id").alias("hands")).where(F.col("hands") >= min_hands)


def similar_names(players: DataFrame, *, cutoff: float = CUTOFF) -> DataFrame:
    """All pairs of names with a similarity of at least ``cutoff``, and no others.

    The player with more hands (then the smaller name) is compared first, since
    the ratio may depend on the order.  Rare characters lead the global order,
    so keys are as selective as the names allow.
    """
    names = players.where(F.length("player_name") >= MIN_LENGTH).select("player_name", "hands")
    chars = F.split(F.lower("player_name"), "")
    token = F.transform(chars, lambda c, i: F.concat(
        c, F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda x: x == c)).cast("string")))
    exploded = names.select("player_name", F.explode(token).alias("token"))
    rarity = exploded.groupBy("token").agg(F.count("*").alias("n"))
    ordered = exploded.join(rarity, "token").groupBy("player_name").agg(
        F.array_sort(F.collect_list(F.struct("n", "token")))["token"].alias("tokens"))
    keyed = ordered.join(names, "player_name").select(
        "player_name", "hands", F.explode(_signature_udf(cutoff)("tokens")).alias("sig"))
    a = keyed.select("sig", F.col("player_name").alias("a"), F.col("hands").alias("a_hands"))
    b = keyed.select("sig", F.col("player_name").alias("b"), F.col("hands").alias("b_hands"))
    first = (F.col("a_hands") > F.col("b_hands")) | ((F.col("a_hands") == F.col("b_hands")) & (F.col("a") < F.col("b")))
    candidates = a.join(b, "sig").where(first).select("a", "a_hands", "b", "b_hands").distinct()
    return candidates.withColumn("ratio", similarity("a", "b")).where(F.col("ratio") >= cutoff)


def alias_pairs(events: DataFrame, *, cutoff: float = CUTOFF, min_hands: int = 1) -> DataFrame:
    """Pairs of names that look like one player, with the one to keep."""
    pairs = similar_names(players_by_hands(events, min_hands=min_hands), cutoff=cutoff)
    keep_a = (F.col("a_hands") > F.col("b_hands")) | (
        (F.col("a_hands") == F.col("b_hands")) & (F.length("a") >= F.length("b")))
    pick = lambda x, y: F.when(keep_a, F.col(x)).otherwise(F.col(y))
    return pairs.select(
        pick("b", "a").alias("alias"), pick("a", "b").alias("canonical"), F.round("ratio", 3).alias("ratio"),
        pick("b_hands", "a_hands").alias("alias_hands"), pick("a_hands", "b_hands").alias("canonical_hands"),
    ).withColumn("recommend", F.concat("alias", F.lit(" → "), "canonical")).orderBy(F.desc("ratio"), "alias", "canonical")


def name_clusters(names: DataFrame, pairs: DataFrame) -> DataFrame:
    """Canonical name of every name: the longest (then smallest) one connected to it.

    ``pairs`` has columns a, b.  Each round takes the best label among the
    neighbours and then that label's own label, so long chains halve.  Labels
    are written to the checkpoint folder between rounds.
    """
    usable = names.where(~is_placeholder("player_name")).select("player_name").distinct()
    both = pairs.select("a", "b").where(~is_placeholder("a") & ~is_placeholder("b"))
    edges = written(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    rank = lambda c: F.struct((-F.length(c)).alias("shorter"), F.col(c).alias("name"))
    labels = written(usable.select("player_name", rank("player_name").alias("label")))
    while True:
        offered = edges.join(labels, edges["b"] == labels["player_name"]).select(
            F.col("a").alias("player_name"), "label")
        better = labels.union(offered).groupBy("player_name").agg(F.min("label").alias("label"))
        target = better.select(F.col("player_name").alias("via"), F.col("label").alias("label_of_label"))
        jumped = better.join(target, F.col("label.name") == F.col("via"), "left").select(
            "player_name", F.least(F.col("label"), F.coalesce("label_of_label", "label")).alias("label"))
        after = written(jumped)
        moved = after.join(labels.withColumnRenamed("label", "old"), "player_name").where(
            ~F.col("label").eqNullSafe(F.col("old")))
        labels = after
        if moved.isEmpty():
            break
    return labels.select("player_name", F.col("label.name").alias("canonical"))


def alias_clusters(events: DataFrame, *, cutoff: float = CUTOFF, min_hands: int = 1) -> DataFrame:
    players = players_by_hands(events, min_hands=min_hands)
    return name_clusters(players, similar_names(players, cutoff=cutoff))


def renamed(events: DataFrame, mapping: DataFrame) -> DataFrame:
    """Events under their canonical names.  ``mapping``: player_name, canonical, one row per name."""
    to = mapping.where(F.col("player_name") != F.col("canonical"))
    return events.join(to, "player_name", "left").select(*[
        F.coalesce("canonical", "player_name").alias("player_name") if c == "player_name" else F.col(c)
        for c in events.columns])


def rename_report(events: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rows each rename would change; counted per name before it is looked up."""
    counts = events.groupBy("player_name").agg(F.count("*").alias("rows_updated"))
    to = mapping.where(F.col("player_name") != F.col("canonical"))
    return counts.join(to, "player_name").select(
        F.col("player_name").alias("from_name"), F.col("canonical").alias("to_name"), "rows_updated")


# ------------------------------------------------------------ fingerprints

#: Registered hashes that share a key before that key counts as crowded.
CROWDED = 1_000
#: Bits to flip when a hash of crowded keys is looked up directly.
FLIPS = 2


def bit_order(hashes: DataFrame, c: str) -> list[int]:
    """The 64 bits, those that split the hashes most evenly first (65 numbers are all that leaves Spark)."""
    bits = [F.shiftrightunsigned(F.col(c), i).bitwiseAND(F.lit(1)) for i in range(64)]
    row = hashes.agg(F.count(c).alias("n"), *[F.sum(b).alias(f"b{i}") for i, b in enumerate(bits)]).first()
    return sorted(range(64), key=lambda i: (abs((row[f"b{i}"] or 0) * 2 - row["n"]), i))


def _band_keys(c: str, max_distance: int, order: list[int] | None = None) -> Column:
    """Keys of a 64-bit hash: all pairs of its bands, to which bits are dealt in ``order`` (none: neighbours make a band).

    Two hashes at most d bits apart agree in at least two of d + 2 bands, whatever bits a band has.
    Dealt this way, every band has its share of the bits that tell hashes apart.
    """
    n = max_distance + 2
    edges = [round(i * 64 / n) for i in range(n + 1)]
    bands = [] if order else [
        F.shiftrightunsigned(F.col(c), lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in zip(edges, edges[1:], strict=False)]
    for k in range(n if order else 0):
        value = F.lit(0).cast("bigint")
        for place, bit in enumerate(order[k::n]):
            value = value.bitwiseOR(F.shiftleft(F.shiftrightunsigned(F.col(c), bit).bitwiseAND(F.lit(1)), place))
        bands.append(value)
    return F.array(*[
        F.struct(F.lit(i * n + j).alias("pair"), x.alias("x"), y.alias("y"))
        for (i, x), (j, y) in combinations(enumerate(bands), 2)
    ])


def _flipped(c: str, flips: int) -> Column:
    """A hash and all hashes up to ``flips`` bits from it, with the distance."""
    masks = [sum(1 << b for b in bits) for n in range(flips + 1) for bits in combinations(range(64), n)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    near = F.transform(F.array(*[F.lit(m) for m in signed]), lambda m: F.struct(F.col(c).bitwiseXOR(m).alias("k"), F.bit_count(m).alias("distance")))
    return F.explode(near)


def nearest_fingerprints(
    readings: DataFrame, registry: DataFrame, *, max_distance: int = 6, crowded: int = CROWDED, flips: int = FLIPS,
) -> DataFrame:
    """Best registered player for every avatar hash, within ``max_distance`` bits.

    ``registry``: phash, name.  Only distinct hashes are matched, and readings
    take the answer back by hash, so repeated avatars cost nothing.  A best
    match that is only a placeholder counts as none.

    Where more than ``crowded`` registered hashes share a key (dark avatars, say), hashes with that key first look up all
    hashes within ``flips`` bits of them, one by one; among so many neighbours nearly all find theirs, and only
    the others are compared with the whole bucket.

    Only the first name of a registered hash can be its best, so a hash is matched once however many players share it.  Joins by
    key sort both sides: keys compress so well that Spark would take far too large a side for one to broadcast, by way of the driver.
    """
    wanted = readings.select(F.col("phash").alias("h")).where(F.col("phash").isNotNull()).distinct()
    known = registry.where(F.col("phash").isNotNull()).groupBy(F.col("phash").alias("k")).agg(F.min(F.struct("name"))["name"].alias("name"))
    # So few hashes crowd no key, however they lie.
    order = bit_order(known, "k") if known.limit(crowded + 1).count() > crowded else None
    left = wanted.select("h", F.explode(_band_keys("h", max_distance, order)).alias("key"))
    right = known.select("k", "name", F.explode(_band_keys("k", max_distance, order)).alias("key"))
    if order is None:
        near = _close(left, right, max_distance)
    else:
        hot = written(right.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > crowded).select("key"))
        pressed = left.join(hot, "key", "left_semi").select("h").distinct()
        looked = pressed.select("h", _flipped("h", min(flips, max_distance)).alias("f")).select("h", "f.*")
        found = written(looked.join(known.hint("merge"), "k").select("h", "name", "distance"))
        # A hash found within these flips has all its nearest there.
        left = left.join(found.select("h").distinct(), "h", "left_anti")
        near = _close(left, right, max_distance).unionByName(found)
    best = near.groupBy("h").agg(F.min(F.struct("distance", "name")).alias("best"))
    match = best.select("h", F.col("best.distance").alias("distance"), F.col("best.name").alias("matched_name"))
    out = readings.join(match, readings["phash"] == match["h"], "left").drop("h")
    real = ~is_placeholder("matched_name")
    return out.withColumns({
        "matched_name": F.when(real, F.col("matched_name")), "distance": F.when(real, F.col("distance"))})


def _close(left: DataFrame, right: DataFrame, max_distance: int) -> DataFrame:
    """h, name and distance of the pairs that share a key and are close."""
    distance = hash_distance("h", "k")
    return left.join(right.hint("merge"), "key").select("h", "name", distance.alias("distance")).where(F.col("distance") <= max_distance)


def seat_swaps(readings: DataFrame, seated: DataFrame, registry: DataFrame, *, max_distance: int = 12) -> DataFrame:
    """Seats whose avatar no longer fits the player cached for them.

    ``seated``: table_id, seat, name.  A player's first registered hash counts.
    """
    first = registry.groupBy("name").agg(F.min("phash").alias("cached_phash"))
    cached = seated.join(first, "name")
    far = hash_distance("phash", "cached_phash")
    return readings.where(F.col("phash").isNotNull()).join(cached, ["table_id", "seat"]).withColumn(
        "distance", far).where(F.col("distance") > max_distance)


def seat_names(readings: DataFrame) -> DataFrame:
    """Name of every seat from two readings of it (``first_text, second_text, avatar_bits``)."""
    name = player_name_of(F.col("first_text"), F.col("second_text"), F.col("avatar_bits"))
    return readings.withColumn("player_name", name).withColumn("name_source", chain(
        (F.col("player_name").isNull(), "none"), (is_placeholder("player_name"), "placeholder"), default="text"))


def placeholder_upgrades(readings: DataFrame) -> DataFrame:
    """Placeholders that later turned out to be a named player at the same seat.

    ``readings``: table_id, seat, at, player_name.  Gives a rename mapping: a
    placeholder maps to the first real name read after it.
    """
    from railbird.functions.ordered import running, time_split

    rows = readings.where(F.col("player_name").isNotNull()).withColumn("_back", -F.unix_micros("at"))
    real = F.when(~is_placeholder("player_name"), F.col("player_name"))
    nxt = running(rows, ["table_id", "seat"], ["_back"], {"next_name": ("last", real)}, split=-time_split("at"), inclusive=False)
    moves = nxt.where(is_placeholder("player_name") & F.col("next_name").isNotNull())
    return moves.groupBy("player_name").agg(F.min_by("next_name", "at").alias("canonical"))
