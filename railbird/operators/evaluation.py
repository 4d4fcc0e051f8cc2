"""Sampling for review, agreement, drift and classifier reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from railbird.functions.ordered import numbered
from railbird.functions.semantics import chain, count_if, pct, round_half_away

POOL_SIZES = {"screenshot": 30, "override": 5, "clean": 5}


# Rows ranked together in one task.
SLICE_ROWS = 50_000


def seeded(key: Column | str, seed: int) -> Column:
    """A fixed shuffle: rows ordered by this are in random but repeatable order."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string") if isinstance(key, str) else key))


def _first(df: DataFrame, keys: list[str], order: Column, n: Column | int, name: str = "_rn", most: int | None = None) -> DataFrame:
    """The first n rows per key, n at most ``most``; that limit is applied before the shuffle too (Spark does so with a plain number only)."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= (n if most is None else most)).where(F.col(name) <= n).drop(name)


def review_sample(
    events: DataFrame, *, sizes: dict[str, int] | None = None, pool_limit: int | None = None, seed: int = 0,
    threshold: float = 0.7,
) -> DataFrame:
    """Events to label by hand: a few of each pool at random, of the whole pool or of its first ``pool_limit``."""
    sizes = {**POOL_SIZES, **(sizes or {})}
    low = F.col("confidence_score") < threshold
    pool = chain((low, "screenshot"), (F.col("raw.override_reason").isNotNull(), "override"),
                 (F.col("confidence_score") >= threshold, "clean"))
    rows = events.select(
        F.col("id").alias("event_id"), "hand_id", "player_name", "position", "street", "action_type", "amount",
        "confidence_score", F.col("raw.override_reason").alias("override_reason"), "timestamp", pool.alias("pool"))
    pools = rows.where(F.col("pool").isNotNull())
    if pool_limit is not None:
        pools = _first(pools, ["pool"], F.col("event_id"), pool_limit)
    quota = chain(*[(F.col("pool") == k, n) for k, n in sizes.items()])
    return _first(pools, ["pool"], seeded("event_id", seed), quota, most=max(sizes.values()))


def _judged(labels: DataFrame) -> DataFrame:
    judged = labels.where(~F.col("user_action").isin("skip", "quit"))
    return judged.withColumn("agree", F.col("ai_action") == F.col("user_action"))


def agreement_report(labels: DataFrame) -> DataFrame:
    """Agreement of predicted and reviewed actions: overall, by evidence, by action.

    ``labels``: ai_action, user_action, has_screenshot.  Counted at the finest
    grain before the grouping sets expand the counts.
    """
    fine = _judged(labels).groupBy("ai_action", "has_screenshot").agg(
        F.count("*").alias("n"), count_if(F.col("agree")).alias("agreed"))
    g = fine.groupingSets(
        [[], [F.col("has_screenshot")], [F.col("ai_action")]], F.col("has_screenshot"), F.col("ai_action"),
    ).agg(F.sum("agreed").alias("agreed"), F.sum("n").alias("n"),
          F.grouping("has_screenshot").alias("g1"), F.grouping("ai_action").alias("g2"))
    return g.select(
        chain((F.col("g1") == 0, "evidence"), (F.col("g2") == 0, "action"), default="overall").alias("section"),
        chain((F.col("g1") == 0, F.col("has_screenshot").cast("string")), (F.col("g2") == 0, F.col("ai_action")),
              default=F.lit("all")).alias("value"),
        "agreed", "n", pct(F.col("agreed"), F.col("n")).alias("agree_pct"))


def top_disagreements(labels: DataFrame, *, limit: int = 5) -> DataFrame:
    return (
        _judged(labels).where(~F.col("agree")).groupBy("ai_action", "user_action")
        .agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ai_action", "user_action").limit(limit))


# ------------------------------------------------------------ distribution drift

CHANNELS = ["r", "g", "b"]
BINS, TOP, EPS = 32, 256.0, 1e-10


def _verdict(chi: Column, dist: Column) -> Column:
    return chain(((chi < 0.05) & (dist < 5), "match"), ((chi < 0.20) & (dist < 20), "moderate"), default="significant")


def drift_report(
    samples: DataFrame, *, groups: tuple[str, str], keys: list[str] | None = None, max_per_group: int | None = None,
) -> DataFrame:
    """Colour distributions of two groups: means, spreads, brightness histogram, verdict.

    ``samples``: sample_id, grp, r, g, b and the ``keys`` to compare within.
    Each group becomes one row of moments and 32 bin counts in a single
    aggregation; the comparison then works inside a row.  ``max_per_group``
    keeps the first samples by id, as the compared tool does.
    """
    given, keys = keys or [], keys or ["_all"]
    one, two = groups
    rows = samples.where(F.col("grp").isin(one, two))
    if not given:
        rows = rows.withColumn("_all", F.lit(1))
    if max_per_group is not None:
        rows = _first(rows, [*keys, "grp"], F.col("sample_id"), max_per_group)
    lum = F.col("r") * 0.299 + F.col("g") * 0.587 + F.col("b") * 0.114
    slot = F.least(F.floor(lum / (TOP / BINS)), F.lit(BINS - 1))
    rows = rows.withColumn("_bin", F.when(lum.between(0, TOP), slot))
    stats = rows.groupBy(*keys, "grp").agg(
        F.count("*").alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in CHANNELS],
        *[F.stddev_pop(c).alias(f"std_{c}") for c in CHANNELS],
        F.array(*[count_if(F.col("_bin") == i).cast("double") for i in range(BINS)]).alias("hist"))
    total = F.aggregate("hist", F.lit(0.0), lambda a, x: a + x)
    stats = stats.withColumn("hist", F.transform("hist", lambda x: F.try_divide(x, total)))
    side = lambda name, p: stats.where(F.col("grp") == name).drop("grp").select(
        *keys, *[F.col(c).alias(f"{p}_{c}") for c in stats.columns if c not in [*keys, "grp"]])
    a, b = side(one, "a"), side(two, "b")
    both = a.join(b, keys)
    chi = F.aggregate(
        F.zip_with("a_hist", "b_hist", lambda x, y: (x - y) * (x - y) / (x + y + 2 * EPS)), F.lit(0.0), lambda s, x: s + x)
    sq = lambda c: F.pow(F.col(f"a_mean_{c}") - F.col(f"b_mean_{c}"), F.lit(2.0))
    dist = F.sqrt(sq("r") + sq("g") + sq("b"))
    gap = lambda kind, c: round_half_away(F.col(f"b_{kind}_{c}") - F.col(f"a_{kind}_{c}"), 4).alias(f"{kind}_gap_{c}")
    return both.withColumn("_chi", chi).withColumn("_dist", dist).select(
        *given, "a_n", "b_n", *[gap(k, c) for k in ("mean", "std") for c in CHANNELS],
        round_half_away("_chi", 6).alias("chi_square"), round_half_away("_dist", 4).alias("mean_distance"),
        _verdict(F.col("_chi"), F.col("_dist")).alias("verdict"))


# ------------------------------------------------------------ classifiers

CARD_DOMAINS = ["community", "showdown"]


def classifier_report(predictions: DataFrame) -> DataFrame:
    """Rank, suit and whole-card accuracy of card samples per domain."""
    rank, suit = F.col("rank") == F.col("pred_rank"), F.col("suit") == F.col("pred_suit")
    cards = predictions.where(F.col("is_card") & F.col("domain").isin(CARD_DOMAINS))
    counts = cards.groupBy("domain").agg(
        F.count("*").alias("n"), count_if(rank).alias("rank_ok"), count_if(suit).alias("suit_ok"),
        count_if(rank & suit).alias("both_ok"), count_if(F.col("is_rare")).alias("rare_n"),
        count_if(F.col("is_rare") & rank & suit).alias("rare_ok"))
    part = lambda a, n: round_half_away(F.try_divide(F.col(a), F.col(n)), 6)
    return counts.select(
        "domain", "n", "rare_n", part("rank_ok", "n").alias("rank_acc"), part("suit_ok", "n").alias("suit_acc"),
        part("both_ok", "n").alias("both_acc"), part("rare_ok", "rare_n").alias("rare_acc"))


def classifier_score(predictions: DataFrame) -> DataFrame:
    """Recall of the card/no-card decision and the combined score of both domains."""
    both = (F.col("rank") == F.col("pred_rank")) & (F.col("suit") == F.col("pred_suit"))
    of = lambda d: F.col("is_card") & (F.col("domain") == d)
    acc = lambda d: F.try_divide(count_if(of(d) & both), count_if(of(d)))
    m = predictions.agg(
        F.try_divide(count_if(~F.col("is_card") & ~F.col("pred_is_card")), count_if(F.col("domain") == "noncard"))
        .alias("noncard_recall"),
        F.try_divide(count_if(F.col("is_card") & F.col("pred_is_card")), count_if(F.col("is_card"))).alias("card_recall"),
        acc("community").alias("c"), acc("showdown").alias("s"))
    c, s = F.coalesce("c", F.lit(0.0)), F.col("s")
    score = chain((s.isNull(), c), ((c <= 0) | (s <= 0), F.lit(0.0)), default=F.try_divide(2 * c * s, c + s))
    return m.select(
        round_half_away("noncard_recall", 6).alias("noncard_recall"), round_half_away("card_recall", 6).alias("card_recall"),
        round_half_away(score, 6).alias("score"))


def recognition_summary(predictions: DataFrame) -> DataFrame:
    """Correct, wrong and unrecognised labels (``expected``, ``recognised``)."""
    got, want = F.col("recognised"), F.col("expected")
    return predictions.agg(
        F.count("*").alias("total"), count_if(got == want).alias("correct"), count_if(got != want).alias("wrong"),
        count_if(got.isNull()).alias("unrecognised"), pct(count_if(got == want), F.count("*")).alias("accuracy_pct"))


def holdout_split(
    samples: DataFrame, *, fraction: float = 0.2, min_domain: int = 5, seed: int = 0, order: Column | None = None,
) -> DataFrame:
    """Adds ``part``: train or holdout, drawn per domain (``sample_id, domain, train_only``).

    Small domains keep everything for training, larger ones hold out at least
    one.  There are few domains, so ranks are counted in slices of the hash, as many
    as give ``SLICE_ROWS`` rows each, and carried over them.
    """
    hashed = samples.withColumn("_h", seeded("sample_id", seed) if order is None else order)
    open_ = hashed.where(~F.col("train_only"))
    sizes = open_.groupBy("domain").agg(F.count("*").alias("_n"))
    share = F.conv(F.substring("_h", 1, 8), 16, 10).cast("double") / 4294967296.0
    sized = open_.join(sizes.withColumnRenamed("_n", "_all"), "domain")
    slices = F.floor(share * F.ceil(F.col("_all") / SLICE_ROWS)).cast("bigint")
    ranked = numbered(sized, ["domain"], ["_h", "sample_id"], "_rn", split=slices).drop("_all")
    quota = F.when(F.col("_n") >= min_domain, F.greatest(F.lit(1), F.floor(F.col("_n") * fraction))).otherwise(0)
    drawn = ranked.join(sizes, "domain").select(
        *samples.columns, F.when(F.col("_rn") <= quota, "holdout").otherwise("train").alias("part"))
    kept = samples.where(F.col("train_only")).withColumn("part", F.lit("train"))
    return drawn.unionByName(kept)
