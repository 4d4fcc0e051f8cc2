"""The parallel prefix against the sequential fold, on rows made to sit on the rules' edges."""

import random

import pytest
from pyspark.sql import functions as F

from railbird.functions import steps
from railbird.functions.prefix import Digest
from railbird.operators import derive as d


def states_after(step, rows):
    names = [p.split()[0] for p in step.state.split(", ")]
    state = dict.fromkeys(names)
    trail = [dict(state)]
    for r in rows:
        step(state, dict(r))
        trail.append(dict(state))
    return trail


def plain(state):
    """Of a board only whether it has cards counts, and an empty seat is one that was never seen."""
    return {f: bool(v and v > 0) if f == "board" else None if v == "empty" else v for f, v in state.items()}


def readings(rnd, n):
    """Table readings: pots that fall and rise, boards that come and go, hero hashes that flicker and change."""
    rows, hero = [], rnd.getrandbits(63)
    for i in range(n):
        kind = rnd.choice(["pot", "pot", "pot", "community", "hero", "action"])
        value = text = phash = phash2 = None
        if kind == "pot":
            value = rnd.choice([None, 3.0, 5.0, 9.5, 10.0, 10.0, 20.0, 45.0, 50.0, 90.0, 100.0])
            text = rnd.choice([steps.POT_LABEL, ""])
        elif kind == "community":
            value = rnd.choice([None, 0.0, 0.0, 3.0, 4.0, 0.4])
        elif kind == "hero":
            if rnd.random() < 0.2:
                hero = rnd.getrandbits(63)
            phash = rnd.choice([None, hero, hero ^ 7, hero ^ 0xFFF, hero])
            phash2 = rnd.choice([None, None, hero ^ 0xFFFF0, 5])
        rows.append({"kind": kind, "value": value, "text": text, "phash": phash, "phash2": phash2, "target": None})
    return rows


def numbers(rnd, n):
    pool = [None, 0.0, -2.0, 1.0, 9.0, 9.0, 9.1, 81.0, 82.0, 100.0, 0.1, 700.0, 11.2, 11.1]
    return [{"kind": "x", "value": rnd.choice(pool)} for _ in range(n)]


def targets(rnd, n):
    return [{"target": rnd.choice(["empty", "sitting_out", "active", "folded", "all_in", "leaving", "new_hand", "odd"])} for _ in range(n)]


def names(rnd, n):
    pool = [None, 3, 4, 3 ^ 0xFFFF, 1 << 40, (1 << 40) ^ 0xFFFFF]
    return [{"readable": rnd.choice([None, None, "ann", "bob", "cy"]), "phash": rnd.choice(pool)} for _ in range(n)]


def times(rnd, n):
    at = 0
    return [{"at": (at := at + rnd.choice([0, 1, 1, 2, 3, 9]) * 1_000_000)} for _ in range(n)]


RULES = {"debounce": (steps.Debounce(5.0), times), "name": (steps.SeatName(), names), "segment": (steps.Segment(), readings), "any pot": (steps.Segment(label=None), readings), "stack": (steps.StackJump(), numbers),
         "pot": (steps.PotMonotone(), numbers), "seat": (steps.SeatLifecycle(), targets)}


@pytest.mark.parametrize("name", RULES)
def test_maps_give_the_states_of_the_fold(name):
    import json

    step, make = RULES[name]
    for seed in range(150):
        rnd = random.Random(seed)
        rows = make(rnd, rnd.randrange(1, 60))
        cuts = sorted({0, len(rows), *(rnd.randrange(len(rows)) for _ in range(rnd.randrange(8)))})
        trail = states_after(step, rows)
        known = [{} for _ in cuts]
        for mapper in step.maps(["kind", "value", "text", "phash", "phash2", "target", "readable"]):
            state = dict.fromkeys(mapper.fields)
            for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                assert plain(state) == plain({f: trail[a][f] for f in mapper.fields}), (seed, n)
                total = mapper.begin(dict(known[n]))
                for row in rows[a:b]:
                    mapper.feed(total, row)
                known[n].update(state)
                state = mapper.apply(json.loads(json.dumps(mapper.finish(total))), state)


def test_digests_stay_small():
    step, rnd = steps.StackJump(), random.Random(1)
    (mapper,) = step.maps([])
    total = mapper.begin({})
    for _ in range(5000):
        mapper.feed(total, {"value": rnd.uniform(100, 700)})
    assert isinstance(mapper, Digest) and len(mapper.finish(total)[0]) < 40 and len(total["runs"]) == 1


def feed(spark, rows, keys=3):
    data = [(f"T{i % keys}", i // 3, i, r["kind"], r["value"], r["text"], r["phash"], r["phash2"], i % 2) for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, "table_id string, second long, tick long, kind string, value double, text string, phash long, phash2 long, seat int")
    return df.withColumn("ts", F.timestamp_seconds(F.col("second") * 40)).drop("second")


def same(a, b):
    assert a.columns == b.columns
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


@pytest.mark.parametrize("keys", [1, 3])
def test_jobs_equal_the_sequential_fold(spark, keys):
    obs = feed(spark, readings(random.Random(keys), 600), keys).repartition(4)
    order = ["ts", "tick", "kind"]
    for step in (steps.Segment(), steps.Segment(label=None)):
        same(d.apply_step(obs, ["table_id"], order, step, width="5 minutes"), d.apply_step(obs, ["table_id"], order, step))
    stacks = feed(spark, [{**r, "text": None, "phash": None, "phash2": None} for r in numbers(random.Random(9), 500)], keys)
    for step in (steps.StackJump(), steps.PotMonotone()):
        same(d.apply_step(stacks, ["table_id", "seat"], order, step, width="3 minutes"), d.apply_step(stacks, ["table_id", "seat"], order, step))
    missing = stacks.withColumn("table_id", F.when(F.col("tick") % 2 == 0, F.col("table_id")))
    same(d.apply_step(missing, ["table_id"], order, steps.StackJump(), width="3 minutes"), d.apply_step(missing, ["table_id"], order, steps.StackJump()))
    clock = obs.withColumn("kind", F.when(F.col("tick") % 5 == 0, "action").otherwise("timer"))
    same(d.decision_times(clock, ["table_id"], width="3 minutes"), d.decision_times(clock, ["table_id"], width=None))
    assert d.apply_step(obs.limit(0), ["table_id"], order, steps.Segment(), width="5 minutes").count() == 0


def test_one_table_is_folded_by_many_tasks(spark):
    obs = feed(spark, readings(random.Random(4), 3000), 1)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = d.apply_step(obs, ["table_id"], ["ts", "tick"], steps.Segment(), width="5 minutes")
        per_task = out.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert len(per_task) == 8 and max(r["count"] for r in per_task) < 1200


def test_showdown_in_two_parts_equals_the_rule(spark):
    rnd, cards = random.Random(2), ["2c", "3d", "9h", "Ks", "Ad", None]
    rows = [(f"T{rnd.randrange(2)}", rnd.choice([None, 1, 2]) if i % 50 == 0 else i // 60, i, i // 3, rnd.randrange(4), rnd.choice(["2c,3d,4h,5s,9c", "2c,3d", None]),
             rnd.choice([None, 1, 3, 3, 3]), i % 9 == 0, rnd.choice([None, 3, 9, 9, 9]), rnd.choice([None, 100.0, 150.0, 150.0]), rnd.choice([40.0, 60.0, 60.0]),
             rnd.choice(cards), rnd.choice([None, 0.8, 0.95]), rnd.choice(cards), 0.99) for i in range(900)]
    df = spark.createDataFrame(rows, "table_id string, hand_id long, tick long, s long, seat int, board string, live_seats int, is_hero boolean, "
                               "hash_distance int, brightness double, texture double, card1 string, conf1 double, card2 string, conf2 double")
    df = df.withColumn("ts", F.timestamp_micros(F.col("s") * 400_000)).drop("s")
    want = d.apply_step(df, ["table_id"], ["ts", "tick", "seat", "card1", "card2"], steps.ShowdownGate())
    got = d.showdown_decisions(df, width="10 seconds")
    same(got.select(want.columns), want)
    assert got.where("accepted").count() > 0 and got.select("reason").distinct().count() > 9
