"""The whole flow as one stream, cut into batches, against the batch flow."""

import random
import time
from datetime import datetime, timedelta

from railbird.operators import observed
from railbird.streaming import flow, jobs

T0 = datetime(2024, 1, 1)
SCHEMA = "table_id string, tick bigint, ts timestamp, seat int, kind string, text string, value double, phash bigint"


def ticks(n):
    """Ticks of two tables; in each the hero, the board or the pot may be read, then some seats."""
    rnd, out = random.Random(5), []
    for i in range(n):
        at, table, rows = T0 + timedelta(seconds=i), f"T{rnd.randrange(2)}", []
        if rnd.random() < 0.1:
            rows.append((None, "hero", None, None, rnd.choice([0, (1 << 20) - 1])))
        if rnd.random() < 0.3:
            rows.append((None, "community", None, float(rnd.choice([0, 3, 4, 5])), None))
        if rnd.random() < 0.4:
            rows.append((None, "pot", rnd.choice(["总底池 9", ""]), float(rnd.choice([5, 10, 12, 30, 60, 90])), None))
        for seat in rnd.sample(range(3), rnd.randrange(3)):
            rows += rnd.sample([(seat, "action", rnd.choice(["FOLD", "CALL 5", " CALL 5 ", "RAISE 20", "", "ALL-IN", "CHECK", "hm"]), None, None),
                                (seat, "stack", None, rnd.choice([100.0, 95.0, 80.0, 75.0, 9.0, 0.0, 1000.0]), None),
                                (seat, "timer", None, rnd.choice([10.0, 9.0, 25.0, None]), None)], rnd.randrange(1, 4))
        out.append([(table, i, at, *r) for r in rows])
    return out


def test_stream_equals_batch(spark, tmp_path):
    made = ticks(260)
    for n in range(0, len(made), 65):
        spark.createDataFrame([r for rows in made[n : n + 65] for r in rows], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    players = spark.createDataFrame([("T0", 1, "ann", "BB"), ("T1", 2, "bob", "CO")], "table_id string, seat int, player_name string, position string")
    job = jobs.to_table(flow.observed_events(stream, seats=players, debounce_s=4.0), str(tmp_path / "o"), str(tmp_path / "c"))
    job.trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "o"))
    batch = observed.observed_events(spark.createDataFrame([r for rows in made for r in rows], SCHEMA), players=players, debounce_s=4.0)
    flat = lambda df: sorted(map(repr, df.select(batch.columns).select("*", "raw.*").drop("raw").collect()))
    assert not got.where("late").count() and flat(got) == flat(batch) and batch.count() > 40
    assert batch.where("raw.stack_after is not null and raw.decision_time_ms is not null").count() > 0
