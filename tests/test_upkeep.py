"""Tables that are kept up to date: upserts and the incremental cache."""

import os
from datetime import datetime

from pyspark.sql import functions as F
from test_literals import events

from railbird.operators import cache
from railbird.sources import tables, upsert


def _files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_upsert_rewrites_the_buckets_it_needs(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "phash bigint, name string, seen_at timestamp"
    at = lambda n: datetime(2024, 1, n)
    put = lambda rows: upsert.upsert(spark.createDataFrame(rows, schema), path, ["phash"], tables.merged_registry, buckets=16)
    read = lambda: {r.phash: (r.name, r.seen_at) for r in upsert.read_upserted(spark, path, spark.createDataFrame([], schema).schema).collect()}
    assert read() == {}
    put([(n, f"a{n}", at(5)) for n in range(100)] + [(None, "none", at(1))])
    before = _files(path)
    second = [(7, "b", at(6)), (8, "old", at(2)), (200, "c", at(3))]
    put(second)
    after = _files(path)
    assert 0 < len(set(after) - set(before)) <= 3 and set(before) & set(after)
    want = read()
    assert want[7] == ("b", at(6)) and want[8] == ("a8", at(5)) and want[200] == ("c", at(3)) and want[None] == ("none", at(1)) and len(want) == 102
    put(second)
    put([])
    assert read() == want


def test_upserts_of_a_stream(spark, tmp_path):
    schema = "phash bigint, name string, seen_at timestamp"
    for n in range(3):
        spark.createDataFrame([(k, f"n{n}", datetime(2024, 1, 1 + n)) for k in range(n, 5)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    path = str(tmp_path / "t")
    for check in ("c1", "c2"):  # a new checkpoint replays everything
        upsert.upserts(stream, path, ["phash"], tables.merged_registry, str(tmp_path / check), buckets=4).trigger(availableNow=True).start().awaitTermination()
        got = {r.phash: r.name for r in upsert.read_upserted(spark, path, stream.schema).collect()}
        assert got == {0: "n0", 1: "n1", 2: "n2", 3: "n2", 4: "n2"}


def _day(n, hour=12):
    return datetime(2024, 1, n, hour)


def test_a_refresh_reads_its_days_alone(spark, tmp_path):
    rows = [{"hand_id": h, "action": a, "player": p, "street": s, "ts": _day(d, 23), "seq": q}
            for h, d in ((1, 1), (2, 1), (3, 2), (4, 3)) for q, (p, a, s) in enumerate([("A", "raise", "preflop"), ("B", "call", "preflop"), ("A", "bet", "flop"), ("B", "fold", "flop")])]
    ev = events(spark, rows)
    # The hand of the second day goes on after midnight.
    ev = ev.withColumn("timestamp", F.when((F.col("hand_id") == 3) & (F.col("sequence_number") > 1), F.col("timestamp") + F.expr("interval 2 hours")).otherwise(F.col("timestamp")))
    hands = spark.createDataFrame([(h, _day(d, 23), {"BB": "A"}) for h, d in ((1, 1), (2, 1), (3, 2), (4, 3))], "id bigint, started_at timestamp, seats map<string,string>").withColumns({
        "showdown_cards": F.lit(None).cast("map<string,array<string>>"), "button_seat_index": F.lit(0), "num_seats": F.lit(9), "winner_player_name": F.lit(None).cast("string")})
    path = str(tmp_path / "cache")
    cache.write_states(cache.period_states(hands.where("id < 3"), ev.where("hand_id < 3")), path)
    old = _files(path)
    for _ in range(2):
        cache.refresh(hands, ev, path, since=_day(2, 0), until=_day(4, 0))
    assert set(old) <= set(_files(path)) and {k: v for k, v in _files(path).items() if k in old} == old
    got = cache.merged_cache(spark.read.parquet(path), as_of=_day(5)).drop("stats_json").orderBy("player_name").collect()
    whole = cache.merged_cache(cache.period_states(hands, ev), as_of=_day(5)).drop("stats_json").orderBy("player_name").collect()
    assert got == whole and [(r.player_name, r.total_hands, r.last_updated) for r in got] == [("A", 4, _day(5)), ("B", 4, _day(5))]
