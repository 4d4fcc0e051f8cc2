"""What a task or the driver gets is bounded where the input grows."""

import os
from types import SimpleNamespace

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrameReader
from pyspark.sql import functions as F
from test_literals import events

from railbird import session
from railbird.functions import prefix, steps
from railbird.operators import derive, evaluation, identity
from railbird.plans import source_queries
from railbird.plans.base import query
from railbird.sources import sidecars


def test_review_limits_each_part_before_the_shuffle(spark):
    rows = spark.range(4000).select(
        F.col("id").cast("string").alias("id"), (F.col("id") % 10).alias("hand_id"), F.lit("P").alias("player_name"), F.lit("BB").alias("position"),
        F.lit("flop").alias("street"), F.lit("call").alias("action_type"), F.lit(1.0).alias("amount"), (F.col("id") % 10 / 10).alias("confidence_score"),
        F.struct(F.lit(None).cast("string").alias("override_reason")).alias("raw"), F.lit(None).cast("timestamp").alias("timestamp"))
    out = evaluation.review_sample(rows)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    got = out.groupBy("pool").count().collect()
    assert {r["pool"]: r["count"] for r in got} == {"screenshot": 30, "clean": 5}


def test_a_hash_of_many_players_is_matched_once(spark):
    """Many names of one hash crowd no key; the first name, null before all, stays the best."""
    names = spark.createDataFrame([(5, f"p{i:04}") for i in range(300)] + [(1 << 40, None), (1 << 40, "q")], "phash long, name string")
    readings = spark.createDataFrame([(4,), ((1 << 40) + 1,), (None,)], "phash long")
    out = identity.nearest_fingerprints(readings, names, crowded=10)
    assert {r.phash: (r.matched_name, r.distance) for r in out.collect()} == {4: ("p0000", 1), (1 << 40) + 1: (None, None), None: (None, None)}
    # Two hashes crowd nothing, so none is looked up bit by bit.
    assert "bit_count" in out._jdf.queryExecution().optimizedPlan().toString() and "Generate explode([[" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_queries_deal_shuffles_finely(spark):
    old = spark.conf.get(session.FINE_CONF, None)
    spark.conf.unset(session.FINE_CONF)
    query(lambda t: spark.range(1))(spark, "unused")
    assert int(spark.conf.get(session.FINE_CONF)) >= session.FINE_PARTS
    # What the cluster says stays.
    spark.conf.set(session.FINE_CONF, "7")
    query(lambda t: spark.range(1))(spark, "unused")
    assert spark.conf.get(session.FINE_CONF) == "7"
    if old is None:
        spark.conf.unset(session.FINE_CONF)
    else:
        spark.conf.set(session.FINE_CONF, old)


def test_many_sidecars_are_read_in_few_tasks(spark, tmp_path):
    for i in range(600):
        (tmp_path / f"{i}.json").write_text(f'{{"event_id": "{i}"}}')
    before = spark.conf.get(session.OPEN_CONF)
    got = sidecars.read_sidecars(spark, str(tmp_path), sidecars.REVIEW)
    # A part of the result for every task that read files: 19 at 32 files each.
    assert len(got.inputFiles()) <= 2 * spark.sparkContext.defaultParallelism < 19
    assert {r.event_id for r in got.collect()} == {str(i) for i in range(600)}
    assert spark.conf.get(session.OPEN_CONF) == before


def test_sidecars_are_listed_in_groups(spark, tmp_path, monkeypatch):
    """No read lists more files than the driver may hold, and none is kept for later; odd names, files beside folders and what
    Spark passes over stay as they were."""
    for i in range(300):
        folder = tmp_path / ("hand [1]", "hand {a,b}*", r"back\slash", "deep/a", "deep/b", ".", "_gone", ".gone", "_kept=1", "same")[i % 10]
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{i}_meta.json").write_text(f'{{"event_id": "{i}"}}')
    (tmp_path / "_0_meta.json").write_text('{"event_id": "hidden"}')
    (tmp_path / "0_other.json").write_text('{"event_id": "other"}')
    listed, kept, load = [], set(), DataFrameReader.load
    cache = "spark.sql.hive.filesourcePartitionFileCacheSize"
    before = spark.conf.get(cache)

    def counted(reader, path=None, *args, **kwargs):
        df = load(reader, path, *args, **kwargs)
        listed.append(len(df.inputFiles()))
        kept.add(spark.conf.get(cache))
        return df

    monkeypatch.setattr(DataFrameReader, "load", counted)
    monkeypatch.setattr(sidecars, "LISTED", 40, raising=False)
    got = sidecars.read_sidecars(spark, str(tmp_path), sidecars.REVIEW, pattern="*_meta.json").collect()
    assert sorted(int(r.event_id) for r in got) == [i for i in range(300) if i % 10 not in (6, 7)]
    assert sum(listed) == 240 and max(listed) <= 40
    assert kept == {"0"} and spark.conf.get(cache) == before
    # Patterns and empty folders as before.
    some = sidecars.read_sidecars(spark, str(tmp_path / "{deep,same}"), sidecars.REVIEW, pattern="*_meta.json")
    assert {int(r.event_id) % 10 for r in some.collect()} == {3, 4, 9}
    (tmp_path / "empty").mkdir()
    assert sidecars.read_sidecars(spark, str(tmp_path / "empty"), sidecars.REVIEW).count() == 0
    with pytest.raises(AnalysisException):
        sidecars.read_sidecars(spark, str(tmp_path / "none"), sidecars.REVIEW)


def test_reviews_are_dealt_to_folders(spark, monkeypatch):
    """A file for every review, and few in a folder: a folder is what a read can list by itself."""
    rows = events(spark, [{"hand_id": i, "action": "call", "conf": 0.5, "amount": 1.0 * i} for i in range(60)])
    rows = rows.withColumn("raw", F.struct(F.lit("x").alias("override_reason"))).coalesce(2)
    folders, read = [], sidecars.read_sidecars
    monkeypatch.setattr(sidecars, "FOLDER", 8, raising=False)
    monkeypatch.setattr(sidecars, "read_sidecars", lambda s, folder, *a, **k: (folders.append(folder.removeprefix("file:")), read(s, folder, *a, **k))[1])
    got = source_queries._sidecars(SimpleNamespace(spark=spark, events=rows))
    assert sorted(r.amount for r in got.collect()) == [1.0 * i for i in range(60)]
    files = [len([n for n in names if n.startswith("part-")]) for _, _, names in os.walk(folders[0])]
    assert sum(files) == 60 and max(files) <= 8


def _table_rows(spark):
    rows = [("T", i, kind, value, text, phash) for i, (kind, value, text, phash) in enumerate([
        ("stack", 5.0, "", None), ("hero", None, "Kh", None), ("hero", None, "", 7), ("pot", None, "", None), ("pot", 50.0, "", None),
        ("community", 3.0, "", None), ("timer", 9.0, "", None), ("action", None, "FOLD", None), ("community", 0.0, "", None),
        ("hero", None, "", (1 << 60) - 1), (None, 1.0, "", 3), ("pot", 60.0, "", None), ("pot", 20.0, "", None)] * 3)]
    df = spark.createDataFrame(rows, "table_id string, tick long, kind string, value double, text string, phash long")
    return df.withColumn("ts", F.timestamp_seconds("tick")).withColumn("other", F.array(F.struct("tick", "ts")))


def test_maps_are_made_from_the_rows_that_tell_something(spark, monkeypatch):
    """Rows a rule passes over reach no map; the rule's result is that of the plain fold, other columns as they were."""
    df, order, step = _table_rows(spark), ["ts", "tick"], steps.Segment(label=None)
    told, real = [], prefix._maps

    def maps(rows, keys, order, mapper):
        told.append({r.kind for r in rows.where("not __head").select("kind").distinct().collect()})
        return real(rows, keys, order, mapper)

    monkeypatch.setattr(prefix, "_maps", maps)
    want = derive.apply_step(df, ["table_id"], order, step)
    got = derive.apply_step(df, ["table_id"], order, step, width="4 seconds")
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert told == [{"hero"}, {"hero", "pot", "community"}]


def test_segment_hands_runs_its_fold_once(spark):
    out = derive.segment_hands(_table_rows(spark).drop("other").withColumn("seat", F.lit(1)), pot_label=None, width="4 seconds")
    assert "MapInArrow" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 39
