"""Stateful rules hold a batch's rows in columns, and one group serves many keys."""

import weakref
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from railbird.functions.fold import parse_schema
from railbird.functions.steps import Numbering
from railbird.streaming import processors
from railbird.streaming.processors import RuleProcessor, WindowProcessor, stateful


class _Map:
    """A map state in memory."""

    def __init__(self):
        self.kept = {}

    def exists(self):
        return bool(self.kept)

    def getValue(self, key):
        return self.kept.get(key)

    def containsKey(self, key):
        return key in self.kept

    def updateValue(self, key, value):
        self.kept[key] = value


class _Value(_Map):
    def get(self):
        return self.kept[0]

    def update(self, value):
        self.kept[0] = value


def _frames(rows, size, columns):
    """Frames of ``size`` rows; fails if the reader still holds more than the last two."""
    alive = []
    for at in range(0, len(rows), size):
        frame = pd.DataFrame(rows[at:at + size], columns=columns)
        alive = [r for r in alive if r() is not None] + [weakref.ref(frame)]
        assert len(alive) <= 2
        yield frame


def test_a_rules_rows_come_out_slice_by_slice(spark):
    inputs = parse_schema("hand string, n bigint, tags array<string>, at bigint")
    outputs = parse_schema("hand string, n bigint, tags array<string>, at bigint, sequence_number int, late boolean")
    rule = RuleProcessor(Numbering(0), ["hand"], ["at", "n"], inputs, outputs, None)
    rule.states = _Map()
    rows = [(f"h{i % 3}" if i % 3 else None, i, ["x"] if i % 2 else None, 20_000 - i) for i in range(20_000)]
    sizes, got = [], []
    for out in rule.handleInputRows((1,), _frames(rows, 1000, inputs.names), None):
        sizes.append(len(out))
        got += out.to_dict("records")
    assert sum(sizes) == len(rows) and max(sizes) <= processors._SLICE
    assert not any(r["late"] for r in got) and {(r["n"], tuple(r["tags"] or ())) for r in got} == {(n, tuple(t or ())) for _, n, t, _ in rows}
    for hand in (None, "h1", "h2"):
        mine = [r for r in got if r["hand"] == hand]
        assert [r["sequence_number"] for r in mine] == list(range(1, len(mine) + 1)) and mine == sorted(mine, key=lambda r: r["at"])
    # The next batch goes on where each key stopped.
    (out,) = rule.handleInputRows((1,), iter([pd.DataFrame([("h1", 1, None, 30_000), ("h2", 2, None, 5)], columns=inputs.names)]), None)
    assert out["late"].tolist() == [False, True] and out["sequence_number"].tolist()[0] == sum(r[0] == "h1" for r in rows) + 1


def test_windows_are_summed_frame_by_frame(spark):
    class Handle:
        registerTimer = staticmethod(lambda at: None)

    win = WindowProcessor(["feed"], ["n"], 10, parse_schema("feed string, window_start timestamp, n double, late boolean"))
    win.handle, win.windows, win.front = Handle, _Map(), _Value()
    rows = [(5000 - i, 1.0) for i in range(5000)]
    assert not list(win.handleInputRows(("all",), _frames(rows, 500, ["at", "n"]), None))
    # The oldest row sets the front, whichever frame it came in.
    assert win.front.get() == (0,) and win.windows.kept[(0,)] == ([9.0],) and sum(v[0][0] for v in win.windows.kept.values()) == 5000
    win.front.update((20,))
    (told,) = win.handleInputRows(("all",), iter([pd.DataFrame([(3, 2.0), (25, 4.0)], columns=["at", "n"])]), None)
    assert told["late"].tolist() == [True] and told["n"].tolist() == [2.0] and win.windows.kept[(20,)] == ([14.0],)


def test_many_keys_share_few_groups(spark, tmp_path):
    """Over twice as many keys as groups, in two batches; missing keys are a key."""
    t0 = datetime(2024, 1, 1)
    for part in range(2):
        rows = [(k if k else None, part * 2 + i, t0 + timedelta(seconds=part * 2 + i)) for k in range(20) for i in range(2)]
        spark.createDataFrame(rows, "hand bigint, id int, ts timestamp").coalesce(1).write.parquet(str(tmp_path / f"in/p{part}"))
    stream = spark.readStream.schema("hand bigint, id int, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/p*"))
    out = stateful(stream, ["hand"], ["ts", "id"], Numbering(0), buckets=8)
    out.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "o"))
    assert got.count() == 80 and got.where(F.col("late") | (F.col("sequence_number") != F.col("id") + 1)).isEmpty()
