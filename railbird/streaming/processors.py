"""Ordered rules with state kept by Spark, one value per key.

The rule objects are the ones batch jobs fold with, so a stream and a batch over
the same rows agree.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from railbird.functions.fold import parse_schema

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Groups of keys that are handled together; part of a stream's checkpoint, so fixed for its life.
BUCKETS = 256
#: Rows that are Python objects at once.
_SLICE = 4096
_NESTED = (T.StructType, T.ArrayType, T.MapType, T.VariantType)


def use_rocksdb(spark: SparkSession) -> None:
    """State by key outside the JVM heap; the stateful operator requires it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _packed_type(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, _NESTED):
        return pa.binary()
    return pa.timestamp("us") if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else to_arrow_type(kind)


def _packed(batch: pd.DataFrame, fields: T.StructType) -> pa.Table:
    """Rows as columns of few bytes; nested values as they are, pickled."""
    columns = []
    for f in fields:
        values = batch[f.name]
        if isinstance(f.dataType, _NESTED):
            values = values.map(lambda v: None if v is None else pickle.dumps(v))
        columns.append(pa.Array.from_pandas(values, type=_packed_type(f.dataType)))
    return pa.Table.from_arrays(columns, names=fields.names)


class RuleProcessor(StatefulProcessor):
    """Feeds the rows of a bucket's keys to a rule, key by key and in order.

    A row older than what its key has already seen cannot be folded in without
    undoing later ones; it comes out marked late and changes nothing, and so does one
    without a time.

    Every key has its own state in the bucket's map.  A batch's rows are held in columns and become Python
    objects slice by slice, so a key may have many rows in a batch and a batch many keys.
    """

    def __init__(self, step, keys: list[str], order: list[str], inputs: T.StructType, outputs: T.StructType, ttl_ms: int | None):
        self.step, self.keys, self.order, self.inputs, self.outputs, self.ttl_ms = step, keys, order, inputs, outputs, ttl_ms
        # Parsed here: the text can only be read where there is a session.
        self.schema = parse_schema(f"{step.state}, seen_at bigint")
        self.names = self.schema.fieldNames()
        self.key_schema = T.StructType([inputs[k] for k in keys])
        self.nested = [f.name for f in inputs if isinstance(f.dataType, _NESTED)]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.states = handle.getMapState("rules", self.key_schema, self.schema, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        table = pa.concat_tables([_packed(batch, self.inputs) for batch in rows])
        by = [*self.keys, *(o for o in self.order if o not in self.keys)]
        order = pc.sort_indices(table.select(by).combine_chunks(), sort_keys=[(c, "ascending") for c in by], null_placement="at_end")
        known = self.states.exists()
        current, state = None, {}
        for at in range(0, len(order), _SLICE):
            out: list[dict] = []
            for row in table.take(order[at:at + _SLICE]).to_pylist():
                now = tuple([row[k] for k in self.keys])
                if now != current:
                    self._save(current, state)
                    current, saved = now, self.states.getValue(now) if known else None
                    state = dict(zip(self.names, saved)) if saved else dict.fromkeys(self.names)
                for n in self.nested:
                    row[n] = None if row[n] is None else pickle.loads(row[n])
                if row["at"] is None or (state["seen_at"] is not None and row["at"] < state["seen_at"]):
                    row["late"] = True
                    out.append(row)
                    continue
                for r in self.step(state, row):
                    out.append({**r, "late": False})
                state["seen_at"] = row["at"]
            yield pd.DataFrame({n: pd.Series([r.get(n) for r in out], dtype=object) for n in self.outputs.names})
        self._save(current, state)

    def _save(self, key: tuple | None, state: dict) -> None:
        if key is not None:
            self.states.updateValue(key, tuple(state[n] for n in self.names))

    def close(self) -> None:
        pass


def stateful(
    df: DataFrame, keys: list[str], order: list[str], step, *, ts: str = "ts", ttl_ms: int | None = None, buckets: int = BUCKETS,
) -> DataFrame:
    """A rule over a stream.  The result has the input's columns, the rule's and ``late``.

    ``ttl_ms`` drops the state of keys that stay silent; give it for rules whose
    memory has a horizon, such as the debounce.

    Keys are dealt to ``buckets``, which Spark groups by; each key keeps a state of its own.  What a group costs (a frame
    in, a frame out) is then paid by bucket, not by key, of which there may be one for every few rows.
    """
    rows = df.withColumn("at", F.unix_micros(ts))
    inputs = rows.schema
    outputs = T.StructType([*inputs, *parse_schema(step.extra), T.StructField("late", T.BooleanType())])
    return rows.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).groupBy("_bucket").transformWithStateInPandas(
        statefulProcessor=RuleProcessor(step, keys, order, inputs, outputs, ttl_ms), outputStructType=outputs,
        outputMode="Append", timeMode="None" if ttl_ms is None else "ProcessingTime").drop("at")


class WindowProcessor(StatefulProcessor):
    """Sums of a key's rows by window, told when event time passes a window's end, whether rows came or not.

    A timer stands at the end of the oldest open window and moves on by itself, so windows in which
    a key is silent come out with zeros.  A row of a window that has been told comes out as a late row with its own
    values; it is in no sum.  So the sums and the late rows together hold every row once.
    """

    def __init__(self, keys: list[str], values: list[str], micros: int, outputs: T.StructType):
        self.keys, self.values, self.micros, self.outputs = keys, values, micros, outputs
        self.slot, self.sums, self.edge = parse_schema("start bigint"), parse_schema("sums array<double>"), parse_schema("open bigint")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.windows = handle.getMapState("windows", self.slot, self.sums)
        self.front = handle.getValueState("front", self.edge)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # No row is late before the key's first batch is through.
        front = self.front.get()[0] if self.front.exists() else None
        first, added = None, {}
        for batch in rows:
            start = batch["at"] // self.micros * self.micros
            late = start < front if front is not None else start != start
            first = int(start.min()) if first is None else min(first, int(start.min()))
            for begin, part in batch.loc[~late, self.values].groupby(start[~late]):
                sums = added.get(int(begin), [0.0] * len(self.values))
                added[int(begin)] = [a + float(b) for a, b in zip(sums, part.sum(), strict=True)]
            if late.any():
                yield self._told(key, [(int(s), row, True) for s, row in zip(start[late], batch[late][self.values].fillna(0.0).values.tolist())])
        if front is None:
            self.front.update((first,))
            self._wake(first)
        for begin, sums in added.items():
            slot = (begin,)
            known = self.windows.getValue(slot)[0] if self.windows.containsKey(slot) else [0.0] * len(self.values)
            self.windows.updateValue(slot, ([a + b for a, b in zip(known, sums, strict=True)],))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, front, out = timerValues.getCurrentWatermarkInMs() * 1000, self.front.get()[0], []
        while front + self.micros <= now:
            slot, sums = (front,), [0.0] * len(self.values)
            if self.windows.containsKey(slot):
                sums = list(self.windows.getValue(slot)[0])
                self.windows.removeKey(slot)
            out.append((front, sums, False))
            front += self.micros
        self.front.update((front,))
        self._wake(front)
        yield self._told(key, out)

    def _wake(self, front: int) -> None:
        self.handle.registerTimer(-(-(front + self.micros) // 1000))

    def _told(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        columns = [[k] * len(rows) for k in key] + [[pd.Timestamp(s, unit="us", tz="UTC") for s, _, _ in rows]]
        columns += [[r[1][n] for r in rows] for n in range(len(self.values))] + [[r[2] for r in rows]]
        return pd.DataFrame({name: pd.Series(c, dtype=object) for name, c in zip(self.outputs.names, columns, strict=True)})

    def close(self) -> None:
        pass


def windowed_sums(df: DataFrame, keys: list[str], values: list[str], *, ts: str, window: str, delay: str) -> DataFrame:
    """keys, window_start, the sums of ``values`` and ``late`` for every window of every key, silent ones included.

    From a key's first row on, a window is told once event time (of all keys) has passed its end by ``delay``.
    """
    number, unit = window.split()
    micros = int(number) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")] * 1_000_000
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    outputs = parse_schema(", ".join([kinds, "window_start timestamp", *(f"`{v}` double" for v in values), "late boolean"]))
    # The time goes on as a number: Spark would drop rows behind the watermark by the column that bears it.
    rows = df.withWatermark(ts, delay).select(*keys, F.unix_micros(ts).alias("at"), *[F.coalesce(F.col(v).cast("double"), F.lit(0.0)).alias(v) for v in values])
    return rows.where("at is not null").groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=WindowProcessor(keys, values, micros, outputs), outputStructType=outputs, outputMode="Append", timeMode="EventTime")
