"""A parallel prefix over rule states: ordered rules of one key on all cores.

A rule that remembers its last accepted reading folds a key's rows one after the other.  Here the
order is cut into splits, and every (key, split) is first summed up as a *map* from the state at its
start to the state at its end.  Maps are small, so running through those of a key gives every split's
entry state; then all splits are folded side by side from known states.  Three shuffles (five where a
rule's state comes in two parts), whatever the length of a feed: the narrow rows, one map for each split, the rows.

Two kinds of maps are exact for the rules of ``steps``:

* ``Table``: of a state with few values, the exit of every entry.
* ``Digest``: most rules forget: after a *reset* (an accepted reading, a hand boundary) the
  state follows from that row alone.  A map holds the few rows that may be the first reset for some
  entry, each with the exit that follows, found by carrying one run on from every such row; runs that
  come to the same state are one from there on.  An entry is played over these rows until one resets it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from railbird.functions.fold import lists, parse_schema, with_outputs

_SPLIT, _ENTRY, _HEAD = "__split", "__entry", "__head"
_BATCH = 4096
State = dict[str, Any]


class Mapper(Protocol):
    """Sums a split up for the state fields ``fields``, from the input ``columns``."""

    fields: Sequence[str]
    columns: Sequence[str]
    #: SQL condition of the rows that may say something to a map; all others leave map and state as they are (none: all rows may).
    only: str | None

    def begin(self, known: State) -> Any:
        """The sum of no rows; ``known`` has the fields that earlier mappers settled."""

    def feed(self, total: Any, row: dict) -> None:
        """Adds a row."""

    def finish(self, total: Any) -> Any:
        """The map, as JSON can hold it."""

    def apply(self, packed: Any, state: State) -> State:
        """The exit state of the entry ``state``."""


class Table:
    """The map of a state field with few values."""

    only = None

    def __init__(self, step: Callable, field: str, values: Sequence[Any], columns: Sequence[str]) -> None:
        self.step, self.fields, self.values, self.columns = step, [field], list(values), columns

    def begin(self, known: State) -> list[list]:
        return [[v, [v]] for v in self.values]

    def feed(self, total: list[list], row: dict) -> None:
        field, merged = self.fields[0], {}
        for now, entries in total:
            state = {field: now}
            self.step(state, row)
            merged.setdefault(state[field], []).extend(entries)
        total[:] = [[now, entries] for now, entries in merged.items()]

    def finish(self, total: list[list]) -> list[list]:
        return total

    def apply(self, packed: list[list], state: State) -> State:
        (field,) = self.fields
        return {field: next(now for now, entries in packed if state[field] in entries)}


class Digest:
    """The map of a rule that forgets.

    ``step(state, row)`` is the rule.  ``look(memory, row, outs)`` says what a row may do to a state that no row of
    the split has reset yet: 0 nothing, 1 change or reset it, 2 reset it for certain; ``memory`` is a dict of its own for
    every split, ``outs`` what the rule said from its first state.  ``resets(outs)`` tells from the rule's output that
    a row has reset the state, ``after(row)`` is the state then.  ``only`` is the condition of the rows that ``step`` and ``look`` don't pass over.
    """

    def __init__(
        self, step: Callable, fields: Sequence[str], columns: Sequence[str], *, look: Callable, resets: Callable, after: Callable, only: str | None = None,
    ) -> None:
        self.step, self.fields, self.columns, self.only = step, list(fields), list(columns), only
        self.look, self.resets, self.after = look, resets, after

    def begin(self, known: State) -> dict:
        return {"memory": {}, "rows": [], "open": True, "probe": {**known, **dict.fromkeys(self.fields)}, "runs": [], "own": []}

    def feed(self, total: dict, row: dict) -> None:
        outs = self.step(total["probe"], row)
        runs = total["runs"]
        for run in runs:
            self.step(run, row)
        code = self.look(total["memory"], row, outs) if total["open"] else 0
        if code:
            total["rows"].append([[row[c] for c in self.columns], code == 2, len(total["own"])])
            runs.append({**total["probe"], **self.after(row)})
            total["own"].append(len(runs) - 1)
            total["open"] = code == 1
        if len(runs) > 1:
            seen: dict[tuple, int] = {}
            where = [seen.setdefault(tuple(r[f] for f in self.fields), len(seen)) for r in runs]
            if len(seen) < len(runs):
                total["runs"] = [runs[where.index(k)] for k in range(len(seen))]
                total["own"] = [where[k] for k in total["own"]]

    def finish(self, total: dict) -> list:
        exits = [[r[f] for f in self.fields] for r in total["runs"]]
        return [[[values, certain, total["own"][n]] for values, certain, n in total["rows"]], exits]

    def apply(self, packed: list, state: State) -> State:
        rows, exits = packed
        now = dict(state)
        for values, certain, n in rows:
            if certain or self.resets(self.step(now, dict(zip(self.columns, values, strict=True)))):
                return dict(zip(self.fields, exits[n], strict=True))
        return {f: now[f] for f in self.fields}


def _groups(source: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[tuple, dict]]:
    """(key, row) of sorted rows, a batch at a time."""
    for batch in source:
        for at in range(0, batch.num_rows, _BATCH):
            for row in batch.slice(at, _BATCH).to_pylist():
                yield tuple(row[k] for k in by), row


def _parts(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in source:
        for at in range(0, batch.num_rows, _BATCH):
            yield batch.slice(at, _BATCH)


def _schema(df: DataFrame, names: list[str], extra: str) -> str:
    return ", ".join([*(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names), extra])


def _ordered(order: list[str]) -> list[Column]:
    return [F.col(o).asc_nulls_last() for o in order]


def _maps(rows: DataFrame, keys: list[str], order: list[str], mapper: Mapper) -> DataFrame:
    """keys, split and map of every (key, split).  Rows with ``__head`` bring the entry state known so far."""
    by, columns = [*keys, _SPLIT], list(mapper.columns)
    ddl = _schema(rows, by, "map string")
    schema = to_arrow_schema(parse_schema(ddl))
    used = list(dict.fromkeys([*by, *order, *columns, _HEAD, _ENTRY]))
    dealt = rows.select(*used).repartition(*by).sortWithinPartitions(*by, F.col(_HEAD).desc(), *_ordered(order))
    # Python needs no columns that only sort.
    dealt = dealt.select(*dict.fromkeys([*by, *columns, _HEAD, _ENTRY]))

    def make(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now, total = [], None, None
        for part in _parts(source):
            for key, values, (head, entry) in zip(lists(part, by), lists(part, columns), lists(part, [_HEAD, _ENTRY]), strict=True):
                if key != now:
                    if now is not None:
                        out.append((*now, json.dumps(mapper.finish(total))))
                    now, total = key, mapper.begin(json.loads(entry) if head else {})
                if not head:
                    mapper.feed(total, dict(zip(columns, values, strict=True)))
            if len(out) >= _BATCH:
                yield _batch(out, schema)
                out = []
        if now is not None:
            out.append((*now, json.dumps(mapper.finish(total))))
        if out:
            yield _batch(out, schema)

    return dealt.mapInArrow(make, ddl)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _entries(maps: DataFrame, keys: list[str], mapper: Mapper) -> DataFrame:
    """keys, split and entry state: the maps of every key applied one after the other.

    ``before`` holds what earlier mappers settled and is handed on.
    """
    by = [*keys, _SPLIT]
    ddl = _schema(maps, by, f"{_ENTRY} string")
    schema = to_arrow_schema(parse_schema(ddl))
    dealt = maps.repartition(*(keys or [F.lit(0)])).sortWithinPartitions(*by)

    def make(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, now, state = [], None, {}
        for key, row in _groups(source, keys):
            if key != now:
                now, state = key, dict.fromkeys(mapper.fields)
            known = json.loads(row["before"])
            out.append((*key, row[_SPLIT], json.dumps({**known, **state})))
            state = mapper.apply(json.loads(row["map"]), state)
            if len(out) >= _BATCH:
                yield _batch(out, schema)
                out = []
        if out:
            yield _batch(out, schema)

    return dealt.mapInArrow(make, ddl)


def prefix_fold(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], step: Callable, mappers: Sequence[Mapper],
    output_schema: str, split: Column,
) -> DataFrame:
    """``step(state, row)`` over the rows of each key in ``order``, its splits side by side.

    The result equals the sequential fold's; ``split`` must not decrease along the order.  The rule reads the columns of its
    mappers only and gives input rows back with more columns; the others never become Python values.
    """
    keys, order = list(keys), list(order)
    by = [*keys, _SPLIT]
    names = parse_schema(step.state).fieldNames()
    reads = list(dict.fromkeys(c for m in mappers for c in m.columns))
    rows = df.withColumn(_SPLIT, split).withColumns({_HEAD: F.lit(False), _ENTRY: F.lit(None).cast("string")})
    heads = None
    for mapper in mappers:
        if heads is None and mapper.only is not None:
            begins = rows.select(*by).distinct().withColumns({_HEAD: F.lit(True), _ENTRY: F.lit("{}")})
        else:
            begins = heads
        told = rows if mapper.only is None else rows.where(mapper.only)
        known = told if begins is None else told.unionByName(begins, allowMissingColumns=True)
        maps = _maps(known, keys, order, mapper)
        if heads is None:
            maps = maps.withColumn("before", F.lit("{}"))
        else:
            before = heads.select(*by, F.col(_ENTRY).alias("before"))
            maps = maps.alias("m").join(before.alias("b"), [F.col(f"m.{k}").eqNullSafe(F.col(f"b.{k}")) for k in by]).select("m.*", "b.before")
        heads = _entries(maps, keys, mapper).withColumn(_HEAD, F.lit(True))
    out_schema = to_arrow_schema(parse_schema(output_schema))
    dealt = rows.unionByName(heads, allowMissingColumns=True).repartition(*by).sortWithinPartitions(*by, F.col(_HEAD).desc(), *_ordered(order))

    def make(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: State = {}
        for part in _parts(source):
            out, kept = [], []
            for n, (values, (head, entry)) in enumerate(zip(lists(part, reads), lists(part, [_HEAD, _ENTRY]), strict=True)):
                if head:
                    state = {**dict.fromkeys(names), **json.loads(entry)}
                else:
                    made = step(state, dict(zip(reads, values, strict=True)))
                    out.extend(made)
                    kept.extend([n] * len(made))
            if out:
                yield with_outputs(part, kept, out, out_schema)

    return dealt.mapInArrow(make, output_schema)
