"""An ordered fold: one pass over each key's rows, in order, with constant memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

_BATCH = 4096


def parse_schema(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


def lists(part: pa.RecordBatch, names: Sequence[str]) -> Iterator[tuple]:
    """The rows' values of some columns, converted a column at a time."""
    return zip(*(part.column(n).to_pylist() for n in names), strict=True) if names else iter([()] * part.num_rows)


def with_outputs(part: pa.RecordBatch, kept: list[int], outs: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    """The input rows ``kept`` with what a rule adds to them; the input's own columns stay Arrow's."""
    names, at = set(part.schema.names), pa.array(kept, pa.int64())
    own = lambda f: part.column(f.name).take(at).cast(f.type)
    return pa.RecordBatch.from_arrays([own(f) if f.name in names else pa.array([o[f.name] for o in outs], f.type) for f in schema], schema=schema)


def fold_sorted(
    df: DataFrame, keys: list[str], order: list[str], step: Callable, state_schema: str, output_schema: str,
    piece: Column | None = None,
) -> DataFrame:
    """``step(state, row)`` over the rows of each key (and ``piece``) in ``order``.

    The shuffle deals rows by key and sorts them; a task then streams through its
    keys and holds one state and one batch of rows, whatever the size of a key.

    A step that names the columns it ``reads`` gets only these as Python values; it gives input rows back with more columns.
    """
    reads = getattr(step, "reads", None)
    names = parse_schema(state_schema).fieldNames()
    out_schema = to_arrow_schema(parse_schema(output_schema))
    rows = df if piece is None else df.withColumn("__piece", piece)
    by = keys if piece is None else [*keys, "__piece"]
    dealt = rows.repartition(*by).sortWithinPartitions(*by, *[F.col(o).asc_nulls_last() for o in order])

    def make(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []
        for batch in source:
            for at in range(0, batch.num_rows, _BATCH):
                part = batch.slice(at, _BATCH)
                if reads is not None:
                    rows, kept = (dict(zip(reads, values, strict=True)) for values in lists(part, reads)), []
                else:
                    rows = part.to_pylist()
                for n, (now, row) in enumerate(zip(lists(part, by), rows, strict=True)):
                    if state is None or now != key:
                        key, state = now, dict.fromkeys(names)
                    made = step(state, row)
                    out.extend(made)
                    if reads is not None:
                        kept.extend([n] * len(made))
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=out_schema) if reads is None else with_outputs(part, kept, out, out_schema)
                    out = []

    return dealt.mapInArrow(make, output_schema)
