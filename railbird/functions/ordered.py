"""Order-dependent building blocks that never put a whole key into one task.

A window partitioned by a key alone sends all rows of that key to one task, and
a window without a key sends everything to one.  Both break as soon as a key is
hot.  The functions here take a *split*: a column that never decreases along the
order (an hour of the timestamp, a block of a sequence number).  Work runs per
(key, split); what has to cross a split border is one row per (key, split),
which is shifted or summed on its own and joined back.

The join back is on exactly the columns the big side is already partitioned by,
so it adds no second shuffle of the rows themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SPLIT, _KEY, _CARRY, _EDGE = "__split", "__key", "__carry", "__edge"
_LAST = 9223372036854775807


def time_split(ts: Column | str, width: str = "1 hour") -> Column:
    """Whole buckets of ``width`` since the epoch; a missing time sorts last."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    number, unit = width.split()
    seconds = int(number) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]
    return F.coalesce(F.floor(F.unix_micros(ts) / F.lit(seconds * 1_000_000)), F.lit(_LAST)).cast("bigint")


def block_split(seq: Column | str, size: int) -> Column:
    """Blocks of a number that grows along the order."""
    seq = F.col(seq) if isinstance(seq, str) else seq
    return F.coalesce(F.floor(seq / F.lit(size)), F.lit(_LAST)).cast("bigint")


def _order(order: Iterable[str]) -> list[Column]:
    return [F.col(o).asc_nulls_last() for o in order]


def _keyed(df: DataFrame, keys: Sequence[str], split: Column) -> tuple[DataFrame, list[str]]:
    """Adds the split and the keys as one struct.

    A struct is never NULL itself, so rows with a missing key join back by plain
    equality, on the very columns the window has already partitioned by.
    """
    work = df.withColumn(_SPLIT, split)
    if not keys:
        return work, [_SPLIT]
    return work.withColumn(_KEY, F.struct(*keys)), [_KEY, _SPLIT]


def _join_carry(inner: DataFrame, heads: DataFrame, part: Sequence[str], value: Column) -> DataFrame:
    carry = heads.select(*[F.col(c).alias(f"{c}_of") for c in part], value.alias(_CARRY))
    cond = [inner[c] == carry[f"{c}_of"] for c in part]
    return inner.join(carry, cond, "left").drop(*[f"{c}_of" for c in part], *part)


def shifted(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column],
    *, split: Column | None = None, forward: bool = False,
) -> DataFrame:
    """Adds the previous (``forward``: the next) row's ``values`` under their names.

    Values travel in a struct, so that a neighbour whose values are NULL is not
    taken for a missing one at a split border.
    """
    packed = F.struct(*[v.alias(n) for n, v in values.items()])
    step = F.lead if forward else F.lag
    if split is None:
        w = Window.partitionBy(*keys).orderBy(*_order(order))
        out = df.withColumn(_EDGE, step(packed).over(w))
        return _unpack(out, _EDGE, values)

    work, part = _keyed(df, keys, split)
    w = Window.partitionBy(*part).orderBy(*_order(order))
    inner = work.withColumn(_EDGE, step(packed).over(w))

    # One row per (key, split): its last row for a lag, its first for a lead.
    rank = F.struct(*[F.struct(F.col(o).isNull(), F.col(o)) for o in order])
    pick = F.min_by if forward else F.max_by
    heads = work.groupBy(*part).agg(pick(packed, rank).alias(_EDGE))
    over = Window.partitionBy(*part[:-1]).orderBy(F.col(_SPLIT))
    heads = heads.withColumn(_CARRY, step(F.col(_EDGE)).over(over)).where(F.col(_CARRY).isNotNull())
    out = _join_carry(inner, heads, part, F.col(_CARRY))
    out = out.withColumn(_EDGE, F.coalesce(_EDGE, _CARRY)).drop(_CARRY)
    return _unpack(out, _EDGE, values)


def _unpack(df: DataFrame, packed: str, names: Iterable[str]) -> DataFrame:
    return df.select(*[c for c in df.columns if c != packed], *[F.col(packed)[n].alias(n) for n in names])


def running(
    df: DataFrame, keys: Sequence[str], order: Sequence[str],
    totals: dict[str, tuple[str, Column]], *, split: Column | None = None, inclusive: bool = True,
) -> DataFrame:
    """Running ``sum``, ``max``, ``min``, ``count`` or ``last`` (latest non-null).

    ``totals`` maps an output name to (kind, expression).  A split's own total is
    combined with the totals of all earlier splits of the same key.
    """
    agg = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count,
           "last": lambda c: F.last(c, ignorenulls=True)}
    end = 0 if inclusive else -1
    work, part = (df, list(keys)) if split is None else _keyed(df, keys, split)
    w = Window.partitionBy(*part).orderBy(*_order(order)).rowsBetween(Window.unboundedPreceding, end)
    inner = work.select("*", *[agg[k](e).over(w).alias(n) for n, (k, e) in totals.items()])
    if split is None:
        return inner

    rank = F.struct(*[F.struct(F.col(o).isNull(), F.col(o)) for o in order])
    per_split = []
    for n, (k, e) in totals.items():
        # max_by skips rows whose ordering is NULL: only non-null values compete.
        whole = F.max_by(e, F.when(e.isNotNull(), rank)) if k == "last" else agg[k](e)
        per_split.append(whole.alias(n))
    heads = work.groupBy(*part).agg(*per_split)
    before = Window.partitionBy(*part[:-1]).orderBy(F.col(_SPLIT)).rowsBetween(Window.unboundedPreceding, -1)
    again = {**agg, "count": F.sum}
    packed = F.struct(*[again[k](F.col(n)).over(before).alias(n) for n, (k, _) in totals.items()])
    out = _join_carry(inner, heads, part, packed)
    merge = {
        "sum": lambda a, b: F.coalesce(a + b, a, b), "count": lambda a, b: a + F.coalesce(b, F.lit(0)),
        "max": F.greatest, "min": F.least, "last": F.coalesce,
    }
    keep = [c for c in df.columns if c not in totals]
    return out.select(*keep, *[
        merge[k](F.col(n), F.col(_CARRY)[n]).alias(n) for n, (k, _) in totals.items()
    ])


def numbered(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, *, split: Column | None = None,
) -> DataFrame:
    """1-based row number along the order."""
    return running(df, keys, order, {name: ("count", F.lit(1))}, split=split)


def carried_fold(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], *, step: Callable[[dict, dict], list[dict]],
    state_schema: str, output_schema: str, forgets: Column | None = None, split: Column | None = None,
) -> DataFrame:
    """A left fold along the order of each key, exact, in one shuffle and one pass.

    ``step(state, row)`` changes the state (a dict with the columns of
    ``state_schema``, all None at first) and returns output rows.

    A task streams through sorted rows, so its memory does not follow the size of a
    key; its time does.  ``forgets`` marks the rows at which the rule provably gives the
    same result from any state: a key is cut there, and its pieces run side by side.  They
    are numbered by a running count over ``split``.
    """
    from railbird.functions.fold import fold_sorted

    if forgets is None:
        return fold_sorted(df, list(keys), list(order), step, state_schema, output_schema)
    marked = running(df.withColumn("__cut", forgets), keys, order,
                     {"__nth": ("count", F.when(F.col("__cut"), 1))}, split=split).drop("__cut")
    return fold_sorted(marked, list(keys), list(order), step, state_schema, output_schema, F.col("__nth"))
