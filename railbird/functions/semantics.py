"""Rounding, casting, matching and map helpers with the semantics the audits need.

Rounding is half away from zero on decimals, float to int is half-even, and a
bad or missing number is NULL instead of an error.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_EXACT = "decimal(38,10)"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_away(c: Column | str, digits: int = 0) -> Column:
    return F.round(col(c).cast(_EXACT), digits).cast("double")


def to_int(c: Column | str) -> Column:
    """Float to integer, ties to even (a plain cast would truncate)."""
    return F.rint(col(c)).cast("bigint")


def pct(num: Column, den: Column, digits: int = 1) -> Column:
    return round_half_away(F.try_divide(num * F.lit(100.0), den), digits)


def int_pct(num: Column, den: Column) -> Column:
    return pct(num, den, 0).cast("int")


def count_if(cond: Column) -> Column:
    """Rows for which cond is true; an empty or unknown cond counts 0."""
    return F.sum(F.when(cond, 1).otherwise(0))


def flag(cond: Column) -> Column:
    """1/0, unknown counts as 0; max() of it is 'any'."""
    return F.when(cond, 1).otherwise(0)


def named_player(c: Column | str = "player_name") -> Column:
    """Drops placeholder names.  The underscore is a LIKE wildcard here: a bare
    'TempUser' is kept and 'TempUserX' is dropped."""
    return ~col(c).like("TempUser_%")


def named_player_prefix(c: Column | str = "player_name") -> Column:
    """The stricter form some reports use: anything starting with 'TempUser'."""
    return col(c).isNotNull() & ~col(c).like("TempUser%")


def is_placeholder(c: Column | str) -> Column:
    return col(c).startswith("TempUser_")


def shanghai(ts: Column | str) -> Column:
    return F.date_format(F.from_utc_timestamp(col(ts), "Asia/Shanghai"), "MM-dd HH:mm:ss")


def seconds_between(start: Column | str, end: Column | str) -> Column:
    return (F.unix_micros(col(end)) - F.unix_micros(col(start))) / F.lit(1e6)


def minutes(n: float) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(n * 60.0).cast("decimal(18,6)"))


def numeric_map(c: Column) -> Column:
    """map<string,string> to map<string,double>; quoted numbers are numbers and
    a null or unreadable value keeps its key."""
    return F.transform_values(c, lambda _, v: v.try_cast("double"))


def map_total(c: Column | str) -> Column:
    """Sum of a numeric map's values without exploding it; 0 when there are none."""
    return F.aggregate(F.map_values(col(c)), F.lit(0.0), lambda acc, v: acc + F.coalesce(v, F.lit(0.0)))


def chain(*branches: tuple[Column, object], default: object = None) -> Column:
    """First matching branch wins."""
    (cond, value), *rest = branches
    out = F.when(cond, value)
    for cond, value in rest:
        out = out.when(cond, value)
    return out if default is None else out.otherwise(default)


def any_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds)


def lookup(mapping: dict) -> Column:
    """A small constant dict as a map literal."""
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])


def newest_first(c: Column | str) -> Column:
    """Descending with missing values first, the default of the source database."""
    return col(c).desc_nulls_first()
