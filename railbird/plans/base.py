"""Shared pieces of the query registry: table access, flat output, SQL prelude."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from railbird.session import fine_shuffles
from railbird.sources import derivations, testdata

Query = Callable[[SparkSession, str], DataFrame]


class Tables:
    """The engine's tables over one data folder."""

    #: Data folder to the folder of its parsed tables, where they were written (see ``write_silver``).
    silver: dict[str, str] = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def _typed(self, name: str, derive: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
        folder = self.silver.get(self.sf_dir)
        return self.spark.read.parquet(f"{folder}/{name}") if folder else derive(self.spark, self.sf_dir)

    def write_silver(self, folder: str) -> None:
        """Parses the tables once; queries over this data folder then read them."""
        for name in ("hands", "events", "diagnostics", "observations"):
            getattr(self, name).write.mode("overwrite").parquet(f"{folder}/{name}")
        self.silver[self.sf_dir] = folder

    @property
    def hands(self) -> DataFrame:
        return self._typed("hands", testdata.hands)

    @property
    def events(self) -> DataFrame:
        return self._typed("events", testdata.action_events)

    @property
    def diagnostics(self) -> DataFrame:
        return self._typed("diagnostics", testdata.diagnostic_events)

    @property
    def observations(self) -> DataFrame:
        return self._typed("observations", testdata.observations)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def flat(df: DataFrame) -> DataFrame:
    """Output without nested or zone-dependent types: arrays joined with commas,
    times and intervals as text or seconds."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType):
            text = F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit("NULL")))
            c = F.when(c.isNotNull(), F.array_join(text, ","))
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(f.dataType, T.DayTimeIntervalType):
            c = F.extract(F.lit("SECOND"), c).cast("double") + 60 * (
                F.extract(F.lit("MINUTE"), c) + 60 * (
                    F.extract(F.lit("HOUR"), c) + 24 * F.extract(F.lit("DAY"), c)))
        elif isinstance(f.dataType, (T.MapType, T.StructType)):
            c = F.to_json(c)
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(fn: Callable[[Tables], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        fine_shuffles(spark)
        return flat(fn(Tables(spark, sf_dir)))

    return run


_HAND = f"""select *, cast(json(seats_json) as map(varchar, varchar)) as seats,
  cast(json(stacks_initial_json) as map(varchar, double)) as si,
  cast(json(stacks_final_json) as map(varchar, double)) as sf,
  cast(json(showdown_json) as map(varchar, varchar[])) as shown,
  cast(json(hero_cards_json) as varchar[]) as hero,
  cast(json(turn_cards_json) as varchar[]) as turn
from ({derivations.HANDS})"""
_EV = f"select *, hand_id || '-' || sequence_number as id from ({derivations.ACTION_EVENTS})"

PRELUDE = {"hand": _HAND, "ev": _EV, "diag": derivations.DIAGNOSTIC_EVENTS, "obs": derivations.OBSERVATIONS}


def sql(body: str, **extra: str) -> str:
    """Puts the derived tables a statement mentions in front of it."""
    ctes = {**PRELUDE, **extra}
    used = [n for n in ctes if re.search(rf"\b{n}\b", body) or any(
        re.search(rf"\b{n}\b", t) for k, t in extra.items() if k != n)]
    head = ",\n".join(f"{n} as ({ctes[n]})" for n in used)
    recursive = "recursive " if "recursive" in body else ""
    body = body.replace("with recursive ", "with ", 1) if recursive else body
    body = body.strip()
    copies = lambda m: f"cross join (select unnest(range(0, {m[1]})) as i) s"
    head, body = (re.sub(r"\bEACH_OF_(\d+)\b", copies, x) for x in (head, body))
    if not head:
        return body
    if body.startswith("with "):
        return f"with {recursive}{head},\n{body[5:]}"
    return f"with {recursive}{head}\n{body}"


TS = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"


def ts(expr: str) -> str:
    return TS.format(expr)


def rnd(expr: str, digits: int = 0) -> str:
    return f"cast(round(cast({expr} as decimal(38,10)), {digits}) as double)"
