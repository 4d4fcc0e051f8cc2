"""Split windows and piecewise folds against one pass in order."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from railbird.functions import steps
from railbird.functions.ordered import block_split, carried_fold, numbered, running, shifted
from railbird.operators import hand_audits
from railbird.operators.derive import ddl


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(7)
    # One key holds most rows; some values and some order keys are missing.
    data = [("hot" if rnd.random() < 0.7 else f"k{rnd.randrange(5)}", rnd.randrange(300) if rnd.random() < 0.97 else None,
             i, float(rnd.randrange(50)) if rnd.random() < 0.9 else None) for i in range(1500)]
    return spark.createDataFrame(data, "k string, t int, id int, v double").cache()


def same(a, b, cols):
    left, right = a.select(*cols), b.select(*cols)
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def window(*keys):
    return Window.partitionBy(*keys).orderBy(F.asc_nulls_last("t"), F.asc_nulls_last("id"))


@pytest.mark.parametrize("keys", [[], ["k"]])
@pytest.mark.parametrize("forward", [False, True])
def test_shifted_equals_plain_window(rows, keys, forward):
    got = shifted(rows, keys, ["t", "id"], {"pid": F.col("id"), "pv": F.col("v")}, split=block_split("t", 20), forward=forward)
    step = F.lead if forward else F.lag
    want = rows.select("*", step("id").over(window(*keys)).alias("pid"), step("v").over(window(*keys)).alias("pv"))
    assert same(got, want, ["id", "pid", "pv"])


@pytest.mark.parametrize("inclusive", [False, True])
def test_running_equals_plain_window(rows, inclusive):
    kinds = {"s": "sum", "x": "max", "n": "min", "c": "count", "l": "last"}
    got = running(rows, ["k"], ["t", "id"], {n: (k, F.col("v")) for n, k in kinds.items()},
                  split=block_split("t", 20), inclusive=inclusive)
    w = window("k").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    want = rows.select("*", F.sum("v").over(w).alias("s"), F.max("v").over(w).alias("x"), F.min("v").over(w).alias("n"),
                       F.count("v").over(w).alias("c"), F.last("v", ignorenulls=True).over(w).alias("l"))
    assert same(got, want, ["id", *kinds])


def test_numbered(rows):
    got = numbered(rows, ["k"], ["t", "id"], "n", split=block_split("t", 20))
    assert same(got, rows.select("*", F.row_number().over(window("k")).cast("long").alias("n")), ["id", "n"])


@pytest.mark.parametrize("rule", [steps.Debounce(0.00001), steps.StackJump(3), steps.PotMonotone()], ids=lambda r: type(r).__name__)
def test_fold_equals_loop(rows, rule):
    key = F.when(F.col("k") != "k0", F.col("k")).alias("k")  # one key is missing
    df = rows.where("t is not null").select(key, "t", "id", F.col("v").alias("value"), F.col("t").cast("long").alias("at"))
    got = carried_fold(df, ["k"], ["t", "id"], step=rule, state_schema=rule.state,
                       output_schema=ddl(df, extra=rule.extra))
    extra = [c.split()[0] for c in rule.extra.split(", ")]
    states, want = {}, []
    fields = [f.split()[0] for f in rule.state.split(", ")]
    for row in sorted((r.asDict() for r in df.collect()), key=lambda r: (str(r["k"]), r["t"], r["id"])):
        want += rule(states.setdefault(row["k"], dict.fromkeys(fields)), row)
    pick = lambda r: tuple(r[c] for c in ["id", *extra])
    assert sorted(map(pick, (r.asDict() for r in got.collect())), key=str) == sorted(map(pick, want), key=str)


def test_cross_hand_windows_stay_distributed(spark):
    """Only one row per time split may meet in a single task."""
    hands = spark.createDataFrame([], """id bigint, table_name string, started_at timestamp, pot_size_final double,
        stacks_initial map<string,double>, stacks_final map<string,double>""")
    for audit in (hand_audits.stack_continuity, hand_audits.stack_cross_hand):
        plan = audit(hands)._jdf.queryExecution().executedPlan().toString()
        for line, deeper in zip(plan.splitlines(), plan.splitlines()[1:]):
            if "SinglePartition" in line:
                assert "HashAggregate" in deeper or "SortAggregate" in deeper or "Aggregate" in deeper or "LocalTableScan" in deeper, plan
