"""History as of each event against a replay that inserts, purges and counts."""

import random

import pytest
from pyspark.sql import functions as F

from vigilake import schema
from vigilake.operators.rates import RateSpec
from vigilake.operators.retention import counts_as_of, history_as_of

KINDS = "event_id long, stage string, session_id string, timestamp double, value double, _other string, body string"


def replay(rows, window, max_age, max_rows, every):
    held, out = [], {}
    for n, r in enumerate(sorted((r for r in rows if r[3] is not None), key=lambda r: (r[3], r[0])), 1):
        held.append(r)
        if n % every == 0:
            held = [h for h in held if h[3] >= r[3] - max_age][-max_rows:]
        mine = [h for h in held if h[2] == r[2] and h[4] < 7 and (window is None or h[3] > r[3] - window)]
        out[r[0]] = (n, len(held), len(mine) if r[2] is not None else 0)
    return out


@pytest.mark.parametrize("window, max_age, max_rows, every", [(None, 1e9, 20, 7), (40, 30, 1000, 10), (25, 60, 35, 4), (None, 15, 9, 1)])
def test_equals_a_replay(spark, window, max_age, max_rows, every):
    r = random.Random(every)
    rows = [(i, "tool.before", r.choice(["hot", "hot", "a", None]), None if i % 31 == 0 else float(r.choice([50, r.randrange(300)])), float(r.randrange(9)), "x", None) for i in range(400)]
    df = spark.createDataFrame(rows, KINDS)
    spec = RateSpec(("session_id",), window, where="value < 7", name="x")
    got = {g.event_id: g for g in counts_as_of(df, spec, max_age, max_rows, every).collect()}
    assert len(got) == len(rows)
    want = replay(rows, window, max_age, max_rows, every)
    for i, g in got.items():
        if i in want:
            assert (g.arrival, g.arrival - g.oldest + 1, g.x) == want[i]
        else:
            assert (g.arrival, g.oldest, g.x) == (None, None, 0)
        assert g["_other"] == "x"


def test_empty_repeated_and_other_aggregates(spark):
    none = spark.createDataFrame([], KINDS)
    assert counts_as_of(none, RateSpec()).collect() == []
    same = spark.createDataFrame([(1, "tool.before", "s", 5.0, 1.0, "x", "b")] * 6, KINDS)
    got = sorted((g.arrival, g.cnt) for g in counts_as_of(same, RateSpec(), max_rows=2, every=3).collect())
    assert got == [(1, 1), (2, 2), (3, 2), (4, 3), (5, 4), (6, 2)]
    with pytest.raises(ValueError):
        counts_as_of(same, RateSpec(agg="sum", value="value"))


def test_no_task_holds_the_log(spark):
    """Neither numbering nor counting sorts all rows in one place: windows are by key and slice, but for a row a range."""
    events = schema.as_events(spark.range(500).select(F.col("id").alias("event_id"), F.lit("tool.before").alias("stage"), (F.col("id") / 3).alias("timestamp")))
    plan = history_as_of(events)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if " Window " in line]
    assert windows and all("_n" in line for line in windows)
