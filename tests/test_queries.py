"""Every query of the library's own operators against its SQL, on the smallest tables."""

import math
import os

import pytest

from pyspark.sql import functions as F

from vigilake.jobs import queries as jobs

SF = "/root/testdata/sf0.001"
TABLES = "events documents conversations pages".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    return (None if math.isnan(value) else round(value, 5)) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(jobs.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = jobs.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    found = duck.execute(jobs.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall()), key=repr)


def test_entry_module(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["event_id", "action", "reasons", "n_results"]


def test_hot_sessions_are_detected(spark, tmp_path):
    """Events of one session within a minute: the flagship and its like count them, and so does their SQL."""
    duckdb = pytest.importorskip("duckdb")
    import pandas as pd

    n = 240
    ts = pd.Timestamp("2024-01-01") + pd.to_timedelta([i * 200 for i in range(n)], unit="ms")
    rows = pd.DataFrame({"event_id": range(n), "ts": ts.astype("datetime64[us]"), "user_id": 1, "event_type": ["click", "error"] * (n // 2), "value": 1.0, "props": '{"k": 1}'})
    rows.to_parquet(tmp_path / "events.parquet", index=False)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    for name in ["a1_decisions", "s8_audit"]:
        df = jobs.queries()[name](spark, str(tmp_path))
        got = sorted((r.event_id, r.action, r.reasons, r.n_results) for r in df.collect())
        assert got == sorted(con.execute(f"SELECT event_id, action, reasons, n_results FROM ({jobs.oracle_sql()[name]})").fetchall())
        assert sum("tool call rate" in r[2] for r in got) > 20 and any(r[1] == "detect" and r[2].startswith("Unusually") for r in got)


def test_tables_of_few_row_groups_are_dealt_out_by_rows(spark, tmp_path, monkeypatch):
    """A task of events, and of rates, has so many rows, however large the table."""
    from vigilake.jobs import agent_log
    from vigilake.operators.rates import RateSpec, trailing

    monkeypatch.setattr(agent_log, "TASK_ROWS", 500, raising=False)
    spark.range(10_000).selectExpr("id AS event_id", "'a' AS session_id", "CAST(id AS double) AS timestamp").coalesce(1).write.parquet(f"{tmp_path}/t")
    dealt = agent_log.spread(spark.read.parquet(f"{tmp_path}/t"))
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 20 and max(sizes) < 1000
    rated = trailing(dealt, RateSpec(("session_id",), 100), partitions=agent_log.tasks(dealt))
    assert rated.rdd.getNumPartitions() == 20
    assert {r.cnt for r in rated.filter("event_id >= 99").collect()} == {100}


def test_verdicts_are_results_without_evidence(spark):
    from vigilake import schema
    from vigilake.operators.chain import evaluate
    from vigilake.rules.pack import rule_pack

    rows = [(i, "tool.before", "s", float(i), "exec", c) for i, c in enumerate(['{"command":"rm -rf /"}', '{"command":"ls"}', '{"command":"printenv"}'] * 25)]
    df = schema.as_events(spark.createDataFrame(rows, "event_id long, stage string, session_id string, timestamp double, tool_name string, tool_args string"))
    bare = lambda r: [x.asDict() | {"match": None, "redacted": None, "keyword": None} for x in r.results]
    whole, lean = ({r.event_id: (r.action, r.reasons, r.n_results, bare(r)) for r in evaluate(df, list(rule_pack()), details=d).collect()} for d in (True, "verdicts"))
    assert whole == lean and any(r[1] for r in whole.values())
