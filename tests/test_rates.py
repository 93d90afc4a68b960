"""Trailing rates against a replay, and the streaming ones against the batch."""

import json
import random

import pytest
from pyspark.sql import functions as F

from vigilake import schema
from vigilake.operators.chain import evaluate
from vigilake.operators.rate_queries import recognise
from vigilake.operators.rates import RateSpec, threshold, trailing
from vigilake.rules.loader import rule_from
from vigilake.rules.model import Evaluator
from vigilake.sources import events as sources
from vigilake.sources import traffic
from vigilake.streaming import scoring


def log(spark, n=300, seed=5):
    r = random.Random(seed)
    rows = [(i, "tool.before", r.choice(["", "a", "b"]), float(r.randrange(0, 400)), r.choice([None, "exec", "read"]), float(r.randrange(9))) for i in range(n)]
    return rows, schema.as_events(spark.createDataFrame(rows, "event_id long, stage string, session_id string, timestamp double, tool_name string, value double"))


@pytest.mark.parametrize("bucketed", [False, True])
@pytest.mark.parametrize("keys", [("session_id",), ("session_id", "tool_name")])
def test_counts_equal_a_replay(spark, bucketed, keys):
    rows, df = log(spark)
    got = {r.event_id: r.cnt for r in trailing(df, RateSpec(keys, 60), bucketed=bucketed).collect()}
    at = {"session_id": 2, "tool_name": 4}
    for r in rows:
        mine = [x for x in rows if all(x[at[k]] == r[at[k]] for k in keys) and r[3] - 60 < x[3] and (x[3], x[0]) <= (r[3], r[0])]
        assert got[r[0]] == (0 if any(r[at[k]] is None for k in keys) else len(mine))


def test_other_aggregates(spark):
    rows, df = log(spark, 120)
    got = {r.event_id: r for r in trailing(trailing(df, RateSpec(("session_id",), 50, "max", "value", name="m")), RateSpec(("session_id",), 50, "avg", "value", name="a")).collect()}
    for r in rows:
        before = [x[5] for x in rows if x[2] == r[2] and r[3] - 50 < x[3] and (x[3], x[0]) <= (r[3], r[0])]
        assert got[r[0]].m == max(before) and got[r[0]].a == pytest.approx(sum(before) / len(before))


@pytest.mark.parametrize("window", [50, None])
@pytest.mark.parametrize("bucketed", [False, True])
def test_all_aggregates_equal_a_replay(spark, window, bucketed):
    rows, df = log(spark, 150, 8)
    df = df.withColumn("timestamp", F.col("timestamp") * 40 if window is None else F.col("timestamp"))
    scale = 40 if window is None else 1
    for agg, value in [("count", None), ("sum", "value"), ("avg", "value"), ("min", "value"), ("max", "value"), ("distinct", "tool_name")]:
        got = {r.event_id: r.x for r in trailing(df, RateSpec(("session_id",), window, agg, value, where="value < 7", name="x"), bucketed=bucketed).collect()}
        assert len(got) == len(rows)
        for r in rows:
            past = [x for x in rows if x[2] == r[2] and (x[3], x[0]) <= (r[3], r[0]) and (window is None or r[3] - window < x[3]) and x[5] < 7]
            upto = [x[5] for x in past]
            want = {"count": len(upto), "sum": sum(upto), "avg": sum(upto) / len(upto) if upto else None, "min": min(upto, default=None), "max": max(upto, default=None), "distinct": len({x[4] for x in past} - {None})}[agg]
            assert got[r[0]] == (want if want is None else pytest.approx(want)), (agg, r, scale)


def test_one_session_of_half_the_events(spark):
    """The busy session is dealt out over many partitions; rows without any key too."""
    n = 4000
    df = schema.as_events(spark.range(n).select(F.col("id").alias("event_id"), F.lit("tool.before").alias("stage"), F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("session_id"), (F.col("id") / 4.0).alias("timestamp"), F.lit(None).cast("string").alias("tool_name")))
    got = trailing(df, RateSpec(("session_id",), 60)).filter("session_id = 'hot'")
    assert got.agg(F.max("cnt")).first()[0] == 120
    assert "_slice" in got._jdf.queryExecution().executedPlan().toString()
    assert {r.cnt for r in trailing(df, RateSpec(("tool_name",), 60)).collect()} == {0}


def test_thresholds(spark):
    n = {"cnt": F.lit(15)}
    row = spark.range(1).select(*[threshold(c, n).alias(str(i)) for i, c in enumerate(["cnt > 10", "cnt > 20", "cnt >= 15", "cnt == 15", "cnt != 10", "cnt ~ 1", "no > -1"])]).first()
    assert list(row) == [True, False, True, True, True, False, True]


def test_queries_of_the_known_shape():
    spec = recognise("SELECT COUNT(*) as cnt FROM events WHERE session_id = :session_id AND tool_name = :tool_name AND timestamp > :now - 300", "cnt > 20")
    assert spec == RateSpec(("session_id", "tool_name"), 300.0, "count", None, None, "cnt", "cnt > 20")
    for bad in ("SELECT 1", "SELECT COUNT(*) AS n FROM events WHERE session_id = :user_id", "SELECT COUNT(*) AS n FROM events WHERE tool_name <> :tool_name", "SELECT SUM(value) + 1 AS n FROM events WHERE value > 1", "SELECT MAX(CASE WHEN value > 1 THEN 1 END) AS n FROM events WHERE value > 1", "SELECT COUNT(*) AS n FROM events WHERE value > (SELECT 1)", "SELECT COUNT(*) AS n FROM events WHERE upper(tool_name) = 'X'", "SELECT COUNT(*) AS n FROM events WHERE value > 1 AND", "SELECT COUNT(*) AS n FROM other WHERE session_id = :session_id"):
        with pytest.raises(ValueError):
            recognise(bad, "n > 1")


def test_blocked_events_are_no_history(spark):
    stop = Evaluator("stop", "regex", ("tool.before",), (rule_from({"id": "x", "title": "X", "pattern": "rm", "action": "block"}, "regex"),))
    burst = Evaluator("burst", "sql", ("tool.before",), (rule_from({"id": "b", "title": "B", "action": "block", "query": "SELECT COUNT(*) AS cnt FROM events WHERE session_id = :session_id", "condition": "cnt > 3"}, "sql"),))
    rows = [(i, "tool.before", "s", 1.0, "exec", json.dumps({"command": "rm" if i == 1 else "ls"})) for i in range(5)]
    df = schema.as_events(spark.createDataFrame(rows, "event_id long, stage string, session_id string, timestamp double, tool_name string, tool_args string"))
    assert [r.action for r in evaluate(df, [burst, stop]).orderBy("event_id").collect()] == ["allow", "block", "allow", "allow", "block"]


def test_stream_equals_batch_in_order(spark, tmp_path):
    rows, df = log(spark, 60)
    df = df.withColumn("timestamp", F.col("timestamp") + 1000)  # the first watermark is the epoch
    df.withColumn("tool_result", F.lit(None).cast("string")).orderBy("timestamp", "event_id").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = sources.with_event_time(spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in")))
    q = scoring.rate_rule_stream(stream).writeStream.format("memory").queryName("rates").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.event_id: r.cnt for r in spark.table("rates").collect()}
    assert got == {r.event_id: r.cnt for r in trailing(df, RateSpec(("session_id",), 60)).collect()}


def test_stream_of_decisions_and_audit(spark, tmp_path):
    lines = [json.dumps({"event_id": 1, "stage": "tool.before", "timestamp": 1.0, "tool_name": "exec", "tool_args": {"command": "rm -rf /"}}), json.dumps({"event_id": 2, "stage": "odd"}), "no json", json.dumps({"event_id": 3, "stage": "tool.after", "timestamp": 2.0, "tool_result": {"a": 1}})]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "log.jsonl").write_text("\n".join(lines))
    events, rejects = sources.read_events(spark, str(tmp_path / "in"))
    assert events.count() == 2 and rejects.count() == 2
    assert {r.event_id: r.tool_result_is_string for r in events.collect()} == {1: False, 3: False}
    odd = ['{"stage":"tool.after","tool_args":{"tool_result":"y"},"tool_result":{"a":1},"params":{"p":2},"raw":{}}', '{"stage":"tool.after","tool_result":"s"}', '{"stage":"tool.after","tool_result":null}']
    got = [sources.parse_events(spark.createDataFrame([(x,) for x in odd], "value string"), 0.0)[0].collect() for _ in range(2)]
    assert got[0] == got[1] and len({r.event_id for r in got[0]}) == 3 and None not in {r.event_id for r in got[0]}
    assert [(r.tool_result, r.tool_result_is_string) for r in got[0]] == [('{"a":1}', False), ("s", True), (None, False)] and got[0][0].params == '{"p":2}'
    from vigilake.rules.pack import category

    decided = scoring.evaluate_stream(sources.read_events_stream(spark, str(tmp_path / "in")), category("dangerous_commands"))
    scoring.write_audit_stream(decided, str(tmp_path / "audit"), str(tmp_path / "cp"), str(tmp_path / "alerts")).awaitTermination(120)
    assert sorted(json.loads(r.value)["action"] for r in spark.read.text(str(tmp_path / "audit")).collect()) == ["allow", "block"]
    assert spark.read.json(str(tmp_path / "alerts")).count() == 1


def test_streamed_calls(spark, tmp_path):
    start, part, stop = '{"type":"content_block_start","content_block":{"type":"tool_use","name":"n"}}', '{"type":"content_block_delta","delta":{"type":"input_json_delta","partial_json":"%s"}}', '{"type":"content_block_stop"}'
    data = [start, part % '{\\"a\\":', part % "1}", stop, '{"type":"content_block_start","content_block":{"type":"text"}}', stop, start, part % "broken", stop, start]
    df = spark.createDataFrame([(1, i, d) for i, d in enumerate(data)], "stream_id long, seq int, data string")
    got = traffic.assemble_tool_calls(df).orderBy("block").select("block", "tool_name", "tool_args").collect()
    assert [tuple(r) for r in got] == [(0, "n", '{"a":1}'), (1, "n", "{}")]
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = scoring.assemble_tool_calls_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("calls").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.block, r.tool_args) for r in spark.table("calls").collect()) == [(0, '{"a":1}'), (1, "{}")]


def test_rewritten_responses_keep_their_fields(spark):
    body = {"id": "m1", "model": "x", "usage": {"in": 1.5, "out": [1, None]}, "stop_reason": "tool_use", "content": [{"type": "text", "text": "so \"é\""}, {"type": "tool_use", "id": "a", "name": "n", "input": {"k": [1, {"z": None}]}}, {"type": "tool_use", "id": "b", "name": "m", "input": {}}]}
    odd = '{"content" : "plain", "stop_reason":"tool_use"}'
    rows = [(1, json.dumps(body)), (2, json.dumps(body)), (3, json.dumps(body)), (4, odd), (5, "no json")]
    bad = [(1, 1, "n", True, ["r1", "r2"]), (1, 2, "m", True, []), (2, 2, "m", True, ["r"]), (2, 1, "n", False, []), (4, 0, "n", True, ["r"])]
    got = {r.response_id: r.body for r in traffic.rewrite_responses(spark.createDataFrame(rows, "response_id long, body string"), spark.createDataFrame(bad, "response_id long, pos int, tool_name string, blocked boolean, reasons array<string>")).collect()}
    text = lambda n, why, how="Tool call '%s' was blocked": {"type": "text", "text": f"[SECURITY] {how % n}: {why}"}
    assert json.loads(got[1]) == body | {"stop_reason": "end_turn", "content": [body["content"][0], text("n", "r1; r2"), text("m", "Blocked by security policy")]}
    assert json.loads(got[2]) == body | {"content": [*body["content"][:2], text("m", "r")]}
    assert got[3] == rows[2][1] and got[4] == odd and got[5] == "no json"
    calls = spark.createDataFrame([("s", 0, 3, "n", True, ['a "b"'])], "stream_id string, block int, index int, tool_name string, blocked boolean, reasons array<string>")
    records = [json.loads(r.data) for r in traffic.replaced_records(calls).orderBy("nth").collect()]
    assert [r["type"] for r in records] == ["content_block_start", "content_block_delta", "content_block_stop"] and {r["index"] for r in records} == {3}
    assert records[1]["delta"] == {"type": "text_delta", "text": "[SECURITY] Tool 'n' blocked: a \"b\""}


def test_stream_of_rate_decisions(spark, tmp_path):
    stop = Evaluator("stop", "regex", ("tool.before",), (rule_from({"id": "x", "title": "X", "pattern": "rm", "action": "block"}, "regex"),))
    rule = rule_from({"id": "b", "title": "B", "action": "block", "query": "SELECT COUNT(*) AS cnt FROM events WHERE session_id = :session_id AND timestamp > :now - 60", "condition": "cnt > 2"}, "sql")
    both = [stop, Evaluator("burst", "sql", ("tool.before",), (rule,))]
    rows = [(i, "tool.before", "s", 1000.0 + i, "exec", json.dumps({"command": "rm" if i == 1 else "ls"}), None) for i in range(6)]
    df = schema.as_events(spark.createDataFrame(rows, "event_id long, stage string, session_id string, timestamp double, tool_name string, tool_args string, tool_result string"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = sources.with_event_time(spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in")))
    q = scoring.rate_decisions_stream(stream, both, rule).writeStream.format("memory").queryName("decided").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.event_id: r.action for r in spark.table("decided").collect()}
    assert got == {r.event_id: r.action for r in evaluate(df, both).collect() if r.event_id != 1} and got[5] == "block" and got[2] == "allow"


def test_gate(spark):
    d = spark.createDataFrame([(1, 0, 0, False), (1, 1, 0, True), (1, 1, 1, False), (1, 2, 0, False), (2, 0, 0, False), (2, 2, 0, True), (2, 2, 1, False)], "request_id long, step int, pos int, blocked boolean")
    assert sorted((r.request_id, r.step, r.pos) for r in traffic.gate_traffic(d).collect()) == [(1, 0, 0), (1, 1, 0), (2, 0, 0), (2, 2, 0), (2, 2, 1)]
    assert [r.request_id for r in traffic.forwarded(d.select("request_id").distinct(), d).collect()] == [2]


def test_events_without_times_and_equal_lines(spark, tmp_path):
    """Lines without a time have their file's, or the one given; equal lines are events of their own; every event counts itself."""
    line = json.dumps({"stage": "tool.before", "session_id": "s", "tool_name": "exec", "tool_args": {"command": "ls"}})
    (tmp_path / "a.jsonl").write_text("\n".join([line] * 3 + [json.dumps({"stage": "odd"})]))
    (tmp_path / "b.jsonl").write_text("\n".join([line] * 2 + [json.dumps({"stage": "tool.before", "session_id": "s", "timestamp": 7.5, "event_id": 9})]))
    for arrived in (None, 1000.0):
        e, rejects = sources.read_events(spark, str(tmp_path), arrived)
        rows = trailing(e, RateSpec(("session_id",), 60)).collect()
        assert len({r.event_id for r in rows}) == 6 and rejects.count() == 1
        assert min(r.cnt for r in rows) == 1 and all(r.timestamp is not None for r in rows)
        assert sorted(r.cnt for r in rows) == ([1, 1, 2, 3, 4, 5] if arrived else sorted(r.cnt for r in rows))
    e, _ = sources.parse_events(spark.createDataFrame([(line,)] * 4, "value string"), 5.0)
    assert sorted(r.cnt for r in trailing(e, RateSpec(("session_id",), 60)).collect()) == [1, 2, 3, 4]


def test_null_times_are_nobody_s_history(spark):
    rows = [(i, "tool.before", "s", None if i % 2 else float(i), None, 1.0) for i in range(10)]
    df = schema.as_events(spark.createDataFrame(rows, "event_id long, stage string, session_id string, timestamp double, tool_name string, value double"))
    for window in (60, None):
        got = {r.event_id: r.cnt for r in trailing(df, RateSpec(("session_id",), window)).collect()}
        assert got == {i: 0 if i % 2 else i // 2 + 1 for i in range(10)}


@pytest.mark.parametrize("seed", range(3))
def test_rates_of_many_equal_times(spark, seed):
    """Few distinct times, half of the events in one session: every aggregate equals a replay in the order of (time, id)."""
    r = random.Random(seed)
    rows = [(i, "tool.before", r.choice(["hot", "hot", "a", ""]), float(r.randrange(-8, 30)), r.choice([None, "exec", "read", "write"]), r.choice([0.1, 0.2, 0.3, -7.0])) for i in range(250)]
    df = schema.as_events(spark.createDataFrame(rows, "event_id long, stage string, session_id string, timestamp double, tool_name string, value double"))
    aggs = {"count": None, "sum": "value", "avg": "value", "min": "value", "max": "value", "distinct": "tool_name"}
    from vigilake.operators.rates import trailing_many

    specs = {f"{a}{w}": RateSpec(keys, w, a, v, name=a) for a, v in aggs.items() for w, keys in ((7, ("session_id",)), (3, ("session_id", "tool_name")))}
    got = {row.event_id: row for row in trailing_many(df, specs).collect()}
    assert len(got) == len(rows)
    for e in rows:
        for name, s in specs.items():
            past = [x for x in rows if x[2] == e[2] and (len(s.keys) == 1 or x[4] == e[4]) and e[3] - s.window < x[3] and (x[3], x[0]) <= (e[3], e[0])]
            values = [x[5] for x in past]
            want = {"count": len(past), "sum": sum(values), "avg": sum(values) / len(values), "min": min(values), "max": max(values), "distinct": len({x[4] for x in past} - {None})}[s.agg]
            if len(s.keys) == 2 and e[4] is None:
                want = 0 if s.agg in ("count", "distinct") else None
            assert got[e[0]][name] == (want if want is None else pytest.approx(want, abs=1e-12)), (name, e)


def test_rules_of_one_evaluator_share_an_exchange(spark):
    """Half the events in one session: one exchange serves both rules of the pack and carries no text."""
    from vigilake.rules.pack import rule_pack

    n = 400
    at = spark.range(n).select(F.col("id").alias("event_id"), F.lit("tool.before").alias("stage"), F.when(F.col("id") % 2 == 0, "hot").otherwise(F.col("id").cast("string")).alias("session_id"), (F.col("id") / 4.0).alias("timestamp"), F.lit("exec").alias("tool_name"), F.lit('{"command":"ls"}').alias("tool_args"))
    decided = evaluate(schema.as_events(at), list(rule_pack())).select("event_id", "action", "reasons", "n_results")
    plan = decided._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(exchanges) == 1 and "_slice" in exchanges[0]
    below = plan[plan.index("Exchange hashpartitioning") :].splitlines()[1]
    assert "Project" in below and not any(c in below for c in ("_text", "tool_args", "message_text", "tool_result", "results"))
    assert decided.filter("action = 'detect'").count() == n // 2 - 20


@pytest.mark.parametrize(
    "query, agg, test",
    [
        ("SELECT COUNT(*) AS n FROM events WHERE session_id = :session_id AND tool_name = 'exec' AND timestamp > :now - 60", "count", lambda tool, v: tool == "exec"),
        ("SELECT SUM(CASE WHEN value >= 4 THEN 1 ELSE 0 END) AS n FROM events WHERE session_id = :session_id AND timestamp > :now - 60", "count", lambda tool, v: v >= 4),
        ("SELECT COUNT(*) FILTER (WHERE value < 4 OR tool_name IS NULL) AS n FROM events WHERE session_id = :session_id AND timestamp > :now - 60;", "count", lambda tool, v: v < 4 or tool is None),
        ("SELECT MAX(value) AS n FROM events WHERE session_id = :session_id AND (tool_name IN ('read', 'it''s') OR NOT value <> 8) AND timestamp > :now - 60", "max", lambda tool, v: tool == "read" or v == 8),
        ("SELECT COUNT(DISTINCT value) AS n FROM events WHERE session_id = :session_id AND tool_name LIKE 'EX%' AND value > -1 AND timestamp > :now - 60", "distinct", lambda tool, v: (tool or "").startswith("ex")),
    ],
)
def test_tests_in_queries(spark, query, agg, test):
    rows, df = log(spark, 120)
    spec = recognise(query, "n > 1")
    assert spec.agg == agg and spec.keys == ("session_id",) and spec.window == 60
    got = {r.event_id: r.n for r in trailing(df, spec).collect()}
    for r in rows:
        past = [x[5] for x in rows if x[2] == r[2] and r[3] - 60 < x[3] and (x[3], x[0]) <= (r[3], r[0]) and test(x[4], x[5])]
        assert got[r[0]] == {"count": len(past), "max": max(past, default=None), "distinct": len(set(past))}[agg]
