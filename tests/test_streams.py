"""Streams: rates against the batch, whole packs with late events, deliveries that break off, held records."""

import json
import random

import pytest
from pyspark.sql import functions as F

from vigilake import schema
from vigilake.operators.chain import evaluate
from vigilake.operators.rates import RateSpec, trailing_many
from vigilake.rules.loader import rule_from
from vigilake.rules.model import Evaluator
from vigilake.sources import events as sources
from vigilake.streaming import scoring

EVENT = "event_id long, stage string, session_id string, timestamp double, tool_name string, value double"
NOW = {"availableNow": True}


def feed(spark, place, rows, kinds=EVENT):
    """One more file of a stream, with ``rows``; and the stream."""
    df = schema.as_events(spark.createDataFrame(rows, kinds)) if kinds is EVENT else spark.createDataFrame(rows, kinds)
    df.coalesce(1).write.mode("append").parquet(f"{place}/in")
    return spark.readStream.schema(df.schema).parquet(f"{place}/in")


def drain(stream, place, name="out"):
    q = stream.writeStream.format("parquet").option("path", f"{place}/{name}").option("checkpointLocation", f"{place}/{name}-state").trigger(**NOW).start()
    q.awaitTermination()
    return q


AGGREGATES = {"count": None, "sum": "value", "avg": "value", "min": "value", "max": "value", "distinct": "tool_name"}


@pytest.mark.parametrize("agg", AGGREGATES)
def test_rates_on_a_stream_equal_the_batch(spark, tmp_path, agg):
    r = random.Random(3)
    rows = sorted(((i, "tool.before", r.choice([None, "hot", "hot", "a"]), float(r.randrange(1, 95)), r.choice([None, "exec", "read"]), float(r.randrange(9))) for i in range(200)), key=lambda x: (x[3], x[0]))
    spec = RateSpec(("session_id", "channel") if agg == "count" else ("session_id",), 20, agg, AGGREGATES[agg], where="value < 7", name="x")
    want = {}
    for part in (rows[:120], rows[120:]):  # in two runs, in order of time
        stream = feed(spark, str(tmp_path), part)
        stream = stream.withColumn("session_id", F.nullif("session_id", F.lit("")))
        drain(scoring.rate_stream(sources.with_event_time(stream), spec, "1 hour"), str(tmp_path))
    whole = spark.read.parquet(f"{tmp_path}/in").withColumn("session_id", F.nullif("session_id", F.lit("")))
    want = {x.event_id: x.x for x in trailing_many(whole, {"x": spec}).collect()}
    got = {x.event_id: x.x for x in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got.keys() == want.keys()
    assert all(got[i] == (want[i] if want[i] is None else pytest.approx(want[i])) for i in want)


def test_idle_keys_are_forgotten(spark, tmp_path):
    spec, place = RateSpec(("session_id",), 60), str(tmp_path)
    held = []
    for at in ([float(i) for i in range(50)], [10_000.0], [20_000.0], [30_000.0]):
        stream = feed(spark, place, [(int(t), "tool.before", f"s{i % 10}" if t < 100 else "late", t, "exec", 1.0) for i, t in enumerate(at)])
        q = drain(scoring.rate_stream(sources.with_event_time(stream), spec, "1 second"), place)
        held.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert held[0] >= 10 and held[-1] <= 4


def rated():
    """A rule without history that blocks, and two of rates, one of a sum."""
    stop = Evaluator("stop", "regex", ("tool.before",), (rule_from({"id": "x", "title": "x", "pattern": "rm", "action": "block"}, "regex"),))
    specs = [{"keys": ("session_id",), "window": 30, "condition": "cnt > 3"}, {"keys": ("session_id",), "window": 10, "agg": "sum", "value": "value", "name": "total", "condition": "total >= 3"}]
    rules = [rule_from({"id": f"r{i}", "title": f"r{i}", "rate": s, "action": "detect"}, "sql") for i, s in enumerate(specs)]
    return [stop, Evaluator("rates", "sql", ("tool.before",), tuple(rules))]


def test_decisions_of_a_stream_with_late_events(spark, tmp_path):
    """Two runs in order and one of late events: on time as the batch says, late ones by rules without history; a batch that is run again says the same."""
    place = str(tmp_path)
    r = random.Random(1)
    rows = [(i, "tool.before", r.choice("ab"), float(i), "exec", float(r.randrange(3))) for i in range(60)]
    late = [(100 + i, "tool.before", "a", float(i), "rm", 1.0) for i in range(5)]

    def deliver(decided, n):
        decided.select("event_id", "action", "late", F.array_join("reasons", ";").alias("why")).write.mode("overwrite").parquet(f"{place}/out/batch={n}")

    for part in (rows[:40], rows[40:], late):
        stream = feed(spark, place, [(*x[:4], x[4], x[5]) for x in part])
        scoring.decide_stream(stream, rated(), deliver, f"{place}/history", f"{place}/state", lateness_s=5).awaitTermination()
    got = {x.event_id: (x.action, x.why) for x in spark.read.parquet(f"{place}/out").filter("not late").collect()}
    df = schema.as_events(spark.createDataFrame(rows, EVENT))
    want = {x.event_id: (x.action, ";".join(x.reasons)) for x in evaluate(df, rated()).collect()}
    assert got == want and any(a == "detect" for a, _ in want.values())
    assert {x.event_id: x.action for x in spark.read.parquet(f"{place}/out").filter("late").collect()} == {x[0]: "allow" for x in late}
    marks = {x.batch: (x.newest, x.late) for x in spark.read.parquet(*[f"{place}/history/marks/batch={n}" for n in range(3)]).collect()}
    assert marks == {0: (39.0, 0), 1: (59.0, 0), 2: (59.0, 5)}
    # batch 1 again, as after a failure before its end was noted
    again = {}
    batch = schema.as_events(spark.createDataFrame(rows[40:], EVENT))
    history = scoring._History(f"{place}/history", rated(), 5)
    scoring.decide_batch(batch, 1, rated(), history, lambda d, n: again.update({x.event_id: (x.action, ";".join(x.reasons)) for x in d.collect()}))
    assert again == {x[0]: want[x[0]] for x in rows[40:]}


def test_old_history_is_removed(spark, tmp_path):
    place = str(tmp_path)
    for at in (0.0, 1000.0, 2000.0):
        stream = feed(spark, place, [(int(at) + i, "tool.before", "a", at + i, "exec", 1.0) for i in range(4)])
        scoring.decide_stream(stream, rated(), lambda d, n: d.count(), f"{place}/history", f"{place}/state", lateness_s=5).awaitTermination()
    assert sorted(p.name for p in (tmp_path / "history" / "events").iterdir() if not p.name.startswith(".")) == ["batch=1", "batch=2"]
    with pytest.raises(ValueError, match="bounded"):
        scoring._History(place, [Evaluator("e", "sql", ("tool.before",), (rule_from({"id": "r", "title": "r", "rate": {"window": None}}, "sql"),))], 5)


def test_a_delivery_that_breaks_off_is_made_once_more(spark, tmp_path):
    """The first run fails after its delivery was half done; the second delivers, a third, of the same batch, doesn't."""
    place, got = str(tmp_path), []
    stream = feed(spark, place, [(1, "tool.before", "a", 1.0, "exec", 1.0), (2, "tool.before", "a", 2.0, "rm", 1.0)])
    decided = scoring.evaluate_stream(stream.withColumn("tool_args", F.to_json(F.struct(F.col("tool_name").alias("command")))), rated())

    def deliver(alerts, n, fail=False):
        if fail:
            raise RuntimeError("receiver is away")
        got.append((n, [r.action for r in alerts.collect()]))

    with pytest.raises(Exception, match="receiver is away"):
        scoring.deliver_alerts_stream(decided, lambda a, n: deliver(a, n, True), f"{place}/ledger", f"{place}/state").awaitTermination()
    scoring.deliver_alerts_stream(decided, deliver, f"{place}/ledger", f"{place}/state").awaitTermination()
    assert got == [(0, ["block"])]
    # the stream's own notes lost: the batch comes again, the ledger knows it
    scoring.deliver_alerts_stream(decided, deliver, f"{place}/ledger", f"{place}/other-state").awaitTermination()
    assert got == [(0, ["block"])]


def test_a_stream_goes_on_with_another_trigger(spark, tmp_path):
    place = str(tmp_path)
    stream = feed(spark, place, [(1, "tool.before", "a", 1.0, "exec", 1.0)])
    q = scoring.write_audit_stream(scoring.evaluate_stream(stream, rated()), f"{place}/audit", f"{place}/state", trigger={"processingTime": "0 seconds"})
    try:
        q.processAllAvailable()
        feed(spark, place, [(2, "tool.before", "a", 2.0, "exec", 1.0)])
        q.processAllAvailable()
        assert q.isActive and spark.read.text(f"{place}/audit").count() == 2
    finally:
        q.stop()


def record(kind, **more):
    return json.dumps({"type": kind, **more})


def test_held_records_and_state_of_calls(spark, tmp_path):
    """A call over two runs is held until it ends; a message that stops leaves no state behind."""
    start = record("content_block_start", index=3, content_block={"type": "tool_use", "name": "exec"})
    part = lambda t: record("content_block_delta", delta={"type": "input_json_delta", "partial_json": t})
    stop, text, end = record("content_block_stop"), record("content_block_delta", delta={"type": "text_delta", "text": "hi"}), record("message_stop")
    runs = [[("a", 0, text), ("a", 1, start), ("a", 2, part('{"command":')), ("b", 0, start), ("b", 1, part('{"command":"ls"}'))], [("a", 3, part('"rm x"}')), ("a", 4, stop), ("b", 2, stop)], [("a", 5, text), ("a", 6, end), ("b", 3, end)]]
    place, kinds, states = str(tmp_path), "stream_id string, seq int, data string", []
    for run in runs:
        stream = feed(spark, place, run, kinds)
        scoring.rewrite_stream(stream, rated()[:1], lambda rows, n: rows.write.mode("overwrite").parquet(f"{place}/out/batch={n}"), f"{place}/held", f"{place}/state").awaitTermination()
        states.append(drain(scoring.assemble_tool_calls_stream(stream), place, "calls").lastProgress["stateOperators"][0]["numRowsTotal"])
    rows = spark.read.parquet(f"{place}/out").orderBy("stream_id", "seq", "nth").collect()
    assert [(r.stream_id, r.seq, json.loads(r.data)["type"]) for r in rows if r.batch == 0] == [("a", 0, "content_block_delta")]
    assert [r.data for r in rows if r.stream_id == "b"] == [start, part('{"command":"ls"}'), stop, end]
    a = [json.loads(r.data) for r in rows if r.stream_id == "a"]
    assert [x["type"] for x in a] == ["content_block_delta", "content_block_start", "content_block_delta", "content_block_stop", "content_block_delta", "message_stop"]
    assert a[2]["delta"]["text"].startswith("[SECURITY] Tool 'exec' blocked: ") and a[1]["index"] == 3
    calls = {(r.stream_id, r.tool_args) for r in spark.read.parquet(f"{place}/calls").collect()}
    assert calls == {("a", '{"command":"rm x"}'), ("b", '{"command":"ls"}')}
    assert states[0] > 0 and states[-1] == 0


DECIDED = "request_id long, step int, pos int, event_id long, action string, reasons array<string>, blocked boolean, event_time timestamp"


def gate(spark, place, decided, own, name):
    """One run of the gate over what has come by now."""
    import datetime

    at = lambda s: datetime.datetime.fromtimestamp(s, datetime.UTC)
    d = spark.createDataFrame([(*r[:-1], at(r[-1])) for r in decided], DECIDED)
    o = spark.createDataFrame([(*r[:-1], at(r[-1])) for r in own], "request_id long, own int, event_time timestamp")
    for df, kind in ((d, "decided"), (o, "own")):
        df.coalesce(1).write.mode("append").parquet(f"{place}/{kind}")
    read = lambda df, kind: spark.readStream.schema(df.schema).parquet(f"{place}/{kind}")
    return drain(scoring.gate_stream(read(d, "decided"), read(o, "own"), 60, "1 hour"), place, name)


def test_the_gate_on_a_stream_equals_the_batch(spark, tmp_path):
    """Decisions of 60 requests in three runs without order, some of them twice; requests without events of their own too."""
    from vigilake.sources import traffic

    r = random.Random(4)
    decided, own = [], []
    for q in range(60):
        mine = [(0, 0)] * (q % 2) + [(1, p) for p in range(q % 4)]
        own.append((q, len(mine), 1000.0 + q))
        for step, pos in mine + [(2, p) for p in range(1 + q % 3)]:
            bad = r.random() < 0.3
            decided.append((q, step, pos, None, "block" if bad else "allow", ["why"] if bad else [], bad, 1000.0 + q))
    want = sorted((x.request_id, x.step, x.pos, x.action) for x in traffic.gate_traffic(spark.createDataFrame([d[:-1] for d in decided], DECIDED.rpartition(",")[0])).collect())
    sent = decided[:]
    r.shuffle(sent)
    r.shuffle(own)
    place = str(tmp_path)
    gate(spark, place, sent[:80] + sent[:5], own[:20], "out")
    gate(spark, place, sent[80:130], own[20:40], "out")
    gate(spark, place, sent[130:], own[40:], "out")
    rows = spark.read.parquet(f"{place}/out").collect()
    assert all(x.complete for x in rows)
    assert sorted((x.request_id, x.step, x.pos, x.action) for x in rows) == want
    assert len(want) < len(decided)


def test_what_waits_in_vain_is_given_out_as_not_complete(spark, tmp_path):
    place = str(tmp_path)
    call = lambda q, t: (q, 2, 0, 7, "allow", [], False, t)
    gate(spark, place, [call(1, 1000.0), call(2, 1000.0)], [(1, 1, 1000.0), (2, 0, 1000.0)], "out")  # the message of 1 never comes
    gate(spark, place, [call(3, 10_000.0)], [(3, 0, 10_000.0)], "out")
    q = gate(spark, place, [call(4, 20_000.0)], [(4, 0, 20_000.0)], "out")
    got = {x.request_id: (x.complete, x.event_id) for x in spark.read.parquet(f"{place}/out").collect()}
    assert got == {1: (False, 7), 2: (True, 7), 3: (True, 7), 4: (True, 7)}
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] < 8  # requests 1 and 2 are forgotten


def test_state_is_kept_for_buckets_of_keys(spark, tmp_path, monkeypatch):
    """Calls of 600 streams over two runs in far fewer rows of state; null and odd keys are like others."""
    monkeypatch.setattr(scoring, "BUCKETS", 2, raising=False)
    place, n = str(tmp_path), 600
    start, stop = record("content_block_start", content_block={"type": "tool_use", "name": "exec"}), record("content_block_stop")
    part = record("content_block_delta", delta={"type": "input_json_delta", "partial_json": '{"a":1}'})
    name = lambda i: None if i == 0 else f's{i}\x1f"é'
    for run in ([(0, start), (1, part)], [(2, stop)]):
        stream = feed(spark, place, [(name(i), seq, d) for i in range(n) for seq, d in run], "stream_id string, seq int, data string")
        q = drain(scoring.assemble_tool_calls_stream(stream), place)
    rows = spark.read.parquet(f"{place}/out").collect()
    assert len(rows) == n and {(r.stream_id, r.block, r.tool_args) for r in rows} == {(name(i), 0, '{"a":1}') for i in range(n)}
    assert 0 < q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 128


def test_requests_share_rows_of_state(spark, tmp_path, monkeypatch):
    """300 requests whose messages never come, of which all but the last are given out as not complete."""
    monkeypatch.setattr(scoring, "BUCKETS", 2, raising=False)
    place, event = str(tmp_path), (1 << 60) + 1
    q = gate(spark, place, [(i, 2, 0, event, "allow", [], False, 1000.0 + i % 3) for i in range(300)] + [(-1, 2, 0, None, "allow", [], False, 1000.0)], [(-1, 0, 1000.0)], "out")
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 132
    gate(spark, place, [(1000, 2, 0, 7, "allow", [], False, 90_000.0)], [(1000, 1, 90_000.0)], "out")
    got = {r.request_id: (r.complete, r.event_id) for r in spark.read.parquet(f"{place}/out").collect()}
    assert got == {i: (False, event) for i in range(300)} | {-1: (True, None)}


def test_sessions_share_rows_of_state(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scoring, "BUCKETS", 2, raising=False)
    rows = [(i, "tool.before", f"s{i % 200}", float(1 + i // 200), "exec", 1.0) for i in range(400)]
    stream = feed(spark, str(tmp_path), rows)
    q = drain(scoring.rate_stream(sources.with_event_time(stream), RateSpec(("session_id",), 1600, name="x")), str(tmp_path))
    got = {r.event_id: (r.key, r.x) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {i: (f"s{i % 200}", 1 + i // 200) for i in range(400)}
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 10


def test_exchanges_of_a_batch_grow_with_it(spark, monkeypatch):
    monkeypatch.setattr(scoring, "TASK_ROWS", 10)
    assert [scoring._partitions(spark.range(n)) for n in (0, 40, 101)] == [4, 4, 11]
