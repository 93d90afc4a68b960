"""Continuous scoring, rates per event, coarse rate alerts, sinks and assembly of streamed calls."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vigilake.operators.chain import evaluate, read_by_rates
from vigilake.operators.outputs import DEFAULT_ALERTS, alert_feed, audit_records
from vigilake.operators.rates import RateSpec, threshold
from vigilake.rules.model import Evaluator, Rule
from vigilake.schema import ts_us
from vigilake.sources.traffic import rewrite_records

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def evaluate_stream(events: DataFrame, evaluators: list[Evaluator], mode: str = "parity") -> DataFrame:
    """Decisions of a stream of events by rules that need no history; no state is kept."""
    return evaluate(events, [e for e in evaluators if e.type != "sql"], mode)


BUCKETS = 1024


def _bucket(key: str) -> Column:
    """State is kept, and Python called, for a bucket of keys: a call and a frame for each key would cost far more than its rows."""
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int").alias("bucket")


def _by_key(rows: pd.DataFrame, key: str, columns: list[str]) -> dict[str | None, list[tuple]]:
    out: dict[str | None, list[tuple]] = {}
    for k, *values in zip(rows[key], *[rows[c] for c in columns], strict=True):
        out.setdefault(None if k is None or k != k else k, []).append(tuple(values))
    return out


def _remind(handle: StatefulProcessorHandle, at: int) -> None:
    """A bucket has one timer: the earliest of those asked for."""
    held = next(iter(handle.listTimers()), None)
    if held is None or at < held:
        if held is not None:
            handle.deleteTimer(held)
        handle.registerTimer(at)


class _Slots:
    """Values (JSON) of a bucket's keys, many to a row of state: a row for each would cost calls for each.

    Keys are dealt into so many slots that a row stays small where few of them come in a batch.
    """

    def __init__(self, handle: StatefulProcessorHandle, name: str, slots: int = 64):
        self.rows, self.slots = handle.getMapState(name, "slot int", "held string"), slots

    def read(self, keys) -> dict[int, dict]:
        """Slot -> key -> value, of the slots of these keys."""
        known = self.rows.exists()
        found = {n: self.rows.getValue((n,)) if known else None for n in {self.slot(k) for k in keys}}
        return {n: dict(json.loads(v[0])) if v else {} for n, v in found.items()}

    def every(self) -> dict[int, dict]:
        return {k[0]: dict(json.loads(v[0])) for k, v in self.rows.iterator()}

    def write(self, held: dict[int, dict]) -> None:
        for n, values in held.items():
            if values:
                self.rows.updateValue((n,), (json.dumps(list(values.items())),))
            elif self.rows.containsKey((n,)):
                self.rows.removeKey((n,))

    def slot(self, key: str | None) -> int:
        return zlib.crc32((key or "").encode("utf-8", "surrogatepass")) % self.slots


class _Trailing(StatefulProcessor):
    """Recent events of a bucket of keys by slices of time; each new event takes its key's rate over those less than the window older, itself last.

    Only slices that get events are written again; slices that no event to come can reach are removed when the watermark
    passes, by a timer where the bucket is idle.
    """

    def __init__(self, window_us: int, agg: str, slices: int = 16):
        self.window_us, self.agg, self.width = window_us, agg, max(1, window_us // slices)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slices = handle.getMapState("slices", "slice bigint", "us binary, ids binary, xs binary, ks string, vs string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802
        new = pd.concat(list(rows)).sort_values(["us", "event_id"], kind="stable")
        fresh = (new["us"].to_numpy("i8"), new["event_id"].to_numpy("i8"), new["x"].to_numpy("f8"), self._texts(new["k"]), self._texts(new["v"]))
        held = {k[0] for k in self.slices.keys()}  # noqa: SIM118
        first = (int(fresh[0][0]) - self.window_us) // self.width
        n = fresh[0] // self.width
        starts = np.flatnonzero(np.r_[True, n[1:] != n[:-1]])
        mine = {int(n[s]): slice(s, e) for s, e in zip(starts, np.r_[starts[1:], len(n)], strict=True)}
        olds = {m: self._read(self.slices.getValue((m,))) for m in held if m >= first}
        for m, at in mine.items():
            part = tuple(x[at] for x in fresh)
            self.slices.updateValue((m,), self._written(tuple(map(np.concatenate, zip(olds[m], part, strict=True))) if m in olds else part))
        us, ids, x, k, v = map(np.concatenate, zip(*olds.values(), fresh, strict=True))
        codes = pd.factorize(k)[0]
        is_new = np.arange(len(us)) >= len(us) - len(n)
        order = np.lexsort((ids, us, codes))
        us, ids, x, k, v, codes, is_new = (a[order] for a in (us, ids, x, k, v, codes, is_new))
        starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        gone = np.concatenate([s + np.searchsorted(us[s:e], us[s:e] - self.window_us, "right") for s, e in zip(starts, np.r_[starts[1:], len(us)], strict=True)])
        at = np.flatnonzero(is_new)
        yield pd.DataFrame({"key": k[at], "event_id": ids[at], "rate": self._rates(x, v, codes, us // self.width, gone[at], at + 1)})
        self._forget(timers.getCurrentWatermarkInMs() * 1000)

    @staticmethod
    def _texts(values: pd.Series) -> np.ndarray:
        return np.array([None if v is None or v != v else v for v in values] + [None], dtype=object)[:-1]

    @staticmethod
    def _written(part: tuple) -> tuple:
        return (*[a.tobytes() for a in part[:3]], *[json.dumps(a.tolist()) for a in part[3:]])

    @classmethod
    def _read(cls, value: tuple) -> tuple:
        us, ids, xs, ks, vs = value
        return (np.frombuffer(us, "i8"), np.frombuffer(ids, "i8"), np.frombuffer(xs, "f8"), cls._texts(json.loads(ks)), cls._texts(json.loads(vs)))

    def _rates(self, x: np.ndarray, v: np.ndarray, codes: np.ndarray, slices: np.ndarray, lows: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The aggregate of rows ``low`` to ``end`` (exclusive), all of one key: ends of slices by row, whole slices by what they come to."""
        counts = ~np.isnan(x)
        if self.agg == "distinct":
            codes = pd.factorize(v)[0]
            return np.array([len(np.unique(c[c >= 0])) for c in (codes[a:b] for a, b in zip(lows, ends, strict=True))], "f8")
        if self.agg == "count":
            upto = np.concatenate([[0], np.cumsum(counts)])
            return (upto[ends] - upto[lows]).astype("f8")
        starts = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (slices[1:] != slices[:-1])])
        if self.agg in ("sum", "avg"):
            filled, reduce = np.where(counts, x, 0.0), np.add
        else:
            filled, reduce = np.where(counts, x, np.inf if self.agg == "min" else -np.inf), np.minimum if self.agg == "min" else np.maximum
        totals = reduce.reduceat(filled, starts)
        out = np.empty(len(lows))
        for i, (a, b) in enumerate(zip(lows, ends, strict=True)):
            s, e = np.searchsorted(starts, a), np.searchsorted(starts, b, "right") - 1  # whole slices: s up to e
            pieces = [filled[a:b]] if s >= e else [filled[a : starts[s]], totals[s:e], filled[starts[e] : b]]
            out[i] = reduce.reduce([reduce.reduce(p) for p in pieces if len(p)])
        if self.agg == "sum":
            return out
        upto = np.concatenate([[0], np.cumsum(counts)])
        n = upto[ends] - upto[lows]
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(n > 0, out / n if self.agg == "avg" else out, np.nan)

    def _forget(self, mark_us: int) -> None:
        left = [k[0] for k in self.slices.keys()]  # noqa: SIM118
        for n in [n for n in left if (n + 1) * self.width <= mark_us - self.window_us]:
            self.slices.removeKey((n,))
            left.remove(n)
        if left and next(iter(self.handle.listTimers()), None) is None:
            self.handle.registerTimer(((max(left) + 1) * self.width + self.window_us) // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        self.handle.deleteTimer(expiredTimerInfo.getExpiryTimeInMs())
        self._forget(timerValues.getCurrentWatermarkInMs() * 1000)
        return iter([])

    def close(self) -> None:
        pass


def rate_stream(events: DataFrame, spec: RateSpec, watermark: str = "10 minutes") -> DataFrame:
    """(key, event_id, ``spec.name``) per event of a stream with ``event_time``: its rate, of any aggregate, over a bounded window.

    Equals the batch rate when events arrive in order; rates once given aren't revised.  Events with a null key are nobody's
    history and have 0 (sums, averages and extremes: null), as in the batch.  Spark drops events older than the watermark, which
    begins with 1970, and counts them in its progress.  Needs the RocksDB state store.
    """
    if spec.window is None:
        raise ValueError("only bounded windows run on a stream")
    counts = F.expr(spec.where) if spec.where else F.lit(True)
    value = F.col(spec.value) if spec.value else F.lit(1.0)
    x = F.when(counts, F.lit(1.0).cast("double") if spec.agg == "distinct" else value.cast("double"))
    v = F.when(counts, value.cast("string")) if spec.agg == "distinct" else F.lit(None).cast("string")
    unknown = F.lit(False)
    for k in spec.keys:
        unknown = unknown | F.col(k).isNull()
    timed = events.withWatermark("event_time", watermark)
    k = F.to_json(F.array(*[F.col(c).cast("string") for c in spec.keys]))  # tells all keys apart
    rows = timed.filter(~unknown).select(k.alias("k"), "event_id", ts_us().alias("us"), x.alias("x"), v.alias("v"), "event_time").select("*", _bucket("k"))
    found = rows.groupBy("bucket").transformWithStateInPandas(_Trailing(int(round(spec.window * 1_000_000)), spec.agg), "key string, event_id long, rate double", "Append", "EventTime")
    found = found.withColumn("key", F.array_join(F.from_json("key", "array<string>"), "\x1f"))
    whole = spec.agg in ("count", "distinct")
    nobody = timed.filter(unknown).select(F.lit(None).cast("string").alias("key"), "event_id", (F.lit(0.0) if whole else F.lit(None).cast("double")).alias("rate"))
    both = found.unionByName(nobody)
    rate = F.when(F.isnan("rate"), None).otherwise(F.col("rate"))
    return both.select("key", "event_id", (rate.cast("long") if whole else rate).alias(spec.name))


def rate_rule_stream(events: DataFrame, keys: tuple[str, ...] = ("session_id",), window: float = 60, watermark: str = "10 minutes") -> DataFrame:
    """(key, event_id, cnt): :func:`rate_stream` of counts."""
    return rate_stream(events, RateSpec(keys, window), watermark)


def rate_decisions_stream(events: DataFrame, evaluators: list[Evaluator], rule: Rule, watermark: str = "10 minutes") -> DataFrame:
    """(key, event_id, the rate, action, reason) per event of a stream that a rate rule over a bounded window admits.

    Only events in the stages of the rule's evaluator that none of the other evaluators blocks enter its history.
    Events older than the watermark are dropped by Spark, which counts them in ``numRowsDroppedByWatermark``.
    """
    own = next(e for e in evaluators if rule in e.rules)
    admitted = evaluate_stream(events, evaluators).filter(~F.col("blocked") & F.col("stage").isin(*own.stages))
    rate = rate_stream(admitted.select(*events.columns), rule.rate, watermark)
    hit = threshold(rule.rate.condition, {rule.rate.name: F.col(rule.rate.name)})
    return rate.withColumns({"action": F.when(hit, rule.action).otherwise("allow"), "reason": F.when(hit, rule.reason or f"SQL rule triggered: {rule.title}").otherwise("")})


def rate_alerts_stream(events: DataFrame, keys: tuple[str, ...] = ("session_id",), length: str = "60 seconds", slide: str | None = "10 seconds", more_than: int = 50, watermark: str = "10 minutes") -> DataFrame:
    """(start, keys, n): windows in which a key has more than so many events; works on tables as on streams."""
    rows = events.withWatermark("event_time", watermark) if events.isStreaming else events
    n = rows.groupBy(F.window("event_time", length, slide), *keys).agg(F.count("*").alias("n")).filter(F.col("n") > more_than)
    return n.select(F.col("window.start").alias("start"), *keys, "n")


Deliver = Callable[[DataFrame, int], None]


def _start(stream: DataFrame, write: Deliver, checkpoint: str, trigger: dict | None):
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def write_audit_stream(decided: DataFrame, path: str, checkpoint: str, alerts: str | None = None, trigger: dict | None = None):
    """Audit lines (and alerts) of a stream of decisions; a batch that is run again overwrites its own folder.

    ``trigger``: as of :meth:`DataStreamWriter.trigger`, ``{"processingTime": "10 seconds"}`` to go on for ever; what is there now.
    """
    return _start(decided, lambda batch, number: _audit_batch(batch, number, path, alerts), checkpoint, trigger)


def _audit_batch(batch: DataFrame, number: int, path: str, alerts: str | None) -> None:
    batch.persist()
    audit_records(batch).write.mode("overwrite").text(f"{path}/batch={number}")
    if alerts:
        alert_feed(batch).write.mode("overwrite").json(f"{alerts}/batch={number}")
    batch.unpersist()


class Ledger:
    """Which batches have been delivered: a batch that is run again isn't delivered again.

    A delivery ends with a mark in the ledger's folder.  One that broke off before its mark is made again, so what receives
    it must take the batch's number as the key of what it gets, as a folder of that number does.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self.hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self.hadoop(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _mark(self, number: int):
        return self.hadoop(f"{self.path}/{number}")

    def once(self, deliver: Deliver) -> Deliver:
        def write(batch: DataFrame, number: int) -> None:
            if not self.files.exists(self._mark(number)):
                deliver(batch, number)
                self.files.create(self._mark(number), True).close()

        return write


def deliver_alerts_stream(decided: DataFrame, deliver: Deliver, ledger: str, checkpoint: str, actions: tuple[str, ...] = DEFAULT_ALERTS, trigger: dict | None = None):
    """Alerts of a stream of decisions to ``deliver`` (alerts, batch number), each batch once."""
    once = Ledger(decided.sparkSession, ledger).once(deliver)
    return _start(decided, lambda batch, number: once(alert_feed(batch, actions), number), checkpoint, trigger)


TASK_ROWS = 100_000


def _partitions(batch: DataFrame) -> int:
    """For the exchanges of a batch, which nothing adapts to its size: the session's, more where tasks would have more than ``TASK_ROWS``."""
    return max(int(batch.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-batch.count() // TASK_ROWS))


class _History:
    """Admitted events of earlier batches, in folders of a batch each, as far back as some rate looks."""

    def __init__(self, path: str, evaluators: list[Evaluator], lateness_s: float):
        windows = [r.rate.window for e in evaluators if e.type == "sql" for r in e.rules]
        if None in windows:
            raise ValueError("rates over all history would need all of it: only bounded windows run on a stream")
        self.path, self.columns, self.lateness_s = path.rstrip("/"), read_by_rates(evaluators), lateness_s
        self.window_s = max(windows, default=0)

    def _folders(self, spark: SparkSession, kind: str) -> dict[int, str]:
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        files = place.getFileSystem(spark._jsc.hadoopConfiguration())
        found = [str(f.getPath().toString()) for f in files.listStatus(place)] if files.exists(place) else []
        return {int(f.rpartition("=")[2]): f for f in found}

    def marks(self, spark: SparkSession, number: int) -> dict[int, float]:
        """Batch -> its newest time; a row a batch that is still remembered."""
        earlier = [f for n, f in self._folders(spark, "marks").items() if n < number]
        return {r.batch: r.newest for r in spark.read.parquet(*earlier).collect()} if earlier else {}

    def before(self, spark: SparkSession, number: int, schema: T.StructType, marks: dict[int, float]) -> tuple[DataFrame, float | None]:
        """(history, watermark) that batch ``number`` meets: what only it or later ones wrote doesn't count.

        Folders too old for any rate are removed, by what batches that are done have seen.
        """
        newest = max((t for t in marks.values() if t is not None), default=None)
        watermark = None if newest is None else newest - self.lateness_s
        kept = []
        for n, folder in self._folders(spark, "events").items():
            if n < number and n in marks:
                if marks[n] is None or (watermark is not None and marks[n] < watermark - self.window_s):
                    self._remove(spark, folder)
                else:
                    kept.append(folder)
        if not kept:
            return spark.createDataFrame([], schema), watermark
        rows = spark.read.schema(schema).parquet(*kept)
        return rows.filter(F.col("timestamp") >= watermark - self.window_s), watermark

    @staticmethod
    def _remove(spark: SparkSession, folder: str) -> None:
        place = spark._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def decide_batch(batch: DataFrame, number: int, evaluators: list[Evaluator], history: _History, deliver: Deliver, mode: str = "parity", details: bool | str = True) -> int:
    """Decisions of one batch of a stream by all evaluators; gives the number of late events."""
    spark = batch.sparkSession
    kinds = [batch.schema[c] for c in history.columns]
    schema = T.StructType([*kinds, T.StructField("entered", T.ArrayType(T.StringType()))])
    marks = history.marks(spark, number)
    past, watermark = history.before(spark, number, schema, marks)
    late = F.coalesce(F.col("timestamp") < (float("-inf") if watermark is None else watermark), F.lit(False))
    seen = Observation(f"batch {number}")
    rows = batch.withColumn("late", late).observe(seen, F.count_if("late").alias("late"), F.max("timestamp").alias("newest"))
    rows = rows.persist()
    timely = evaluate(rows.filter("not late"), evaluators, mode, history=past, details=details, partitions=_partitions(rows))
    alone = evaluate(rows.filter("late"), [e for e in evaluators if e.type != "sql"], mode, details=details).withColumn("entered", F.array().cast("array<string>"))
    decided = timely.unionByName(alone).persist()
    deliver(decided.drop("entered"), number)
    decided.filter(F.size("entered") > 0).select(*history.columns, "entered").write.mode("overwrite").parquet(f"{history.path}/events/batch={number}")
    counted = seen.get
    newest = max([t for t in (*marks.values(), counted["newest"]) if t is not None], default=None)
    spark.createDataFrame([(number, newest, counted["late"])], "batch long, newest double, late long").write.mode("overwrite").parquet(f"{history.path}/marks/batch={number}")
    decided.unpersist()
    rows.unpersist()
    return counted["late"]


def decide_stream(events: DataFrame, evaluators: list[Evaluator], deliver: Deliver, history: str, checkpoint: str, lateness_s: float = 600, mode: str = "parity", trigger: dict | None = None, details: bool | str = True):
    """Decisions of a stream by all evaluators, rate rules of any aggregate over bounded windows included.

    ``deliver`` (decisions, batch number) gets each batch; a batch that is run again meets the same history and has the same
    number.  An event older than the newest one of earlier batches by more than ``lateness_s`` is ``late``: it gets the verdict
    of the rules without history and enters none.  Late events are counted by ``observe``; the counts stand, a row a
    batch, under ``history``/marks.  History is a narrow table of admitted events, a folder a batch, and reaches back as far
    as lateness and the longest window; decisions once given aren't revised.  ``details``: as of :func:`evaluate`.
    """
    kept = _History(history, evaluators, lateness_s)
    return _start(events, lambda batch, number: decide_batch(batch, number, evaluators, kept, deliver, mode, details) and None, checkpoint, trigger)


class _Gate(StatefulProcessor):
    """Decisions of a bucket of requests, a request's held until its own are all in, and where its first block among those is.

    ``wait_ms`` after a request's last decision its state goes; what is still held then is given out as not complete.
    """

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.requests = _Slots(handle, "requests")  # own, complete, step and place of the stop, until, decisions held

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802
        groups = _by_key(pd.concat(list(rows)), "request", ["own", "at", "step", "pos", "event_id", "action", "reasons", "blocked"])
        state, mark, out, untils = self.requests.read(groups), timers.getCurrentWatermarkInMs(), [], []
        for request, mine in groups.items():
            slot = state[self.requests.slot(request)]
            own, complete, *stop, _, held = slot.get(request, (None, False, None, None, None, []))
            stop = None if stop[0] is None else tuple(stop)
            own = max((int(r[0]) for r in mine if not pd.isna(r[0])), default=own)
            fresh = [self._row(*r[2:]) for r in mine if not pd.isna(r[2])]
            if not complete:
                fresh = list({(r[0], r[1]): r for r in fresh + [tuple(r) for r in held]}.values())  # what came again, once
                before = sorted(r for r in fresh if r[0] < 2)
                complete = own is not None and len(before) >= own
                if complete:
                    stop = next((r[:2] for r in before if r[5]), None)
                held = [] if complete else fresh
            untils.append(max(mark, *(int(r[1]) for r in mine)) + self.wait_ms)
            slot[request] = (own, complete, *(stop or (None, None)), untils[-1], held)
            if complete:
                out += self._given(request, [r for r in fresh if stop is None or r[:2] <= stop], True)
        self.requests.write(state)
        _remind(self.handle, min(untils))
        yield self._frame(out)

    @staticmethod
    def _row(step, pos, event, action, reasons, blocked) -> tuple:
        known = lambda v: None if pd.isna(v) else v
        return (int(step), int(pos), None if pd.isna(event) else int(event), known(action), known(reasons), bool(known(blocked)))

    @staticmethod
    def _given(request: str | None, rows: list[tuple], complete: bool) -> list[tuple]:
        return [(request, *r, complete) for r in sorted(rows, key=lambda r: r[:2])]

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        made = pd.DataFrame(rows, columns=["request", "step", "pos", "event_id", "action", "reasons", "blocked", "complete"], dtype=object)
        return made.astype({"step": "int32", "pos": "int32", "event_id": "Int64", "blocked": bool, "complete": bool})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        self.handle.deleteTimer(expiredTimerInfo.getExpiryTimeInMs())
        mark, out, left, touched = timerValues.getCurrentWatermarkInMs(), [], [], {}
        for n, slot in self.requests.every().items():
            gone = [k for k, v in slot.items() if v[-2] <= mark]
            for request in gone:
                out += self._given(request, [tuple(r) for r in slot.pop(request)[-1]], False)
            left += [v[-2] for v in slot.values()]
            if gone:
                touched[n] = slot
        self.requests.write(touched)
        if left:
            _remind(self.handle, min(left))
        yield self._frame(out)

    def close(self) -> None:
        pass


def gate_stream(decisions: DataFrame, own: DataFrame, wait_s: float = 600, watermark: str = "10 minutes") -> DataFrame:
    """(request_id, step, pos, event_id, action, reasons, blocked, complete) of the decisions of a stream that come to pass.

    ``decisions``: decided :func:`traffic_events` with ``event_time``; ``own``: :func:`own_events` of the same requests.  All of a
    request's decisions wait until as many of steps 0 and 1 are in as the request has; then :func:`gate_traffic` holds of them,
    and of calls (step 2) that come later.  When the watermark passes ``wait_s`` after a request's last record its state goes,
    and what still waits is given out with ``complete`` false: some verdict before it never came, so it isn't known to pass.
    A decision that comes twice before its request is complete counts once.  Rows with a null request are one request, of which
    nothing tells how many decisions it has.  Spark drops records older than the watermark and counts them.
    """
    kind = decisions.schema["request_id"].dataType.simpleString()
    none = lambda t: F.lit(None).cast(t)
    request = F.col("request_id").cast("string").alias("request")
    rows = decisions.select(request, F.col("step").cast("int"), F.col("pos").cast("int"), F.col("event_id").cast("string"), "action", F.array_join("reasons", "; ").alias("reasons"), "blocked", none("int").alias("own"), "event_time")
    marks = own.select(request, none("int").alias("step"), none("int").alias("pos"), none("string").alias("event_id"), none("string").alias("action"), none("string").alias("reasons"), none("boolean").alias("blocked"), F.col("own").cast("int"), "event_time")
    both = rows.unionByName(marks).withWatermark("event_time", watermark).withColumn("at", F.unix_millis("event_time"))
    made = "request string, step int, pos int, event_id long, action string, reasons string, blocked boolean, complete boolean"
    passed = both.select("*", _bucket("request")).groupBy("bucket").transformWithStateInPandas(_Gate(int(wait_s * 1000)), made, "Append", "EventTime")
    return passed.select(F.col("request").cast(kind).alias("request_id"), "step", "pos", "event_id", "action", "reasons", "blocked", "complete")


class _Assemble(StatefulProcessor):
    """The open calls of a bucket of streams: their names, and the parts of their input so far, which are only added to.

    A stream's state goes when its message stops, and, of records with times, when the watermark is ``idle_ms`` past the last.
    """

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = _Slots(handle, "open")  # name, block, whether it is open, number of parts held, until
        self.parts = handle.getMapState("parts", "stream string, n int", "part string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802
        columns = ["type", "block_type", "name", "delta_type", "part", *(["at"] if self.idle_ms is not None else [])]
        groups = _by_key(pd.concat(list(rows)).sort_values("seq", kind="stable"), "stream", columns)
        state, out, untils = self.open.read(groups), [], []
        for stream, mine in groups.items():
            slot = state[self.open.slot(stream)]
            name, block, active, n, _ = slot.pop(stream, ("", 0, False, 0, None))
            fresh, over = [], False
            for kind, block_type, called, delta, part, *_ in mine:
                if not active and kind == "content_block_start" and block_type == "tool_use":
                    name, active = called or "", True
                elif active and kind == "content_block_stop":
                    out.append((stream, block, name, "".join(self._taken(stream, n) + fresh)))
                    n, fresh, block, active = 0, [], block + 1, False
                elif active and delta == "input_json_delta":
                    fresh.append(part or "")
                over = kind == "message_stop"
            if over:
                self._taken(stream, n)
                continue
            if fresh:
                self.parts.updateValue((stream, n), ("".join(fresh),))
                n += 1
            until = None if self.idle_ms is None else max(int(r[-1]) for r in mine) + self.idle_ms
            untils.append(until)
            slot[stream] = (name, block, active, n, until)
        self.open.write(state)
        if untils and self.idle_ms is not None:
            _remind(self.handle, min(untils))
        yield pd.DataFrame(out, columns=["stream", "block", "tool_name", "tool_args"])

    def _taken(self, stream: str | None, n: int) -> list[str]:
        """The parts held of a stream's call, which go."""
        held = [self.parts.getValue((stream, i))[0] for i in range(n)]
        for i in range(n):
            self.parts.removeKey((stream, i))
        return held

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        self.handle.deleteTimer(expiredTimerInfo.getExpiryTimeInMs())
        mark, left, touched = timerValues.getCurrentWatermarkInMs(), [], {}
        for n, slot in self.open.every().items():
            gone = [k for k, v in slot.items() if v[-1] <= mark]
            for stream in gone:
                self._taken(stream, slot.pop(stream)[-2])
            left += [v[-1] for v in slot.values()]
            if gone:
                touched[n] = slot
        self.open.write(touched)
        if left:
            _remind(self.handle, min(left))
        return iter([])

    def close(self) -> None:
        pass


def assemble_tool_calls_stream(chunks: DataFrame, idle_s: float = 3600, watermark: str = "10 minutes") -> DataFrame:
    """(stream_id, block, tool_name, tool_args) of a stream of records (stream_id, seq, data), as calls end; records in order.

    Input that isn't an object is empty, as in the batch.  What is kept of a stream goes with its ``message_stop``; if records
    have an ``event_time``, also when the watermark is ``idle_s`` past its last one.
    """
    timed = "event_time" in chunks.columns
    d = (chunks.withWatermark("event_time", watermark) if timed else chunks).withColumn("d", F.from_json("data", "struct<type:string,content_block:struct<type:string,name:string>,delta:struct<type:string,partial_json:string>>"))
    at = [F.unix_millis("event_time").alias("at"), F.col("event_time")] if timed else []
    rows = d.select(F.col("stream_id").cast("string").alias("stream"), "seq", "d.type", F.col("d.content_block.type").alias("block_type"), F.col("d.content_block.name").alias("name"), F.col("d.delta.type").alias("delta_type"), F.col("d.delta.partial_json").alias("part"), *at)
    kind = chunks.schema["stream_id"].dataType.simpleString()
    calls = rows.select("*", _bucket("stream")).groupBy("bucket").transformWithStateInPandas(_Assemble(int(idle_s * 1000) if timed else None), "stream string, block int, tool_name string, tool_args string", "Append", "EventTime" if timed else "None")
    calls = calls.select(F.col("stream").cast(kind).alias("stream_id"), "block", "tool_name", "tool_args")
    return calls.withColumn("tool_args", F.when(F.schema_of_variant(F.try_parse_json("tool_args")).startswith("OBJECT"), F.col("tool_args")).otherwise(F.lit("{}")))


def rewrite_stream(records: DataFrame, evaluators: list[Evaluator], deliver: Deliver, held: str, checkpoint: str, trigger: dict | None = None):
    """A stream of records (stream_id, seq, data) with blocked calls replaced, to ``deliver`` (records, batch number).

    The records of a call are held back, in tables under ``held`` of a folder a batch, until it ends and its verdict is in;
    others go through at once.  See :func:`rewrite_records`.
    """
    held = held.rstrip("/")

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(held)
        files = place.getFileSystem(spark._jsc.hadoopConfiguration())
        found = {int(f.getPath().getName().partition("=")[2]): f.getPath() for f in (files.listStatus(place) if files.exists(place) else [])}
        before = max((n for n in found if n < number), default=None)
        rows = batch.select("stream_id", "seq", "data")
        if before is not None:
            rows = rows.unionByName(spark.read.schema(rows.schema).parquet(f"{held}/batch={before}"))
        rows = rows.persist()
        given = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", _partitions(rows))
        try:
            through, waiting = rewrite_records(rows, evaluators)
            deliver(through, number)
            waiting.write.mode("overwrite").parquet(f"{held}/batch={number}")
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", given)
        rows.unpersist()
        for n in [n for n in found if before is not None and n < before]:
            files.delete(found[n], True)

    return _start(records, write, checkpoint, trigger)
