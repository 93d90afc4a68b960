"""Rates over history: trailing windows per key that end at each event, exact with ties.

An event counts itself and earlier arrivals (smaller time, or equal time and smaller id) that are less than the
window older.  One shuffle by key and time slice serves all rates that have a key in common; no self-join.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilake.schema import ts_us

_CONDITION = re.compile(r"\s*(\w+)\s*(>=|<=|==|!=|=|>|<)\s*(-?\d+(?:\.\d+)?)\s*")


@dataclass(frozen=True)
class RateSpec:
    """``agg`` (count, sum, avg, min, max, distinct) of ``value`` per ``keys`` in the trailing ``window`` seconds."""

    keys: tuple[str, ...] = ("session_id",)
    window: float | None = 60
    agg: str = "count"
    value: str | None = None
    where: str | None = None
    name: str = "cnt"
    condition: str = "cnt > 0"
    reads: tuple[str, ...] = ()  # columns that ``where`` reads


def threshold(condition: str, columns: dict[str, Column]) -> Column:
    """``name op number`` over ``columns``; other shapes are false, absent or null values 0."""
    m = _CONDITION.fullmatch(condition)
    if not m:
        return F.lit(False)
    value, limit = F.coalesce(columns.get(m[1], F.lit(0.0)).cast("double"), F.lit(0.0)), F.lit(float(m[3]))
    return {">": value > limit, ">=": value >= limit, "<": value < limit, "<=": value <= limit, "==": value == limit, "=": value == limit, "!=": value != limit}[m[2]]


_ALONE = -(1 << 62)  # no time's slice: rows that no history knows


def trailing(df: DataFrame, spec: RateSpec, out: str | None = None, bucketed: bool = True, slice_s: float = 3600, partitions: int | None = None) -> DataFrame:
    """``df`` with the rate of each event as column ``out`` (``spec.name``); see :func:`trailing_many`."""
    return trailing_many(df, {out or spec.name: spec}, bucketed=bucketed, slice_s=slice_s, partitions=partitions)


def trailing_many(df: DataFrame, specs: dict[str, RateSpec], admitted: Column | None = None, bucketed: bool = True, slice_s: float = 3600, partitions: int | None = None) -> DataFrame:
    """``df`` with a column for each of ``specs``: the rate of each event over what came up to it.

    Only ``admitted`` events count and are counted.  Events without a time or with a null key are nobody's history and
    count 0 (sums, averages and extremes: null).  An event's own history ends with itself, by time and id.

    Rates over bounded windows that have keys in common share one exchange by those keys and a time slice, so that a
    busy key isn't one task: each event goes to its own slice and, stripped of what no rate reads, to the next, where it is
    history only.  Counts of all windows share the longest window's slices; other aggregates those of their own.
    ``bucketed`` false keeps all slices of a key together.  Unbounded ones (count, sum, avg, min, max): slices of
    ``slice_s`` seconds, whose totals are run up over a key's slices, one row a slice; unbounded distinct counts aren't sliced.
    ``partitions``: of the exchange of bounded ones, for tables that are large for the session's number.
    """
    ready = {f"_x{i}": _counted(s) for i, s in enumerate(specs.values())}
    enters = F.lit(True) if admitted is None else F.coalesce(admitted, F.lit(False))
    rows = df.withColumns({"_us": ts_us(), "_enters": enters & F.col("timestamp").isNotNull(), **ready})
    named = [(out, s, f"_x{i}") for i, (out, s) in enumerate(specs.items())]
    for group in _groups(named):
        rows = _in_one_exchange(rows, group, list(ready), bucketed, partitions)
    for out, spec, x in named:
        if spec.window is None:
            rows = _unbounded(rows, spec, x, out, bucketed, slice_s)
    return rows.drop("_us", "_enters", *ready)


def _counted(spec: RateSpec) -> Column:
    """What an event adds to the rate: its value, or 1; null if it doesn't count."""
    value = F.lit(1) if not spec.value else F.col(spec.value) if spec.agg == "distinct" else F.col(spec.value).cast("double")
    return F.when(F.expr(spec.where), value) if spec.where else value


def _groups(named: list[tuple]) -> list[list[tuple]]:
    """Bounded rates that share an exchange: all have some key in common; other aggregates than counts one window too."""
    out: list[list[tuple]] = []
    for one in named:
        spec = one[1]
        if spec.window is None:
            continue
        for group in out:
            common = set(spec.keys).intersection(*(s.keys for _, s, _ in group))
            if common and (spec.window == group[0][1].window or all(s.agg == "count" for _, s, _ in [*group, one])):
                group.append(one)
                break
        else:
            out.append([one])
    return out


def _micros(spec: RateSpec) -> int:
    return int(round(spec.window * 1_000_000))


def _known(keys) -> Column:
    known = F.col("_enters")
    for k in keys:
        known = known & F.col(k).isNotNull()
    return known


def _in_one_exchange(rows: DataFrame, group: list[tuple], carried: list[str], bucketed: bool, partitions: int | None) -> DataFrame:
    common = [k for k in group[0][1].keys if all(k in s.keys for _, s, _ in group)]
    width = max(_micros(s) for _, s, _ in group)
    own = F.floor(F.col("_us") / width).cast("long")
    at = lambda n, mine: F.struct(n.alias("s"), F.lit(mine).alias("o"))
    alone = F.lit(_ALONE) + F.pmod(F.xxhash64("event_id", "_us"), F.lit(1 << 40))
    rows = rows.withColumn("_at", F.explode(F.when(_known(common), F.array(at(own, True), at(own + 1, False))).otherwise(F.array(at(alone, True)))))
    read = {"event_id", "_us", "_enters", *carried, *(k for _, s, _ in group for k in s.keys)}
    rows = rows.select(*[F.col(c) if c in read else F.when(F.col("_at.o"), F.col(c)).alias(c) for c in rows.columns if c != "_at"], F.col("_at.s").alias("_slice"), F.col("_at.o").alias("_own"))
    rows = rows.repartition(*([partitions] if partitions else []), *common, *(["_slice"] if bucketed else []))
    halves: dict[tuple, list[tuple]] = {}
    for out, spec, x in group:
        if spec.agg in _BOUNDED:
            rows = _BOUNDED[spec.agg](rows, spec, x, out)
        else:
            halves.setdefault(spec.keys, []).append((out, spec, x))
    for keys, same in halves.items():
        rows = _by_halves(rows, keys, width, same)
    for out, spec, _ in group:
        zero = F.lit(0).cast("long") if spec.agg in ("count", "distinct") else F.lit(None).cast("double")
        rows = rows.withColumn(out, F.when(_known(spec.keys), F.col(out)).otherwise(zero))
    return rows.filter("_own").drop("_slice", "_own")


def _count(rows: DataFrame, spec: RateSpec, x: str, out: str) -> DataFrame:
    """Running counts less those of what has left the window."""
    part = Window.partitionBy(*spec.keys, "_slice")
    upto = part.orderBy("_us", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gone = part.orderBy("_us").rangeBetween(Window.unboundedPreceding, -_micros(spec))
    return rows.withColumn(out, F.count(x).over(upto) - F.count(x).over(gone))


def _by_halves(rows: DataFrame, keys: tuple[str, ...], width: int, rates: list[tuple]) -> DataFrame:
    """Sums and extremes of a window that is as long as a slice: the end of the slice before and the beginning of its own.

    Nothing is subtracted, so sums leave no residue, and every frame grows row by row; rates of the same keys share
    three sorts.  A row of the slice before is met when it leaves the window: the last one met, from the end, holds the rest
    of its slice.
    """
    side = Window.partitionBy(*keys, "_slice", "_own")
    grow = lambda *order: side.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begun, rest = grow("_us", "event_id"), grow(F.desc("_us"), F.desc("event_id"))
    leaves = F.when(F.col("_own"), F.col("_us")).otherwise(F.col("_us") + width)
    met = Window.partitionBy(*keys, "_slice").orderBy(F.desc("_leaves"), F.desc("_own")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    apply = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
    parts = [(i, m, x) for i, (_, spec, x) in enumerate(rates) for m in {"avg": ("sum", "count")}.get(spec.agg, (spec.agg,))]
    rows = rows.withColumns({f"_b{i}{m}": apply[m](x).over(begun) for i, m, x in parts})
    rows = rows.withColumns({f"_r{i}{m}": F.when(~F.col("_own"), apply[m](x).over(rest)) for i, m, x in parts} | {"_leaves": leaves})
    rows = rows.withColumns({f"_r{i}{m}": F.last(f"_r{i}{m}", ignorenulls=True).over(met) for i, m, _ in parts})
    both = {(i, m): F.least(f"_b{i}{m}", f"_r{i}{m}") if m == "min" else F.greatest(f"_b{i}{m}", f"_r{i}{m}") if m == "max" else F.coalesce(f"_b{i}{m}", F.lit(0)) + F.coalesce(f"_r{i}{m}", F.lit(0)) for i, m, _ in parts}
    made = {out: both[i, "sum"] / F.nullif(both[i, "count"].cast("double"), F.lit(0.0)) if spec.agg == "avg" else both[i, spec.agg] for i, (out, spec, _) in enumerate(rates)}
    return rows.withColumns(made).drop("_leaves", *[f"_{h}{i}{m}" for h in "br" for i, m, _ in parts])


def _distinct(rows: DataFrame, spec: RateSpec, x: str, out: str) -> DataFrame:
    """Distinct values in the window: those that began less those that ended, in memory that doesn't grow with it.

    An occurrence of a value begins with its event and ends when the value occurs again or the window has passed, which is
    before all events of that time.
    """
    part = [*spec.keys, "_slice"]
    row = Window.partitionBy(*part, x).orderBy("_us", "event_id")
    rows = rows.withColumn("_again", F.lead(F.struct("_us", "event_id")).over(row))
    held = F.col(x).isNotNull()
    place = lambda t, phase, event, last, d: F.struct(t.alias("t"), F.lit(phase).alias("phase"), event.cast("long").alias("event"), F.lit(last).alias("row"), d.alias("d"))
    replaced = place(F.col("_again._us"), 1, F.col("_again.event_id"), False, F.lit(-1))
    if spec.window is None:
        ends = F.when(held & F.col("_again").isNotNull(), replaced)
    else:
        passed = place(F.col("_us") + _micros(spec), 0, F.lit(None), False, F.lit(-1))
        ends = F.when(held, F.when(F.coalesce(F.col("_again._us") < F.col("_us") + _micros(spec), F.lit(False)), replaced).otherwise(passed))
    at = rows.withColumn("_when", F.explode(F.array(place(F.col("_us"), 1, F.col("event_id"), True, held.cast("int")), ends))).filter("_when is not null").drop("_again")
    upto = Window.partitionBy(*part).orderBy("_when.t", "_when.phase", "_when.event", "_when.row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return at.withColumn(out, F.sum("_when.d").over(upto).cast("long")).filter("_when.row").drop("_when")


_BOUNDED = {"count": _count, "distinct": _distinct}


def _unbounded(rows: DataFrame, spec: RateSpec, x: str, out: str, bucketed: bool, slice_s: float) -> DataFrame:
    """Over all history: what the slices before come to, and the slice up to the event.

    Slices' rows stay where they are; only a row a slice is run up over a key.
    """
    known = _known(spec.keys)
    alone = F.lit(_ALONE) + F.pmod(F.xxhash64("event_id", "_us"), F.lit(1 << 40))
    width = int(slice_s * 1_000_000) if bucketed and spec.agg != "distinct" else None
    rows = rows.withColumn("_slice", F.when(known, F.floor(F.col("_us") / width).cast("long") if width else F.lit(0).cast("long")).otherwise(alone))
    if spec.agg == "distinct":
        made = _distinct(rows.repartition(*spec.keys, "_slice"), spec, x, out)
        return made.withColumn(out, F.when(known, F.col(out)).otherwise(F.lit(0).cast("long"))).drop("_slice")
    order = Window.partitionBy(*spec.keys, "_slice").orderBy("_us", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    names = [f"_upto{n}" for n in range(len(spec.keys))]
    totals = rows.filter(known).groupBy(*[F.col(k).alias(n) for k, n in zip(spec.keys, names, strict=True)], F.col("_slice").alias("_s")).agg(F.count(x).alias("_n"), F.sum(F.col(x).cast("double")).alias("_t"), F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    earlier = Window.partitionBy(*names).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*names, "_s", F.sum("_n").over(earlier).alias("_n"), F.sum("_t").over(earlier).alias("_t"), F.min("_lo").over(earlier).alias("_lo"), F.max("_hi").over(earlier).alias("_hi"))
    same = F.col("_slice") == F.col("_s")
    for k, n in zip(spec.keys, names, strict=True):
        same = same & (F.col(k) == F.col(n))
    rows = rows.withColumns({"_in": F.count(x).over(order), "_it": F.sum(F.col(x).cast("double")).over(order), "_il": F.min(x).over(order), "_ih": F.max(x).over(order)}).join(before, same & known, "left")
    count, total = F.coalesce("_n", F.lit(0)) + F.col("_in"), F.coalesce("_t", F.lit(0.0)) + F.coalesce("_it", F.lit(0.0))
    made = {"count": count, "sum": total, "avg": total / F.nullif(count.cast("double"), F.lit(0.0)), "min": F.least("_lo", "_il"), "max": F.greatest("_hi", "_ih")}[spec.agg]
    zero = F.lit(0).cast("long") if spec.agg == "count" else F.lit(None).cast("double")
    return rows.withColumn(out, F.when(known, made).otherwise(zero)).drop("_slice", *names, "_s", "_n", "_t", "_lo", "_hi", "_in", "_it", "_il", "_ih")


def retain_history(df: DataFrame, max_age: float = 3600, max_rows: int = 10_000) -> DataFrame:
    """The newest events: none older than ``max_age`` seconds before the last one, at most ``max_rows``."""
    newest = df.orderBy(F.desc("timestamp"), F.desc("event_id")).limit(max_rows)
    last = F.max("timestamp").over(Window.partitionBy(F.lit(0)))  # over at most max_rows rows
    return newest.withColumn("_last", last).filter(F.col("timestamp") >= F.col("_last") - max_age).drop("_last")


def history_rows(df: DataFrame, cut: int = 4096) -> DataFrame:
    """Events as history rows: arguments as JSON (null if there are none), the result's JSON text cut."""
    args = F.when(F.coalesce(F.col("tool_args"), F.lit("{}")) != "{}", F.col("tool_args"))
    result = F.when(F.col("tool_result_is_string"), F.regexp_replace(F.to_json(F.array("tool_result")), r"(?s)^\[(.*)\]$", "$1")).otherwise(F.col("tool_result"))
    return df.select("event_id", "stage", "session_id", "channel", "user_id", "timestamp", "tool_name", "message_text", args.alias("tool_args"), F.left(result, F.lit(cut)).alias("tool_result"))
