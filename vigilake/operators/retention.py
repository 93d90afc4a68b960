"""History as of each event: what a capped history that is purged now and then holds when an event arrives.

Arrivals are numbered in the order of time and id.  At every ``every``-th arrival the history drops events more than
``max_age`` seconds older than that arrival, then the oldest beyond ``max_rows``.  As later purges drop all that earlier
ones would, a purge is one number: the oldest arrival that it leaves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilake.operators.rates import RateSpec, _counted, _known, _micros
from vigilake.schema import ts_us
from vigilake.shared import shared_path

_ROW_BITS = 33  # of monotonically_increasing_id: the row's number in its partition


def numbered(df: DataFrame, order: list[str | Column], out: str) -> DataFrame:
    """``df`` with ``out``: 1, 2, ... in ``order`` over all rows, by sorted ranges and what the ranges before hold.

    The sorted rows are a table in the shared folder, as ranges are drawn anew each time that they are worked out.
    Ranges are told apart by a row each, which is all that is summed up in one place and broadcast.
    """
    spark = df.sparkSession
    path = shared_path(spark, "numbered")
    df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    part = F.shiftright("_place", _ROW_BITS)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    at = F.col("_base") + F.col("_place").bitwiseAND((1 << _ROW_BITS) - 1) + 1
    return rows.join(F.broadcast(before), part == F.col("_part")).withColumn(out, at).drop("_place", "_part", "_base")


def history_as_of(df: DataFrame, max_age: float = 3600, max_rows: int = 10_000, every: int = 100) -> DataFrame:
    """``df`` with ``arrival``, the event's number, and ``oldest``, that of the oldest event that history holds then.

    History holds ``arrival - oldest + 1`` events, itself last.  Events without a time aren't recorded: both are null.
    Whole rows are written to the shared folder once: select what is needed first.  Repeated ids of one time are in
    some fixed order.  Names that begin with ``_``, ``arrival`` and ``oldest`` are taken.
    """
    timed = numbered(df.filter("timestamp is not null").withColumn("_us", ts_us()), ["_us", "event_id"], "arrival")
    purge = timed.filter(F.col("arrival") % every == 0).select((F.col("_us") - int(round(max_age * 1_000_000))).alias("_us"), F.lit(0).alias("_kind"), F.floor(F.col("arrival") / every).alias("_nth"))
    both = numbered(purge.unionByName(timed.select("_us", F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_nth"))), ["_us", "_kind", "_nth"], "_at")
    # before the n-th purge's limit stand n purges, itself included, and the events that are too old
    left = both.filter("_kind = 0").select("_nth", (F.greatest(F.col("_at") - F.col("_nth"), F.col("_nth") * every - max_rows, F.lit(0)) + 1).alias("oldest"))
    known = timed.withColumn("_last", F.floor(F.col("arrival") / every)).join(left, F.col("_last") == F.col("_nth"), "left")
    known = known.withColumn("oldest", F.coalesce("oldest", F.lit(1).cast("long"))).drop("_us", "_last", "_nth")
    untimed = df.filter("timestamp is null").withColumns({c: F.lit(None).cast("long") for c in ("arrival", "oldest")})
    return known.unionByName(untimed)


def counts_as_of(df: DataFrame, spec: RateSpec, max_age: float = 3600, max_rows: int = 10_000, every: int = 100) -> DataFrame:
    """:func:`history_as_of` with ``spec.name``: the events of the key in the window that history holds when the event arrives.

    No task holds more than a few times ``max_rows + every`` rows of a key: an event goes to its slice of so many arrivals and,
    as history, to the next.  Events without a time or with a null key count 0.  Only counts.
    """
    if spec.agg != "count":
        raise ValueError(f"{spec.agg} as of each event isn't there: only counts")
    rows = history_as_of(df.withColumns({"_x": _counted(spec), "_enters": F.lit(True)}), max_age, max_rows, every)
    known = _known(spec.keys) & F.col("arrival").isNotNull()
    slice_ = F.floor(F.col("arrival") / (max_rows + every)).cast("long")
    at = lambda n, kind, pos: F.struct(n.alias("s"), F.lit(kind).alias("kind"), pos.alias("pos"))
    own, past, probe = at(slice_, 2, F.col("arrival")), at(slice_ + 1, 1, F.col("arrival")), at(slice_, 0, F.col("oldest"))
    each = rows.filter(known).withColumns({"_us": ts_us(), "_at": F.explode(F.array(own, past, probe))})
    read = {*spec.keys, "arrival", "_us", "_at"}
    each = each.select(*[F.col(c) if c in read else F.when(F.col("_at.kind") == 2, F.col(c)).alias(c) for c in each.columns if c != "_x"], F.when(F.col("_at.kind") > 0, F.col("_x")).alias("_x"), F.col("_at.s").alias("_slice"))
    each = each.repartition(*spec.keys, "_slice")
    part = Window.partitionBy(*spec.keys, "_slice")
    upto = F.count("_x").over(part.orderBy("_at.pos", "_at.kind").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    each = each.withColumn("_upto", upto)
    purged = F.max(F.when(F.col("_at.kind") == 0, F.col("_upto"))).over(Window.partitionBy(*spec.keys, "_slice", "arrival"))
    gone = F.lit(0) if spec.window is None else F.count("_x").over(part.orderBy("_us").rangeBetween(Window.unboundedPreceding, -_micros(spec)))
    each = each.withColumns({"_purged": purged, "_gone": gone}).filter("_at.kind = 2")
    counted = each.withColumn(spec.name, (F.col("_upto") - F.greatest("_purged", "_gone")).cast("long"))
    nobody = rows.filter(~known).withColumn(spec.name, F.lit(0).cast("long"))
    taken = ("_x", "_enters", "_us", "_at", "_slice", "_upto", "_purged", "_gone")
    return counted.drop(*taken).unionByName(nobody.drop(*taken))
