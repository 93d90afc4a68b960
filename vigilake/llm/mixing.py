"""Mixing sources to target weights: each document is taken floor(rate) times, and once more by a seeded draw.

Words are counted per source, targets follow from the sources' weights, a source's rate is its target over its size.
A copy beyond the whole part of the rate is taken if a number in [0, 1) that is made from the document's own content is
below the fraction, so that runs agree whatever the partitioning.  Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilake.llm.scratch import Scratch, quoted, unused

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)  # of the sources in the order of their names, again and again
MOST = 3  # times a source's size that its target may come to
_DRAWS = 1 << 52


def words(text: Column) -> Column:
    """Words of a text; none in a null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _running(df: DataFrame, by: list[Column], sums: dict[str, Column], scratch: Scratch, rows_per_part: int) -> DataFrame:
    """``df`` with sums over all rows up to each in the order of ``by``: within partitions, then over partitions."""
    parts = max(1, -(-df.count() // rows_per_part))
    dealt = scratch.save(df.repartitionByRange(parts, *by).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part").orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = dealt.groupBy("_part").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over a row a partition
    before = totals.select("_part", *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}") for n in sums])
    out = dealt.withColumns({n: F.sum(c).over(inside) for n, c in sums.items()}).join(before, "_part")
    return out.withColumns({n: F.col(n) + F.col(f"_{n}") for n in sums}).drop("_part", *[f"_{n}" for n in sums])


def source_targets(sizes: DataFrame, scratch: Scratch, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, rows_per_part: int = 100_000) -> DataFrame:
    """(source, source_size) -> with ``target`` and ``rate``: the words that each source should give.

    Sources by name (code points, null last) weigh ``weights`` in turn and share the sum of all sizes; none gives more
    than ``most`` times what it has, and what is over is shared out again by weight.  In the end every source gets its
    weight times one common share, or its most: sources reach their most in the order of most over weight, so running
    sums in that order give the share.  Sources needn't fit one task: both orders are ranges with running sums.
    """
    first = _running(sizes.withColumn("_one", F.lit(1)), [F.col("source").asc_nulls_last()], {"_nth": F.col("_one")}, scratch, rows_per_part)
    listed = F.array(*map(F.lit, weights))
    ranked = scratch.save(first.select("source", "source_size", F.element_at(listed, (F.pmod(F.col("_nth") - 1, F.lit(len(weights))) + 1).cast("int")).cast("long").alias("_weight")))
    ranked = ranked.withColumn("_ratio", F.col("source_size") * most / F.col("_weight"))
    order = [F.col("_ratio"), F.col("source").asc_nulls_last()]
    up = scratch.save(_running(ranked, order, {"_cap": F.col("source_size") * most, "_heavy": F.col("_weight")}, scratch, rows_per_part))
    whole = up.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("_weight"), F.lit(0))).first()
    total, heavy = map(int, whole)
    # a source is at its most if sharing what those before it leave would give it as much
    left, rest = F.lit(total) - F.col("_cap") + F.col("source_size") * most, F.lit(heavy) - F.col("_heavy") + F.col("_weight")
    full = up.filter(F.col("source_size") * most * rest <= left * F.col("_weight")).agg(F.coalesce(F.sum(F.col("source_size") * most), F.lit(0)), F.coalesce(F.sum("_weight"), F.lit(0))).first()
    capped, gone = map(int, full)
    share = (total - capped) / (heavy - gone) if heavy > gone else float("inf")
    target = F.least((F.col("source_size") * most).cast("double"), F.lit(share) * F.col("_weight"))
    return up.select("source", "source_size", target.alias("target"), F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"))


def draw(key: Column, text: Column, seed: str = "mix") -> Column:
    """A number in [0, 1) from a document's key and text."""
    h = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(key.cast("string"), F.lit("-")), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary"))
    return F.conv(F.left(h, F.lit(13)), 16, 10).cast("long") / _DRAWS


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = "mix") -> DataFrame:
    """``docs`` with size, source_size, target and copies: how often the mix takes each document, 0 to ``most`` times.

    Null texts have no words; null sources are one source, the last; a source without words gives nothing.  Rows that are
    equal in key and text draw alike.  The table is read twice, for the sources' sizes and for the copies; texts are
    never shuffled unless there are more sources than a broadcast holds.  Columns of these names are replaced.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    sizes = docs.select(F.col(quoted(source)).alias("source"), words(F.col(quoted(text))).alias("n")).groupBy("source").agg(F.sum("n").alias("source_size"))
    targets = scratch.save(source_targets(scratch.save(sizes), scratch, weights, most))
    kept = [F.col(quoted(c)) for c in docs.columns if c.lower() not in ("size", "source_size", "target", "copies") or c in (key, source, text)]
    names = {c: unused(docs, f"_mix_{c}") for c in ("source", "rate", "size", "draw")}
    rows = docs.select(*kept, words(F.col(quoted(text))).alias(names["size"]), draw(F.col(quoted(key)), F.col(quoted(text)), seed).alias(names["draw"]))
    side = targets.select(F.col("source").alias(names["source"]), F.col("rate").alias(names["rate"]), F.col("source_size").alias("_mixed_size"), F.col("target").alias("_mixed_target"))
    both = rows.join(side, F.col(quoted(source)).eqNullSafe(F.col(names["source"])))
    rate = F.col(names["rate"])
    copies = F.floor(rate) + (F.col(names["draw"]) < rate - F.floor(rate)).cast("int")
    return both.select(*kept, F.col(names["size"]).alias("size"), F.col("_mixed_size").alias("source_size"), F.col("_mixed_target").alias("target"), copies.cast("int").alias("copies"))


def emit(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row ``copies`` times, with ``copy`` from 0."""
    return mixed.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
