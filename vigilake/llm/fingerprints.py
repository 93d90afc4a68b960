"""Document fingerprints by SimHash, and search among them by permuted block tables; Spark SQL only.

Terms are shingles of five words; a term's weight is how often it occurs.  Each term's 64-bit hash votes for
or against each bit with its weight; a bit is set where the votes for it weigh more than half.

Search: the 64 bits are cut into ``blocks`` blocks.  Fingerprints within ``radius`` bits agree on at least
``blocks - radius`` whole blocks, so each choice of that many blocks is a table keyed by their bits; a query
meets its candidates by equi-joins on the tables' keys and is verified by XOR and a bit count.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilake.llm.scratch import Scratch
from vigilake.llm.simhash_dedup import shingle_hashes, words
from vigilake.llm.votes import hex16, longs, majority, vote_sums

_LEAST = -(1 << 63)
_ROW_BITS = 33  # of monotonically_increasing_id: the row's number in its partition


def likeness(a: Column, b: Column) -> Column:
    """Estimated cosine of two texts' term weights from their fingerprints, 0 to 1."""
    return F.greatest(F.cos(F.bit_count(a.bitwiseXOR(b)) * (math.pi / 64)), F.lit(0.0))


def _weigh(rows: DataFrame, keys: list[str], text_col: str, shingle: int) -> DataFrame:
    """(*keys, fp): rows of different keys are different texts."""
    hashes = shingle_hashes(rows.select(*keys, words(F.col(text_col)).alias("_w")), keys, "_w", shingle)
    votes = hashes.groupBy(*keys).agg(F.count("h").alias("_n"), *vote_sums(F.col("h")))
    return votes.select(*keys, F.coalesce(majority(F.col("_n")), F.lit(0).cast("long")).alias("fp"))


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """(id, fp) per row; texts without words, or null, have 0; equal texts have equal fingerprints."""
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("id"), F.col(text_col).alias("_text"))
    return _weigh(rows, ["_row", "id"], "_text", shingle).select("id", "fp")


def block_masks(blocks: int, radius: int) -> list[int]:
    """The masks of the tables: every choice of ``blocks - radius`` of the blocks."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [signed(sum(c)) for c in combinations(parts, blocks - radius)]


def search(queries: DataFrame, corpus: DataFrame, radius: int = 3, blocks: int = 5) -> DataFrame:
    """(query, fp): for distinct ``queries`` (fp), every distinct fingerprint of ``corpus`` (fp) within ``radius`` bits."""
    masks = longs(block_masks(blocks, radius))
    table = lambda df, name: df.select("fp", F.explode(F.transform(masks, lambda m: F.xxhash64(m, F.col("fp").bitwiseAND(m)))).alias("key")).withColumnRenamed("fp", name)
    q, c = table(queries.select("fp").distinct(), "query"), table(corpus.select("fp").distinct(), "fp")
    near = F.bit_count(F.col("query").bitwiseXOR(F.col("fp"))) <= radius
    return c.join(q, (c["key"] == q["key"]) & near).select("query", "fp").distinct()


def with_next(docs: DataFrame, id_col: str, text_col: str, scratch: Scratch, rows_per_bucket: int = 256) -> DataFrame:
    """(bucket, nth, halo, id, text, next_text): the text of the next document in descending id, the first after the last.

    Documents are sorted by ranges, a saved table, and dealt on to buckets of neighbours, each with a copy (``halo``) of the
    document that follows its last; of the ranges a row each is gathered and broadcast.  Rows that share an id follow
    each other by text, as far as its first 256 characters tell them apart; null ids come last.  Rows of one id may be many ranges.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(_LEAST))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), key.alias("_key"), F.monotonically_increasing_id().alias("_row"))
    ranges = rows.withColumn("_begins", F.substring("text", 1, 256)).repartitionByRange(F.desc("_key"), "_begins", "_row")
    placed = scratch.save(ranges.sortWithinPartitions(F.desc("_key"), "text", "_row").select("id", "text", F.monotonically_increasing_id().alias("place")))
    part, nth = F.shiftright("place", _ROW_BITS), F.col("place").bitwiseAND((1 << _ROW_BITS) - 1)
    placed = placed.select("id", "text", part.alias("_part"), nth.alias("_nth"), (F.shiftleft(part, 31) + F.floor(nth / rows_per_bucket)).alias("_own"))
    last = placed.groupBy(F.col("_part").alias("_p")).agg(F.max("_own").alias("_last"))
    of_all = Window.orderBy("_p")
    before = last.select("_p", F.coalesce(F.lag("_last").over(of_all), F.max("_last").over(of_all.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("_before"))
    ends = F.when(F.col("_nth") == 0, F.col("_before")).when(F.col("_nth") % rows_per_bucket == 0, F.col("_own") - 1)  # the bucket that this row follows
    at = lambda bucket, halo: F.struct(bucket.alias("bucket"), F.lit(halo).alias("halo"))
    places = F.array_compact(F.array(at(F.col("_own"), False), F.when(ends.isNotNull(), at(ends, True))))
    copied = placed.join(F.broadcast(before), F.col("_part") == F.col("_p")).select("id", "text", "_nth", F.explode(places).alias("p")).select("id", "text", "_nth", "p.bucket", "p.halo")
    w = Window.partitionBy("bucket").orderBy("halo", "_nth")
    return copied.select("bucket", F.row_number().over(w).alias("nth"), "halo", "id", "text", F.lead("text").over(w).alias("next_text"))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, radius: int = 3, query_every: int = 50) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_near) per row.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by as many first ones of
    the next document (or all it has).  ``n_near``: for ids divisible by ``query_every``, how many other rows'
    fingerprints lie within ``radius`` bits; null for other rows.  Null texts count as empty.  Repeated rows
    follow each other and each keep theirs.  An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "fingerprints")
    rows = with_next(docs, id_col, text_col, scratch)
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.select("bucket", "nth", "halo", "id", "text", F.when(~F.col("halo"), edited).alias("edited"))
    kept = ["bucket", "nth", "halo", "id", "n_chars", "edited_sha256"]
    rows = rows.select("bucket", "nth", "halo", "id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("t")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("t")))).alias("x"))
    rows = rows.select(*kept, "x.which", "x.t").filter("t is not null")
    votes = _weigh(rows, [*kept, "which"], "t", shingle)
    both = votes.groupBy(*kept).agg(F.max(F.when(F.col("which") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("which") == 1, F.col("fp"))).alias("edited_fp"))
    following = F.lead("fp").over(Window.partitionBy("bucket").orderBy("nth"))
    out = both.select("*", following.alias("next_fp")).filter(~F.col("halo"))
    out = scratch.save(out.select("id", "n_chars", "edited_sha256", "fp", "edited_fp", "next_fp"))

    asks = F.coalesce(F.col("id") % query_every == 0, F.lit(False))
    sizes = out.groupBy("fp").agg(F.count("*").alias("n"))
    near = search(out.filter(asks), sizes, radius).join(sizes, "fp").groupBy("query").agg((F.sum("n") - 1).alias("n_near"))
    asked = out.filter(asks).join(near, F.col("fp") == F.col("query"), "left").drop("query")
    out = asked.unionByName(out.filter(~asks).withColumn("n_near", F.lit(None).cast("long")))
    return out.select(F.col("id").alias(id_col), "n_chars", "edited_sha256", hex16(F.col("fp")).alias("fingerprint"), hex16(F.col("edited_fp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), "n_near")
