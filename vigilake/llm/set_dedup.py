"""Near-duplicates by the Jaccard similarity of shingle sets.

1. Shingles of words as 64-bit hashes; documents of equal sets are one node.  Of each set a digest and its band keys
   are kept, not the set.
2. Candidates: 160 minima of each set in 32 bands of five.  Two sets of similarity s share no band with probability
   (1 - s^5)^32: 3e-6 at 0.8.
3. Verification on the whole sets, which are made again for candidates alone.  First each member of a band's run with
   the one run's smallest that it shares most bands with; then with the smallest of its other runs, where they are
   still apart.  A run whose members are near copies costs its length.
4. Members of runs that are still apart are compared in blocks of bounded size: all that such runs connect is cut into
   pieces, and every two pieces meet in a group that gives links, not pairs.  This costs the square of the number of
   documents that are alike, but less than ``similarity``, and so stay apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.llm.components import connected_components
from vigilake.llm.scratch import Scratch
from vigilake.llm.simhash_dedup import _forest, words

BANDS, ROWS = 32, 5


def _words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, w): the hashes of each text's words in order."""
    rows = docs.select(F.col(id_col).alias("id"), F.filter(words(F.col(text_col)), lambda w: w != "").alias("w"))
    return rows.select("id", F.transform("w", lambda w: F.xxhash64(w)).alias("w"))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _shingles(w: np.ndarray, size: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles (the whole sequence if shorter; empty without words)."""
    n = min(size, len(w))
    h = np.zeros(len(w) - n + 1 if n else 0, "u8")
    for k in range(n):  # in order: the mix tells places apart
        h = _mix(h + np.uint64(0x9E3779B97F4A7C15) + w[k : len(w) - n + 1 + k])
    return np.unique(h)


def _each(batch: pa.RecordBatch, size: int) -> Iterator[np.ndarray]:
    w = batch.column("w")
    flat, at = w.flatten().to_numpy(zero_copy_only=False).view("u8"), np.r_[0, np.cumsum(w.value_lengths().to_numpy())]
    for a, b in zip(at[:-1], at[1:], strict=True):
        yield _shingles(flat[a:b], size)


def _name(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _sets(size: int):
    """mapInArrow: (id, w) -> (d, s): digest and set."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = list(_each(batch, size))
            ends = np.r_[0, np.cumsum([len(x) for x in out])].astype("i4")
            sets = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, "u8"), *out]).view("i8")))
            yield pa.RecordBatch.from_arrays([pa.array([_name(x) for x in out], pa.binary()), sets], names=["d", "s"])

    return go


def _summaries(size: int):
    """mapInArrow: (id, w) -> (id, n, d, keys): the set's size, its digest, and a key per band."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.random.default_rng(11)
        mult = g.integers(1, 1 << 63, BANDS * ROWS, dtype="u8") * np.uint64(2) + np.uint64(1)
        for batch in batches:
            sizes, names, least = [], [], np.full((batch.num_rows, BANDS * ROWS), np.iinfo("u8").max, "u8")
            for i, s in enumerate(_each(batch, size)):
                sizes.append(len(s))
                names.append(_name(s))
                mixed = _mix(s)
                for k in range(0, len(s), 2048):
                    h = mixed[k : k + 2048, None] * mult
                    least[i] = np.minimum(least[i], (h ^ (h >> np.uint64(32))).min(0))
            key = np.tile(np.arange(BANDS, dtype="u8"), (batch.num_rows, 1))
            for r in range(ROWS):
                key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + least[:, r::ROWS])
            keys = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype="i4") * BANDS), pa.array(key.view("i8").ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), keys], names=["id", "n", "d", "keys"])

    return go


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose sets are as similar as that.  ``a`` are few and meet many, so ``b``'s sets move to them."""
    left = sets.select(F.col("rep").alias("a"), F.col("s").alias("_x"))
    right = sets.select(F.col("rep").alias("b"), F.col("s").alias("_y"))
    both = F.size(F.array_intersect("_x", "_y"))
    enough = both >= similarity * (F.size("_x") + F.size("_y") - both) - 1e-9
    return pairs.select("a", "b").join(right, "b").join(left, "a").filter(enough).select("a", "b")


def _still_apart(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """Pairs (a, b) that the links found so far don't join."""
    part = lambda c: parts.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))
    rows = pairs.join(part("a"), "a", "left").join(part("b"), "b", "left")
    return rows.filter(F.coalesce("_a", "a") != F.coalesce("_b", "b")).drop("_a", "_b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, component_id): a row per row of ``docs``, with the smallest id that links of at least ``similarity`` reach.

    Texts without words link with each other.  Rows that repeat an id are one document.  Rows with a null id link
    like any other; they have their group's smallest id (null if it has none).  An empty table gives no rows; other
    columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "sets")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = scratch.save(_words(docs, id_col, text_col).mapInArrow(_summaries(shingle), f"id {kind}, n long, d binary, keys array<long>"))
    # a set's name in links is a number of its own; its owner is its smallest id
    uniq = rows.groupBy("d").agg(F.min("id").alias("owner"), F.max("n").alias("n"), F.first("keys").alias("keys"))
    uniq = scratch.save(uniq.select(F.monotonically_increasing_id().alias("rep"), "d", "owner", "n", "keys"))
    runs = uniq.filter("n > 0").select("rep", "n", F.explode("keys").alias("key"))
    shared = runs.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("m"), F.count("*").alias("c")).filter("c > 1").select("key", "m")
    met = scratch.save(runs.join(shared, "key"))
    near = F.least("n", "k") >= similarity * F.greatest("n", "k") - 1e-9
    star = met.select(F.col("m.rep").alias("a"), F.col("rep").alias("b"), "n", F.col("m.n").alias("k")).filter("a <> b").filter(near)
    star = scratch.save(star.groupBy("a", "b").agg(F.count("*").alias("bands")))
    sets = _candidate_sets(docs, id_col, text_col, shingle, uniq.join(met.select("rep").distinct(), "rep", "left_semi").select("rep", "d", "owner"), scratch)
    best = star.groupBy("b").agg(F.max(F.struct("bands", "a"))["a"].alias("a"))
    found = scratch.save(_similar(best, sets, similarity))
    parts = scratch.save(connected_components(found, scratch))
    more = scratch.save(_similar(_still_apart(star.select("a", "b"), parts), sets, similarity))
    found = found.unionByName(more)
    parts = scratch.save(connected_components(found, scratch))
    now = scratch.save(met.select("key", "rep", "n").join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("c")))
    mixed = now.groupBy("key").agg(F.min("rep").alias("a"), F.min("c").alias("x"), F.max("c").alias("y")).filter("x <> y").select("key", "a")
    apart = scratch.save(now.join(mixed, "key").select("rep", "n", "c", "a").distinct())
    around = connected_components(apart.select("a", F.col("rep").alias("b")), scratch).select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
    members = apart.select("rep", "n", "c").distinct().join(around, "rep")
    last = scratch.save(_block_links(members, sets, similarity))
    # an id with several sets joins them
    named = rows.select("id", "d").filter("id is not null").distinct()
    many = named.groupBy("id").agg(F.count("*").alias("c")).filter("c > 1").select("id")
    owned = named.join(many, "id", "left_semi").join(uniq.select("d", "rep"), "d")
    one = owned.groupBy("id").agg(F.min("rep").alias("b"))
    links = found.unionByName(last).unionByName(owned.join(one, "id").select(F.col("rep").alias("a"), "b"))
    groups = scratch.save(connected_components(links, scratch))
    by_set = uniq.select("rep", "d", "owner").join(groups.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least = by_set.groupBy("component").agg(F.min("owner").alias("component_id"))
    out = rows.select("id", "d").join(by_set.select("d", "component"), "d").join(least, "component")
    return out.select(F.col("id").alias(id_col), F.col("component_id").cast("long").alias("component_id"))


def _links_between(similarity: float):
    """applyInPandas on two pieces (``stored`` and not) of a cluster: a spanning forest of the links between them."""

    def go(pdf: pd.DataFrame) -> pd.DataFrame:
        data, asks = pdf[pdf["stored"]], pdf[~pdf["stored"]]
        a, b = [], []
        if len(data) and len(asks):
            sizes = data["s"].map(len).to_numpy()
            flat = np.concatenate([np.asarray(x, "i8") for x in data["s"]])
            order = np.argsort(flat, kind="stable")
            held, owner = flat[order], np.repeat(np.arange(len(data)), sizes)[order]
            reps, parts = data["rep"].to_numpy(), data["c"].to_numpy()
            for rep, part, s in zip(asks["rep"], asks["c"], asks["s"], strict=True):
                s = np.asarray(s, "i8")
                lo, hi = np.searchsorted(held, s, "left"), np.searchsorted(held, s, "right")
                n = hi - lo
                at = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                both = np.bincount(owner[at], minlength=len(data))
                near = (both >= similarity * (sizes + len(s) - both) - 1e-9) & (parts != part)
                a += [rep] * int(near.sum())
                b += reps[near].tolist()
        links = _forest(np.array(a, "i8"), np.array(b, "i8")) if a else []
        return pd.DataFrame({"a": pd.array([x for x, _ in links], "Int64"), "b": pd.array([y for _, y in links], "Int64")})

    return go


def _block_links(members: DataFrame, sets: DataFrame, similarity: float, block_rows: int = 512, block_hashes: int = 2_000_000) -> DataFrame:
    """(a, b): links of ``members`` (rep, n, c, cluster) of one cluster and different ``c``, enough to connect all that links connect.

    Clusters are cut by a hash into pieces of about ``block_rows`` documents and ``block_hashes`` hashes at most; each
    piece goes to as many groups as there are pieces.
    """
    pieces = members.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / block_rows), F.ceil(F.sum("n") / block_hashes)).cast("int").alias("pieces"))
    rows = members.join(pieces, "cluster").join(sets, "rep").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("pieces")).cast("int"))
    cols = ["cluster", "rep", "c", "s"]
    stored = rows.select(*cols, F.lit(True).alias("stored"), F.col("own").alias("x"), F.explode(F.sequence("own", F.col("pieces") - 1)).alias("q"))
    asks = rows.select(*cols, F.lit(False).alias("stored"), F.explode(F.sequence(F.lit(0), F.col("own"))).alias("x"), F.col("own").alias("q"))
    return stored.unionByName(asks).groupBy("cluster", "x", "q").applyInPandas(_links_between(similarity), "a long, b long")


def _candidate_sets(docs: DataFrame, id_col: str, text_col: str, shingle: int, wanted: DataFrame, scratch: Scratch) -> DataFrame:
    """(rep, s): the sets of ``wanted`` (rep, d, owner), made from the texts of their owners.

    Sets whose rows have no id are looked for among the rows without one.
    """
    wanted = scratch.save(wanted)
    owners = wanted.filter("owner is not null").select(F.col("owner").alias("__owner")).distinct()
    mine = docs.select(id_col, text_col)
    texts = mine.join(owners, F.col(id_col) == F.col("__owner"), "left_semi")
    if wanted.filter("owner is null").limit(1).count():
        texts = texts.unionByName(mine.filter(F.col(id_col).isNull()))
    made = _words(texts, id_col, text_col).mapInArrow(_sets(shingle), "d binary, s array<long>")
    return scratch.save(made.join(wanted.select("rep", "d"), "d").groupBy("rep").agg(F.first("s").alias("s")))
