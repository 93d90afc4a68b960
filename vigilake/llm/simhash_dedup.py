"""SimHash near-duplicates by generalised pigeonhole.

Fingerprints: word shingles, hashed, vote on 64 bits (all in Spark SQL).  Links: distinct fingerprints that
differ in at most ``radius`` bits.  Candidate search:

1. From counts over all distinct fingerprints, bits that go together are grouped into m partitions.
2. Each partition gets its own threshold T_i (-1: unused) by dynamic programming over estimated costs, with
   sum(T_i + 1) = radius + 1.  Then two fingerprints within the radius differ in at most T_i bits in at least
   one partition i, so no link can be missed, whatever the estimates are worth.
3. Probe: for each partition and each set of T_i of its bits, rows that agree on the partition's other bits
   share a key.  Rows are dealt by key and verified inside the key's run with XOR and a bit count.

A run writes a spanning forest of its links, not all pairs.  A run of more than ``run_limit`` fingerprints
isn't compared pairwise: its members meet at midpoints instead (two words within 2r bits share a word within
r bits of both), which is exact and linear in the run.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilake.llm.components import connected_components
from vigilake.llm.scratch import Scratch, unused
from vigilake.llm.votes import hex16, longs, majority, vote_sums

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """Words of a text, A-Z in lower case; only space and the characters 9 to 13 part them; [""] if there are none."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.split(F.btrim(low, F.lit(SPACES)), r"[\x20\x09-\x0D]+")


def shingle_hashes(rows: DataFrame, keep: list[str], words_col: str, size: int) -> DataFrame:
    """(*keep, h): a row per shingle of ``size`` words (the whole sequence if shorter), h null where there is no word.

    The array is exploded by index so that slicing and hashing stay in generated code.
    """
    w, i = F.col(words_col), F.col("_i")
    at = rows.select(*keep, words_col, F.explode(F.sequence(F.lit(0), F.greatest(F.size(w) - size, F.lit(0)))).alias("_i"))
    shingle = F.concat_ws(" ", *[F.get(w, i + k) for k in range(size)])
    return at.select(*keep, F.when(F.get(w, i) != "", F.xxhash64(shingle)).alias("h"))


def with_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp long, n_shingles long), one row per row of ``docs``.

    A text of fewer words than a shingle is one shingle; a text without words, or null, has fingerprint 0.
    Rows are told apart by position, so repeated rows each keep theirs.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("id"), words(F.col(text_col)).alias("_w"))
    hashes = shingle_hashes(rows, ["_row", "id"], "_w", shingle)
    votes = hashes.groupBy("_row", "id").agg(F.count("h").alias("n_shingles"), *vote_sums(F.col("h")))
    return votes.select("id", F.coalesce(majority(F.col("n_shingles")), F.lit(0).cast("long")).alias("fp"), "n_shingles")


# --- plan of the probe -------------------------------------------------------------------------------------


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often bits i and j are both set, over one partition's fingerprints."""
    total = np.zeros((64, 64))
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8")
        bits = np.unpackbits(fp.view("u1").reshape(-1, 8), axis=1, bitorder="little").astype("f4")
        total += bits.T @ bits
    i, j = np.nonzero(total)
    yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "c": pa.array(total[i, j].astype("i8"))})


def correlated_partitions(both_set: np.ndarray, n: int, m: int) -> list[list[int]]:
    """Bits in m groups of near equal size, the most correlated together, from 64 x 64 counts over all rows."""
    f = both_set / max(n, 1)
    p = np.diag(f)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((f - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    free, groups = set(range(64)), []
    for k in range(m):
        size = (64 - sum(map(len, groups))) // (m - k)
        left = sorted(free)
        group = [max(left, key=lambda b: (corr[b, left].sum(), -b))]
        free.discard(group[0])
        while len(group) < size:
            best = max(sorted(free), key=lambda b: (corr[b, group].sum(), -b))
            group.append(best)
            free.discard(best)
        groups.append(sorted(group))
    return groups


def allocate(cost: list[dict[int, float]], radius: int) -> tuple[float, list[int]]:
    """Thresholds with sum(T + 1) = radius + 1 and the least total cost; ``cost[i][T]`` for T from -1."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for part in cost:
        then: dict[int, tuple[float, list[int]]] = {}
        for used, (c, ts) in best.items():
            for t, more in part.items():
                u = used + t + 1
                if u <= radius + 1 and (u not in then or c + more < then[u][0]):
                    then[u] = (c + more, [*ts, t])
        best = then
    return best.get(radius + 1, (float("inf"), []))


def _at_most(p: np.ndarray) -> np.ndarray:
    """P(at most t of independent events with probabilities p), for each t."""
    d = np.array([1.0])
    for x in p:
        d = np.convolve(d, [1 - x, x])
    return np.cumsum(d)


def plan_masks(fps: DataFrame, n: int, radius: int, run_limit: int, key_cost: float = 200.0) -> tuple[list[int], dict]:
    """Masks whose agreement makes two fingerprints candidates, and what was decided.

    Costs are in XORs; ``key_cost`` is what dealing out one row costs.  All counts are over all rows.
    """
    both = np.zeros((64, 64))
    for r in fps.mapInArrow(_pair_counts, "i int, j int, c long").groupBy("i", "j").agg(F.sum("c").alias("c")).collect():  # at most 64 x 64 rows
        both[r["i"], r["j"]] = r["c"]
    differ = 2 * np.diag(both) / max(n, 1) * (1 - np.diag(both) / max(n, 1))
    tries = {m: correlated_partitions(both, n, m) for m in range(2, radius + 2)}
    mask = lambda bits: sum(1 << b for b in bits)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    whole = {signed(mask(g)) for gs in tries.values() for g in gs}
    # exact candidate counts at threshold 0: sum over values of count squared, by mask, over all rows
    keyed = fps.select(F.explode(F.array(*[F.struct(F.lit(x).alias("mask"), F.col("fp").bitwiseAND(F.lit(x)).alias("v")) for x in sorted(whole)])).alias("k"))
    same = {r["mask"]: r["s"] for r in keyed.groupBy("k.mask", "k.v").count().groupBy("mask").agg(F.sum(F.col("count").cast("double") * F.col("count")).alias("s")).collect()}
    best = None
    for m, groups in tries.items():
        cost = []
        for g in groups:
            near = _at_most(differ[g])
            part = {-1: 0.0}
            for t in range(0, radius + 1):
                if t < len(g) and comb(len(g), t) <= 2500:
                    pairs = same.get(signed(mask(g)), n) * near[t] / max(near[0], 1e-300)
                    keys = comb(len(g), t)
                    run = pairs / max(n * keys, 1)
                    part[t] = n * keys * key_cost + min(pairs * (t + 1), n * keys * 1e5) / 2 + (n * 2081 * key_cost if run > run_limit / 4 else 0)
            cost.append(part)
        total, ts = allocate(cost, radius)
        if ts and (best is None or total < best[0]):
            best = (total, groups, ts)
    _, groups, ts = best
    masks = [signed(mask(b for b in g if b not in skip)) for g, t in zip(groups, ts, strict=True) if t >= 0 for skip in map(set, combinations(g, t))]
    return masks, {"partitions": groups, "thresholds": ts}


# --- probe and verify --------------------------------------------------------------------------------------


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links (a[i], b[i])."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        if (p := root(x)) != (q := root(y)):
            up[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def _dense_links(fp: np.ndarray, rep: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join what is connected inside one run: breadth first, each member looks at what is left."""
    out, left = [], np.arange(len(fp))
    while len(left) > 1:
        seed, left = left[0], left[1:]
        front = [seed]
        while front and len(left):
            x = front.pop()
            near = np.bitwise_count(fp[left] ^ fp[x]) <= radius
            if near.any():
                found = left[near]
                out += [(int(rep[x]), int(y)) for y in rep[found]]
                front += found.tolist()
                left = left[~near]
    return out


def run_links(radius: int, run_limit: int, small: int = 48):
    """mapInArrow over rows (key, fp, rep) sorted by key -> (a, b, hot): links of reps, or members of too long runs."""

    def pairs(key: np.ndarray, fp: np.ndarray, rep: np.ndarray) -> list[tuple[int, int]]:
        """Whole runs only."""
        fp = fp.view("u8")  # bit counts of negative numbers are those of their absolute value
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        left_in_run = np.repeat(starts + sizes, sizes) - np.arange(len(key))
        at = np.flatnonzero((left_in_run > 1) & (np.repeat(sizes, sizes) <= small))
        found_a, found_b = [], []
        for s in range(1, small):
            at = at[left_in_run[at] > s]
            if not len(at):
                break
            near = at[np.bitwise_count(fp[at] ^ fp[at + s]) <= radius]
            found_a.append(rep[near])
            found_b.append(rep[near + s])
        out = _forest(np.concatenate(found_a), np.concatenate(found_b)) if found_a else []
        for k in np.flatnonzero(sizes > small):
            out += _dense_links(fp[starts[k] : starts[k] + sizes[k]], rep[starts[k] : starts[k] + sizes[k]], radius)
        return out

    def batch(links: list[tuple[int, int]], hot: list[np.ndarray]) -> pa.RecordBatch:
        a = np.array([x for x, _ in links], "i8")
        b = np.array([y for _, y in links], "i8")
        more = np.concatenate([np.empty((0, 2), "i8"), *hot])
        return pa.RecordBatch.from_pydict({"a": pa.array(np.r_[a, more[:, 0]]), "b": pa.array(np.r_[b, more[:, 1]]), "hot": pa.array(np.r_[np.zeros(len(a), bool), np.ones(len(more), bool)])})

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, "i8")] * 3
        burning = None  # key of a run that is already too long
        for got in batches:
            rows = [np.concatenate([h, got.column(i).to_numpy(zero_copy_only=False).astype("i8")]) for i, h in enumerate(held)]
            hot = []
            if burning is not None:
                n = int(np.searchsorted(rows[0], burning, side="right"))
                hot.append(np.stack([rows[1][:n], rows[2][:n]], 1))
                rows = [x[n:] for x in rows]
                burning = burning if not len(rows[0]) else None
            if len(rows[0]):
                cut = int(np.searchsorted(rows[0], rows[0][-1]))
                done, held = [x[:cut] for x in rows], [x[cut:] for x in rows]
                if len(held[0]) > run_limit:
                    burning = held[0][-1]
                    hot.append(np.stack([held[1], held[2]], 1))
                    held = [np.empty(0, "i8")] * 3
                if cut:
                    starts = np.flatnonzero(np.r_[True, done[0][1:] != done[0][:-1]])
                    sizes = np.diff(np.r_[starts, cut])
                    if (sizes > run_limit).any():
                        long = np.repeat(sizes > run_limit, sizes)
                        hot.append(np.stack([done[1][long], done[2][long]], 1))
                        done = [x[~long] for x in done]
                links = pairs(*done) if len(done[0]) else []
            else:
                held, links = [np.empty(0, "i8")] * 3, []
            if links or hot:
                yield batch(links, hot)
        if len(held[0]) and (links := pairs(*held)):
            yield batch(links, [])

    return go


def _midpoint_links(hot: DataFrame, radius: int, task_rows: int = 2_000_000) -> DataFrame:
    """(a, b) links of reps that connect exactly what links of at most ``radius`` bits connect.

    Words at distance d <= radius share a word within radius / 2 of both, and only such do (radius is even).

    Spark's estimate of a table's size knows nothing of an explode and takes the midpoints, some 2,000 times as many
    rows, for as small as ``hot``: a join would broadcast them through the driver, and an exchange be merged into one
    task.  So there is no join, and as many tasks as make about ``task_rows`` midpoints each.
    """
    flips = [0] + [sum(1 << b for b in c) for k in range(1, radius // 2 + 1) for c in combinations(range(64), k)]
    flips = [x - (1 << 64) if x >> 63 else x for x in flips]
    tasks = -(-hot.count() * len(flips) // task_rows) or 1
    at = hot.select("fp", "rep").repartition(tasks, "fp").select("rep", "fp", F.explode(longs(flips)).alias("x"))
    at = at.select("rep", F.col("fp").bitwiseXOR(F.col("x")).alias("mid")).repartition(tasks, "mid")
    least = F.min("rep").over(Window.partitionBy("mid"))
    return at.select(F.col("rep").alias("a"), least.alias("b")).filter("a <> b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, run_limit: int = 4096) -> DataFrame:
    """(id, fingerprint, component_id): one row per row of ``docs``.

    ``component_id`` is the smallest id reachable over links of at most ``radius`` differing bits, own id
    included.  Null or empty texts have fingerprint 0 and link like any other.  Rows that repeat an id are one
    document.  Rows with a null id link like any other; they have their group's smallest id (null if it has none).
    An empty table gives an empty result; other columns of ``docs`` are ignored.
    """
    if radius % 2:
        raise ValueError("radius must be even: long runs meet at midpoints")
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.save(with_fingerprint(docs, id_col, text_col, shingle))
    # a fingerprint's name in links is a number of its own; its owner is its smallest id, if any of its rows has one
    reps = scratch.save(rows.groupBy("fp").agg(F.min("id").cast("long").alias("owner")).select(F.monotonically_increasing_id().alias("rep"), "fp", "owner"))
    n = reps.count()
    masks, _ = plan_masks(reps.select("fp"), n, radius, run_limit)
    keys = F.transform(longs(masks), lambda m: F.xxhash64(m, F.col("fp").bitwiseAND(m)))
    keyed = reps.select(F.explode(keys).alias("key"), "fp", "rep").repartition("key").sortWithinPartitions("key")
    found = scratch.save(keyed.mapInArrow(run_links(radius, run_limit), "a long, b long, hot boolean"))
    links = found.filter("not hot").select("a", "b")
    if found.filter("hot").limit(1).count():
        hot = scratch.save(found.filter("hot").select(F.col("a").alias("fp"), F.col("b").alias("rep")).distinct())
        links = links.unionByName(_midpoint_links(hot, radius))
    # rows of one id with different texts are one document: the id itself joins their fingerprints
    many = rows.groupBy("id").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).filter("x <> y and id is not null").select("id")
    owned = rows.select("id", "fp").join(many, "id", "left_semi").distinct().join(reps.select("fp", "rep"), "fp")
    links = links.unionByName(owned.join(owned.groupBy("id").agg(F.min("rep").alias("b")), "id").select(F.col("rep").alias("a"), "b"))
    parts = connected_components(links, scratch).select(F.col("node").alias("rep"), "component")
    by_fp = scratch.save(reps.join(parts, "rep", "left").select("fp", "owner", F.coalesce("component", "rep").alias("component")))
    least = by_fp.groupBy("component").agg(F.min("owner").alias("component_id"))
    out = rows.join(by_fp.join(least, "component").select("fp", "component_id"), "fp")
    return out.select(F.col("id").alias(id_col), hex16(F.col("fp")).alias("fingerprint"), "component_id")


def _united(found: list[DataFrame], id_col: str, scratch: Scratch) -> DataFrame:
    """(id, component_id) of what the groups of several searches over the same rows connect."""
    named = [g.select(F.col(id_col).cast("long").alias("a"), F.col("component_id").alias("b")) for g in found]
    links = scratch.save(named[0].unionByName(named[1]).filter("a <> b"))
    parts = connected_components(links, scratch)
    least = parts.groupBy("component").agg(F.min("node").alias("least"))
    dropped = parts.join(least, "component").filter("node <> least").select(F.col("node").alias("a"), "least")
    return named[0].select("a").filter("a is not null").distinct().join(dropped, "a", "left").select(F.col("a").alias(id_col), F.coalesce("least", "a").alias("component_id"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, similarity: float | None = None) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates: the one with the smallest id.

    With ``similarity``, groups are what links of fingerprints and links of ``set_dedup`` (shingle sets of at least that
    Jaccard similarity, of which fingerprints miss many) connect together.

    Of rows that repeat the kept id, the one with the smallest text stays.  Rows with a null id can't be named
    as copies and all stay.
    """
    if similarity is None:
        groups = near_duplicates(docs, id_col, text_col, shingle)
    else:
        from vigilake.llm import set_dedup  # it needs this module's words

        scratch = Scratch(docs.sparkSession, "united")
        groups = _united([scratch.save(f) for f in (near_duplicates(docs, id_col, text_col, shingle), set_dedup.near_duplicates(docs, id_col, text_col, shingle, similarity))], id_col, scratch)
    name, nth = unused(docs, "kept"), unused(docs, "nth")
    kept = groups.filter(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias(name)).distinct()
    named = docs.join(kept, F.col(id_col) == F.col(name), "left_semi")
    first = Window.partitionBy(id_col).orderBy(text_col)
    once = named.withColumn(nth, F.row_number().over(first)).filter(F.col(nth) == 1).drop(nth)
    return once.unionByName(docs.filter(F.col(id_col).isNull()))
