"""Near-duplicates of embeddings over a robust-pruned flat graph.

1. Equal vectors of a label are one node that stands for all of them.
2. Centroids, fitted per large label on a bounded sample, cut each label into clusters; each vector joins its
   ``overlap`` nearest ones and those whose border is within its ``reach``.  Clusters whose centroids are within the
   threshold of each other are one.  A cluster of more than ``shard_rows`` vectors is cut by a hash into pieces.
3. Build: each shard's vectors get neighbour lists by robust pruning (a neighbour is dropped if a kept one is
   closer to it, by a factor alpha, than the vector is).  A vector's lists of all its shards are united.
4. Search: each vector asks in its shards, greedily from the shard's medoid with a beam; whatever it meets
   within the range is expanded until nothing new is within the range.
5. Found pairs are verified by cosine in double precision; each pair counts in one shard only.
6. Audit: all vectors whose id is divisible by 50 (and others where those are few), in blocks, are compared with all
   rows, and with them as many planted queries, which are audited vectors turned by less than the threshold's angle, so that there is
   something to find in any table.  If recall, by link or by vector, is below the target, the search is run again with a wider beam, more overlap, more reach and longer lists; after the third time
   without the graph: each vector is put wherever a link of it may lie, and shards are compared pair by pair.

Shards are bounded, so a task's memory is; links leave a task as counts and a spanning forest, not as pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilake.llm.components import connected_components
from vigilake.llm.scratch import Scratch
from vigilake.llm.simhash_dedup import _forest


@dataclass(frozen=True)
class Settings:
    """``sample_rows`` bounds what centroids are fitted on, ``centroids`` their number, ``audit_rows`` a block of the audit.

    ``reach``: how far across a border links are looked for, in standard deviations of the step that the longest
    link takes towards the border if its direction is by chance; infinite: as far as any link goes.
    """

    threshold: float = 0.98
    shard_rows: int = 800
    overlap: int = 2
    reach: float = 2.0
    degree: int = 24
    alpha: float = 1.2
    beam: int = 24
    sample_rows: int = 20_000
    centroids: int = 8192
    audit_rows: int = 1000
    least_recall: float = 0.98
    seed: int = 7


def distinct_vectors(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(rep, label, v, n): each valid vector of each label once, its smallest id, and how many rows hold it.

    Left out: null labels, ids or vectors, vectors with a null or non-finite component, and zero vectors.
    """
    v = F.transform(F.col("v"), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("v"))
    rows = rows.filter("id is not null and label is not null and v is not null").withColumn("v", v)
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.filter(fine).groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("n")).select("rep", "label", "v", "n")


PLANTED = -(1 << 62)  # planted queries have smaller numbers than any row's id may be


def plant(vectors: np.ndarray, threshold: float, seed: int) -> np.ndarray:
    """Vectors turned by half the angle of the threshold, in directions by chance."""
    u = _unit(vectors)
    r = np.random.default_rng(seed).normal(size=u.shape)
    r -= (r * u).sum(1, keepdims=True) * u
    size = np.linalg.norm(r, axis=1, keepdims=True)
    angle = np.arccos(np.clip(threshold, -1, 1)) / 2
    return np.cos(angle) * u + np.sin(angle) * np.divide(r, size, out=np.zeros_like(r), where=size > 1e-6)


# --- shards ------------------------------------------------------------------------------------------------


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def merged(c: np.ndarray, threshold: float) -> np.ndarray:
    """Numbers of clusters: centroids that a chain of steps within the threshold connects have one number."""
    number = np.arange(len(c))
    for i in range(0, len(c), 256):
        for a, b in zip(*np.nonzero(c[i : i + 256] @ c.T >= threshold), strict=True):
            x, y = number[i + a], number[b]
            if x != y:
                number[number == max(x, y)] = min(x, y)
    return number


def near_clusters(x: np.ndarray, c: np.ndarray, number: np.ndarray, overlap: int, reach: float, threshold: float) -> list[list[int]]:
    """For each unit vector, the clusters of its ``overlap`` nearest centroids and of those within its reach.

    A link of angle t crosses the border of x's nearest centroid m and centroid c only if x (m - c) <= sin(t) |m - c|.
    """
    step = np.sqrt(max(0.0, 1 - threshold**2)) * min(1.0, reach / np.sqrt(x.shape[1])) if threshold > 0 else np.inf
    out = []
    for i in range(0, len(x), 256):
        cos = x[i : i + 256] @ c.T
        order = np.argsort(-cos, axis=1, kind="stable")[:, :overlap]
        first = order[:, 0]
        gap = np.sqrt(np.maximum(2 - 2 * (c[first] @ c.T), 0))
        put = np.take_along_axis(cos, first[:, None], 1) - cos <= np.where(gap > 0, step * gap, 0) + 1e-9
        np.put_along_axis(put, order, True, 1)
        out += [np.unique(number[row]).tolist() for row in put]
    return out


def fit_centroids(nodes: DataFrame, cfg: Settings) -> dict:
    """label -> (unit centroids, numbers of their clusters), for labels of more than ``shard_rows`` vectors, from at most about ``sample_rows`` rows.

    Vectors of one label may differ in length; only those of the label's most frequent length get centroids.
    """
    sizes = nodes.groupBy("label", F.size("v").alias("d")).count().filter(F.col("count") > cfg.shard_rows).orderBy(F.desc("count"), "label", "d").limit(cfg.centroids).collect()
    if not sizes:
        return {}
    total, dims = sum(r["count"] for r in sizes), {}
    for r in sizes:
        dims.setdefault(r["label"], (r["d"], r["count"]))
    share = min(1.0, cfg.sample_rows / total)
    picked = nodes.filter(F.pmod(F.xxhash64("rep", F.lit(cfg.seed)), F.lit(1_000_003)) < share * 1_000_003).filter(F.col("label").isin(list(dims))).select("label", "v").toPandas()
    rng, out = np.random.default_rng(cfg.seed), {}
    for label, rows in picked.groupby("label"):
        d, count = dims[label]
        x = [v for v in rows["v"] if len(v) == d]
        k = min(len(x), max(1, int(cfg.centroids * count / total)), -(-2 * count // cfg.shard_rows))
        if k < 2:
            continue
        x = _unit(np.stack(x))
        c = x[rng.choice(len(x), k, replace=False)]
        for _ in range(8):
            near = (x @ c.T).argmax(1)
            sums = np.zeros_like(c)
            np.add.at(sums, near, x)
            held = np.linalg.norm(sums, axis=1) > 1e-9
            c[held] = sums[held] / np.linalg.norm(sums[held], axis=1, keepdims=True)
        out[label] = c, merged(c, cfg.threshold)
    return out


def _assign(sent, cfg: Settings):
    """mapInArrow: (label, v, ...) -> with ``clusters``, the numbers of the nearest clusters."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = sent.value
        for batch in batches:
            labels, vectors = batch.column("label").to_pylist(), batch.column("v")
            out: list[list[int]] = [[0]] * len(labels)
            rows: dict = {}
            for i, label in enumerate(labels):
                if label in centroids:
                    rows.setdefault(label, []).append(i)
            flat, at = vectors.flatten().to_numpy(), np.r_[0, np.cumsum(vectors.value_lengths().to_numpy())]
            for label, mine in rows.items():
                c, number = centroids[label]
                mine = [i for i in mine if at[i + 1] - at[i] == c.shape[1]]
                if mine:
                    x = _unit(np.stack([flat[at[i] : at[i + 1]] for i in mine]))
                    for i, cs in zip(mine, near_clusters(x, c, number, cfg.overlap, cfg.reach, cfg.threshold), strict=True):
                        out[i] = cs
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int32()))], names=[*batch.schema.names, "clusters"])

    return go


def place(nodes: DataFrame, cfg: Settings) -> DataFrame:
    """(rep, label, v, n, clusters, cluster, pieces): a row per vector and cluster; ``pieces``: parts the cluster is cut into."""
    sent = nodes.sparkSession.sparkContext.broadcast(fit_centroids(nodes.filter(F.col("rep") > PLANTED), cfg))
    kind = nodes.schema["label"].dataType.simpleString()
    put = nodes.mapInArrow(_assign(sent, cfg), f"rep long, label {kind}, v array<double>, n long, clusters array<int>")
    rows = put.withColumn("cluster", F.explode("clusters"))
    sizes = rows.groupBy("label", "cluster").agg(F.ceil(F.count("*") / (2 * cfg.shard_rows)).cast("int").alias("pieces"))
    return rows.join(sizes, ["label", "cluster"])


# --- graph -------------------------------------------------------------------------------------------------


def robust_prune(x: np.ndarray, degree: int, alpha: float, pool: int = 64) -> np.ndarray:
    """Neighbour lists (rows x degree, -1 where there are fewer) of unit vectors, all rows pruned in step."""
    n = len(x)
    dist = np.maximum(2 - 2 * (x @ x.T), 0).astype("f4")
    np.fill_diagonal(dist, np.inf)
    k = min(pool, n - 1)
    if k < 1:
        return np.full((n, 1), -1, "i4")
    near = np.argpartition(dist, k - 1, axis=1)[:, :k]
    far = np.random.default_rng(n).integers(0, n, (n, min(8, n)))  # some long edges, so that the graph holds together
    cand = np.concatenate([near, far], 1)
    d = np.take_along_axis(dist, cand, 1)
    order = np.argsort(d, axis=1, kind="stable")
    cand, d = np.take_along_axis(cand, order, 1), np.take_along_axis(d, order, 1)
    alive = np.isfinite(d)
    rows, out = np.arange(n), np.full((n, degree), -1, "i4")
    for r in range(degree):
        first = alive.argmax(1)
        some = alive[rows, first]
        if not some.any():
            break
        pick = cand[rows, first]
        out[some, r] = pick[some]
        alive[rows, first] = False
        alive &= ~((alpha * dist[pick[:, None], cand] <= d) | (cand == pick[:, None])) | ~some[:, None]
    return out


def both_ways(lists: np.ndarray, most: int) -> list[np.ndarray]:
    """Neighbour lists with edges back: to all whose nearest kept neighbour a row is, to others up to ``most`` in all."""
    rows, rank = np.nonzero(lists >= 0)
    to = lists[rows, rank]
    order = np.lexsort((rows, rank, to))
    rows, rank, to = rows[order], rank[order], to[order]
    nth = np.arange(len(to)) - np.searchsorted(to, to)
    keep = (rank == 0) | (nth < most)
    back = np.split(rows[keep], np.searchsorted(to[keep], np.arange(1, len(lists))))
    return [np.unique(np.r_[a[a >= 0], b]) for a, b in zip(lists, back, strict=True)]


def _build(cfg: Settings):
    def go(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, rows in pdf.groupby(pdf["v"].map(len)):
            reps = rows["rep"].to_numpy()
            lists = both_ways(robust_prune(_unit(np.stack(rows["v"])), cfg.degree, cfg.alpha), cfg.degree)
            out.append(pd.DataFrame({"rep": reps, "near": [reps[a] for a in lists]}))
        return pd.concat(out)

    return go


def build_graph(placed: DataFrame, cfg: Settings) -> DataFrame:
    """(rep, near): the united neighbour lists of all shards, whose sizes bound them."""
    piece = F.pmod(F.xxhash64("rep"), F.col("pieces"))
    lists = placed.filter(F.col("rep") > PLANTED).select("label", "cluster", piece.alias("piece"), "rep", "v").groupBy("label", "cluster", "piece").applyInPandas(_build(cfg), "rep long, near array<long>")
    return lists.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))


def range_search(x: np.ndarray, near: np.ndarray, q: np.ndarray, start: int, threshold: float, beam: int) -> list[np.ndarray]:
    """For each unit query, rows of ``x`` met within the range: beam search from ``start``, then range expansion."""
    nq, n, wide = len(q), len(x), min(beam, len(x))
    met = np.zeros((nq, n), bool)
    met[:, start] = True
    best = np.full((nq, wide), -2.0, "f4")
    who = np.full((nq, wide), start, "i4")
    done = np.ones((nq, wide), bool)
    best[:, 0], done[:, 0] = q @ x[start], False
    act = np.arange(nq)
    while len(act):
        fresh = np.where(done[act], -3, best[act])
        top = np.argsort(-fresh, axis=1, kind="stable")[:, :3]  # a few nodes of the beam at once
        open_ = np.take_along_axis(fresh, top, 1) > -2.5
        act, top, open_ = act[open_.any(1)], top[open_.any(1)], open_[open_.any(1)]
        if not len(act):
            break
        node = np.where(open_, who[act[:, None], top], -1)
        done[act[:, None], top] |= open_
        nb = np.where(node[:, :, None] >= 0, near[node], -1).reshape(len(act), -1)
        new = (nb >= 0) & ~met[act[:, None], np.maximum(nb, 0)]
        nb = np.where(new, nb, -1)
        nb.sort(axis=1)
        nb[:, 1:][nb[:, 1:] == nb[:, :-1]] = -1
        a, b = np.nonzero(nb >= 0)
        sim = np.full(nb.shape, -2.0, "f4")
        sim[a, b] = np.einsum("ij,ij->i", q[act[a]], x[nb[a, b]])
        met[act[a], nb[a, b]] = True
        all_sim = np.concatenate([best[act], sim], 1)
        all_who = np.concatenate([who[act], np.maximum(nb, 0)], 1)
        all_done = np.concatenate([done[act], nb < 0], 1)
        keep = np.argsort(-all_sim, axis=1, kind="stable")[:, :wide]
        best[act] = np.take_along_axis(all_sim, keep, 1)
        who[act] = np.take_along_axis(all_who, keep, 1)
        done[act] = np.take_along_axis(all_done, keep, 1)
    # range expansion: neighbours of what is within the range, until no new one is
    inside, tested = np.zeros((nq, n), bool), np.zeros((nq, n), bool)
    qi, hit = np.nonzero(best >= threshold)
    qi, xi = qi, who[qi, hit]
    tested[qi, xi] = True
    while len(qi):
        inside[qi, xi] = True
        next_q, next_x = [], []
        for i in range(0, len(qi), 10_000):  # neighbours of so many at once
            nb = near[xi[i : i + 10_000]]
            r, c = np.nonzero(nb >= 0)
            pairs = np.unique(qi[i : i + 10_000][r].astype("i8") * n + nb[r, c])
            a, b = pairs // n, pairs % n
            new = ~tested[a, b]
            a, b = a[new], b[new]
            tested[a, b] = True
            for k in range(0, len(a), 100_000):
                u, v = a[k : k + 100_000], b[k : k + 100_000]
                ok = np.einsum("ij,ij->i", q[u], x[v]) >= threshold
                next_q.append(u[ok])
                next_x.append(v[ok])
        qi, xi = (np.concatenate(next_q), np.concatenate(next_x)) if next_q else (np.empty(0, "i8"), np.empty(0, "i8"))
    return [np.flatnonzero(row) for row in inside]


def every_pair(x: np.ndarray, q: np.ndarray, threshold: float) -> list[np.ndarray]:
    """For each unit query, all rows of ``x`` within the range."""
    return [np.flatnonzero(row) for row in q @ x.T >= threshold]


def _search(cfg: Settings, exact: bool):
    """applyInPandas on (piece of the data, piece of the queries) of one cluster: counts and a forest of the links."""

    def one(rows: pd.DataFrame) -> tuple[list, list]:
        data, asks = rows[rows["stored"]], rows[~rows["stored"]]
        if not len(data) or not len(asks):
            return [], []
        v, w = np.stack(data["v"]), np.stack(asks["v"])
        reps, n = data["rep"].to_numpy(), data["n"].to_numpy()
        x, q = _unit(v), _unit(w)
        x4, q4 = x.astype("f4"), q.astype("f4")
        if exact:
            found = [hits for i in range(0, len(q), 128) for hits in every_pair(x4, q4[i : i + 128], cfg.threshold - 1e-5)]
        else:
            place_of = {r: i for i, r in enumerate(reps.tolist())}
            lists = [[place_of[y] for y in near if y in place_of] for near in data["near"]]
            near = np.full((len(reps), max(1, max(map(len, lists)))), -1, "i4")
            for i, a in enumerate(lists):
                near[i, : len(a)] = a
            start = int((x @ x.mean(0)).argmax())
            found = [hits for i in range(0, len(q), 128) for hits in range_search(x4, near, q4[i : i + 128], start, cfg.threshold - 1e-5, cfg.beam)]
        cluster = int(rows["cluster"].iloc[0])
        homes_x, homes_q = [set(c) for c in data["clusters"]], [set(c) for c in asks["clusters"]]
        counts, links = [], []
        for i, (rep, hits) in enumerate(zip(asks["rep"].tolist(), found, strict=True)):
            hits = hits[reps[hits] != rep]
            # verify in double precision, and count a pair in the first cluster that holds both
            with np.errstate(over="ignore", invalid="ignore"):
                cos = (v[hits] @ w[i]) / (np.linalg.norm(v[hits], axis=1) * np.linalg.norm(w[i]))
            cos = np.where(np.isfinite(cos), cos, x[hits] @ q[i])  # products beyond double precision
            sure = cos >= cfg.threshold
            hits = [j for j in hits[sure].tolist() if min(homes_x[j] & homes_q[i]) == cluster]
            if hits:
                counts.append((rep, int(n[hits].sum())))
                if rep > PLANTED:  # planted queries join nothing
                    links += [(rep, int(reps[j])) for j in hits]
        forest = _forest(np.array([a for a, _ in links], "i8"), np.array([b for _, b in links], "i8")) if links else []
        return counts, forest

    def go(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, c = [], [], []
        for _, rows in pdf.groupby(pdf["v"].map(len)):  # vectors of different lengths don't compare
            counts, links = one(rows)
            a += [x for x, _ in counts] + [x for x, _ in links]
            b += [None] * len(counts) + [y for _, y in links]
            c += [n for _, n in counts] + [0] * len(links)
        return pd.DataFrame({"a": pd.array(a, "Int64"), "b": pd.array(b, "Int64"), "n": pd.array(c, "Int64")})

    return go


def search_graph(placed: DataFrame, graph: DataFrame | None, cfg: Settings) -> DataFrame:
    """(a, b, n): rows with null b say that ``a`` links to n rows (of other vectors); the others are links.

    Without a graph, all pairs of a shard are compared.
    """
    piece = F.pmod(F.xxhash64("rep"), F.col("pieces"))
    each = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))
    cols = ["label", "cluster", "rep", "v", "n", "clusters"]
    held = placed.filter(F.col("rep") > PLANTED)
    data = held.withColumn("near", F.lit(None).cast("array<long>")) if graph is None else held.join(graph, "rep")
    stored = data.select(*cols, "near", F.lit(True).alias("stored"), piece.cast("int").alias("x"), each.alias("q"))
    asks = placed.select(*cols, F.lit(None).cast("array<long>").alias("near"), F.lit(False).alias("stored"), each.alias("x"), piece.cast("int").alias("q"))
    return stored.unionByName(asks).groupBy("label", "cluster", "x", "q").applyInPandas(_search(cfg, graph is None), "a long, b long, n long")


# --- audit and result --------------------------------------------------------------------------------------


def _exact_counts(sent, threshold: float):
    """mapInArrow over all rows: how many rows link to each audited vector, by comparing with every one."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        counts: dict[int, int] = {}
        for batch in batches:
            labels, reps, n = batch.column("label").to_pylist(), batch.column("rep").to_numpy(), batch.column("n").to_numpy()
            vectors = batch.column("v")
            flat, at = vectors.flatten().to_numpy(), np.r_[0, np.cumsum(vectors.value_lengths().to_numpy())]
            by: dict = {}
            for i, label in enumerate(labels):
                by.setdefault((label, at[i + 1] - at[i]), []).append(i)
            for (label, d), (names, w) in asked.items():
                mine = by.get((label, d))
                if mine:
                    x = flat[(at[mine][:, None] + np.arange(d))]
                    with np.errstate(over="ignore", invalid="ignore"):
                        cos = (w @ x.T) / (np.linalg.norm(w, axis=1)[:, None] * np.linalg.norm(x, axis=1))
                    if not np.isfinite(cos).all():
                        cos = np.where(np.isfinite(cos), cos, _unit(w) @ _unit(x).T)
                    hit = ((cos >= threshold) & (reps[mine] != names[:, None])) @ n[mine]
                    for rep, m in zip(names.tolist(), hit.tolist(), strict=True):
                        counts[rep] = counts.get(rep, 0) + int(m)
        yield pa.RecordBatch.from_pydict({"a": pa.array(list(counts), pa.int64()), "n": pa.array(list(counts.values()), pa.int64())})

    return go


def audit_blocks(nodes: DataFrame, cfg: Settings) -> int:
    """Blocks of about ``audit_rows`` vectors in which all those with ids divisible by 50 are audited."""
    return max(1, -(-nodes.filter(F.col("rep") % 50 == 0).count() // cfg.audit_rows))


def audited(nodes: DataFrame, cfg: Settings, block: int = 0, blocks: int = 1) -> dict:
    """(label, length) -> (numbers, vectors): what a block of the audit asks for.

    The first has planted queries behind the rows that they are made from; where one block is all, it is filled up with other
    vectors.
    """
    if blocks == 1:
        chosen = nodes.orderBy(F.col("rep") % 50 != 0, F.xxhash64("rep", F.lit(cfg.seed + 1)), "rep").limit(cfg.audit_rows)
    else:
        chosen = nodes.filter((F.col("rep") % 50 == 0) & (F.pmod(F.xxhash64("rep", F.lit(cfg.seed + 2)), F.lit(blocks)) == block))
    by: dict = {}
    for r in chosen.select("rep", "label", "v").collect():
        by.setdefault((r["label"], len(r["v"])), []).append(r)
    out, made = {}, 0
    for key, mine in by.items():
        w = np.array([r["v"] for r in mine])
        names = [r["rep"] for r in mine]
        if block == 0:
            names += range(PLANTED - made - len(mine), PLANTED - made)
            made += len(mine)
            w = np.concatenate([w, plant(w, cfg.threshold, cfg.seed)])
        out[key] = np.array(names, "i8"), w
    return out


def exact_counts(nodes: DataFrame, asked: dict, cfg: Settings, blocks: int, scratch: Scratch) -> DataFrame:
    """(a, n): links of every audited vector that has some, by comparing with all rows, a block of vectors at a time."""
    every = None
    for block in range(blocks):
        sent = nodes.sparkSession.sparkContext.broadcast(asked if block == 0 else audited(nodes, cfg, block, blocks))
        counts = nodes.mapInArrow(_exact_counts(sent, cfg.threshold), "a long, n long").groupBy("a").agg(F.sum("n").alias("n")).filter("n > 0")
        saved = scratch.save(counts)
        sent.destroy()
        every = saved if every is None else every.unionByName(saved)
    return every


def audit(true: DataFrame, found: DataFrame) -> float | None:
    """Found links of what the audit asks for, as a share of those that comparing with all rows gives; None without any.

    The lesser of the share of all their links and the mean share of those vectors that have links.
    """
    got = found.filter("b is null").groupBy("a").agg(F.sum("n").alias("got"))
    share = F.coalesce("got", F.lit(0)) / F.col("n")
    r = true.join(got, "a", "left").agg((F.sum(F.coalesce("got", F.lit(0))) / F.sum("n")).alias("links"), F.avg(share).alias("vectors")).first()
    return None if r["links"] is None else min(r["links"], r["vectors"])


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cfg: Settings | None = None) -> DataFrame:
    """(id, n_links, component_id, kept, audited_recall), one row per row of ``vectors``.

    Rows link where labels are equal and not null and the cosine is at least the threshold.  Rows that are left
    out of ``distinct_vectors`` link with nothing.  Rows with one id and one vector count as rows of their own.
    An empty table gives no rows.  ``audited_recall`` is the audit's figure, the same on each row; null where no vector can
    link with anything.
    """
    cfg = cfg or Settings()
    scratch = Scratch(vectors.sparkSession, "embeddings")
    nodes = scratch.save(distinct_vectors(vectors, id_col, vec_col, label_col))
    blocks = audit_blocks(nodes, cfg)
    asked = audited(nodes, cfg, 0, blocks)
    true = exact_counts(nodes, asked, cfg, blocks, scratch)
    kind = nodes.schema["label"].dataType
    schema = T.StructType([T.StructField("rep", T.LongType()), T.StructField("label", kind), T.StructField("v", T.ArrayType(T.DoubleType())), T.StructField("n", T.LongType())])
    planted = vectors.sparkSession.createDataFrame([(int(rep), label, v.tolist(), 0) for (label, _), (names, w) in asked.items() for rep, v in zip(names, w, strict=True) if rep <= PLANTED], schema)
    for attempt in range(4):
        placed = scratch.save(place(nodes.unionByName(planted), cfg))
        every = scratch.save(search_graph(placed, build_graph(placed, cfg) if attempt < 3 else None, cfg))
        recall = audit(true, every)
        scratch.drop(placed)
        if recall is None or recall >= cfg.least_recall:
            break
        cfg = replace(cfg, overlap=cfg.overlap + 1, reach=cfg.reach * 2 if attempt < 2 else float("inf"), beam=cfg.beam * 2, degree=cfg.degree * 3 // 2)
    else:
        raise RuntimeError(f"audited recall {recall} after comparing all pairs")
    found = every.filter(F.col("a") > PLANTED)
    parts = connected_components(found.filter("b is not null").select("a", "b"), scratch).select(F.col("node").alias("rep"), "component")
    counts = found.filter("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    known = nodes.join(parts, "rep", "left").join(counts, "rep", "left").select(F.col("label").alias("_l"), F.col("v").alias("_v"), (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("_label"), F.transform(vec_col, lambda x: x.cast("double")).alias("_vec"))
    out = rows.join(known, (F.col("_label") == F.col("_l")) & (F.col("_vec") == F.col("_v")) & F.col("id").isNotNull(), "left")
    component = F.coalesce("component_id", F.col("id").cast("long"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"), F.lit(recall).cast("double").alias("audited_recall"))
