"""SimHash and embedding near-duplicates, fingerprints and components against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vigilake.llm import embedding_dedup, fingerprints, simhash_dedup
from vigilake.llm.components import connected_components
from vigilake.llm.scratch import Scratch

LOW = str.maketrans(simhash_dedup.UPPER, simhash_dedup.LOWER)


def simhash(text, size=4):
    words = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(LOW))
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), seed=42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def groups(ids, linked):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def texts(n=120, seed=1):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    out = [" ".join(r.choice(vocabulary) for _ in range(r.randrange(30, 200))) for _ in range(n)]
    for i in range(0, n, 4):  # near copies: one word changed in a long text
        words = (out[i] + " " + " ".join(r.choice(vocabulary) for _ in range(400))).split()
        out[i] = " ".join(words)
        words[r.randrange(len(words))] = "changed"
        out[i + 1] = " ".join(words)
    return [*out, None, "", "  \t\n", "One two", "one TWO", "a b c d", out[0], out[0], "é\u00a0x y"]


def test_near_duplicates_equal_brute_force(spark):
    docs = list(enumerate(texts()))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"fp": F.lit("mine"), "id": F.lit(0)})
    got = {r.doc_id: r for r in simhash_dedup.near_duplicates(df).collect()}
    fp = {i: simhash(t) for i, t in docs}
    want = groups(fp, [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 4])
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{x:016x}" for i, x in fp.items()}
    assert {i: r.component_id for i, r in got.items()} == want
    kept = simhash_dedup.keep_one_of_each(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted({*want.values()})


def test_pipeline_drops_what_is_similar(spark):
    import corpus_pipeline

    rng, rows = random.Random(4), []
    for k in range(15):
        base = [f"w{rng.randrange(5000)}" for _ in range(150)]
        for _ in range(6):
            near = [w if rng.random() > rng.choice([0.0, 0.01, 0.03, 0.06]) else f"x{rng.randrange(5000)}" for w in base]
            rows.append((len(rows), " ".join(near)))
    rows += [(len(rows), "a b c"), (len(rows) + 1, "A  b c"), (len(rows) + 2, ""), (len(rows) + 3, None), (0, "one id of two texts"), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate(LOW))
        return {" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))}

    named = [(i, shingles(t)) for i, t in rows if i is not None]
    links = [(i, j) for i, x in named for j, y in named if i < j and (x == y or (x | y and len(x & y) / len(x | y) >= 0.8))]
    want = groups({i for i, _ in named}, links)
    kept = corpus_pipeline.drop_near_duplicates(spark, df, "").collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(i for i in want if want[i] == i)
    assert len({i for i in want if want[i] == i}) < len(named) - 20 and sum(r.doc_id is None for r in kept) == 1


def test_ids_that_repeat_or_are_null(spark):
    df = spark.createDataFrame([(5, "a b c d e"), (5, "x y z u v"), (3, "x y z u v"), (9, "a b c d e"), (None, "a b c d e"), (None, "q q")], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.component_id) for r in simhash_dedup.near_duplicates(df).collect() if r.component_id is not None) == [(-1, 3), (3, 3), (5, 3), (5, 3), (9, 3)]
    assert sorted(r.text for r in simhash_dedup.keep_one_of_each(df).collect()) == ["a b c d e", "q q", "x y z u v"]
    empty = df.filter("false")
    assert simhash_dedup.near_duplicates(empty).count() == 0


def test_links_go_through_rows_without_id(spark, monkeypatch):
    """Three fingerprints in a chain, the middle one's row without an id."""
    fps = {1: 0, None: 0b111, 5: 0b111111, 7: -1}
    monkeypatch.setattr(simhash_dedup, "with_fingerprint", lambda docs, *_: docs.select(F.col("doc_id").alias("id"), "fp"))
    got = simhash_dedup.near_duplicates(spark.createDataFrame(list(fps.items()), "doc_id long, fp long")).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, None: 1, 5: 1, 7: 7}


def test_long_runs_meet_at_midpoints(spark):
    r = random.Random(4)
    center = r.getrandbits(64)
    fps = sorted({center ^ sum(1 << b for b in r.sample(range(64), r.randrange(1, 5))) for _ in range(40)} | {r.getrandbits(64) for _ in range(20)})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    hot = spark.createDataFrame([(x, i) for i, x in enumerate(signed)], "fp long, rep long")
    links = [(x.a, x.b) for x in simhash_dedup._midpoint_links(hot, 4).collect()]
    want = groups(range(len(fps)), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4])
    assert groups(range(len(fps)), links) == want
    # a run limit that sends everything there
    go = simhash_dedup.run_links(4, 3)
    import pyarrow as pa

    key = np.sort(np.array([r.randrange(4) for _ in signed], "i8"))
    batches = [pa.RecordBatch.from_pydict({"key": pa.array(key[i : i + 7]), "fp": pa.array(signed[i : i + 7], pa.int64()), "rep": pa.array(range(i, min(i + 7, len(key))), pa.int64())}) for i in range(0, len(key), 7)]
    out = [x for b in go(iter(batches)) for x in b.to_pylist()]
    long = {k for k in range(4) if (key == k).sum() > 3}
    assert {x["b"] for x in out if x["hot"]} == {i for i, k in enumerate(key) if k in long}


def test_midpoints_are_not_broadcast(spark):
    """Midpoints are 2,081 times the rows that Spark expects: none go through the driver, and no task gets all of them."""
    r = random.Random(6)
    center = r.getrandbits(64)
    fps = list({r.getrandbits(64) for _ in range(1800)} | {center ^ 1 << b for b in range(64)})
    hot = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x, i) for i, x in enumerate(fps)], "fp long, rep long").distinct()
    links = simhash_dedup._midpoint_links(hot, 4)
    found = [(x.a, x.b) for x in links.collect()]
    near = [i for i, x in enumerate(fps) if (x ^ center).bit_count() == 1]
    got = groups(range(len(fps)), found)
    assert len(near) == 64 and {got[i] for i in near} == {min(near)} and all(got[i] == i for i in got if i not in near)
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    assert all(len(fps) * 2081 / int(n) <= 2_000_000 for n in re.findall(r"hashpartitioning\((?:fp|mid)#\d+L?, (\d+)\), REPARTITION", plan)) and "REPARTITION_BY_NUM" in plan


@pytest.mark.parametrize("m", [2, 3, 5])
def test_masks_miss_nothing(m):
    groups_ = simhash_dedup.correlated_partitions(np.eye(64) * 10, 20, m)
    assert sorted(b for g in groups_ for b in g) == list(range(64))
    cost = [{t: (t + 2.0) ** 2 for t in range(-1, 5)} for _ in groups_]
    _, ts = simhash_dedup.allocate(cost, 4)
    assert sum(t + 1 for t in ts) == 5


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(50)] + [(r.randrange(100, 160), r.randrange(100, 160)) for _ in range(40)] + [(7, 7), (200, 300)]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    want = groups({x for e in edges for x in e}, edges)
    assert all(want[k] == v for k, v in got.items()) and got[50] == 0 and got[300] == 200
    assert connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


def test_embeddings_equal_brute_force(spark):
    g = np.random.default_rng(3)
    base = g.normal(size=(40, 16))
    x = np.concatenate([base[g.integers(0, 40, 400)] + g.normal(scale=0.05, size=(400, 16)), base[:5], base[:5], base[:3] * 7])
    labels = [int(i) for i in g.integers(0, 2, len(x))]
    rows = [(i, [float(np.float32(a)) for a in v], k) for i, (v, k) in enumerate(zip(x, labels, strict=True))]
    rows += [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, rows[0][1], None), (1003, [float("nan")] * 16, 0), (1004, [1.0, None], 0), (1005, [1.0, 2.0], 0), (1006, [2.0, 4.0], 0), (1007, rows[0][1], rows[0][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df, cfg=embedding_dedup.Settings(shard_rows=60)).collect()}
    fine = {i: np.array(v) for i, v, k in rows if v and k is not None and None not in v and np.isfinite(v).all() and any(v)}
    label = {i: k for i, _, k in rows}
    links = [(a, b) for a in fine for b in fine if a < b and label[a] == label[b] and len(fine[a]) == len(fine[b]) and fine[a] @ fine[b] / np.linalg.norm(fine[a]) / np.linalg.norm(fine[b]) >= 0.98]
    n = {i: 0 for i, _, _ in rows}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    want = groups(n, links)
    found = sum(r.n_links for r in got.values())
    assert all(got[i].n_links <= n[i] for i in n) and found >= 0.98 * sum(n.values())
    assert got[0].audited_recall >= 0.98 and sum(got[i].component_id != want[i] for i in n) <= 0.02 * len(n)
    assert [got[i].n_links for i in range(1000, 1005)] == [0] * 5 and got[1006].component_id == 1005
    assert all(r.kept == (i == r.component_id) for i, r in got.items())
    assert embedding_dedup.near_duplicates(df.filter("false")).count() == 0


def test_embeddings_of_a_large_group(spark):
    g = np.random.default_rng(5)
    x = np.concatenate([g.normal(size=32) + g.normal(scale=0.07, size=(1000, 32)), g.normal(size=(2000, 32))])
    x = x[g.permutation(len(x))].astype("f4").astype("f8")
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (u @ u.T >= 0.98).sum(1) - 1
    assert want.max() > 900
    nodes = embedding_dedup.distinct_vectors(df, "vec_id", "embedding", "label")
    for cfg, graph, least in [(embedding_dedup.Settings(shard_rows=100), True, 0.98), (embedding_dedup.Settings(shard_rows=100, reach=float("inf")), False, 1.0)]:
        placed = embedding_dedup.place(nodes, cfg).cache()
        found = embedding_dedup.search_graph(placed, embedding_dedup.build_graph(placed, cfg) if graph else None, cfg)
        got = {r.a: r.n for r in found.filter("b is null").groupBy("a").agg(F.sum("n").alias("n")).collect()}
        assert all(got.get(i, 0) <= want[i] for i in range(len(x)))
        assert sum(got.values()) >= least * want.sum()
        assert np.mean([got.get(i, 0) / want[i] for i in np.flatnonzero(want)]) >= least
    # one vector's lost links count, however few they are
    cfg = embedding_dedup.Settings()
    asked = embedding_dedup.audited(nodes, cfg)
    names, _ = asked[0, 32]
    real = names[names > embedding_dedup.PLANTED]
    assert len(names) == 2000 and len(real) == 1000 and {int(i) % 50 for i in real[:60]} == {0}
    rows_only = {key: (n[n > embedding_dedup.PLANTED], w[n > embedding_dedup.PLANTED]) for key, (n, w) in asked.items()}
    seen = [i for i in real.tolist() if want[i]]
    some = spark.createDataFrame([(int(i), None, int(want[i])) for i in np.flatnonzero(want) if i != seen[0]], "a long, b long, n long")
    true = embedding_dedup.exact_counts(nodes, rows_only, cfg, 1, Scratch(spark, "t"))
    assert embedding_dedup.audit(true, some) <= 1 - 1 / len(seen) + 1e-9
    # more ids divisible by 50 than a block holds: every one is asked for, in some block, and counted exactly
    small = embedding_dedup.Settings(audit_rows=9)
    blocks = embedding_dedup.audit_blocks(nodes, small)
    each = [embedding_dedup.audited(nodes, small, b, blocks) for b in range(blocks)]
    fifty = {int(i) for block in each for n, _ in block.values() for i in n if i > embedding_dedup.PLANTED}
    assert blocks > 1 and fifty == {r.rep for r in nodes.filter("rep % 50 = 0").collect()}
    counted = {r.a: r.n for r in embedding_dedup.exact_counts(nodes, each[0], small, blocks, Scratch(spark, "t")).filter(F.col("a") > embedding_dedup.PLANTED).collect()}
    assert counted == {i: int(want[i]) for i in fifty if want[i]}


def test_planted_queries_are_evidence(spark):
    """A table without links: only the planted queries tell whether the search works."""
    g = np.random.default_rng(8)
    x = g.normal(size=(1200, 24))
    w = embedding_dedup.plant(x[:50], 0.98, 1)
    cos = (w * x[:50]).sum(1) / np.linalg.norm(w, axis=1) / np.linalg.norm(x[:50], axis=1)
    assert np.allclose(cos, np.cos(np.arccos(0.98) / 2))
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = embedding_dedup.near_duplicates(df, cfg=embedding_dedup.Settings(shard_rows=100)).collect()
    assert len(got) == 1200 and {r.n_links for r in got} == {0} and got[0].audited_recall >= 0.98
    # a search that finds nothing is found out
    nodes = embedding_dedup.distinct_vectors(df, "vec_id", "embedding", "label")
    none = spark.createDataFrame([], "a long, b long, n long")
    cfg = embedding_dedup.Settings()
    assert embedding_dedup.audit(embedding_dedup.exact_counts(nodes, embedding_dedup.audited(nodes, cfg), cfg, 1, Scratch(spark, "t")), none) == 0
    assert embedding_dedup.near_duplicates(df.filter("vec_id % 50 <> 0")).first().audited_recall >= 0.98
    assert embedding_dedup.near_duplicates(df.withColumn("label", F.lit(None).cast("int"))).first().audited_recall is None


def test_huge_vectors_link(spark):
    rows = [(50, [1e200, 1e200], 0), (51, [2e200, 2e200], 0), (52, [1e200, -1e200], 0)]
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {50: 1, 51: 1, 52: 0}


def test_fingerprints_of_edits(spark):
    docs = [(i, t) for i, t in enumerate(texts(40))] + [(3, "again"), (None, "no id")]
    got = fingerprints.fingerprint_edits(spark.createDataFrame(docs, "doc_id long, text string"), query_every=2).collect()
    import hashlib

    order = sorted(((-(1 << 63) if i is None else i, t or "") for i, t in docs), key=lambda x: (-x[0], x[1]))
    want = []
    for k, (i, t) in enumerate(order):
        half = len(t) // 2
        edited = t[: len(t) - half] + order[(k + 1) % len(order)][1][:half]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), f"{simhash5(t):016x}", f"{simhash5(edited):016x}"))
    key = lambda r: (-(1 << 63) if r.doc_id is None else r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint)
    assert sorted(map(key, got)) == sorted(want)
    fps = [int(r.fingerprint, 16) for r in got]
    for r in got:
        if r.doc_id is not None and r.doc_id % 2 == 0:
            assert r.n_near == sum((int(r.fingerprint, 16) ^ x).bit_count() <= 3 for x in fps) - 1
        else:
            assert r.n_near is None
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1


def test_next_documents_over_ranges_and_buckets(spark, tmp_path):
    """Half of the rows share an id, some are copies: each row is followed by the next one, the last by the first."""
    from vigilake.llm.scratch import Scratch

    docs = [(7 if i % 2 else i, f"text {i // 3 % 40:03d}") for i in range(300)] + [(None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    rows = fingerprints.with_next(df, "doc_id", "text", Scratch(spark, "next"), rows_per_bucket=8).filter("not halo").collect()
    order = sorted(((-1 if i is None else i, t or "") for i, t in docs), key=lambda x: (-x[0], x[1]))
    want = [(i, t, order[(k + 1) % len(order)][1]) for k, (i, t) in enumerate(order)]
    assert sorted((-1 if r.id is None else r.id, r.text, r.next_text) for r in rows) == sorted(want)
    assert len({r.bucket for r in rows}) > 30
    one = spark.createDataFrame([(1, "alone")], "doc_id long, text string")
    assert [(r.text, r.next_text) for r in fingerprints.with_next(one, "doc_id", "text", Scratch(spark, "one")).filter("not halo").collect()] == [("alone", "alone")]


def simhash5(text):
    """As the contract's fingerprint, but over words as the operator cuts them and shingles of five."""
    return simhash(text, 5)


def test_block_tables_find_all_within_the_radius():
    r = random.Random(6)
    masks = [m & (1 << 64) - 1 for m in fingerprints.block_masks(5, 3)]
    for _ in range(200):
        x = r.getrandbits(64)
        y = x ^ sum(1 << b for b in r.sample(range(64), 3))
        assert any(x & m == y & m for m in masks)
