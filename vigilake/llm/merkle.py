"""Merkle manifest of a table: a digest tree per group, a tree over the groups' roots, and a proof for each row.

Trees grow by a monoid of sparse forests.  A fragment is a set of nodes keyed by (level, index); two fragments meet by
union, and whenever the run of siblings under a parent is complete (its length is known from the number of leaves),
their parent takes their place.  The order of merges doesn't matter, so partitions of sorted leaves make fragments on
their own and these are merged sixteen neighbours at a time, round by round, in tasks: as many trees as there are
groups never meet in one place, nor on the driver.  A fragment holds at most two open runs a level.

Proofs go the other way: each partition asks for the few nodes beside its edges and works out the rest itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilake.llm.scratch import Scratch, quoted

FAN_IN = 16  # fragments that one merge takes


def digest_of(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# --- the monoid --------------------------------------------------------------------------------------------


def width(size: int, level: int, arity: int = 2) -> int:
    """Nodes of a level of a tree of ``size`` leaves."""
    for _ in range(level):
        size = -(-size // arity)
    return size


def height(size: int, arity: int = 2) -> int:
    level = 0
    while size > 1:
        size, level = -(-size // arity), level + 1
    return level


def settle(nodes: dict[tuple[int, int], str], size: int, arity: int = 2) -> tuple[dict[tuple[int, int], str], dict[tuple[int, int], str]]:
    """(open nodes, nodes made) of a fragment of a tree of ``size`` leaves: complete runs give way to their parents.

    Merging is ``settle`` of the union, whatever the order and grouping of fragments.
    """
    levels: dict[int, dict[int, str]] = {}
    for (level, i), d in nodes.items():
        levels.setdefault(level, {})[i] = d
    still, made = {}, {}
    count, top = size, height(size, arity)
    for level in range(top):
        at = levels.pop(level, {})
        for parent in sorted({i // arity for i in at}):
            run = range(parent * arity, min(parent * arity + arity, count))
            if all(i in at for i in run):
                d = digest_of(*(at[i] for i in run))
                levels.setdefault(level + 1, {})[parent] = made[level + 1, parent] = d
            else:
                still |= {(level, i): at[i] for i in run if i in at}
        count = -(-count // arity)
    still |= {(top, i): d for i, d in levels.get(top, {}).items()}
    return still, made


def edge_nodes(first: int, count: int, size: int, arity: int = 2) -> Iterator[tuple[int, int]]:
    """(level, index) of the runs at both ends of leaves ``first`` and on, level by level, and of the root."""
    a, b, n = first, first + count - 1, size
    for level in range(height(size, arity)):
        runs = {a // arity, b // arity}
        yield from ((level, i) for p in sorted(runs) for i in range(p * arity, min(p * arity + arity, n)))
        a, b, n = a // arity, b // arity, -(-n // arity)
    yield height(size, arity), 0


Runs = list[tuple[int, list[list[str]]]]


def local_runs(first: int, leaves: list[str], size: int, near: dict[tuple[int, int], str], arity: int = 2) -> Runs:
    """Per level, the first parent above these leaves and the runs under it and its successors; ``near`` has the rest."""
    out: Runs = []
    at, nodes, count = first, leaves, size
    for level in range(height(size, arity)):
        low, high = at // arity, (at + len(nodes) - 1) // arity
        node = lambda i: nodes[i - at] if at <= i < at + len(nodes) else near[level, i]  # noqa: B023, E731
        runs = [[node(i) for i in range(p * arity, min(p * arity + arity, count))] for p in range(low, high + 1)]
        out.append((low, runs))
        at, nodes, count = low, [digest_of(*r) for r in runs], -(-count // arity)
    return out


def suffixes(runs: Runs, arity: int = 2, after: str = "") -> tuple[int, list[str]]:
    """The lowest parents: the first's index, and for each the siblings of its ancestors, lowest first, then ``after``."""
    if not runs:
        return 0, [after]
    low, above = runs[-1][0], [after] * len(runs[-1][1])
    for level in range(len(runs) - 1, 0, -1):
        first, groups = runs[level]
        below = runs[level - 1]
        nodes = range(below[0], below[0] + len(below[1]))
        above = ["".join(d for k, d in enumerate(groups[i // arity - first]) if k != i % arity) + above[i // arity - first] for i in nodes]
        low = below[0]
    return low, above


def fold(i: int, digest: str, runs: Runs, arity: int = 2) -> str:
    """The root that leaf ``i`` with this digest and its siblings give."""
    for low, groups in runs:
        run = list(groups[i // arity - low])
        run[i % arity] = digest
        digest, i = digest_of(*run), i // arity
    return digest


# --- trees over tables -------------------------------------------------------------------------------------

_NODES = "tree string, part long, block long, parts long, size long, level int, idx long, digest string, open boolean, fresh boolean, top boolean"
_NODE_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_()]


def _node_table(rows: list[tuple]) -> pa.Table:
    names = [c.split()[0] for c in _NODES.split(", ")]
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(cols, _NODE_TYPES, strict=True)], names=names)


def _fragments(arity: int):
    def up(leaves: pa.Table, span: pa.Table) -> pa.Table:
        """Open nodes of a partition's leaves."""
        s = span.to_pylist()[0]
        digests = leaves.sort_by("pos")["digest"].to_pylist()
        still, _ = settle({(0, s["first"] + i): d for i, d in enumerate(digests)}, s["size"], arity)
        top = height(s["size"], arity)
        return _node_table([(s["tree"], s["part"], s["block"], s["parts"], s["size"], level, i, d, True, True, level == top) for (level, i), d in still.items()])

    return up


def _merged(arity: int):
    def merge(table: pa.Table) -> pa.Table:
        """Fragments of neighbours as one: nodes made, and older ones that are still open."""
        rows = table.to_pylist()
        r = rows[0]
        still, made = settle({(x["level"], x["idx"]): x["digest"] for x in rows}, r["size"], arity)
        top = height(r["size"], arity)
        head = (r["tree"], r["part"], r["block"], r["parts"], r["size"])
        return _node_table([(*head, *k, d, k in still, k in made, k[0] == top) for k, d in ({**still, **made}).items()])

    return merge


def grow(leaves: DataFrame, order: list[Column], scratch: Scratch, arity: int = 2, rows_per_part: int = 50_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(placed, spans, nodes) of ``leaves`` (tree, digest, more), each tree's in ``order``.

    ``placed`` has the leaves with ``part`` and ``pos``; ``spans`` a row per tree and part: which leaves it holds;
    ``nodes`` all nodes that some fragment left open or a merge made, roots marked ``top``.  Leaves that ``order``
    doesn't tell apart are dealt out over partitions by where they came from.
    """
    spark = leaves.sparkSession
    leaves = scratch.save(leaves.withColumn("_from", F.xxhash64(F.monotonically_increasing_id())))
    rows = leaves.count()
    parts = max(1, -(-rows // rows_per_part), min(spark.sparkContext.defaultParallelism, rows // 2000))
    by = [F.col("tree"), *order, F.col("_from")]
    dealt = leaves.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    placed = scratch.save(dealt.withColumns({"pos": F.monotonically_increasing_id(), "part": F.spark_partition_id().cast("long")}).drop("_from"))
    per_tree = Window.partitionBy("tree")
    before = per_tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("tree", "part").agg(F.count("*").alias("count"))
    spans = scratch.save(
        counts.select(
            "tree",
            "part",
            "count",
            F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"),
            F.sum("count").over(per_tree).alias("size"),
            (F.row_number().over(per_tree.orderBy("part")) - 1).cast("long").alias("block"),
            F.count("*").over(per_tree).alias("parts"),
        )
    )
    keys = ["tree", "part"]
    found = scratch.save(placed.select(*keys, "pos", "digest").groupBy(*keys).cogroup(spans.groupBy(*keys)).applyInArrow(_fragments(arity), _NODES))
    nodes, now = [found], found
    most = spans.agg(F.max("parts")).first()[0] or 0
    while most > 1:  # trees whose parts have all met drop out
        near = now.filter(F.col("open") & (F.col("parts") > 1)).withColumns({"block": F.floor(F.col("block") / FAN_IN).cast("long"), "parts": F.ceil(F.col("parts") / FAN_IN).cast("long")})
        now = scratch.save(near.groupBy("tree", "block").applyInArrow(_merged(arity), _NODES))
        nodes.append(now.filter("fresh"))
        most = -(-most // FAN_IN)
    every = nodes[0]
    for more in nodes[1:]:
        every = every.unionByName(more)
    return placed, spans, every.select("tree", "level", "idx", "digest", "top")


def _wanted(arity: int):
    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s in batch.itertuples(index=False):
                rows = [(s.tree, s.part, s.first, s.size, level, i) for level, i in edge_nodes(s.first, s.count, s.size, arity)]
                yield pd.DataFrame(rows, columns=["tree", "part", "first", "size", "level", "idx"])

    return ask


def beside(spans: DataFrame, nodes: DataFrame, arity: int = 2) -> DataFrame:
    """(tree, part, first, size, level, idx, digest): what a part needs of other parts' nodes, and the root."""
    wanted = spans.select("tree", "part", "first", "count", "size").mapInPandas(_wanted(arity), "tree string, part long, first long, size long, level int, idx long")
    return wanted.join(nodes.drop("top"), ["tree", "level", "idx"])


def _read_near(near: list[dict], arity: int) -> tuple[int, int, dict[tuple[int, int], str], str]:
    known = {(x["level"], x["idx"]): x["digest"] for x in near}
    first, size = near[0]["first"], near[0]["size"]
    return first, size, known, known[height(size, arity), 0]


def _group_paths(arity: int):
    def paths(leaves: pa.Table, near: pa.Table) -> pa.Table:
        """For each group's root: what stands left and right of it and its ancestors, level by level, and the whole's root."""
        first, size, known, root = _read_near(near.to_pylist(), arity)
        leaves = leaves.sort_by("pos")
        digests, names = leaves["digest"].to_pylist(), leaves["group"].to_pylist()
        runs = local_runs(first, digests, size, known, arity)
        lefts, rights = [], []
        for i in range(first, first + len(digests)):
            left, right = [], []
            for low, groups in runs:
                run, k = groups[i // arity - low], i % arity
                left.append("".join(run[:k]))
                right.append("".join(run[k + 1 :]))
                i //= arity  # noqa: PLW2901
            lefts.append(left)
            rights.append(right)
        listed = pa.list_(pa.string())
        return pa.Table.from_arrays([pa.array(names, pa.string()), pa.array(digests, pa.string()), pa.array(lefts, listed), pa.array(rights, listed), pa.array([root] * len(names), pa.string())], names=["tree", "subroot", "lefts", "rights", "root"])

    return paths


def _proofs(arity: int, key_type: pa.DataType):
    def prove(leaves: pa.Table, near: pa.Table) -> pa.Table:
        rows = near.to_pylist()
        first, size, known, subroot = _read_near(rows, arity)
        lefts, rights, root = (rows[0][c] for c in ("lefts", "rights", "root"))
        leaves = leaves.sort_by("pos")
        digests = leaves["digest"].to_pylist()
        runs = local_runs(first, digests, size, known, arity)
        low, after = suffixes(runs, arity, "".join(a + b for a, b in zip(lefts, rights, strict=True)))
        proofs, folded = [], []
        for n, (own, changed) in enumerate(zip(digests, leaves["changed"].to_pylist(), strict=True)):
            i = first + n
            run = runs[0][1][i // arity - runs[0][0]] if runs else [own]
            others = "".join(d for k, d in enumerate(run) if k != i % arity) if runs else ""
            proofs.append(digest_of(others, after[i // arity - low] if runs else after[0]))
            top = fold(i, changed or own, runs, arity)
            for a, b in zip(lefts, rights, strict=True):
                top = digest_of(a, top, b)
            folded.append(top)
        n = len(digests)
        text = pa.string()
        cols = [leaves["key"].combine_chunks().cast(key_type), pa.array(digests, text), pa.array([subroot] * n, text), pa.array([root] * n, text), pa.array(proofs, text), pa.array(folded, text), pa.array([f == root for f in folded], pa.bool_())]
        return pa.Table.from_arrays(cols, names=["key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return prove


# --- documents ---------------------------------------------------------------------------------------------


def leaf_digest(*columns: Column) -> Column:
    """SHA-256 of columns, one after the other: ``-`` for null, else byte count, ``:`` and value."""
    text = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in text]), 256)


def manifest(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), key: str = "doc_id", group: str = "lang", tampered: dict[str, Column] | None = None, arity: int = 2, rows_per_part: int = 50_000) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified): a row per row of ``docs``.

    A tree per value of ``group`` (null is one), leaves by ``key`` (null first; rows of one key by their digests, equal
    rows in any order, which changes no digest); a tree over the groups in the order of their bytes, null first.  ``tampered``
    replaces columns of the rows that are checked: their leaf is folded with the original siblings, and ``verified`` says whether
    that gives the root.  Texts are hashed where they are read; only digests are shuffled.  An empty table gives no rows;
    columns that aren't named count for nothing.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "merkle")
    at = {c: F.col(quoted(c)) for c in {*columns, key, group}}
    leaf = leaf_digest(*(at[c] for c in columns))
    changed = F.lit(None).cast("string")
    if tampered:
        other = leaf_digest(*(tampered.get(c, at[c]) for c in columns))
        differs = F.lit(False)
        for c, new in tampered.items():
            differs = differs | ~new.eqNullSafe(at[c])
        changed = F.when(differs, other)
    tree = F.coalesce(F.concat(F.lit("="), at[group].cast("string")), F.lit(""))  # a null group is before all others
    leaves = docs.select(tree.alias("tree"), at[key].alias("key"), leaf.alias("digest"), changed.alias("changed"))
    kind = docs.schema[key].dataType
    placed, spans, nodes = grow(leaves, [F.col("key").asc_nulls_first(), F.col("digest")], scratch, arity, rows_per_part)
    roots = nodes.filter("top").select(F.lit("").alias("tree"), F.col("tree").alias("group"), "digest")
    above, above_spans, above_nodes = grow(roots, [F.col("group")], scratch, arity, rows_per_part)
    keys = ["tree", "part"]
    near_top = beside(above_spans, above_nodes, arity)
    paths = scratch.save(above.select(*keys, "pos", "group", "digest").groupBy(*keys).cogroup(near_top.groupBy(*keys)).applyInArrow(_group_paths(arity), "tree string, subroot string, lefts array<string>, rights array<string>, root string"))
    near = scratch.save(beside(spans, nodes, arity).join(paths.drop("subroot"), "tree"))
    name = kind.simpleString()
    schema = f"key {name}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    arrow_kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(name)
    if arrow_kind is None:
        raise ValueError(f"keys of type {name} aren't supported: integers and strings are")
    out = placed.select(*keys, "pos", "key", "digest", "changed").groupBy(*keys).cogroup(near.groupBy(*keys)).applyInArrow(_proofs(arity, arrow_kind), schema)
    return out.withColumnRenamed("key", key)


def tampered_documents(docs: DataFrame, rate: int = 7) -> dict[str, Column]:
    """``n_chars`` one too high where ``rate`` divides the CRC-32 of the id; nulls stay."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % rate == 0
    return {"n_chars": F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
