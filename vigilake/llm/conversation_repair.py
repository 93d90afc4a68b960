"""Repair of damaged conversations at least cost, one dynamic program for all conversations that share a prefix.

Each row of a conversation becomes a symbol of its role and fault, a conversation a signature of one character a row.
Distinct signatures are sorted in ranges; each range is walked as the prefix trie that it is: layers of costs are kept for the
current path only, and one is computed per trie node, so conversations that begin alike share them.  At a terminal node the
cheapest edits are traced, and all conversations of the signature get them.  Edits are then applied to the rows in place.

Rows are put in order once, by ranges of (conversation, turn), so a conversation of any length is spread over parts; signatures
are put together from parts, and texts stay in their part.  Only a digest, which runs from end to end, sees a long
conversation's parts in one task, one at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.llm.scratch import Scratch

SPACES = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5  # costs; the last is for a truncated row that stays
NEVER = 1 << 60
# Where a repaired conversation is: nothing yet, after the system's turn, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
SPOKEN = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # what an inserted or rerolled row leads to
NAMES = {USER: "user", ASSISTANT: "assistant"}
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
Layer = tuple[int, ...]


# --- the dynamic program -----------------------------------------------------------------------------------


def moves(symbol: str) -> list[tuple[str, int, int, int]]:
    """(edit, from, to, cost) for a row: ``d`` must go, others are role initials, capital if truncated."""
    out = [("D", q, q, DELETE) for q in range(4)]
    if symbol != "d":
        more = CUT_OFF if symbol.isupper() else 0
        out += [("K", a, b, KEEP + more) for a, b in KEPT.get(symbol.lower(), {}).items()]
        out += [("R", a, b, REROLE + more) for a, b in SPOKEN.items()]
    return out


MOVES = {c: moves(c) for c in "dsuaoSUAO"}
INSERTS = [("I", a, b, INSERT) for a, b in SPOKEN.items()]


def _with_inserts(cost: list[int]) -> Layer:
    for _ in range(3):
        for _, a, b, c in INSERTS:
            cost[b] = min(cost[b], cost[a] + c)
    return tuple(cost)


FIRST = _with_inserts([0, NEVER, NEVER, NEVER])


def next_layer(layer: Layer, symbol: str) -> Layer:
    cost = [NEVER] * 4
    for _, a, b, c in MOVES[symbol]:
        cost[b] = min(cost[b], layer[a] + c)
    return _with_inserts(cost)


def trace(signature: str, layers: list[Layer]) -> tuple[int, str]:
    """(cost, edits) of a signature: of the cheapest edits the string that is least in ASCII.

    Places that lie on a cheapest path are marked from the end; then the least letter that leads to one is taken.
    """
    n = len(signature)
    best = min(layers[n][q] for q in ENDS)
    marked = [set() for _ in range(n + 1)]
    marked[n] = {q for q in ENDS if layers[n][q] == best}
    for i in range(n, -1, -1):
        for _ in range(3):
            marked[i] |= {a for _, a, b, c in INSERTS if b in marked[i] and layers[i][a] + c == layers[i][b]}
        if i:
            marked[i - 1] = {a for _, a, b, c in MOVES[signature[i - 1]] if b in marked[i] and layers[i - 1][a] + c == layers[i][b]}
    i, q, out = 0, START, []
    while i < n or q not in ENDS or layers[n][q] != best:
        tight = [("I", i, b) for _, a, b, c in INSERTS if a == q and b in marked[i] and layers[i][a] + c == layers[i][b]]
        if i < n:
            tight += [(e, i + 1, b) for e, a, b, c in MOVES[signature[i]] if a == q and b in marked[i + 1] and layers[i][a] + c == layers[i + 1][b]]
        edit, i, q = min(tight)
        out.append(edit)
    return best, "".join(out)


def walk(signatures: Iterator[str]) -> Iterator[tuple[str, int, str]]:
    """(signature, cost, edits) of signatures in order: a depth-first walk of their trie that keeps one path's layers."""
    path, layers = "", [FIRST]
    for s in signatures:
        shared = 0
        for a, b in zip(path, s, strict=False):
            if a != b:
                break
            shared += 1
        del layers[shared + 1 :]
        for c in s[shared:]:
            layers.append(next_layer(layers[-1], c))
        path = s
        yield s, *trace(s, layers)


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def texts():
        for batch in batches:
            yield from batch.column("signature").to_pylist()

    rows = []
    for row in walk(texts()):
        rows.append(row)
        if len(rows) == 1000:
            yield _answer_rows(rows)
            rows = []
    if rows:
        yield _answer_rows(rows)


def _answer_rows(rows: list) -> pa.RecordBatch:
    a, b, c = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.int64()), pa.array(c, pa.string())], names=["signature", "cost", "audit"])


def cheapest_edits(signatures: DataFrame, per_part: int = 20_000) -> DataFrame:
    """(signature, cost, audit) of distinct signatures, by range: each task walks its part of the trie."""
    distinct = signatures.select("signature").distinct().withColumn("_head", F.left("signature", F.lit(200)))
    parts = max(1, -(-distinct.count() // per_part))
    dealt = distinct.repartitionByRange(parts, "_head").sortWithinPartitions("signature").select("signature")
    return dealt.mapInArrow(_answers, "signature string, cost long, audit string")


# --- rows to signatures ------------------------------------------------------------------------------------


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): ``rows`` damaged by the CRC-32 of ``conv_id:turn`` modulo 20; null: one space.

    0: gone, 1: no text, 2: text without ``.!?``, 3: twice, 4: role user.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    at = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind"))
    again = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    body = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return at.select("conv_id", "turn", role.alias("role"), body.alias("text"), (F.col("kind") == 0).alias("gone"), again.alias("again")).drop("again")


def in_order(rows: DataFrame, scratch: Scratch, rows_per_part: int = 50_000) -> DataFrame:
    """``rows`` (conv_id, turn, role, text, gone) with ``part`` and ``pos``, saved: conversations one after the other, by turn.

    Null turns come first; rows of one turn by role, the text's first 200 characters and what both say.
    """
    same = F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    rows = scratch.save(rows.withColumns({"same": same, "_from": F.xxhash64(F.monotonically_increasing_id())}))
    n = rows.count()
    parts = max(1, -(-n // rows_per_part), min(rows.sparkSession.sparkContext.defaultParallelism, n // 2000))
    by = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.left("role", F.lit(20)), F.left("text", F.lit(200)), F.col("same"), F.col("_from")]
    dealt = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    return scratch.save(dealt.withColumns({"pos": F.monotonically_increasing_id(), "part": F.spark_partition_id().cast("long")}).drop("_from"))


def signatures(placed: DataFrame) -> DataFrame:
    """A row per conversation: signature, initials, counts of faults, gaps, and how many rows each part has."""
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    first = F.left("role", F.lit(1))
    rows = placed.select("conv_id", "part", "pos", "same", "gone", F.when(~F.col("gone"), F.col("turn")).alias("turn"), F.when(first.isin("s", "u", "a"), first).otherwise("o").alias("role"), (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    said = rows.filter("not gone and not blank").groupBy("conv_id", "same").agg(F.min("pos").alias("_first"), F.count("*").alias("_n")).filter("_n > 1").select(F.col("conv_id").alias("_conv"), F.col("same").alias("_same"), "_first")
    seen = rows.join(said, rows["conv_id"].eqNullSafe(F.col("_conv")) & (rows["same"] == F.col("_same")), "left")
    again = ~F.col("blank") & F.coalesce(F.col("pos") > F.col("_first"), F.lit(False))
    cut = ~F.col("blank") & ~again & F.col("cut")
    here = lambda c: F.when(F.col("gone"), F.lit(0)).otherwise(c.cast("long"))
    symbol = F.when(F.col("blank") | again, "d").when(cut, F.upper("role")).otherwise(F.col("role"))
    faults = seen.select("conv_id", "part", "pos", "turn", here(F.lit(1)).alias("n"), here(F.col("blank")).alias("blank"), here(again).alias("duplicate"), here(cut).alias("truncated"), F.when(F.col("gone"), "").otherwise(symbol).alias("symbol"), F.when(F.col("gone"), "").otherwise(F.col("role")).alias("role"))
    listed = F.array_sort(F.collect_list(F.struct("pos", "symbol", "role")))
    turns = F.collect_set("turn")
    counts = ("n", "blank", "duplicate", "truncated")
    parts = faults.groupBy("conv_id", "part").agg(listed.alias("rows"), F.size(turns).cast("long").alias("turns"), F.min("turn").alias("low"), F.max("turn").alias("high"), *[F.sum(c).alias(c) for c in counts])
    joined = lambda c: F.array_join(F.transform("rows", lambda r: r[c]), "")
    parts = parts.select("conv_id", "part", "turns", "low", "high", *counts, joined("symbol").alias("symbols"), joined("role").alias("roles"))
    whole = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "n", "symbols", "roles", "low", "high"))).alias("parts"), F.sum("turns").alias("turns"), F.min("low").alias("low"), F.max("high").alias("high"), *[F.sum(c).alias(c) for c in counts[1:]])
    # a turn that ends one part and begins the next was counted twice
    real = F.filter("parts", lambda p: p["low"].isNotNull())
    met = F.aggregate(real, F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("at")), lambda s, p: F.struct((s["n"] + F.coalesce((p["low"] == s["at"]).cast("long"), F.lit(0))).alias("n"), p["high"].cast("long").alias("at")))["n"]
    text = lambda c: F.array_join(F.transform("parts", lambda p: p[c]), "")
    out = whole.withColumns({"signature": text("symbols"), "roles": text("roles"), "distinct": F.col("turns") - met})
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("distinct"), F.lit(0)).cast("long")
    illegal = F.greatest(F.length("roles") - 1, F.lit(0)) - F.regexp_count("roles", F.lit("(?=su|ua|au)"))
    return out.select("conv_id", gaps.alias("gaps"), *counts[1:], illegal.cast("long").alias("illegal"), "signature", F.transform("parts", lambda p: F.struct(p["part"].alias("part"), p["n"].alias("n"))).alias("parts"))


# --- edits to rows -----------------------------------------------------------------------------------------


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each part's share of the edits of its conversation, and where the conversation is when it begins."""
    for batch in batches:
        out = []
        for conv, parts, audit, signature in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "parts", "audit", "signature")), strict=True):
            at, state, row = 0, START, 0
            for k, p in enumerate(parts):
                begin, begun, left = at, state, p["n"]
                while at < len(audit) and (left or k == len(parts) - 1):
                    e, at = audit[at], at + 1
                    if e == "K":
                        state = KEPT[signature[row].lower()][state]
                    elif e != "D":
                        state = SPOKEN[state]
                    if e != "I":
                        row, left = row + 1, left - 1
                out.append((conv, p["part"], len(parts), audit[begin:at], begun))
        conv, part, n, edits, begun = zip(*out, strict=True) if out else ((),) * 5
        yield pa.RecordBatch.from_arrays([pa.array(conv, batch.schema.field("conv_id").type), pa.array(part, pa.int64()), pa.array(n, pa.int64()), pa.array(edits, pa.string()), pa.array(begun, pa.int32())], names=["conv_id", "part", "parts", "edits", "begun"])


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows behind a row of their part's edits -> that row (``nth`` -1) and the repaired rows."""
    now = None  # conv_id, part, parts, edits, next edit, state, rows so far

    def pending(out):
        """Inserted rows that come next."""
        while now[4] < len(now[3]) and now[3][now[4]] == "I":
            state = now[5] = SPOKEN[now[5]]
            now[4] += 1
            out.append((now[0], now[1], now[2], now[6], NAMES[state], "", "I"))
            now[6] += 1

    for batch in batches:
        out = []
        names = ("conv_id", "part", "parts", "edits", "begun", "pos", "role", "text")
        for conv, part, parts, edits, begun, pos, role, text in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if pos < 0:
                if now:
                    pending(out)
                now = [conv, part, parts, edits, 0, begun, 0]
                out.append((conv, part, parts, -1, None, None, None))
                continue
            pending(out)
            edit = now[3][now[4]]
            now[4] += 1
            if edit == "D":
                continue
            if edit == "K":
                now[5] = KEPT[role[:1]][now[5]]
            else:
                now[5] = SPOKEN[now[5]]
                role = NAMES[now[5]]
            out.append((conv, part, parts, now[6], role, text, edit))
            now[6] += 1
        yield _repaired_rows(out, batch.schema.field("conv_id").type)
    if now:
        out, kind = [], batch.schema.field("conv_id").type
        pending(out)
        yield _repaired_rows(out, kind)


def _repaired_rows(out: list, kind: pa.DataType) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True)) or [()] * 7
    types = (kind, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=["conv_id", "part", "parts", "nth", "role", "text", "edit"])


def apply_edits(placed: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, part, parts, nth, role, text, edit): repaired rows in order (part, nth); a row with ``nth`` -1 begins each part."""
    kind = placed.schema["conv_id"].dataType.simpleString()
    steps = convs.select("conv_id", "parts", "audit", "signature").mapInArrow(_steps, f"conv_id {kind}, part long, parts long, edits string, begun int")
    null = lambda t: F.lit(None).cast(t)
    heads = steps.select("conv_id", "part", "parts", "edits", "begun", F.lit(-1).cast("long").alias("pos"), null("string").alias("role"), null("string").alias("text"))
    rows = placed.filter("not gone").select("conv_id", "part", null("long").alias("parts"), null("string").alias("edits"), null("int").alias("begun"), "pos", "role", "text")
    dealt = heads.unionByName(rows).repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "pos")
    return dealt.mapInArrow(_apply, f"conv_id {kind}, part long, parts long, nth long, role string, text string, edit string")


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired rows -> a row per part: the digest if it is the whole conversation, else its lines."""
    now, done = None, []

    def row():
        body = "\n".join(now[3])
        alone = now[2] == 1
        return now[0], now[1], hashlib.sha256(body.encode("utf-8", "surrogatepass")).hexdigest() if alone else None, None if alone or not now[3] else body

    for batch in batches:
        for conv, part, parts, nth, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "parts", "nth", "role", "text")), strict=True):
            if nth < 0:
                done += [row()] if now else []
                now = [conv, part, parts, []]
            else:
                now[3].append(f"{role}:{text}")
        if done:
            yield _body_rows(done, batch.schema.field("conv_id").type)
            done = []
    if now:
        yield _body_rows([row()], batch.schema.field("conv_id").type)


def _body_rows(rows: list, kind: pa.DataType) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (kind, pa.int64(), pa.string(), pa.string()), strict=True)], names=["conv_id", "part", "digest", "body"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bodies of parts in order -> a digest per conversation."""
    now = None  # conv_id, hash, anything yet
    for batch in batches:
        done = []
        for conv, body in zip(batch.column("conv_id").to_pylist(), batch.column("body").to_pylist(), strict=True):
            if now is None or now[0] != conv:
                done += [now] if now else []
                now = [conv, hashlib.sha256(), False]
            if body is not None:
                now[1].update((("\n" if now[2] else "") + body).encode("utf-8", "surrogatepass"))
                now[2] = True
        if done:
            yield _digest_rows(done, batch.schema.field("conv_id").type)
    if now:
        yield _digest_rows([now], batch.schema.field("conv_id").type)


def _digest_rows(rows: list, kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), pa.array([r[1].hexdigest() for r in rows], pa.string())], names=["conv_id", "digest"])


def digests(repaired: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, digest): SHA-256 of ``role:text`` lines; conversations in one part are done where they are."""
    kind = repaired.schema["conv_id"].dataType.simpleString()
    bodies = scratch.save(repaired.mapInArrow(_bodies, f"conv_id {kind}, part long, digest string, body string"))
    long = bodies.filter("digest is null").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return bodies.filter("digest is not null").select("conv_id", "digest").unionByName(long.mapInArrow(_digests, f"conv_id {kind}, digest string"))


class Repair:
    """Conversations (conv_id, turn, role, text, gone) of a table, with their faults and cheapest edits.

    Rows with a null id are one conversation.  ``gone`` rows only say that their conversation exists.  A role's first
    letter is what counts; an empty role stands for none of the three.  Null roles and texts must have been filled.
    """

    def __init__(self, rows: DataFrame, rows_per_part: int = 50_000):
        self.scratch = Scratch(rows.sparkSession, "repair")
        self.placed = in_order(rows, self.scratch, rows_per_part)
        convs = self.scratch.save(signatures(self.placed))
        answers = self.scratch.save(cheapest_edits(convs))
        self.conversations = self.scratch.save(convs.join(answers, "signature"))

    def rows(self) -> DataFrame:
        """(conv_id, part, nth, role, text, edit): the repaired conversations, in order of part and nth."""
        return apply_edits(self.placed, self.conversations).filter("nth >= 0").drop("parts")

    def report(self) -> DataFrame:
        """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256): a row per conversation."""
        found = digests(apply_edits(self.placed, self.conversations), self.scratch).select(F.col("conv_id").alias("_conv"), F.col("digest").alias("repaired_sha256"))
        c = self.conversations
        return c.join(found, c["conv_id"].eqNullSafe(F.col("_conv"))).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repair_damaged(conversations: DataFrame, rows_per_part: int = 50_000) -> DataFrame:
    """The report on ``conversations`` after :func:`damage`; an empty table gives no rows; more columns count for nothing."""
    return Repair(damage(conversations), rows_per_part).report()
