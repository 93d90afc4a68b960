"""SentencePiece encoding and decoding, giant documents in parallel by a max-plus scan.

A text is a lattice of vocabulary pieces; its encoding is the path of most weight.  In a unigram model a step onto a
piece weighs the piece's score.  In a byte-pair model the encoding is the only path all of whose neighbours fit (two
pieces fit if they are the encoding of what they spell): a step weighs 0 if its pieces fit, minus infinity if not.

Giant documents are cut into chunks of a fixed number of characters, wherever that falls:

1. A cut's states are the pieces that start before it and end at or after it.  A chunk's transfer matrix holds, for
   each state at its start and each at its end, the most weight of a path from the one to the other.
2. Matrices are combined in the (max, +) semiring, which is associative: in Spark, ``fan`` neighbours at a time, level
   by level, up to one per document; then down again, which gives the state at each cut.
3. With both its states known, each chunk is traced back on its own.

No piece joins a character to a space after it, so at such a place inside a chunk all paths meet: the chunk's matrix is
the outer sum of two vectors, from its start to the first such place and from the last one to its end, and what lies
between is encoded by the library.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilake.llm.scratch import Scratch

SPACE = "▁"  # what the model writes for a space
_UNKNOWN = 10.0  # how far below the worst piece a unigram model weighs a character that is none (a fixed value)


class Lattice:
    """Pieces with scores, and the weights of steps between them."""

    def __init__(self, pieces: dict[str, float], unigram: bool):
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece holds a space after another character; paths don't meet before spaces")
        self.pieces, self.unigram = pieces, unigram
        self.longest = max(map(len, pieces), default=1)
        self.unknown = min(pieces.values(), default=0.0) - _UNKNOWN
        self.merged = lru_cache(200_000)(self._merged)

    def _merged(self, text: str) -> tuple[str, ...]:
        """The byte-pair encoding of a short string as it stands: the best-scored pair is merged first, the leftmost of equals."""
        parts = list(text)
        while True:
            best = max(((self.pieces[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.pieces), default=None)
            if best is None:
                return tuple(parts)
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def weight(self, before: str, piece: str) -> float:
        """Of a step from ``before`` (empty: from nowhere) to ``piece``."""
        if self.unigram:
            return self.pieces.get(piece, self.unknown)
        return 0.0 if not before or self.merged(before + piece) == (before, piece) else -np.inf

    def ends(self, text: str, at: int) -> list[int]:
        """Ends of pieces that start at ``at``; a character that is no piece stands for itself."""
        out = [e for e in range(at + 1, min(at + self.longest, len(text)) + 1) if text[at:e] in self.pieces and (self.unigram or self.merged(text[at:e]) == (text[at:e],))]
        return out if out and out[0] == at + 1 else [at + 1, *out]

    def states(self, text: str, cut: int) -> list[tuple[int, int]]:
        """Pieces that start before ``cut`` and end at or after it."""
        return [(s, e) for s in range(max(0, cut - self.longest), cut) for e in self.ends(text, s) if e >= cut]

    def forward(self, text: str, starts: list[tuple[int, int]], stop: int) -> dict[tuple[int, int], np.ndarray]:
        """For each piece reached that starts before ``stop``: the most weight from each of ``starts`` (pieces, or a place (p, p))."""
        reach: dict[tuple[int, int], np.ndarray] = {}
        into: dict[int, list[tuple[int, int]]] = {}
        for i, node in enumerate(starts):
            reach[node] = np.full(len(starts), -np.inf)
            reach[node][i] = 0.0
            into.setdefault(node[1], []).append(node)
        for p in range(min(into, default=stop), stop):
            for before in into.get(p, ()):
                left = text[before[0] : before[1]]
                for e in self.ends(text, p):
                    w = self.weight(left, text[p:e])
                    if w > -np.inf:
                        known = reach.get((p, e))
                        if known is None:
                            into.setdefault(e, []).append((p, e))
                            reach[p, e] = reach[before] + w
                        else:
                            np.maximum(known, reach[before] + w, out=known)
        return reach

    def trace(self, text: str, start: tuple[int, int], stop: int, leave: tuple[int, int] | None) -> list[str]:
        """The pieces after ``start`` on the best path, up to ``leave``, or to any that ends at ``stop``."""
        best: dict[tuple[int, int], float] = {start: 0.0}
        came: dict[tuple[int, int], tuple[int, int]] = {}
        into: dict[int, list[tuple[int, int]]] = {start[1]: [start]}
        for p in range(start[1], stop):
            for before in into.get(p, ()):
                for e in self.ends(text, p):
                    value = best[before] + self.weight(text[before[0] : before[1]], text[p:e])
                    if value > best.get((p, e), -np.inf):
                        if (p, e) not in best:
                            into.setdefault(e, []).append((p, e))
                        best[p, e], came[p, e] = value, before
        node = leave or max(into[stop], key=best.__getitem__)
        out = []
        while node != start:
            out.append(text[node[0] : node[1]])
            node = came[node]
        return out[::-1]


class Codec:
    """A model's library and its lattice."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            kind = sentencepiece_model_pb2.ModelProto.FromString(f.read()).trainer_spec.model_type
        special = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)
        self.id_of = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not special(i)}
        self.lattice = Lattice({p: sp.get_score(i) for p, i in self.id_of.items()}, kind == 1)

    def ids(self, pieces: list[str]) -> list[int]:
        out = []
        for p in pieces:
            got = self.id_of.get(p)
            out += [got] if got is not None else [self.sp.piece_to_id(f"<0x{x:02X}>") for x in p.encode("utf-8", "surrogatepass")]
        return out

    def between(self, text: str) -> list[int]:
        """Ids of a span that starts with a space, which the library puts before a text itself."""
        return self.sp.encode(text[1:]) if len(text) > 1 else self.ids([text] if text else [])


# --- the semiring ------------------------------------------------------------------------------------------


Matrix = tuple[np.ndarray, np.ndarray] | np.ndarray  # an outer sum of two vectors, or all entries


def product(a: Matrix, b: Matrix) -> Matrix:
    """The (max, +) product; with an outer sum on either side it is one."""
    if isinstance(a, tuple):
        if isinstance(b, tuple):
            return a[0], b[1] + (a[1] + b[0]).max()
        return a[0], (a[1][:, None] + b).max(0)
    if isinstance(b, tuple):
        return (a + b[0]).max(1), b[1]
    return np.stack([(row[:, None] + b).max(0) for row in a])


def row_of(m: Matrix, i: int) -> np.ndarray:
    return m[0][i] + m[1] if isinstance(m, tuple) else m[i]


def column_of(m: Matrix, j: int) -> np.ndarray:
    return m[0] + m[1][j] if isinstance(m, tuple) else m[:, j]


def states_between(matrices: list[Matrix], entry: int, leave: int) -> list[int]:
    """The best states at the cuts between neighbours, from ``entry`` before the first to ``leave`` behind the last."""
    upto = [row_of(matrices[0], entry)]
    for m in matrices[1:-1]:
        upto.append((upto[-1][:, None] + (m[0][:, None] + m[1] if isinstance(m, tuple) else m)).max(0))
    out, state = [], leave
    for m, v in zip(matrices[:0:-1], upto[::-1], strict=False):
        state = int((v + column_of(m, state)).argmax())
        out.append(state)
    return out[::-1]


def _pack(m: Matrix) -> tuple[list, list, list | None]:
    return (m[0].tolist(), m[1].tolist(), None) if isinstance(m, tuple) else ([0.0] * m.shape[0], [0.0] * m.shape[1], m.ravel().tolist())


def _unpack(h, t, full) -> Matrix:
    if full is None:
        return np.asarray(h, "f8"), np.asarray(t, "f8")
    return np.asarray(full, "f8").reshape(len(h), len(t))


# --- chunks ------------------------------------------------------------------------------------------------


def cuts(n: int, size: int) -> list[int]:
    """Places to cut n characters into chunks of ``size``, the last of at least half and at most three halves of it."""
    return [0, *range(size, n - size // 2, size), n]


def _chunks(path: str, size: int):
    """(row, id, text) of giant documents -> (row, id, k, text, cut, stop, last), a piece's length of text around each chunk."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        margin = Codec(path).lattice.longest
        step = max(size, 2 * margin)
        for batch in batches:
            for i in range(batch.num_rows):
                text = SPACE + batch.column(2)[i].as_py().replace(" ", SPACE)
                at = cuts(len(text), step)
                out = []
                for k, (a, b) in enumerate(zip(at, at[1:], strict=False)):
                    lo = max(0, a - margin)
                    out.append((k, text[lo : b + margin], a - lo, b - lo, b == len(text)))
                cols = list(zip(*out, strict=True))
                types = (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.bool_())
                same = [pa.chunked_array([batch.column(c).slice(i, 1)] * len(out)).combine_chunks() for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*same, *[pa.array(list(c), t) for c, t in zip(cols, types, strict=True)]], names=["row", "id", "k", "text", "cut", "stop", "last"])

    return go


def meeting_places(text: str, cut: int, stop: int, first: bool, last: bool) -> tuple[int, int] | None:
    """The first and the last place from ``cut`` on and before ``stop`` where all paths meet, or None.

    A document's start and end are such places too.
    """
    a = cut if first else next(_spaces(text, cut, stop, False), -1)
    b = stop if last else next(_spaces(text, cut, stop, True), -1)
    if a < 0 and b < 0:
        return None
    return (b if a < 0 else a), (a if b < 0 else b)


def _spaces(text: str, cut: int, stop: int, back: bool) -> Iterator[int]:
    """Spaces after other characters, from ``cut`` on and before ``stop``, in either direction."""
    p = text.rfind(SPACE, cut, stop) if back else text.find(SPACE, cut, stop)
    while p >= 0:
        if p and text[p - 1] != SPACE:
            yield p
        p = text.rfind(SPACE, cut, p) if back else text.find(SPACE, p + 1, stop)


def transfer(lattice: Lattice, text: str, cut: int, stop: int, first: bool, last: bool) -> Matrix:
    """A chunk's matrix, less what all paths weigh between meeting places.  At a document's start and end there is one state."""
    entries = [(cut, cut)] if first else lattice.states(text, cut)
    exits = [] if last else lattice.states(text, stop)
    met = meeting_places(text, cut, stop, first, last)
    none = np.full(len(entries), -np.inf)
    if met is None:
        reach = lattice.forward(text, entries, stop)
        return np.stack([reach.get(x, none) for x in exits], axis=1)
    head = np.zeros(1)
    if not first:
        head = np.max([none, *[v for (_, e), v in lattice.forward(text, entries, met[0]).items() if e == met[0]]], axis=0)
    if last:
        return head, np.zeros(1)
    reach = lattice.forward(text, [(met[1], met[1])], stop)
    return head, np.array([reach[x][0] if x in reach else -np.inf for x in exits])


def _transfer(path: str):
    """Chunks -> (row, id, k, h, t, full, head, tail, cut, stop, last, ids): matrix, texts to trace, and ids of what lies between."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        margin = codec.lattice.longest
        for batch in _slices(batches, 3):
            out, ids = [], []
            for k, text, cut, stop, last in zip(*(batch.column(c).to_pylist() for c in ("k", "text", "cut", "stop", "last")), strict=True):
                h, t, full = _pack(transfer(codec.lattice, text, cut, stop, k == 0, last))
                met = meeting_places(text, cut, stop, k == 0, last)
                if met:
                    out.append((h, t, full, text[: met[0]], text[met[1] : stop + margin], cut, stop - met[1]))
                    ids.append(codec.between(text[met[0] : met[1]]))
                else:
                    out.append((h, t, full, text, None, cut, stop))
                    ids.append([])
            types = (*[pa.list_(pa.float64())] * 3, pa.string(), pa.string(), pa.int32(), pa.int32())
            made = [pa.array(list(c), x) for c, x in zip(list(zip(*out, strict=True)), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "id", "k")), *made, batch.column("last"), _lists(ids)], names=["row", "id", "k", "h", "t", "full", "head", "tail", "cut", "stop", "last", "ids"])

    return go


_MATRIX = "h array<double>, t array<double>, full array<double>"


def _combine(rows: list[dict]) -> list[dict]:
    """Neighbours in order -> their product."""
    m = _unpack(rows[0]["h"], rows[0]["t"], rows[0]["full"])
    for r in rows[1:]:
        m = product(m, _unpack(r["h"], r["t"], r["full"]))
    h, t, full = _pack(m)
    return [{"row": rows[0]["row"], "k": rows[0]["up"], "h": h, "t": t, "full": full}]


def _resolve(rows: list[dict]) -> list[dict]:
    """Neighbours in order, with the states around them all -> the states around each."""
    entry, leave = rows[0]["entry"], rows[0]["leave"]
    inner = states_between([_unpack(r["h"], r["t"], r["full"]) for r in rows], entry, leave)
    return [{"row": r["row"], "k": r["k"], "entry": a, "leave": b} for r, a, b in zip(rows, [entry, *inner], [*inner, leave], strict=True)]


_LEVEL = pa.schema([("row", pa.int64()), ("k", pa.int64()), *[(c, pa.list_(pa.float64())) for c in ("h", "t", "full")]])
_STATES = pa.schema([("row", pa.int64()), ("k", pa.int64()), ("entry", pa.int32()), ("leave", pa.int32())])


def _by_neighbours(rows: DataFrame, make, schema: pa.Schema, ddl: str) -> DataFrame:
    """``make`` of each group (row, up) in the order of k.  Groups are small: ``fan`` rows at most.

    The number of partitions is asked for, as the work is more than the rows' bytes would let expect.
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if held and (held[0]["row"], held[0]["up"]) != (r["row"], r["up"]):
                    out += make(held)
                    held = []
                held.append(r)
            yield pa.RecordBatch.from_pylist(out, schema)
        yield pa.RecordBatch.from_pylist(make(held) if held else [], schema)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "row", "up").sortWithinPartitions("row", "up", "k").mapInArrow(go, ddl)


def scan(matrices: DataFrame, scratch: Scratch, fan: int = 32) -> DataFrame:
    """(row, k, h, t, full) -> (row, k, entry, leave): the numbers of the states at each chunk's ends.

    A level joins ``fan`` neighbours a group; levels are as many as it takes to get to one matrix per row.
    """
    levels = [matrices.select("row", F.col("k").cast("long").alias("k"), "h", "t", "full")]
    up = F.floor(F.col("k") / fan).cast("long").alias("up")
    while levels[-1].filter("k > 0").limit(1).count():
        levels.append(scratch.save(_by_neighbours(levels[-1].select("*", up), _combine, _LEVEL, f"row long, k long, {_MATRIX}")))
    states = levels.pop().select("row", "k", F.lit(0).alias("entry"), F.lit(0).alias("leave"))
    for level in reversed(levels):
        around = states.withColumnRenamed("k", "up")
        states = scratch.save(_by_neighbours(level.select("*", up).join(around, ["row", "up"]), _resolve, _STATES, "row long, k long, entry int, leave int"))
    return states


def _trace(path: str):
    """(row, k, head, tail, cut, stop, last, entry, leave) -> (row, k, part, ids): what comes before (0) and behind (2) the middle."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        lattice = codec.lattice
        for batch in batches:
            out, ids = [], []
            for r in batch.to_pylist():
                head, tail, cut, stop = r["head"], r["tail"], r["cut"], r["stop"]
                if r["k"] > 0:
                    entry = lattice.states(head, cut)[r["entry"]]
                    leave = lattice.states(head, stop)[r["leave"]] if tail is None else None
                    out.append((r["row"], r["k"], 0))
                    ids.append(codec.ids(lattice.trace(head, entry, len(head) if leave is None else stop, leave)))
                if tail is not None and not r["last"]:
                    out.append((r["row"], r["k"], 2))
                    ids.append(codec.ids(lattice.trace(tail, (0, 0), stop, lattice.states(tail, stop)[r["leave"]])))
            cols = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([*[pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32()), strict=True)], _lists(ids)], names=["row", "k", "part", "ids"])

    return go


_PART = f"k int, {_MATRIX}, head string, tail string, cut int, stop int, last boolean, ids array<int>"


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = 16_384) -> DataFrame:
    """(id, ids array<int>, n_chunks) per row of ``docs``: what the library gives for the whole text.

    Null texts have no ids, as empty ones.  Texts of more than ``chunk_chars`` characters are cut and their
    chunks dealt out.  Repeated rows each keep theirs; ids may be null or repeat; an empty table gives no rows;
    other columns are ignored.  Where a unigram model weighs several paths of a giant text alike, it may be another
    of them than the library's; a byte-pair model has one path.
    """
    scratch = Scratch(docs.sparkSession, "pieces")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    giant = F.length("text") > chunk_chars
    kind = docs.schema[id_col].dataType.simpleString()
    whole = rows.filter(~giant).mapInArrow(_encode_small(model_path), f"id {kind}, ids array<int>, n_chunks int")
    # numbers of rows are given once, as chunks are written; what follows reads them
    numbered = rows.filter(giant).select(F.monotonically_increasing_id().alias("row"), "id", "text")
    chunks = scratch.save(numbered.mapInArrow(_chunks(model_path, chunk_chars), f"row long, id {kind}, k int, text string, cut int, stop int, last boolean"))
    parts = scratch.save(chunks.repartition("row", "k").mapInArrow(_transfer(model_path), f"row long, id {kind}, {_PART}"))
    scratch.drop(chunks)
    states = scan(parts, scratch)
    around = parts.select("row", "k", "head", "tail", "cut", "stop", "last").join(states, ["row", "k"])
    ends = around.select("row", "k", "head", "tail", "cut", "stop", "last", "entry", "leave").mapInArrow(_trace(model_path), "row long, k int, part int, ids array<int>")
    middle = parts.select("row", "k", F.lit(1).alias("part"), "ids", "id")
    every = middle.unionByName(ends, allowMissingColumns=True)
    own = F.max(F.when((F.col("part") == 1) & (F.col("k") == 0), F.struct("id"))).getField("id").alias("id")
    joined = every.groupBy("row").agg(own, F.sort_array(F.collect_list(F.struct("k", "part", "ids"))).alias("c"), F.count_if(F.col("part") == 1).cast("int").alias("n_chunks"))
    big = joined.select("id", F.flatten(F.transform("c", lambda x: x["ids"])).alias("ids"), "n_chunks")
    return whole.unionByName(big).withColumnRenamed("id", id_col)


def _lists(each: list[list[int]]) -> pa.Array:
    sizes = np.fromiter(map(len, each), "i8", len(each))
    flat = np.concatenate([np.empty(0, "i4"), *(np.array(x, "i4") for x in each)])
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype("i4")), pa.array(flat))


def _slices(batches: Iterator[pa.RecordBatch], text_at: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of about ``most`` bytes of text or one row: ids of a large batch, as Python numbers, take far more room."""
    for batch in batches:
        ends = np.cumsum(np.diff(np.frombuffer(batch.column(text_at).buffers()[1], "i4")[batch.column(text_at).offset :][: batch.num_rows + 1]))
        first = 0
        while first < batch.num_rows:
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + most)))
            yield batch.slice(first, last - first)
            first = last


def _encode_small(path: str):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for batch in _slices(batches, 1):
            ids = codec.sp.encode(batch.column(1).to_pylist(), num_threads=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(ids), pa.array(np.ones(len(ids), "i4"))], names=["id", "ids", "n_chunks"])

    return go


def _digest(path: str):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for batch in batches:
            n, crc, sha = [], [], []
            for ids in batch.column(1):
                own = ids.values.to_numpy().astype("<u4") if ids.is_valid else np.empty(0, "<u4")
                n.append(len(own))
                crc.append(zlib.crc32(own.tobytes()))
                sha.append(hashlib.sha256(codec.sp.decode(own.tolist()).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(sha, pa.string())], names=["id", "n_chunks", "n_ids", "ids_crc32", "decoded_sha256"])

    return go


def encode_and_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = 16_384) -> DataFrame:
    """(id, n_chunks, n_ids, ids_crc32, decoded_sha256): digests of the ids (little-endian, 32 bits) and of the decoded text."""
    coded = encode(docs, model_path, id_col, text_col, chunk_chars)
    kind = coded.schema[id_col].dataType.simpleString()
    return coded.select(F.col(id_col).alias("id"), "ids", "n_chunks").mapInArrow(_digest(model_path), f"id {kind}, n_chunks int, n_ids long, ids_crc32 long, decoded_sha256 string").withColumnRenamed("id", id_col)
