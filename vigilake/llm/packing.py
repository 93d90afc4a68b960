"""Best-fit packing of tokenised documents into sequences, certified by lower bounds.

1. Tokenise every document in place; keep lengths and checksums only.  Documents longer than a sequence are
   cut into whole sequences and a rest.
2. Deal the pieces out by row number to partitions of bounded size; pack each by best-fit decreasing.
3. Dual-feasible functions give a lower bound on each partition's number of sequences.  Sequences of a
   partition that meets its bound stay, all but its emptiest one; a partition with a gap gives up its emptier
   sequences too, up to 1 / ``shrink`` of its pieces.  What was given up is exchanged: dealt out anew to fewer
   partitions, and packed again, until one partition is left.  So rounds end: each has at most 1 / ``shrink`` of the
   pieces of the one before.

Only rows of a few numbers move; no text is shuffled.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilake.llm.scratch import Scratch

END_ID = 1
_CACHE = 1_000_000  # entries of a worker's memo of words (under 200 MB), emptied when full


class WordCodec:
    """Ids of whole texts by a word-level tokenizer whose pre-tokenizer never joins across white space.

    A text's ids are those of its words, one after the other, so each word is encoded once and remembered as
    bytes.  Words that the tokenizer's normaliser could change in context, or that hold a special token, go
    through the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)")
        self.id_bytes = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.model = self.tokenizer.model
        # the tokenizer's own split, inside a word
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        self.space = re.compile("[\x1c-\x1f]")
        self.byte_char = _byte_chars()
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        got = self.parts.get(part)
        if got is None:
            if len(self.parts) >= _CACHE:
                self.parts.clear()
            raw = part if part.isascii() and part.isprintable() else "".join(map(self.byte_char.__getitem__, part.encode()))
            got = self.parts[part] = b"".join([self.id_bytes[t.id] for t in self.model.tokenize(raw)])
        return got

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        # Latin letters without combining marks: composed already, and lower case is character by character
        if word.isascii() or (max(word) < "ɐ" and "İ" not in word):
            low = word.lower()
            if low.isalpha():
                got = self._part(low)
            elif low[:-1].isalpha() and low[-1] in ".,;:!?":  # letters, then one mark
                got = self._part(low[:-1]) + self._part(low[-1])
            else:
                got = self._whole(word) if self.special.search(word) else b"".join(map(self._part, self.pieces.findall(low)))
        else:
            got = self._whole(word)
        if len(self.words) >= _CACHE:
            self.words.clear()
        self.words[word] = got
        return got

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of the whole text."""
        if self.space.search(text):  # white space to Python, not to the tokenizer
            return self._whole(text)
        known, word = self.words.get, self._word
        return b"".join([known(w) or word(w) for w in text.split()])


def _byte_chars() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself, or the next free from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _cut(path: str, capacity: int):
    """mapInArrow: (id, text) -> the pieces of each document."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = WordCodec(path)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            ids, piece, start, length, crc = [], [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = codec.encode(text.as_py() or "") + end
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    ids.append(doc)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    return go


# --- packing of one partition ------------------------------------------------------------------------------


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """No packing has fewer sequences: the largest of the volume bound and those of dual-feasible functions.

    f_k maps lengths above capacity - k to the capacity, those below k to 0, others to themselves; any f whose
    values of lengths that fit together fit together gives a bound.
    """
    counts = np.bincount(lengths, minlength=capacity + 1).astype("i8")
    total = np.cumsum(counts * np.arange(capacity + 1))
    number = np.cumsum(counts)
    k = np.arange(0, capacity // 2 + 1)
    big = number[-1] - number[capacity - k]
    below = np.where(k > 0, total[np.maximum(k - 1, 0)], 0)
    return int(max((-(-((big * capacity) + total[capacity - k] - below) // capacity)).max(), 0))


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length: longest first, each into the fullest bin that still holds it.

    Bins are kept by free room; an integer whose bit r says that some bin has r free finds the least that fits.
    """
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), "i8"), np.empty(len(lengths), "i8")
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, made = 0, 0
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                mask ^= 1 << room
        else:
            room, b = capacity, made
            made += 1
        bins[i], offsets[i] = b, capacity - room
        left = room - n
        if left:
            by_room[left].append(b)
            mask |= 1 << left
    return bins, offsets


def _pack(capacity: int, round_: int, last: bool, shrink: int):
    """applyInPandas on one partition: packs it, and marks the sequences that it gives up for exchange."""

    def go(pdf: pd.DataFrame) -> pd.DataFrame:
        lengths = pdf["length"].to_numpy("i8")
        bins, offsets = best_fit_decreasing(lengths, capacity)
        n = int(bins.max()) + 1
        filled = np.bincount(bins, lengths, n)
        gap = n - lower_bound(lengths, capacity)
        emptiest = np.argsort(filled, kind="stable")
        spare = np.cumsum(capacity - filled[emptiest])
        # enough room for the gap, and the emptiest sequence in any case, but no more pieces than may go on
        give = 0 if last else min(n, 1 + (int(np.searchsorted(spare, gap * capacity)) + 8 * gap if gap else 0))
        held = np.cumsum(np.bincount(bins, minlength=n)[emptiest])
        give = min(give, int(np.searchsorted(held, len(lengths) // shrink, "right")))
        given = np.zeros(n, bool)
        given[emptiest[:give]] = filled[emptiest[:give]] < capacity
        part = int(pdf["part"].iloc[0])
        return pdf.assign(seq=(round_ << 56) | (part << 28) | bins, offset=offsets, given=given[bins])

    return go


PIECE = "row long, id long, piece int, start long, length long, ids_crc32 long"


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, rows_per_part: int = 16_000, shrink: int = 2) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset): one row per piece of every document.

    A document is the ids of its whole text, then id 1; null or empty texts are that id alone.  Only documents
    of more than ``capacity`` ids are cut.  Repeated rows are packed each; ids may be null or repeat.  An
    empty table gives no rows.  Ties in length are packed in the order of their rows.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    cut = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_cut(tokenizer_path, capacity), PIECE.removeprefix("row long, "))
    pieces = scratch.save(cut.select(F.monotonically_increasing_id().alias("row"), "*"))
    packed = packed_pieces(pieces, scratch, capacity, rows_per_part, shrink)
    return packed.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", F.col("seq").alias("sequence_id"), "offset")


def _dealt(n: int, at: Column) -> Column:
    return F.pmod(F.xxhash64(at), F.lit(n)).cast("long")


def packed_pieces(pieces: DataFrame, scratch: Scratch, capacity: int, rows_per_part: int, shrink: int) -> DataFrame:
    """``pieces`` with (seq, offset): whole sequences at once, the others in rounds of packing and exchange."""
    whole = pieces.filter(F.col("length") == capacity).withColumn("seq", F.lit(63 << 56).cast("long") + F.col("row")).withColumn("offset", F.lit(0).cast("long"))
    todo = pieces.filter(F.col("length") < capacity)
    rows = todo.count()
    kept = [whole]
    schema = f"{PIECE}, part long, seq long, offset long, given boolean"
    for round_ in range(62):
        parts = max(1, -(-rows // rows_per_part))
        if not rows:
            break
        last = parts == 1
        dealt = todo.withColumn("part", _dealt(parts, F.concat_ws("-", "row", F.lit(round_))))
        done = scratch.save(dealt.groupBy("part").applyInPandas(_pack(capacity, round_, last, shrink), schema))
        kept.append(done.filter("not given").drop("given", "part"))
        if last:
            break
        todo = done.filter("given").drop("given", "part", "seq", "offset")
        rows = todo.count()
    out = kept[0]
    for more in kept[1:]:
        out = out.unionByName(more)
    return out
