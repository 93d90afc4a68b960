"""Bit votes of 64-bit hashes, summed natively: 32 long sums hold 64 counters of 32 bits each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bits g and g + 32 of a hash, moved to bits 0 and 32.
_PAIR = (1 << 32) | 1


def vote_sums(hash_col: Column, weight: Column | None = None) -> list[Column]:
    """32 sums; sum g counts (in its two halves) the hashes with bit g and with bit g + 32 set."""
    out = []
    for g in range(32):
        lanes = F.shiftrightunsigned(hash_col, g).bitwiseAND(F.lit(_PAIR))
        out.append(F.sum(lanes if weight is None else lanes * weight).alias(f"v{g}"))
    return out


def majority(total: Column) -> Column:
    """The 64-bit word whose bit is 1 where more than half of ``total`` voted for it (sums v0 .. v31)."""
    word = F.lit(0).cast("long")
    for g in range(32):
        low, high = F.col(f"v{g}").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(F.col(f"v{g}"), 32)
        word = word.bitwiseOR(F.when(low * 2 > total, F.lit(1 << g).cast("long")).otherwise(F.lit(0).cast("long")))
        word = word.bitwiseOR(F.when(high * 2 > total, F.shiftleft(F.lit(1).cast("long"), g + 32)).otherwise(F.lit(0).cast("long")))
    return word


def longs(values: list[int]) -> Column:
    """A constant array of longs."""
    return F.array(*[F.lit(x).cast("long") for x in values])


def hex16(word: Column) -> Column:
    """16 lower-case hex digits of a long, as unsigned."""
    return F.lower(F.lpad(F.hex(word), 16, "0"))
