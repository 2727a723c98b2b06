"""Bit-mask column functions. A mask is one or more signed 64-bit words; bit i of a word is source i."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_BITS = 64


def bit(i: Column | int) -> Column:
    """The word with only bit i set (bit 63 is the sign bit)."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), i if isinstance(i, Column) else F.lit(i))


def and_not(a: Column, b: Column) -> Column:
    return a.bitwiseAND(F.bitwise_not(b))


def any_set(words: list[Column]) -> Column:
    """True if a bit of any word is set. Words are compared with 0 only: their sign carries a source."""
    return reduce(lambda x, y: x | y, [w != F.lit(0).cast("long") for w in words])


def popcount(words: list[Column]) -> Column:
    return reduce(lambda x, y: x + y, [F.bit_count(w) for w in words])


def trailing_zeros(word: Column) -> Column:
    """Index of the lowest set bit; 64 for 0. The word of bit 63 alone has no negative and is told apart first."""
    lowest = word.bitwiseAND(F.bitwise_not(word) + 1)
    return F.when(word == 0, 64).when(word == F.lit(-(2**63)), 63).otherwise(F.bit_count(lowest - 1))


def full_mask(n: int) -> int:
    """The signed word with the lowest n (0 to 64) bits set."""
    return -1 if n >= WORD_BITS else (1 << n) - 1 if n < 63 else 2**63 - 1
