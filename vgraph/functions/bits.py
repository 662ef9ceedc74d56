"""Integer and bit functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def align_down(x: Column, to: int = 64) -> Column:
    return x - F.pmod(x, F.lit(to))


def align_up(x: Column, to: int = 64) -> Column:
    return align_down(x + (to - 1), to)


def to_string(x: Column) -> Column:
    """A number as text."""
    return x.cast("string")


def count_ones(word: Column) -> Column:
    return F.bit_count(word)


def set_bits(word: Column, base: Column | int = 0) -> Column:
    """An array of the places of the ones of a 64-bit word, after ``base``."""
    base = base if isinstance(base, Column) else F.lit(base)
    return F.transform(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda k: F.getbit(word, k) == 1), lambda k: k.cast("bigint") + base)


def bitmap_to_set(words: DataFrame) -> DataFrame:
    """vid of all ones of a bitmap: rows word_index, word; each word stands for 64 ids."""
    return words.select(F.explode(set_bits(F.col("word"), F.col("word_index") * 64)).alias("vid"))


def set_to_bitmap(ids: DataFrame) -> DataFrame:
    """word_index, word of a set of ids (vid)."""
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("vid", F.lit(64)).cast("int"))
    return ids.distinct().groupBy(F.floor(F.col("vid") / 64).alias("word_index")).agg(F.bit_or(one).alias("word"))


# The layout of a packed id: 2 bits of kind, 18 of machine, 44 of index.
_INDEX, _MACHINE = 44, 18


def pack_id(kind: Column, machine: Column, index: Column) -> Column:
    return F.shiftleft(kind.cast("bigint"), _INDEX + _MACHINE).bitwiseOR(F.shiftleft(machine.cast("bigint"), _INDEX)).bitwiseOR(index)


def unpack_id(packed: Column) -> tuple[Column, Column, Column]:
    return (
        F.shiftrightunsigned(packed, _INDEX + _MACHINE).bitwiseAND(F.lit(3)),
        F.shiftrightunsigned(packed, _INDEX).bitwiseAND(F.lit((1 << _MACHINE) - 1)),
        packed.bitwiseAND(F.lit((1 << _INDEX) - 1)),
    )


def owner(vid: Column, parts: int) -> Column:
    """The part that owns a vertex, and its place there is vid / parts."""
    return F.pmod(vid, F.lit(parts))
