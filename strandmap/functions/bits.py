"""Bit-level columns: oriented nodes, edge orientation, flags, packed pairs, widths, sparse sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Flag bits of a block row.
BLOCK_START, BLOCK_END, HAS_RANKS = 1, 2, 32


def node_type(node: Column, reverse: Column) -> Column:
    return F.shiftleft(node.cast("bigint"), 1).bitwiseOR(reverse.cast("bigint"))


def node_of(kind: Column) -> Column:
    return F.shiftright(kind, 1)


def is_reverse(kind: Column) -> Column:
    return kind.bitwiseAND(1)


def edge_orientation(target: Column) -> Column:
    """2 for a target read forwards, 3 for backwards."""
    return F.when(target.bitwiseAND(1) == 0, 2).otherwise(3)


def ends(orientation: Column) -> tuple[Column, Column]:
    return F.shiftright(orientation, 1), orientation.bitwiseAND(1)


def pack_pair(low: Column, high: Column) -> Column:
    """Two unsigned 32-bit numbers in one word."""
    return F.shiftleft(high.cast("bigint"), 32).bitwiseOR(low.cast("bigint").bitwiseAND(0xFFFFFFFF))


def unpack_pair(word: Column) -> tuple[Column, Column]:
    return word.bitwiseAND(0xFFFFFFFF), F.call_function("shiftrightunsigned", word, F.lit(32))


def width_for(most: Column) -> Column:
    """Bits that hold values up to most; 1 at least."""
    return F.when(most > 0, F.length(F.bin(most))).otherwise(1)


def has(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(bit) != 0


def low_width(universe: Column, size: Column) -> Column:
    """Low bits of a sparse set: the whole logarithm of universe / size, 1 at least."""
    return F.greatest(F.lit(1), F.length(F.bin(F.floor(universe / F.greatest(size, F.lit(1))).cast("bigint"))) - 1)


def stack_entry(node: Column, fresh: Column) -> Column:
    """A node id of 31 bits, and above it whether the node begins a block."""
    return node.cast("bigint").bitwiseAND(0x7FFFFFFF).bitwiseOR(F.shiftleft(fresh.cast("bigint"), 31))


def of_stack_entry(entry: Column) -> tuple[Column, Column]:
    return entry.bitwiseAND(0x7FFFFFFF), has(entry, 1 << 31)


def orientation(from_end: Column, to_end: Column) -> Column:
    """The two ends of an edge in one number."""
    return F.shiftleft(from_end, 1).bitwiseOR(to_end)


def pack_ints(values: Column, width: int) -> Column:
    """Numbers of width bits (32 at most), one behind the other from the lowest bit on, as 64-bit words:
    word w is the sum of what each number that touches it leaves there."""
    n = F.size(values)

    def word(w: Column) -> Column:
        first = F.floor(w * 64 / width).cast("int")
        last = F.least(F.ceil((w + 1) * 64 / width).cast("int"), n) - 1
        own = F.transform(F.sequence(first, F.greatest(first, last)), lambda i: _moved(F.coalesce(F.get(values, i), F.lit(0)).cast("bigint"), i * width - w * 64))
        return F.aggregate(own, F.lit(0).cast("bigint"), lambda s, x: s.bitwiseOR(x))

    words = F.ceil(n * width / 64).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), words - 1), word)).otherwise(F.array().cast("array<bigint>"))


def _moved(value: Column, by: Column) -> Column:
    """value shifted up by so many bits, down if negative; what passes the ends of a word is lost."""
    up = F.call_function("shiftleft", value, F.greatest(by, F.lit(0)).cast("int"))
    down = F.call_function("shiftrightunsigned", value, F.greatest(-by, F.lit(0)).cast("int"))
    return F.when(by >= 64, 0).when(by <= -64, 0).when(by >= 0, up).otherwise(down)


def int_at(words: Column, i: Column, width: int) -> Column:
    """Number i (from 0) of packed numbers of width bits."""
    at = i * width
    word = F.floor(at / 64).cast("int")
    low = F.call_function("shiftrightunsigned", F.get(words, word), (at % 64).cast("int"))
    high = F.when(at % 64 + width > 64, _moved(F.coalesce(F.get(words, word + 1), F.lit(0)), 64 - at % 64)).otherwise(0)
    return low.bitwiseOR(high).bitwiseAND((1 << width) - 1)


def pack_split(values: Column, width: int) -> tuple[Column, Column]:
    """Any 64-bit numbers: the words of their width lowest bits, and what is above these of each, an empty list where
    no number of the list passes the width."""
    above = F.transform(values, lambda x: F.call_function("shiftrightunsigned", x.cast("bigint"), F.lit(width)))
    low = F.transform(values, lambda x: x.cast("bigint").bitwiseAND((1 << width) - 1))
    return pack_ints(low, width), F.when(F.exists(above, lambda x: x != 0), above).otherwise(F.array().cast("array<bigint>"))


def split_at(words: Column, above: Column, i: Column, width: int) -> Column:
    """Number i (from 0) of what pack_split() made."""
    return F.shiftleft(F.coalesce(F.get(above, i), F.lit(0).cast("bigint")), width).bitwiseOR(int_at(words, i, width))


def safe_name(name: Column) -> Column:
    """A name for files: any character but letters, digits, points, dashes and underscores becomes an underscore."""
    return F.regexp_replace(name, "[^a-zA-Z0-9._-]", "_")
