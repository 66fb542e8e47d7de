"""DNA columns: complement, packing into words of 15 bases (2 bits each) or 10 (3 bits, with N), composition. All native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bases of a word by the bits of a base, and the bit that marks a full word.
PER_WORD, FULL = {2: 15, 3: 10}, 1 << 31
#: Bases by their codes; the last only with 3 bits.
BASES = "ACGTN"


def clean(text: Column) -> Column:
    """The letters ACGTN of a text, upper-cased (others are dropped before, so no locale matters)."""
    return F.upper(F.regexp_replace(text, "[^ACGTNacgtn]", ""))


def reverse_complement(seq: Column) -> Column:
    """Case-preserving; characters that are no base pass through."""
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def oriented(seq: Column, forward: Column) -> Column:
    return F.when(forward, seq).otherwise(reverse_complement(seq))


def base_code(base: Column) -> Column:
    """0 to 4 for A, C, G, T, N in any case; other characters raise."""
    code = F.instr(F.lit("ACGTN"), F.upper(base)) - 1
    return F.when(code >= 0, code).otherwise(F.raise_error(F.concat(F.lit("not a base: "), base)).cast("int"))


def code_base(code: Column) -> Column:
    return F.substring(F.lit("ACGTN"), code + 1, F.lit(1))


def words_for(length: Column, bits: int = 2) -> Column:
    return F.ceil(length / PER_WORD[bits])


def is_full(word: Column) -> Column:
    """Whether a word holds as many bases as fit: its sign bit."""
    return word < 0


def needs_n(seq: Column) -> Column:
    return F.contains(F.upper(seq), F.lit("N"))


def pack(seq: Column, bits: int = 2, flags: bool = True) -> Column:
    """Words of a string of bases, in any case: base i of a word at its bits from bits * i on; the sign bit is
    set in full words, unless flags is off, as in words that several sequences share. Any other character
    raises, N too where a base has 2 bits.

    A word's reversed bases read as digits of base 4 or 8, which keeps packing in built-in functions;
    one pattern cuts all words, so the work is linear in the length."""
    per, known = PER_WORD[bits], BASES[: bits + 2]
    digits = F.translate(seq, known + known.lower(), "01234"[: bits + 2] * 2)
    parts = F.regexp_extract_all(digits, F.lit(f"[0-9]{{1,{per}}}"), F.lit(0))
    full = lambda p: F.when(F.length(p) == per, F.lit(FULL)).otherwise(0) if flags else F.lit(0)
    words = F.transform(parts, lambda p: (F.conv(F.reverse(p), 2**bits, 10).cast("bigint") - full(p)).cast("int"))
    return F.when(seq.rlike(rf"\A[{known}{known.lower()}]*\z"), words).when(seq.isNotNull(), F.raise_error(F.concat(F.lit("not a base: "), F.regexp_replace(seq, f"[{known}{known.lower()}]", ""))).cast("array<int>"))


def code_at(words: Column, i: Column, bits: int = 2) -> Column:
    """The code of base i (from 0)."""
    word = F.element_at(words, F.floor(i / PER_WORD[bits]).cast("int") + 1)
    return F.call_function("shiftrightunsigned", word, ((i % PER_WORD[bits]) * bits).cast("int")).bitwiseAND(2**bits - 1)


def base_at(words: Column, i: Column, bits: int = 2) -> Column:
    return code_base(code_at(words, i, bits))


def unpack(words: Column, length: Column, bits: int = 2) -> Column:
    """The bases of words, upper-cased: each word written in base 4 or 8, lowest digit first."""
    per = PER_WORD[bits]
    text = F.transform(words, lambda w: F.reverse(F.lpad(F.conv(w.cast("bigint").bitwiseAND((1 << bits * per) - 1).cast("string"), 10, 2**bits), per, "0")))
    return F.substring(F.translate(F.array_join(text, ""), "01234", BASES), F.lit(1), length)


def copy_words(words: Column, first: Column, count: Column) -> Column:
    """count words from word first on (from 0)."""
    return F.slice(words, first + 1, count)


def format_bits(sequences: DataFrame, seq: str = "seq") -> int:
    """Bits of a base for a whole table: 3 if any label has an N."""
    return 3 if sequences.agg(F.bool_or(needs_n(F.col(seq)))).first()[0] else 2


def packed(sequences: DataFrame, seq: str = "seq") -> DataFrame:
    """All rows with words and length in place of the label, and the bits of a base, chosen for all of them."""
    bits = format_bits(sequences, seq)
    return sequences.withColumn("words", pack(F.col(seq), bits)).withColumn("length", F.length(seq)).withColumn("bits", F.lit(bits)).drop(seq)


def count_base(seq: Column, base: str) -> Column:
    return F.length(seq) - F.length(F.replace(seq, F.lit(base), F.lit("")))
