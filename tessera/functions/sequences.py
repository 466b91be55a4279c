"""Column expressions over DNA words and small arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pack(seq: str | Column) -> Column:
    """A word over ACGT (up to 31 bases) as a base-4 integer, first base most significant; null for other letters."""
    s = _col(seq)
    return F.when(s.rlike("^[ACGT]{1,31}$"), F.conv(F.translate(s, BASES, "0123"), 4, 10).cast("bigint"))


def unpack(code: str | Column, k: int) -> Column:
    """The word of length ``k`` that packs to ``code``."""
    return F.translate(F.lpad(F.conv(_col(code).cast("string"), 10, 4), k, "0"), "0123", BASES)


def reverse_complement(seq: str | Column) -> Column:
    return F.reverse(F.translate(_col(seq), "ACGTacgt", "TGCAtgca"))


#: Window starts that are cut from one piece: positions in a text are found from its start, so long texts are cut first.
PIECE = 512


def windows(seq: str | Column, k: int, offset: int = 0) -> Column:
    """All words of length ``k`` from ``offset`` on; an empty array if there is no room for one.

    Texts are cut in pieces of PIECE window starts and words are cut from these, so the cost is
    linear in the text.
    """
    s = _col(seq)
    n = F.length(s) - k - offset + 1
    pieces = F.transform(F.sequence(F.lit(1 + offset), F.length(s) - k + 1, F.lit(PIECE)), lambda i: F.substr(s, i, F.lit(PIECE + k - 1)))
    every = F.flatten(F.transform(pieces, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - k + 1), lambda i: F.substr(p, i, F.lit(k)))))
    return F.when(n >= 1, every).otherwise(F.array().cast("array<string>"))


def word_code(word: Column, k: int) -> Column:
    """Base-4 number of a short word over ACGT."""
    code = F.lit(0)
    for p in range(k):
        code = code * 4 + F.instr(F.lit(BASES), F.substr(word, F.lit(p + 1), F.lit(1))) - 1
    return code


def flanked(seq: str | Column, left: str, right: str, width: int) -> Column:
    """The last ``width`` bases of the left flank, the word, the first ``width`` bases of the right one."""
    return F.concat(F.lit(left[len(left) - width :]), _col(seq), F.lit(right[:width]))


def log2(x: str | Column) -> Column:
    return F.log2(_col(x))


def log10_bin(x: str | Column, low: float, width: float) -> Column:
    """Number of the bin of log10(x), from 1; null where x has no logarithm."""
    return F.when(_col(x) > 0, F.floor((F.log10(_col(x)) - low) / width) + 1).cast("bigint")


def count_of(seq: str | Column, letter: str) -> Column:
    s = _col(seq)
    return F.length(s) - F.length(F.replace(s, F.lit(letter), F.lit("")))


def floats(values: Sequence[float]) -> Column:
    """A literal array of doubles."""
    return F.expr("array(" + ", ".join(f"{float(v)!r}D" for v in values) + ")")


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def array_sum(a: str | Column) -> Column:
    return F.aggregate(_col(a), F.lit(0.0), lambda s, x: s + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def mean(a: str | Column) -> Column:
    return F.try_divide(array_sum(a), F.size(_col(a)))


def variance(a: str | Column) -> Column:
    """Sample variance; null for fewer than two values."""
    m = mean(a)
    squares = F.aggregate(_col(a), F.lit(0.0), lambda s, x: s + (x - m) * (x - m))
    return F.try_divide(squares, F.size(_col(a)) - 1)


def max_index(a: str | Column) -> Column:
    """Index, from 0, of the first largest value."""
    return (F.array_position(_col(a), F.array_max(_col(a))) - 1).cast("int")


def max_normalised(a: str | Column) -> Column:
    """Values divided by the largest."""
    top = F.array_max(_col(a))
    return F.transform(_col(a), lambda x: F.try_divide(x, top))


def cyclic_shift(a: str | Column, by: int) -> Column:
    """The array moved ``by`` places to the left, what falls off joining the end."""
    return F.concat(F.slice(_col(a), by + 1, F.size(_col(a)) - by), F.slice(_col(a), 1, by))


def reverse_blocks(a: str | Column, block: int) -> Column:
    """Blocks of ``block`` values in reverse order, each block as it was."""
    n = F.floor(F.size(_col(a)) / block).cast("int")
    return F.flatten(F.transform(F.sequence(n - 1, F.lit(0)), lambda i: F.slice(_col(a), i * block + 1, block)))


def reversed_mono(betas: Sequence[float]) -> list[float]:
    """Weights by (position, base) that score a window's reverse complement from the window itself."""
    return list(reversed(betas))


def reversed_di(betas: Sequence[float]) -> list[float]:
    """The same for weights by (position, pair of bases)."""
    k = len(betas) // 16
    return [betas[(k - 1 - p) * 16 + (3 - second) * 4 + (3 - first)] for p in range(k) for first in range(4) for second in range(4)]
