"""SimHash: term hashes vote on 64 signed bits. DataFrame functions only.

Votes are counted two bits to a sum: bit ``i`` in the low half of a long and bit ``i + 32``
in the high half. All terms of a text are in one task, so the partial sums before the
shuffle are already whole and the shuffle moves one row per text, never its terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_RE, ascii_lower, strip_spaces

_LANES = 0x0000000100000001
_LOW = 0xFFFFFFFF


def words(text: Column) -> Column:
    """Lower-cased (A-Z) words of a text; a text without words gives one empty word."""
    return F.split(strip_spaces(ascii_lower(text)), SPACE_RE)


def vote(terms: DataFrame, keys: list[str], h: str, weight: str | None = None) -> DataFrame:
    """``keys`` and ``fp`` (long): bit i is 1 if terms of more than half the weight have it set.

    The weights of one key must stay below 2**32 in sum.
    """
    unit = F.lit(_LANES)
    lane = lambda i: F.shiftrightunsigned(F.col(h), i).bitwiseAND(unit)
    w = F.lit(1).cast("long") if weight is None else F.col(weight)
    one = (lambda i: lane(i)) if weight is None else (lambda i: lane(i) * w)
    sums = terms.groupBy(*keys).agg(F.sum(w).alias("_w"), *[F.sum(one(i)).alias(f"_{i}") for i in range(32)])

    def bit(i: int) -> Column:
        count = F.col(f"_{i}").bitwiseAND(F.lit(_LOW)) if i < 32 else F.shiftrightunsigned(F.col(f"_{i - 32}"), 32)
        value = 1 << i if i < 63 else -(1 << 63)
        return F.when(count * 2 > F.col("_w"), F.lit(value)).otherwise(F.lit(0)).cast("long")

    bits = [bit(i) for i in range(64)]
    while len(bits) > 1:
        bits = [a.bitwiseOR(b) for a, b in zip(bits[::2], bits[1::2])]
    return sums.select(*keys, bits[0].alias("fp"))


def hex16(fp: Column) -> Column:
    """16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal fingerprints, 0 for opposite ones."""
    return 1.0 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)
