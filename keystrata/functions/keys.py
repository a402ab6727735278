"""Keys: hexadecimal text of a signed 112-bit integer, 0 <= key < 2**111."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits of the low half; both halves fit conv()'s 64 bits and decimal(18,0).
HALF = 14
SCALE = 16**HALF


def canonical(key: Column) -> Column:
    """Upper case, without leading zeros."""
    return F.regexp_replace(F.upper(key), r"^0+(.)", "$1")


def in_domain(key: Column) -> Column:
    """Whether the text is a key: hex digits only, below 2**111. Null: false."""
    k = canonical(key)
    return F.coalesce(key.rlike(r"\A[0-9A-Fa-f]+\z") & ((F.length(k) < 28) | ((F.length(k) == 28) & (F.substring(k, 1, 1) < "8"))), F.lit(False))


def to_number(key: Column) -> Column:
    """The key as decimal(37,0); null outside the domain."""
    padded = F.lpad(canonical(key), 2 * HALF, "0")
    half = lambda start: F.conv(F.substring(padded, start, HALF), 16, 10).cast("decimal(18,0)")
    return F.when(in_domain(key), (half(1) * F.lit(SCALE).cast("decimal(17,0)") + half(HALF + 1)).cast("decimal(37,0)"))


def from_number(number: Column) -> Column:
    """Canonical text of a non-negative decimal(37,0) below 2**111."""
    scale = F.lit(SCALE).cast("decimal(18,0)")
    low = (number % scale).cast("decimal(18,0)")
    high = ((number - low) / scale).cast("decimal(18,0)")
    text = lambda half: F.lpad(F.hex(half.cast("long")), HALF, "0")
    return canonical(F.concat(text(high), text(low)))


def of_long(number: Column) -> Column:
    """Canonical key of a non-negative bigint."""
    return F.hex(number.cast("long"))


def generated(seq: Column, salt: int = 0) -> Column:
    """A key for a save without one. The row's number is part of it, so keys of
    distinct rows are distinct; a digest of it and the salt spreads their order.
    27 digits: always in the domain."""
    spread = F.substring(F.sha2(F.concat_ws(":", F.lit(str(salt)), seq.cast("string")), 256), 1, 10)
    return F.upper(F.concat(F.lit("1"), spread, F.lpad(F.lower(F.hex(seq.cast("long"))), 16, "0")))


def starts_with(prefix: Column, text: Column) -> Column:
    """Prefix test under which the empty prefix starts nothing."""
    return (F.length(prefix) > 0) & text.startswith(prefix)
