"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. ``lower`` takes the fast path of pure ASCII
    text; other text goes through ``translate``, which leaves e.g. an E acute."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def long_array(values) -> Column:
    """A constant array<bigint>, folded to one literal."""
    return F.from_json(F.lit("[" + ",".join(str(int(v)) for v in values) + "]"), "array<bigint>")
