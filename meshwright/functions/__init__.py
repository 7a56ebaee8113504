"""Column expressions shared by the vertex programs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reciprocal(x: Column) -> Column:
    """1 / x, and 0 where x is 0."""
    return F.when(x > 0, 1 / x).otherwise(0.0)


def damped(total: Column, damping: float = 0.85) -> Column:
    return F.lit(damping) * total + F.lit(1 - damping)


def new_bits(mask: Column, known: Column) -> Column:
    """Bits of ``mask`` that ``known`` lacks."""
    return mask.bitwiseAND(F.bitwise_not(known))


def bit_positions(mask: Column, width: int) -> Column:
    """Positions of the set bits, ascending."""
    return F.filter(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.call_function("getbit", mask, i) == 1)
