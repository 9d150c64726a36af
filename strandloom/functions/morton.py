"""Interleaved keys of node pairs: x on the even bits, y on the odd ones."""

from __future__ import annotations

from pyspark.sql import functions as F

# Masks of the usual bit-spreading steps.
_MASKS = [0x0000FFFF0000FFFF, 0x00FF00FF00FF00FF, 0x0F0F0F0F0F0F0F0F, 0x3333333333333333, 0x5555555555555555]
_SHIFTS = [16, 8, 4, 2, 1]


def _spread(x):
    for s, m in zip(_SHIFTS, _MASKS):
        x = x.bitwiseOR(F.shiftleft(x, s)).bitwiseAND(F.lit(m))
    return x


def _gather(x):
    x = x.bitwiseAND(F.lit(_MASKS[-1]))
    for s, m in zip(reversed(_SHIFTS), [*reversed(_MASKS[:-1]), 0x00000000FFFFFFFF]):
        x = x.bitwiseOR(F.shiftrightunsigned(x, s)).bitwiseAND(F.lit(m))
    return x


def pair_key(x, y):
    """The key of two ids below 2^31."""
    return _spread(x.cast("long")).bitwiseOR(F.shiftleft(_spread(y.cast("long")), 1))


def unpaired(key):
    """Struct (x, y) of a key."""
    return F.struct(_gather(key).alias("x"), _gather(F.shiftrightunsigned(key, 1)).alias("y"))
