"""Scalar expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def within(c: Column, lo: Column, hi: Column) -> Column:
    """The value if it lies between two bounds, else null."""
    return F.when(c.between(lo, hi), c)


def standardise(c: Column, mean: Column, std: Column) -> Column:
    return (c - mean) / F.when(std > 1e-9, std).otherwise(F.lit(1.0))


def round_scaled(c: Column, digits: int) -> Column:
    """Rounded as SQL engines do it, which scale, round and scale back: 0.285 times 100 is 28.499999999999996, so it gives 0.28."""
    scale = float(10**digits)
    return F.round(c * scale, 0) / scale


def fourier(c: Column, frequency: float) -> tuple[Column, Column]:
    """Sine and cosine of a coordinate."""
    a = c * (2.0 * math.pi * frequency)
    return F.sin(a), F.cos(a)


def soft_utility(rmse: Column, tau: float) -> Column:
    return F.exp(-rmse / tau)


def damp(value: Column, since: Column, tau: float, alpha: float) -> Column:
    """A drift that is pulled toward 0 with distance."""
    return value * (1.0 - alpha * (1.0 - F.exp(-since / tau)))


def row_id(well: Column, row: Column) -> Column:
    return F.concat_ws("_", well.cast("string"), row.cast("string"))


def row_of(row_id: Column) -> Column:
    return F.substring_index(row_id, "_", -1).cast("long")


def well_of(row_id: Column) -> Column:
    return F.regexp_extract(row_id, "^(.*)_[0-9]+$", 1)


def variant_part(name: Column, part: str) -> Column:
    """The number after a keyword in a variant's name such as pf_scale_5_beam_0.2_hold_0.1; null without it."""
    found = F.regexp_extract(name, rf"(?:^|_){part}_([0-9]+(?:\.[0-9]+)?)", 1)
    return F.when(found != "", found.cast("double"))


def hash_unit(*parts: Column | str) -> Column:
    """A number in (0, 1) from the values of columns, the same in any engine: the first 52 bits of an MD5 digest."""
    text = F.concat_ws(":", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(2**52)


def hash_unit_sql(*parts: str) -> str:
    """``hash_unit`` in SQL."""
    return f"((CAST(CAST('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0)"
