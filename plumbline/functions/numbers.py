"""Scalar number functions: rounding, quantising, units, folds, percentiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: SI prefixes by name, as powers of ten. Fixed values.
SI_PREFIXES = {"EXA": 18, "PETA": 15, "TERA": 12, "GIGA": 9, "MEGA": 6, "KILO": 3, "HECTO": 2, "DECA": 1, "DECI": -1, "CENTI": -2, "MILLI": -3, "MICRO": -6, "NANO": -9, "PICO": -12, "FEMTO": -15, "ATTO": -18}


def metric(value: Column, places: int = 6) -> Column:
    """Half-even rounding of a metric."""
    return F.bround(value, places)


def fixed(value: Column, places: int = 6) -> Column:
    """Quantise a double by its shortest decimal form, half to even, never -0."""
    return F.bround(value.cast("string").cast("decimal(38,18)"), places).cast(f"decimal(20,{places})")


def to_si(value: Column, prefix: Column, power: int) -> Column:
    """``value`` of a prefixed unit in SI units; null for a prefix that is unknown."""
    table = F.create_map(*[x for k, v in SI_PREFIXES.items() for x in (F.lit(k), F.lit(v))])
    factor = F.when(prefix.isNull(), F.lit(0)).otherwise(table[prefix])
    return value * F.pow(F.lit(10.0), factor * power)


def metres(value: Column, unit: Column) -> Column:
    """cm and mm by division, so that 30 cm are 0.3 m exactly; not finite: null."""
    out = F.when(unit == "cm", value / 100).when(unit == "mm", value / 1000).otherwise(value)
    return F.when(F.abs(out) < F.lit(float("inf")), out)


def fold_of(identifier: Column, folds: int = 5) -> Column:
    """The SHA-256 of an id as one number, modulo ``folds``; digit by digit, so exact."""
    digits = F.split(F.sha2(identifier.cast("binary"), 256), "")
    value = F.transform(F.filter(digits, lambda d: d != ""), lambda d: F.conv(d, 16, 10).cast("int"))
    return F.aggregate(value, F.lit(0), lambda a, d: (a * 16 + d) % folds)


def nearest_rank(value: Column, percent: float) -> Column:
    """An aggregate: the value at the nearest rank of a percentile."""
    ordered = F.sort_array(F.collect_list(value))
    at = F.greatest(F.lit(1), F.ceil(F.size(ordered) * F.lit(percent) / 100)).cast("int")
    return F.element_at(ordered, at)


def to_page(pixel: Column, size: Column) -> Column:
    """A pixel position as a share of the page, clipped to it, six places."""
    return F.bround(F.least(F.greatest(pixel / size, F.lit(0.0)), F.lit(1.0)), 6)


def to_pixel(share: Column, size: Column) -> Column:
    """The pixel of a share of the page."""
    return F.bround(share * size, 0).cast("int")
