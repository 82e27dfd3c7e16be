"""Membership functions and spreads as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def gauss(x: Column, centre: Column, sigma: Column) -> Column:
    return F.exp(-F.pow(x - centre, 2) / (2 * F.pow(sigma, 2)))


def exponential(x: Column, centre: Column, sigma: Column) -> Column:
    return F.exp(-F.abs(x - centre) / sigma)


def sigmoid(x: Column, centre: Column, sigma: Column) -> Column:
    return 1 / (1 + F.exp(-(x - centre) / sigma))


def triangle(x: Column, centre: Column, sigma: Column) -> Column:
    """1 at the centre, down to 0 one spread away."""
    return F.greatest(F.lit(0.0), 1 - F.abs(x - centre) / sigma)


def trapezoid(x: Column, centre: Column, sigma: Column) -> Column:
    """1 within one spread of the centre, 0 from two spreads on."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 - F.abs(x - centre) / sigma))


def spread(centres: Column) -> Column:
    """Largest gap between centres over 2*sqrt(2 ln 2), times ten until it is 1 or more; null where all are equal."""
    raw = (F.array_max(centres) - F.array_min(centres)) / (2 * math.sqrt(2 * math.log(2)))
    tens = F.greatest(F.lit(0.0), F.ceil(-F.log10(raw)).cast("double"))
    return F.when(raw > 0, raw * F.pow(F.lit(10.0), tens))


def nearest(x: Column, centres: Column) -> Column:
    """1-based number of the nearest centre, the first of equal ones."""
    d = F.transform(centres, lambda c: F.abs(x - c))
    return F.array_position(d, F.array_min(d)).cast("int")


#: Terms of a scale of k steps; fixed values of the rule language.
TERMS = {
    2: ("Low", "High"),
    3: ("Low", "Medium", "High"),
    4: ("Low", "Medium", "High", "Very High"),
    5: ("Very Low", "Low", "Medium", "High", "Very High"),
}


def term(bin_id: Column, k: int) -> Column:
    if k not in TERMS:
        raise ValueError(f"there are no terms for a scale of {k} steps")
    return F.get(F.array(*map(F.lit, TERMS[k])), bin_id.cast("int") - 1)


def term_of(bin_id: Column, terms: list[str]) -> Column:
    """The term of a bin by a list of its own; null beyond it."""
    return F.get(F.array(*map(F.lit, terms)), bin_id.cast("int") - 1)
