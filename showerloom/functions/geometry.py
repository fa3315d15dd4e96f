"""Column helpers for 3-vectors, axes, angles and bins.  A vector is a tuple of three columns."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def scaled(a: Vec, k: Column) -> Vec:
    return a[0] * k, a[1] * k, a[2] * k


def minus(a: Vec, b: Vec) -> Vec:
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def layer_of(cell_id: Column) -> Column:
    """Bits 19 to 27 of the readout id; a missing id is an error, as layers cannot be told apart without it."""
    return F.coalesce(F.shiftright(cell_id, 19).bitwiseAND(511), F.raise_error(F.lit("cell_id is missing")).cast("long"))


def bin_of(value: Column, width) -> Column:
    """Nearest multiple of width, halves upwards: floor(v / w + 1/2)."""
    return F.floor(value / width + F.lit(0.5)).cast("long")


def settled(value: Column) -> Column:
    """The nearest multiple of 1e-9, so that equal points compare equal however their sums were ordered."""
    return F.floor(value * 1e9 + 0.5) / 1e9


def wrapped(angle: Column) -> Column:
    """The angle in [-pi, pi)."""
    return F.pmod(angle + F.lit(pi), F.lit(2 * pi)) - F.lit(pi)

