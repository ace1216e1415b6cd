"""Scalar functions that Spark lacks or names otherwise, as Column expressions without UDFs."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from ..model import floor_div, to_timestamp


def gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor by Euclid's steps; 92 of them reduce any pair of 64-bit numbers."""
    pair = F.struct(F.abs(a).cast("long").alias("x"), F.abs(b).cast("long").alias("y"))
    step = lambda p, _: F.when(p["y"] == 0, p).otherwise(F.struct(p["y"].alias("x"), F.try_mod(p["x"], p["y"]).alias("y")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), pair, step)["x"]


def lcm(a: Column, b: Column) -> Column:
    g = gcd(a, b)
    return F.when((a == 0) | (b == 0), F.lit(0).cast("long")).otherwise(F.abs(F.call_function("div", a, g) * b))


def truncated(x: Column, digits: int = 0) -> Column:
    """The number without the decimals after ``digits``, towards zero."""
    scale = F.lit(float(10**digits))
    return F.signum(x) * F.floor(F.abs(x) * scale) / scale


def date_bin(width_us: int, t: Column, origin_us: int = 0) -> Column:
    """The start of the interval of ``width_us`` microseconds, counted from the origin, that holds the time."""
    us = F.unix_micros(t.cast("timestamp")) - origin_us
    return F.timestamp_micros(floor_div(us, width_us) * width_us + origin_us)


def day_of_week(t: Column) -> Column:
    """Sunday is 0."""
    return F.dayofweek(t) - 1


def from_nanos(ns: Column) -> Column:
    return to_timestamp(ns)


def array_positions(a: Column, v: Column) -> Column:
    """All places of a value, from 1."""
    return F.filter(F.transform(a, lambda x, i: F.when(x.eqNullSafe(v), i + 1)), lambda p: p.isNotNull())


def array_remove_first(a: Column, v: Column) -> Column:
    at = F.array_position(a, v).cast("int")
    return F.when(at == 0, a).otherwise(F.filter(a, lambda _, i: i + 1 != at))


def array_resize(a: Column, n: int, fill: Column) -> Column:
    return F.slice(F.concat(a, F.array_repeat(fill, n)), 1, n)


def array_slice(a: Column, start: int, end: int) -> Column:
    """Elements start to end, both from 1 and inclusive."""
    return F.slice(a, start, max(0, end - start + 1))


def string_to_array(s: Column, separator: str) -> Column:
    return F.split(s, re.escape(separator))


def concat_nulls(*parts: Column) -> Column:
    """Concatenation in which null is empty."""
    return F.concat_ws("", *parts)


def to_hex(n: Column) -> Column:
    return F.lower(F.hex(n))


def digest(s: Column, algorithm: str) -> Column:
    """fixed values: the names md5, sha224, sha256, sha384 and sha512."""
    return F.md5(s) if algorithm == "md5" else F.sha2(s, int(algorithm.removeprefix("sha")))
