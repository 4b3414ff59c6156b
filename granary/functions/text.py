"""Numbers and JSON as text, digit for digit as other tools write them."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(value: Column, digits: int) -> Column:
    """A number with so many decimals (1 to 3), rounded by its exact value, halves to even. Null stays null.

    The part behind the point is taken in units of 2**-52 and rounded in whole numbers; what is smaller still (a double
    below 1 may have it) decides halves. format_string rounds the shortest decimal form instead, and halves up.
    """
    size, unit, scale = F.abs(value.cast("double")), 1 << 52, 10**digits
    parts = (size - F.floor(size)) * unit
    tiny = (parts - F.floor(parts)) * scale
    units = F.floor(parts).cast("long") * scale + F.floor(tiny).cast("long")
    low, rest = F.shiftright(units, 52), units.bitwiseAND(F.lit(unit - 1))
    up = (rest > unit // 2) | ((rest == unit // 2) & ((low % 2 == 1) | (tiny > F.floor(tiny))))
    whole = F.floor(size) * scale + low + up.cast("long")
    return F.concat(F.when(value < 0, "-").otherwise(""), F.floor(whole / scale).cast("string"), F.lit("."), F.lpad((whole % scale).cast("string"), digits, "0"))


def json_text(value: Column, kind: str) -> Column:
    """A value of a type (string, boolean, double or whole number) in JSON that is plain ASCII.

    Doubles are written in their shortest form, with an exponent only outside a thousandth to ten million, where other
    tools may still write digits.
    """
    if kind != "string":
        return F.coalesce(value.cast("string"), F.lit("null"))
    named = F.create_map(*(F.lit(x) for pair in (('"', '\\"'), ("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")) for x in pair))

    def one(c: Column) -> Column:
        code = F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "(.{4})", r"\\u$1")
        return F.coalesce(F.try_element_at(named, c), F.when(c.between(" ", "~"), c).otherwise(code))

    chars = F.filter(F.split(value, ""), lambda c: c != "")
    return F.coalesce(F.concat(F.lit('"'), F.array_join(F.transform(chars, one), ""), F.lit('"')), F.lit("null"))


def vector_digest(vector: Column, width: int = 32) -> Column:
    """SHA-256 of a vector's entries as little-endian floats of `width` bits; of a null vector null."""

    @F.pandas_udf("string")
    def digest(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: None if v is None else hashlib.sha256(np.asarray(v, f"<f{width // 8}").tobytes()).hexdigest())

    return digest(vector)
