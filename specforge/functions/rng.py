"""Counter-based randomness: a value is a pure function of seed, table, column, row, attempt and draw.

So retries, repartitioning and lost executors give the same data. The portable form can be written in other SQL
engines bit for bit; the fast form costs a third of it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*key, portable: bool = False) -> Column:
    """A double in [0, 1) for the key, whose parts are literals or Columns."""
    parts = [k if isinstance(k, Column) else F.lit(k) for k in key]
    if portable:
        text = F.concat_ws("|", *[p.cast("string") for p in parts])
        return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(4503599627370496.0)
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") * F.lit(2.0**-53)


def uniform_sql(*key: str) -> str:
    """DuckDB SQL of the portable form; key parts are SQL expressions."""
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(key)})), 1, 13))::UBIGINT::DOUBLE / 4503599627370496)"


def normal(u1: Column, u2: Column) -> Column:
    return F.sqrt(-2.0 * F.log(1.0 - u1)) * F.cos(u2 * 6.283185307179586)


def pick(cdf: list[float], u: Column) -> Column:
    """0-based index of the first cumulated weight that is not below u."""
    return F.least(F.size(F.filter(F.array(*[F.lit(float(c)) for c in cdf]), lambda c: c < u)), F.lit(len(cdf) - 1))
