"""Exact percentiles of whole columns by radix selection.

Each value has an integer key that keeps the order: the unscaled value of a decimal, the number
of a date or timestamp, and for a double its bits.  The wanted order statistics are found digit by digit: one
aggregate counts the values of every column by the first ``BITS`` bits in which they differ at
all; the running count tells which bucket holds each wanted position; the next aggregate counts by
the next bits of the values in these buckets alone, or by whole keys in a bucket of so few values
that they are no more than the digits would be.  It ends when every bucket is one key, mostly after
two passes, and after (bits of the range) / ``BITS`` at most.

No value is shuffled or sorted, only counts by digit, which every task adds up first: a value that
a third of all rows share is one row here.  Each pass reads the wanted columns once.  The driver
gets the counts, at most ``2 ** BITS + 1`` for each bucket, of which a wanted percentile has two at
most, whatever the data's size; these jobs run when the function is called.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits of a key that one pass counts by.
BITS = 12

_EXPONENTS = 1023
_NAN = 0x7FF8000000000000
_INFINITY = 0x7FF0000000000000


def _double_key(x: Column) -> Column:
    """The bits of a double as a long; negative values count downwards.  NaN is above all, as in Spark's order."""
    size = F.abs(x)
    # the logarithm may be off by one next to a power of two; powers of two are exact
    near = F.floor(F.log2(size)).cast("int")
    low = near - F.when(size < F.pow(F.lit(2.0), near), 1).otherwise(0)
    exponent = low + F.when(size >= F.pow(F.lit(2.0), low + 1), 1).otherwise(0)
    normal = ((exponent.cast("long") + _EXPONENTS) * F.lit(2**52)
              + ((size / F.pow(F.lit(2.0), exponent) - 1) * F.lit(2.0**52)).cast("long"))
    tiny = (size * F.lit(2.0**537) * F.lit(2.0**537)).cast("long")
    key = (F.when(size == 0, F.lit(0).cast("long")).when(size == float("inf"), F.lit(_INFINITY))
           .when(size < 2.0**-1022, tiny).otherwise(normal))
    return F.when(x.isNull(), F.lit(None)).when(F.isnan(x), F.lit(_NAN)).when(x < 0, -key).otherwise(key)


def order_key(column: Column, dtype: T.DataType) -> Column:
    """A long with the order of the column's values; null stays null."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return _double_key(column.cast("double"))
    if isinstance(dtype, T.DecimalType):
        if dtype.precision > 18:
            raise ValueError(f"decimals of up to 18 digits have a key; this one has {dtype.precision}")
        return (column.cast(f"decimal(38,{dtype.scale})") * F.lit(10**dtype.scale)).cast("long")
    if isinstance(dtype, T.DateType):
        return F.unix_date(column).cast("long")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(column.cast("timestamp"))
    return column.cast("long")


def key_value(key: int, dtype: T.DataType) -> float:
    """The value of a key as a double; days and microseconds for dates and timestamps."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return math.copysign(struct.unpack(">d", struct.pack(">q", abs(key)))[0], key)
    if isinstance(dtype, T.DecimalType):
        return key / 10**dtype.scale            # of integers, so rounded once
    return float(key)


@dataclass
class _Bucket:
    """Part of a column: its least and greatest possible key, its number of values, and the positions wanted in it."""
    column: str
    low: int
    high: int
    size: int
    wanted: list[int]


def _narrowed(df: DataFrame, keys: dict[str, Column], buckets: list[_Bucket], bits: int) -> list[_Bucket]:
    """The buckets within these that hold the wanted positions.  One pass."""
    # few values have few keys, so these can be counted as they are
    shifts = [0 if b.size <= 1 << bits else max(0, (b.high - b.low).bit_length() - bits) for b in buckets]
    cells = {}                          # one for each column, whose buckets are disjoint
    for at, (b, shift) in enumerate(zip(buckets, shifts)):
        inside = F.col(b.column).between(F.lit(b.low), F.lit(b.high))
        number, digit = cells.get(b.column, (F, F))
        cells[b.column] = number.when(inside, F.lit(at)), digit.when(inside, F.shiftright(F.col(b.column), shift))
    lean = df.select(*[keys[c].alias(c) for c in cells])
    structs = [F.struct(number.alias("_bucket"), digit.alias("_digit")) for number, digit in cells.values()]
    counts = (lean.select(F.inline(F.array(*structs))).where("_bucket is not null").groupBy("_bucket", "_digit")
              .agg(F.count(F.lit(1)).alias("_n")).toArrow())
    number, digit, n = (counts.column(c).to_numpy() for c in ("_bucket", "_digit", "_n"))
    out = []
    for at, (b, shift) in enumerate(zip(buckets, shifts)):
        mine = np.flatnonzero(number == at)
        mine = mine[np.argsort(digit[mine])]
        upto = np.cumsum(n[mine])
        for place in np.unique(np.searchsorted(upto, b.wanted, side="right")):
            first, before = int(digit[mine[place]]) << shift, int(upto[place] - n[mine[place]])
            out.append(_Bucket(b.column, max(b.low, first), min(b.high, first + (1 << shift) - 1), int(n[mine[place]]),
                               [p - before for p in b.wanted if before <= p < upto[place]]))
    return out


def order_statistics(df: DataFrame, wanted: dict[str, Sequence[int]], bounds: dict[str, tuple[int, int, int]], bits: int = BITS) -> dict[str, list[int]]:
    """For each column the keys at the wanted positions (from 0, distinct), ascending; ``bounds`` has each column's
    least and greatest key and number of values."""
    types = {f.name: f.dataType for f in df.schema.fields}
    keys = {c: order_key(F.col(c), types[c]) for c in wanted}
    buckets = [_Bucket(c, *bounds[c], sorted(p)) for c, p in wanted.items() if p]
    found: dict[str, list[int]] = {c: [] for c in wanted}
    while buckets:
        for b in buckets:
            if b.low == b.high:
                found[b.column] += [b.low] * len(b.wanted)
        buckets = [b for b in buckets if b.low < b.high]
        if buckets:
            buckets = _narrowed(df, keys, buckets, bits)
    return {c: sorted(k) for c, k in found.items()}


def column_percentiles(df: DataFrame, wanted: dict[str, Sequence[float]], bits: int = BITS) -> dict[str, list[float | None]]:
    """Exact percentiles of each column, interpolated as ``percentile`` does: position q·(n−1),
    result (hi−pos)·v[lo] + (pos−lo)·v[hi].  Nulls are left out; a column without a value gets nulls."""
    types = {f.name: f.dataType for f in df.schema.fields}
    columns = list(wanted)
    lean = df.select(*[order_key(F.col(c), types[c]).alias(f"_{i}") for i, c in enumerate(columns)])
    row = lean.agg(*[f(f"_{i}").alias(f"{n}{i}") for i in range(len(columns)) for n, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
    places, positions, bounds = {}, {}, {}
    for i, c in enumerate(columns):
        n = row[f"n{i}"]
        places[c] = [(n - 1) * float(q) for q in wanted[c]] if n else []
        positions[c] = sorted({k for p in places[c] for k in (math.floor(p), math.ceil(p))})
        bounds[c] = (row[f"lo{i}"], row[f"hi{i}"], n)
    keys = order_statistics(df, positions, bounds, bits)
    out: dict[str, list[float | None]] = {}
    for c in columns:
        value = dict(zip(positions[c], (key_value(k, types[c]) for k in keys[c])))
        out[c] = [_between(value, p) for p in places[c]] if places[c] else [None] * len(wanted[c])
    return out


def _between(value: dict[int, float], place: float) -> float:
    low, high = math.floor(place), math.ceil(place)
    if low == high or value[low] == value[high]:
        return value[low]
    return (high - place) * value[low] + (place - low) * value[high]


def day(number: float | None) -> date | None:
    """The date of a percentile of dates, rounded down."""
    return None if number is None else date.fromordinal(date(1970, 1, 1).toordinal() + math.floor(number))
