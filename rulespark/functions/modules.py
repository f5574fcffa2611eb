"""Functions of the modules that conditions may call, over the bytes of a blob as a latin-1 string.

Byte statistics come from a histogram: numpy over Arrow batches, or in loops a deletion for each distinct byte.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TWO64, TWO63 = 1 << 64, 1 << 63


def let(value: Column, body) -> Column:
    """Evaluate a value once for use in a body."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def wrap(wide: Column) -> Column:
    """A decimal as a signed 64-bit integer that wraps around."""
    m = F.pmod(wide, F.lit(str(TWO64)).cast("decimal(38,0)"))
    return F.when(m >= F.lit(str(TWO63)).cast("decimal(38,0)"), m - F.lit(str(TWO64)).cast("decimal(38,0)")).otherwise(m).cast("long")


def _wide(c: Column) -> Column:
    return c.cast("long").cast("decimal(38,0)")


def add(a: Column, b: Column) -> Column:
    return wrap(_wide(a) + _wide(b))


def subtract(a: Column, b: Column) -> Column:
    return wrap(_wide(a) - _wide(b))


def multiply(a: Column, b: Column) -> Column:
    """a * b by the high and low halves of b, so that no product is wider than 38 digits."""
    a, b = a.cast("long"), b.cast("long")
    half = lambda c: c.cast("decimal(19,0)")
    low, high = half(b.bitwiseAND(F.lit((1 << 32) - 1))), F.shiftright(b, 32).cast("decimal(11,0)")
    upper = half(wrap((half(a) * high).cast("decimal(38,0)"))) * F.lit(1 << 32).cast("decimal(11,0)")
    return wrap(upper.cast("decimal(38,0)") + (half(a) * low.cast("decimal(11,0)")).cast("decimal(38,0)"))


def shift(a: Column, n: Column, left: bool) -> Column:
    """Counts of 64 and more give 0; negative ones are undefined."""
    name = "shiftleft" if left else "shiftright"
    return F.when(n >= 64, F.lit(0).cast("long")).when(n >= 0, F.call_function(name, a.cast("long"), F.least(n, F.lit(63)).cast("int")))


def histogram(s: Column) -> Column:
    """(b, n) of each byte that occurs, in order of first places; a scan for each distinct byte."""

    def of(s: Column) -> Column:
        distinct = F.array_distinct(F.filter(F.split(s, ""), lambda c: c != ""))
        return F.transform(distinct, lambda c: F.struct(F.ascii(c).alias("b"), (F.length(s) - F.length(F.replace(s, c, F.lit("")))).cast("long").alias("n")))

    return let(s, of)  # or the text would be decoded again for each byte


def codes(s: Column) -> Column:
    """The bytes of a latin-1 string as numbers."""
    return F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("double"))


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda a, x: a + x)


def total_of(h: Column) -> Column:
    return F.aggregate(h, F.lit(0).cast("long"), lambda a, x: a + x["n"])


def entropy_of(h: Column) -> Column:
    # log2(t) - sum(n log2 n) / t: the histogram stands in no lambda, where a Python function may not
    weighted = _sum(F.transform(h, lambda x: x["n"] * F.log2(x["n"])))
    return F.when(F.size(h) > 0, F.abs(F.log2(total_of(h)) - weighted / total_of(h)))


def mean_of(h: Column) -> Column:
    return F.when(F.size(h) > 0, _sum(F.transform(h, lambda x: x["n"] * x["b"].cast("double"))) / total_of(h))


def deviation_of(h: Column, around: Column) -> Column:
    return F.when(F.size(h) > 0, _sum(F.transform(h, lambda x: x["n"] * F.abs(x["b"].cast("double") - around))) / total_of(h))


def entropy(s: Column) -> Column:
    return let(histogram(s), entropy_of)


def mean(s: Column) -> Column:
    return let(histogram(s), mean_of)


def deviation(s: Column, around: Column) -> Column:
    return let(histogram(s), lambda h: deviation_of(h, around))


def mode_of(h: Column) -> Column:
    """The most frequent byte, the smallest of several."""
    return F.array_min(F.transform(h, lambda x: F.struct((-x["n"]).alias("n"), x["b"].cast("long").alias("b"))))["b"]


def mode(s: Column) -> Column:
    return mode_of(histogram(s))


def counted(s: Column) -> Column:
    """(b, n) of each byte that occurs, by numpy over Arrow batches: some ten times as fast as a scan for each byte.

    Not inside a lambda, where Spark takes no such function."""
    from pyspark.sql.functions import pandas_udf

    global _COUNTER
    if _COUNTER is None:

        @pandas_udf("array<struct<b:int,n:bigint>>")
        def counter(blobs: pd.Series) -> pd.Series:
            import numpy as np

            def one(blob):
                if blob is None:
                    return None
                counts = np.bincount(np.frombuffer(blob, np.uint8), minlength=256)
                return [{"b": int(b), "n": int(counts[b])} for b in np.flatnonzero(counts)]

            return blobs.map(one)

        _COUNTER = counter
    return _COUNTER(raw(s))


_COUNTER = None


def statistic(of, native):
    """A byte statistic from the histogram; inside a loop over variables the JVM's own."""

    def call(context, s: Column, *more: Column) -> Column:
        return native(s, *more) if context.env else of(counted(s), *more)

    return call


def count(s: Column, byte: Column) -> Column:
    return (F.length(s) - F.length(F.replace(s, F.char(byte), F.lit("")))).cast("long")


def checksum32_of(h: Column) -> Column:
    return F.pmod(_sum(F.transform(h, lambda x: x["n"] * x["b"].cast("double"))).cast("long"), F.lit(1 << 32))


def checksum32(s: Column) -> Column:
    return checksum32_of(histogram(s))


def serial_correlation(s: Column) -> Column:
    """Of each byte with the next, the last with the first."""

    def of(x: Column) -> Column:
        n = F.size(x)
        nexts = F.concat(F.slice(x, 2, F.greatest(n - 1, F.lit(0))), F.slice(x, 1, 1))
        products, total, squares = _sum(F.zip_with(x, nexts, lambda a, b: a * b)), _sum(x), _sum(F.transform(x, lambda a: a * a))
        below = n * squares - total * total
        return F.when(below == 0, -100000.0).otherwise((n * products - total * total) / F.nullif(below, F.lit(0.0)))

    return F.when(F.length(s) > 0, let(codes(s), of))


def monte_carlo_pi(s: Column) -> Column:
    """Relative distance of pi from its estimate by points of 6 bytes."""

    def of(x: Column) -> Column:
        n = F.floor(F.size(x) / 6).cast("int")
        at = lambda k, j: F.get(x, k * 6 + j)
        part = lambda k, j: at(k, j) * 65536.0 + at(k, j + 1) * 256.0 + at(k, j + 2)
        radius = (256.0**3 - 1) ** 2
        inside = F.size(F.filter(F.sequence(F.lit(0), n - 1), lambda k: part(k, 0) * part(k, 0) + part(k, 3) * part(k, 3) <= radius))
        pi = 3.141592653589793
        return F.when(n > 0, F.abs((inside * 4.0 / n - pi) / pi))

    return F.when(F.length(s) >= 6, let(codes(s), of))


def integer(data: Column, offset: Column, width: int, signed: bool, big: bool) -> Column:
    """An integer of so many bytes; null beyond the end."""
    raw = F.hex(F.substring(data, (offset + 1).cast("int"), F.lit(width)))
    pairs = [F.substring(raw, 2 * k + 1, 2) for k in range(width)]
    value = F.conv(F.concat(*(pairs if big else pairs[::-1])), 16, 10).cast("long")
    if signed:
        value = F.when(value >= 1 << (8 * width - 1), value - (1 << (8 * width))).otherwise(value)
    return F.when((offset >= 0) & (offset + width <= F.octet_length(data)), value)


def part(s: Column, offset: Column, size: Column) -> Column:
    """Bytes [offset, offset + size), or null if the offset is beyond the end."""
    return F.when((offset >= 0) & (offset <= F.length(s)) & (size >= 0), F.substring(s, (offset + 1).cast("int"), size.cast("int")))


def raw(s: Column) -> Column:
    return F.encode(s, "ISO-8859-1")


def on_bytes(f):
    """f(string) or f(offset, size) over the blob; more arguments come first of all."""

    def call(context, args, more=()):
        s = args[0][0] if len(args) == 1 else part(context.latin, args[0][0], args[1][0])
        return f(context, s, *more) if getattr(f, "__name__", "") == "call" else f(s, *more)

    return call


#: name -> (builder over (context, [(Column, kind)]), kind of the result)
MODULES = {
    "math.abs": (lambda c, a: F.abs(a[0][0]), "int"),
    "math.min": (lambda c, a: F.least(a[0][0], a[1][0]), "int"),
    "math.max": (lambda c, a: F.greatest(a[0][0], a[1][0]), "int"),
    "math.to_number": (lambda c, a: a[0][0].cast("long"), "int"),
    "math.to_string": (lambda c, a: F.lower(F.conv(a[0][0].cast("string"), 10, 10 if len(a) == 1 else a[1][2])), "string"),
    "math.in_range": (lambda c, a: a[0][0].between(a[1][0], a[2][0]).cast("long"), "int"),
    "math.entropy": (lambda c, a: on_bytes(statistic(entropy_of, entropy))(c, a), "float"),
    "math.mean": (lambda c, a: on_bytes(statistic(mean_of, mean))(c, a), "float"),
    "math.deviation": (lambda c, a: on_bytes(statistic(deviation_of, deviation))(c, a[:-1], (a[-1][0],)), "float"),
    "math.serial_correlation": (lambda c, a: on_bytes(serial_correlation)(c, a), "float"),
    "math.monte_carlo_pi": (lambda c, a: on_bytes(monte_carlo_pi)(c, a), "float"),
    "math.mode": (lambda c, a: on_bytes(statistic(mode_of, mode))(c, a) if a else statistic(mode_of, mode)(c, c.latin), "int"),
    "math.count": (lambda c, a: count(c.latin if len(a) == 1 else part(c.latin, a[1][0], a[2][0]), a[0][0]), "int"),
    "math.percentage": (lambda c, a: (lambda s: count(s, a[0][0]) / F.nullif(F.length(s), F.lit(0)))(c.latin if len(a) == 1 else part(c.latin, a[1][0], a[2][0])), "float"),
    "hash.md5": (lambda c, a: on_bytes(lambda s: F.md5(raw(s)))(c, a), "string"),
    "hash.sha1": (lambda c, a: on_bytes(lambda s: F.sha1(raw(s)))(c, a), "string"),
    "hash.sha256": (lambda c, a: on_bytes(lambda s: F.sha2(raw(s), 256))(c, a), "string"),
    "hash.crc32": (lambda c, a: on_bytes(lambda s: F.crc32(raw(s)))(c, a), "int"),
    "hash.checksum32": (lambda c, a: on_bytes(statistic(checksum32_of, checksum32))(c, a), "int"),
    "string.length": (lambda c, a: F.length(a[0][0]).cast("long"), "int"),
    "string.to_int": (lambda c, a: a[0][0].try_cast("long") if len(a) == 1 else F.conv(a[0][0], a[1][2], 10).try_cast("long"), "int"),
    "time.now": (lambda c, a: F.unix_seconds(F.current_timestamp()), "int"),
    "console.log": (lambda c, a: F.lit(1).cast("long"), "int"),
    "console.hex": (lambda c, a: F.lit(1).cast("long"), "int"),
}
CONSTANTS = {"math.MEAN_BYTES": 127.5}
for _width in (8, 16, 32):
    for _sign in ("uint", "int"):
        for _end in ("", "be"):
            MODULES[f"{_sign}{_width}{_end}"] = ((lambda w, s, b: lambda c, a: integer(c.data, a[0][0], w, s, b))(_width // 8, _sign == "int", _end == "be"), "int")
