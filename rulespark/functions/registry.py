"""Scalar functions of the rule languages, as builders of Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def ip_number(ip: Column) -> Column:
    """A dotted IPv4 address as a number; null if it is none."""
    parts = F.split(ip, r"\.")
    valid = ip.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$")
    number = reduce(lambda a, b: a * 256 + b, [F.get(parts, F.lit(k)).try_cast("long") for k in range(4)])
    return F.when(valid, number)


def ip6_hex(ip: Column) -> Column:
    """An IPv6 address as 32 hexadecimal digits; null if it is none."""
    halves = F.split(F.lower(ip), "::")
    groups = lambda c: F.filter(F.split(c, ":"), lambda x: x != "")
    left, right = groups(F.get(halves, F.lit(0))), groups(F.coalesce(F.get(halves, F.lit(1)), F.lit("")))
    n = F.size(left) + F.size(right)
    middle = F.repeat(F.lit("0000"), F.greatest(F.lit(8) - n, F.lit(0)))
    text = lambda g: F.array_join(F.transform(g, lambda x: F.lpad(x, 4, "0")), "")
    valid = ip.rlike(r"^[0-9A-Fa-f:]{2,39}$") & ~ip.rlike(r"[0-9A-Fa-f]{5}|:::|^:[^:]|[^:]:$") & (F.size(halves) <= 2) & F.when(F.size(halves) == 2, n <= 7).otherwise(n == 8)
    return F.when(valid, F.concat(text(left), middle, text(right)))


def in_cidr(ip: Column, cidr: str) -> Column:
    """Whether an address lies in a network; addresses of the other family, and texts that are none, give null."""
    import ipaddress

    net = ipaddress.ip_network(cidr, strict=False)
    low, high = int(net.network_address), int(net.broadcast_address)
    if net.version == 6:
        return ip6_hex(ip).between(f"{low:032x}", f"{high:032x}")
    return ip_number(ip).between(low, high)


def literal(c) -> str:
    """The Python value of a literal argument."""
    if isinstance(c, Column):
        raise ValueError("a constant is needed here")
    return c


def lift(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


#: name -> builder over arguments that are Columns or constants.
FUNCTIONS = {
    "re.regex": lambda s, p: lift(s).rlike(literal(p)),
    "re.capture": lambda s, p: F.regexp_extract(lift(s), literal(p), 1),
    "re.replace": lambda s, p, r: F.regexp_replace(lift(s), literal(p), literal(r)),
    "strings.concat": lambda *a: F.concat(*[lift(x).cast("string") for x in a]),
    "strings.to_lower": lambda s: F.lower(lift(s)),
    "strings.to_upper": lambda s: F.upper(lift(s)),
    "strings.length": lambda s: F.length(lift(s)),
    "strings.coalesce": lambda *a: F.coalesce(*map(lift, a)),
    "math.abs": lambda x: F.abs(lift(x)),
    "math.max": lambda *a: F.greatest(*map(lift, a)),
    "math.min": lambda *a: F.least(*map(lift, a)),
    "math.floor": lambda x: F.floor(lift(x)),
    "math.ceil": lambda x: F.ceil(lift(x)),
    "math.round": lambda x, n=0: F.round(lift(x), literal(n)),
    "net.ip_in_range": lambda ip, cidr: in_cidr(lift(ip), literal(cidr)),
    "net.ip_in_range_cidr": lambda ip, cidr: in_cidr(lift(ip), literal(cidr)),
    "arrays.length": lambda a: F.size(lift(a)),
    "arrays.contains": lambda a, x: F.array_contains(lift(a), x),
    "arrays.concat": lambda *a: F.concat(*map(lift, a)),
    "timestamp.get_day_of_week": lambda t, zone="UTC": F.dayofweek(F.from_utc_timestamp(lift(t).cast("timestamp"), literal(zone))),
    "timestamp.get_hour": lambda t, zone="UTC": F.hour(F.from_utc_timestamp(lift(t).cast("timestamp"), literal(zone))),
    "timestamp.as_unix_seconds": lambda t: F.unix_seconds(lift(t).cast("timestamp")),
}


def register(name: str, builder) -> None:
    """Add or replace a function; a builder takes Columns or constants and gives a Column."""
    FUNCTIONS[name] = builder
