"""IPv4 and IPv6 addresses as numbers, in column expressions: parsing, canonical text, and ranges.

An address is two longs, the upper and the lower half of its 128 bits; IPv4 lies at ::ffff:0:0/96.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Ranges by what they are for.
PRIVATE = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "169.254.0.0/16", "100.64.0.0/10", "fc00::/7", "fe80::/10")
LOOPBACK = ("127.0.0.0/8", "::1/128")
UNSPECIFIED = ("0.0.0.0/32", "::/128")

_V4 = r"^\d{1,3}(\.\d{1,3}){3}$"
#: An IPv4 address in the last place of an IPv6 one.
_TAIL = r"(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$"


def _let(value: Column, f) -> Column:
    return F.element_at(F.transform(F.array(value), f), 1)


def _v4_long(ip: Column) -> Column:
    """32 bits; null for what is no IPv4 address (parts over 255, leading zeros)."""

    def joined(parts: Column) -> Column:
        ok = F.forall(parts, lambda p: (p.cast("int") <= 255) & (p.cast("int").cast("string") == p))
        return F.when(ok, F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a * 256 + p.cast("long")))

    return F.when(ip.rlike(_V4), _let(F.split(ip, r"\."), joined))


def ipv6_groups(ip: Column) -> Column:
    """The eight 16-bit numbers of an IPv6 address; null for what is none. ``::`` stands for one group or more."""
    tail = _v4_long(F.regexp_extract(ip, _TAIL, 0))
    as_hex = lambda n: F.lower(F.hex(n))
    plain = F.when(~ip.contains("."), F.lower(ip)).when(
        tail.isNotNull(), F.concat(F.lower(F.regexp_replace(ip, _TAIL, "")), as_hex(F.shiftright(tail, 16)), F.lit(":"), as_hex(tail.bitwiseAND(F.lit(0xFFFF))))
    )
    parse = lambda s: F.when(s == "", F.array().cast("array<long>")).otherwise(F.transform(F.split(s, ":"), lambda g: F.conv(g, 16, 10).cast("long")))
    group = "[0-9a-f]{1,4}"
    side = f"(?:{group}(?::{group})*)?"

    def whole(s: Column) -> Column:
        left, right = parse(F.substring_index(s, "::", 1)), parse(F.substring_index(s, "::", -1))
        short = _let(F.struct(left.alias("a"), right.alias("b")), lambda x: F.when(
            F.size(x["a"]) + F.size(x["b"]) <= 7, F.concat(x["a"], F.array_repeat(F.lit(0).cast("long"), 8 - F.size(x["a"]) - F.size(x["b"])), x["b"])))
        return F.when(s.rlike(f"^{side}::{side}$"), short).when(s.rlike(f"^{group}(?::{group}){{7}}$"), parse(s))

    return _let(plain, whole)


def _halves(groups: Column) -> Column:
    half = lambda at: F.aggregate(F.slice(groups, at, 4), F.lit(0).cast("long"), lambda a, g: F.shiftleft(a, 16).bitwiseOR(g))
    return F.when(groups.isNotNull(), F.struct(half(1).alias("upper"), half(5).alias("lower")))


def address_number(ip: Column) -> Column:
    """(upper, lower) of an IPv4 or IPv6 address; null for what is neither."""
    v4 = _let(_v4_long(ip), lambda n: F.when(n.isNotNull(), F.struct(F.lit(0).cast("long").alias("upper"), n.bitwiseOR(F.lit(0xFFFF << 32)).alias("lower"))))
    return F.when(ip.contains(":"), _let(ipv6_groups(ip), _halves)).otherwise(v4)


def canonical_ipv6(ip: Column) -> Column:
    """Lower-case text without leading zeros, the first of the longest runs of zero groups (two or more) as ``::``; null for what is no address."""

    def text(groups: Column) -> Column:
        mapped = (F.aggregate(F.slice(groups, 1, 5), F.lit(0).cast("long"), lambda a, g: a + g) == 0) & (groups[5] == 0xFFFF)
        byte = lambda g, shift: F.shiftright(g, shift).bitwiseAND(F.lit(255)).cast("string")
        dotted = F.concat(F.lit("::ffff:"), F.concat_ws(".", byte(groups[6], 8), byte(groups[6], 0), byte(groups[7], 8), byte(groups[7], 0)))
        return F.when(mapped, dotted).otherwise(_let(F.array_join(F.transform(groups, lambda g: F.lower(F.hex(g))), ":"), _shortened))

    return _let(ipv6_groups(ip), lambda g: F.when(g.isNotNull(), text(g)))


def _shortened(joined: Column) -> Column:
    out = joined
    for n in range(2, 9):  # the longest run comes last, and so decides
        run = rf"^(|.*?:)0(?::0){{{n - 1}}}(|:.*)$"
        before, after = F.regexp_extract(joined, run, 1), F.regexp_extract(joined, run, 2)
        colon = lambda c: F.when(c == "", F.lit(":")).otherwise(c)
        out = F.when(joined.rlike(run), F.concat(colon(before), colon(after))).otherwise(out)
    return out


def _as_v6(cidr: str) -> tuple[int, int]:
    """(first address, prefix length) of a range, with IPv4 at its place among IPv6."""
    net = ipaddress.ip_network(cidr)
    first, length = int(net.network_address), net.prefixlen
    return (first, length) if net.version == 6 else (first | 0xFFFF << 32, length + 96)


def _signed(n: int) -> int:
    return n - (1 << 64) if n >= 1 << 63 else n


def _mask(length: int) -> tuple[int, int]:
    bits = ((1 << length) - 1) << (128 - length)
    return _signed(bits >> 64), _signed(bits & (1 << 64) - 1)


def in_ranges(number: Column, cidrs: Sequence[str]) -> Column:
    """Whether an address number lies in one of a few known ranges; null for null."""
    found = F.lit(False)
    for cidr in cidrs:
        (first, length), (upper, lower) = _as_v6(cidr), _mask(_as_v6(cidr)[1])
        same = (number["upper"].bitwiseAND(F.lit(upper)) == _signed(first >> 64)) & (number["lower"].bitwiseAND(F.lit(lower)) == _signed(first & (1 << 64) - 1))
        found = found | same
    return found


def match_ranges(rows: DataFrame, number: str, ranges: DataFrame) -> DataFrame:
    """``rows`` with the columns of the longest range of ``ranges`` (column cidr, others) that holds the address number; null ones if none does.

    Ranges are prefixes, so they are met by equality: an address is looked up under each prefix length that occurs, of which there are 129
    at most. Distinct addresses are looked up once. A text that is no range matches nothing.
    """
    address, length = F.substring_index("cidr", "/", 1), F.substring_index("cidr", "/", -1).try_cast("int")
    length = F.when(address.contains(":"), length).otherwise(length + 96)
    table = ranges.select("*", address_number(address).alias("first"), length.alias("bits")).where("first IS NOT NULL AND bits BETWEEN 0 AND 128")
    high = F.expr("CASE WHEN bits >= 64 THEN -1L WHEN bits = 0 THEN 0L ELSE shiftleft(-1L, 64 - bits) END")
    low = F.expr("CASE WHEN bits <= 64 THEN 0L ELSE shiftleft(-1L, 128 - bits) END")
    prefix = F.struct(F.col("first.upper").bitwiseAND(high).alias("upper"), F.col("first.lower").bitwiseAND(low).alias("lower"))
    table = table.where("bits >= 96 OR cidr LIKE '%:%'").select("bits", prefix.alias("prefix"), F.struct(*ranges.columns).alias("range"))
    lengths = sorted(r.bits for r in table.select("bits").distinct().collect())
    n = F.col("number")
    cut = [F.struct(F.lit(b).alias("bits"), F.struct(n["upper"].bitwiseAND(F.lit(_mask(b)[0])).alias("upper"), n["lower"].bitwiseAND(F.lit(_mask(b)[1])).alias("lower")).alias("prefix")) for b in lengths]
    cut = F.array(*cut) if cut else F.array().cast("array<struct<bits:int,prefix:struct<upper:bigint,lower:bigint>>>")
    numbers = rows.select(F.col(number).alias("number")).where("number IS NOT NULL").distinct()
    met = numbers.select("number", F.explode(cut).alias("c")).select("number", "c.bits", "c.prefix").join(table, ["bits", "prefix"])
    best = met.groupBy("number").agg(F.max_by("range", "bits").alias("range"))
    return rows.join(best, rows[number] == best["number"], "left").select(*[rows[c] for c in rows.columns], "range.*")
