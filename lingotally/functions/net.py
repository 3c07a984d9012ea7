"""IP addresses as native expressions: validity, numeric keys, private ranges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from lingotally.functions.binding import let

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"


def _net(text: str, bits: int) -> tuple[int, int]:
    a, b, c, d = (int(x) for x in text.split("."))
    low = (a << 24) + (b << 16) + (c << 8) + d
    return low, low + (1 << (32 - bits)) - 1


# ---- fixed values: IPv4 blocks that are not looked up (RFC 1918, 5737, 6598 and others) -------
PRIVATE_V4 = [
    _net("0.0.0.0", 32), _net("10.0.0.0", 8), _net("100.64.0.0", 10), _net("127.0.0.0", 8),
    _net("169.254.0.0", 16), _net("172.16.0.0", 12), _net("192.0.2.0", 24),
    _net("192.168.0.0", 16), _net("198.51.100.0", 24), _net("203.0.113.0", 24),
    _net("224.0.0.0", 4), _net("255.255.255.255", 32),
]


def is_ipv4(ip: Column) -> Column:
    return ip.rlike(IPV4)


def ipv4_to_int(ip: Column) -> Column:
    """Numeric value of a valid dotted quad, else null."""
    def number(parts: Column) -> Column:
        return reduce(lambda acc, i: acc * 256 + parts[i].cast("bigint"), range(1, 4),
                      parts[0].cast("bigint"))

    return F.when(is_ipv4(ip), let(F.split(ip, r"\."), number))


def int_to_ipv4(value: Column) -> Column:
    return F.concat_ws(
        ".",
        *[F.shiftright(value, s).bitwiseAND(F.lit(255).cast("bigint")).cast("string")
          for s in (24, 16, 8, 0)],
    )


_NO_GROUPS = "array<string>"


def _groups(part: Column) -> Column:
    return F.when(part == "", F.array().cast(_NO_GROUPS)).otherwise(F.split(part, ":"))


def _without_quad(ip: Column) -> Column:
    """Lower-cased address with an embedded dotted quad written as two groups."""
    def rewrite(quad: Column) -> Column:
        tail = F.lpad(F.hex(ipv4_to_int(quad)), 8, "0")
        return F.concat(
            F.regexp_replace(ip, r"[0-9.]+$", ""),
            F.substring(tail, 1, 4), F.lit(":"), F.substring(tail, 5, 4),
        )

    quad = F.regexp_extract(ip, r"(?<=:)([0-9]+\.[0-9.]+)$", 1)
    return F.lower(F.when(ip.contains("."), let(quad, rewrite)).otherwise(ip))


def ipv6_to_hex(ip: Column) -> Column:
    """32 hex digits of a valid IPv6 address, else null; ``::`` is filled with zero groups."""
    def assemble(halves: Column) -> Column:
        squeezed = F.size(halves) == 2
        sides = F.struct(
            _groups(halves[0]).alias("l"),
            F.when(squeezed, _groups(F.get(halves, F.lit(1)))).otherwise(
                F.array().cast(_NO_GROUPS)).alias("r"),
        )

        def join(s: Column) -> Column:
            n = F.size(s["l"]) + F.size(s["r"])
            fill = F.array_repeat(F.lit("0"), F.when(squeezed, 8 - n).otherwise(0))
            legal = (F.size(halves) <= 2) & F.when(squeezed, n <= 7).otherwise(n == 8)
            return F.when(legal, F.concat(s["l"], fill, s["r"]))

        return let(sides, join)

    def digits(groups: Column) -> Column:
        legal = F.forall(groups, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
        return F.when(
            legal, F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), "")
        )

    found = let(let(F.split(_without_quad(ip), "::"), assemble), digits)
    return F.when(ip.contains(":"), found)


def ip_valid(ip: Column) -> Column:
    return F.coalesce(
        F.when(ip.contains(":"), ipv6_to_hex(ip).isNotNull()).otherwise(is_ipv4(ip)), F.lit(False)
    )


def is_private_v4(value: Column) -> Column:
    return reduce(lambda a, b: a | b, [value.between(lo, hi) for lo, hi in PRIVATE_V4])


def is_private_v6(digits: Column) -> Column:
    """Loopback, unspecified, multicast, unique local (fc00::/7) or link local (fe80::/10)."""
    return digits.rlike("^(?:0{31}[01]|ff.*|f[cd].*|fe[89ab].*)$")


def is_private(ip: Column) -> Column:
    """False for malformed input."""
    v6 = F.when(ip.contains(":"), is_private_v6(ipv6_to_hex(ip)))
    return F.coalesce(v6, let(ipv4_to_int(ip), is_private_v4), F.lit(False))
