"""Address and domain expressions. All are native; a null or malformed address gives null (or false in tests)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

IPV4 = r"^((25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])$"
IPV4_TAIL = r"(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(\.(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])){3}"

# Ranges that are not public, by the registries (network, prefix length).
PRIVATE4 = [("10.0.0.0", 8), ("172.16.0.0", 12), ("192.168.0.0", 16)]
SPECIAL4 = [
    *PRIVATE4, ("0.0.0.0", 8), ("127.0.0.0", 8), ("169.254.0.0", 16), ("192.0.0.0", 24), ("192.0.2.0", 24), ("198.18.0.0", 15),
    ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4),
]
#: First hexadecimal digits of IPv6 addresses that are not public: all outside 2000::/3, protocol assignments, documentation, 6to4.
SPECIAL6 = r"^([^23]|20010[01]|20010db8|2002|3fff0)"


def number4(address: str) -> int:
    a, b, c, d = map(int, address.split("."))
    return ((a * 256 + b) * 256 + c) * 256 + d


def is_ipv4(ip: Column) -> Column:
    return F.coalesce(ip.rlike(IPV4), F.lit(False))


def ipv4_number(ip: Column) -> Column:
    """The address as a long."""
    part = F.split(ip, r"\.")
    octets = [part[k].cast("long") for k in range(4)]
    return F.when(is_ipv4(ip), ((octets[0] * 256 + octets[1]) * 256 + octets[2]) * 256 + octets[3])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ipv6_hex(ip: Column) -> Column:
    """The address as 32 lower-case hexadecimal digits (IPv4 tails and one :: expanded); null if it is none."""

    def from_text(text: Column) -> Column:
        return F.when(text.contains(":"), let(F.regexp_extract(text, f":({IPV4_TAIL})$", 1), lambda tail: let(without_tail(text, tail), from_plain)))

    def without_tail(text: Column, tail: Column) -> Column:
        low = let(F.split(tail, r"\."), lambda t: F.array_join(F.transform(t, lambda x: F.lpad(F.hex(x.try_cast("long")), 2, "0")), ""))
        return F.lower(F.when(tail != "", let(low, lambda h: F.concat(F.substring(text, F.lit(1), F.length(text) - F.length(tail)), F.substring(h, 1, 4), F.lit(":"), F.substring(h, 5, 4)))).otherwise(text))

    def groups(half: Column) -> Column:
        return F.when(F.coalesce(half, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(half, ":"))

    def from_plain(plain: Column) -> Column:
        return let(F.split(plain, "::", -1), lambda h: let(F.struct(F.size(h).alias("n"), groups(F.get(h, F.lit(0))).alias("a"), groups(F.get(h, F.lit(1))).alias("b")), from_halves))

    def from_halves(x: Column) -> Column:
        gap = F.lit(8) - F.size(x["a"]) - F.size(x["b"])
        filled = F.when(x["n"] == 2, F.concat(x["a"], F.array_repeat(F.lit("0"), F.greatest(gap, F.lit(0))), x["b"])).otherwise(x["a"])
        sound = lambda g: (x["n"] <= 2) & (F.size(g) == 8) & ((x["n"] == 1) | (gap >= 1)) & F.forall(g, lambda y: y.rlike("^[0-9a-f]{1,4}$"))
        return let(filled, lambda g: F.when(sound(g), F.array_join(F.transform(g, lambda y: F.lpad(y, 4, "0")), "")))

    return let(ip, from_text)


def is_ip(ip: Column) -> Column:
    return is_ipv4(ip) | ipv6_hex(ip).isNotNull()


def in_ranges(ip: Column, ranges: list[tuple[str, int]]) -> Column:
    return let(ipv4_number(ip), lambda n: number_in(n, ranges))


def number_in(n: Column, ranges: list[tuple[str, int]]) -> Column:
    hit = F.lit(False)
    for network, bits in ranges:
        low = number4(network)
        hit = hit | n.between(low, low + (1 << (32 - bits)) - 1)
    return F.coalesce(hit, F.lit(False))


def is_internal(ip: Column) -> Column:
    """Whether an IPv4 address is in one of the three private ranges; null and malformed ones are not."""
    return in_ranges(ip, PRIVATE4)


def is_public(ip: Column) -> Column:
    """Whether an address, of either version, may be looked up: none of the special ranges. IPv4 mapped into IPv6 is judged as IPv4."""
    mapped = lambda h: ~number_in(F.conv(F.substring(h, 25, 8), 16, 10).cast("long"), SPECIAL4)
    six = let(ipv6_hex(ip), lambda h: F.when(h.isNull(), False).when(h.startswith("0" * 20 + "ffff"), mapped(h)).otherwise(~h.rlike(SPECIAL6)))
    return (is_ipv4(ip) & ~in_ranges(ip, SPECIAL4)) | six


def label_suffixes(domain: Column) -> Column:
    """All suffixes of a domain that begin at a label: itself, its parent and so on."""
    labels = F.split(F.lower(domain), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def url_host(url: Column) -> Column:
    return F.lower(F.parse_url(url, F.lit("HOST")))
