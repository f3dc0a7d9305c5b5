"""Threat-intelligence and geographic enrichment by equi-joins on distinct keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.network import ipv4_number, ipv6_hex, is_public, label_suffixes
from ..sources.indicators import Indicators

#: Bytes up to which a lookup side is broadcast; beyond it the join shuffles (and AQE may still choose).
BROADCAST_BYTES = 64 << 20


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df, marked for broadcast if its values take no more than limit bytes: the size is checked, not assumed.

    A side that fits is kept, so it is computed once; one that does not is let go.
    """
    kept = df.persist()
    size = [F.coalesce(F.length(F.col(f"`{c}`").cast("string")), F.lit(0)) + 8 for c in df.columns]
    total = kept.agg(F.coalesce(F.sum(sum(size[1:], size[0])), F.lit(0)).alias("n")).first().n
    if total <= limit:
        return F.broadcast(kept)
    kept.unpersist()
    return df


def hits(values: DataFrame, indicators: DataFrame, suffixes: bool) -> DataFrame:
    """The distinct v that equal an indicator or, with suffixes, end in one at a label boundary. One column, v.

    Both sides are distinct keys, so the strategy is left to adaptive execution, which sees their sizes.
    """
    keys = values.select("v").where("v is not null").distinct()
    found = keys.select("v", F.explode(label_suffixes(F.col("v"))).alias("k")) if suffixes else keys.select("v", F.lower("v").alias("k"))
    return found.join(indicators.select(F.col("indicator").alias("k")), "k", "left_semi").select("v").distinct()


def flag(df: DataFrame, column: str, indicators: DataFrame, suffixes: bool, out: str) -> DataFrame:
    """Adds a boolean that tells whether a column hits an indicator; null hits none. The event side is never exploded."""
    found = hits(df.select(F.col(f"`{column}`").alias("v")), indicators, suffixes).select(F.col("v").alias(f"_{out}"))
    return df.join(small(found), F.col(f"`{column}`") == F.col(f"_{out}"), "left").withColumn(out, F.col(f"_{out}").isNotNull()).drop(f"_{out}")


def threat_match(df: DataFrame, feeds: Indicators, ip_column: str | None = "dst_ip", domain_column: str | None = "dns_query", subdomains: bool = True) -> DataFrame:
    """Adds ti_match: the address is listed, or the domain (with subdomains: or a parent of it) is. Null never matches."""
    out, parts = df, []
    if ip_column and ip_column in df.columns:
        out, parts = flag(out, ip_column, feeds.ips(), False, "_ip_hit"), [*parts, "_ip_hit"]
    if domain_column and domain_column in df.columns:
        out, parts = flag(out, domain_column, feeds.domains(), subdomains, "_domain_hit"), [*parts, "_domain_hit"]
    any_hit: Column = F.lit(False)
    for p in parts:
        any_hit = any_hit | F.col(p)
    return out.withColumn("ti_match", any_hit).drop(*parts)


def threat_match_exact(df: DataFrame, feeds: Indicators, ip_column: str | None = "dst_ip", domain_column: str | None = "dns_query") -> DataFrame:
    """The exact-only variant."""
    return threat_match(df, feeds, ip_column, domain_column, subdomains=False)


#: A range is dealt to prefixes of its addresses (in hexadecimal digits): the longest of which it touches at most so many.
PREFIXES_MOST = 16


def hex_ends(ranges: DataFrame) -> tuple[Column, Column]:
    """First and last address as hexadecimal digits, of start_ip and end_ip or of a network in prefix notation."""
    if "network" not in ranges.columns:
        return hex_of(F.col("start_ip")), hex_of(F.col("end_ip"))
    part = F.split("network", "/")
    h, bits = hex_of(F.trim(part[0])), F.get(part, F.lit(1)).try_cast("int")
    digits = F.length(h)
    ok = h.isNotNull() & bits.between(0, digits * 4)
    whole, rest = F.floor(bits / 4).cast("int"), F.pmod(bits, F.lit(4))
    free = F.expr("shiftright(15, pmod(try_cast(get(split(network, '/'), 1) as int), 4))")
    digit = F.conv(F.substring(h, whole + 1, F.lit(1)), 16, 10).cast("int")
    edge = lambda value: F.when(rest > 0, F.lower(F.hex(value))).otherwise("")
    end = lambda value, fill: F.when(ok, F.rpad(F.concat(F.substring(h, F.lit(1), whole), edge(value)), digits, fill))
    return end(digit - digit.bitwiseAND(free), F.lit("0")), end(digit.bitwiseOR(free), F.lit("f"))


def range_table(ranges: DataFrame) -> DataFrame:
    """(start, end, key, country, asn, org) of ip_ranges (start_ip, end_ip or network; country, asn, org): ends as hexadecimal digits.

    Each range is dealt to the address prefixes that it touches, of the longest even number of digits that gives at most PREFIXES_MOST
    (of two digits otherwise), so a look-up is an equi-join and a key holds few ranges, however crowded a region is.
    """
    start, end = hex_ends(ranges)
    known = ranges.select(start.alias("start"), end.alias("end"), "country", "asn", "org").where("start is not null and end is not null and start <= end and length(start) = length(end)")

    def span(digits: int) -> Column:
        head, size = max(0, digits - 14), min(digits, 14)  # 14 digits fit a long; those before must agree
        low, high = (F.conv(F.substring(c, head + 1, size), 16, 10).cast("long") for c in ("start", "end"))
        fits = (F.length("start") >= digits) & (F.substring("start", 1, head) == F.substring("end", 1, head))
        fits = fits & ((high - low < PREFIXES_MOST) if digits > 2 else F.lit(True))
        return F.when(fits, F.struct(F.substring("start", 1, head).alias("head"), low.alias("low"), high.alias("high"), F.lit(size).alias("size")))

    spans = known.withColumn("p", F.element_at(F.filter(F.array(*[span(k) for k in range(2, 33, 2)]), lambda x: x.isNotNull()), -1))
    keys = F.transform(F.sequence("p.low", "p.high"), lambda n: F.concat(F.length("start"), F.lit(":"), F.col("p.head"), F.lower(F.lpad(F.hex(n), F.col("p.size"), F.lit("0")))))
    return spans.select("start", "end", "country", "asn", "org", F.explode(keys).alias("key"))


def hex_of(ip: Column) -> Column:
    """IPv4 as 8 and IPv6 as 32 hexadecimal digits, which sort as the addresses do."""
    return F.coalesce(F.lower(F.lpad(F.hex(ipv4_number(ip)), 8, "0")), ipv6_hex(ip))


def range_width(start: Column, end: Column) -> Column:
    """end - start of hexadecimal addresses as (high, low) 64-bit halves, exact, in the order of the widths."""
    half = lambda c, k: F.conv(F.substring(F.lpad(c, 32, "0"), 1 + 16 * k, 16), 16, 10).cast("decimal(20,0)")
    borrow = F.when(half(end, 1) < half(start, 1), 1).otherwise(0).cast("decimal(20,0)")
    return F.struct((half(end, 0) - half(start, 0) - borrow).alias("high"), (half(end, 1) - half(start, 1) + borrow * F.lit(str(1 << 64)).cast("decimal(20,0)")).alias("low"))


def lookup(values: DataFrame, ranges: DataFrame) -> DataFrame:
    """(v, country, asn, org) of distinct public addresses v; of ranges that hold one, the narrowest wins (then the lowest start)."""
    return lookup_in(values, small(range_table(ranges)))


def lookup_in(values: DataFrame, table: DataFrame) -> DataFrame:
    keys = values.select("v").where("v is not null").distinct().where(is_public(F.col("v"))).withColumn("h", hex_of(F.col("v")))
    every = F.transform(F.sequence(F.lit(2), F.length("h"), F.lit(2)), lambda n: F.concat(F.length("h"), F.lit(":"), F.substring("h", F.lit(1), n)))
    met = keys.select("v", "h", F.explode(every).alias("key")).join(table, "key").where("h >= start and h <= end")
    best = F.min_by(F.struct("country", "asn", "org"), F.struct(range_width(F.col("start"), F.col("end")).alias("w"), F.col("start")))
    return met.groupBy("v").agg(best.alias("b")).select("v", "b.country", "b.asn", "b.org")


def geo(df: DataFrame, ranges: DataFrame, ip_columns: tuple[str, ...] = ("src_ip", "dst_ip"), country: bool = True, asn: bool = True, strict: bool = False) -> DataFrame:
    """Adds {ip}_country, {ip}_asn and {ip}_asn_org for each address column that df has (strict: a missing one is an error).

    Each column looks up its distinct public addresses only, whatever the number of events; private and malformed ones get null.
    """
    out, table = df, small(range_table(ranges))
    for column in ip_columns:
        if column not in df.columns:
            if strict:
                raise ValueError(f"no column {column!r}")
            continue
        found = lookup_in(df.select(F.col(f"`{column}`").alias("v")), table)
        names = ([F.col("country").alias(f"{column}_country")] if country else []) + ([F.col("asn").alias(f"{column}_asn"), F.col("org").alias(f"{column}_asn_org")] if asn else [])
        out = out.join(found.select(F.col("v").alias("_v"), *names), F.col(f"`{column}`") == F.col("_v"), "left").drop("_v")
    return out


def map_lookup(df: DataFrame, column: str, table: dict[str, str], out: str) -> DataFrame:
    """Adds the value of a small literal dictionary; a key it lacks gives null."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv]) if table else F.create_map().cast("map<string,string>")
    return df.withColumn(out, F.try_element_at(pairs, F.col(f"`{column}`")))
