"""Internet addresses in columns: read to numbers, and found among reserved ranges by bisection.

IPv4 addresses are bigints, IPv6 ones 32 hexadecimal digits, which sort as their numbers do. The ranges, less their
exceptions, are merged into sorted intervals once; a search is a balanced tree of comparisons in the plan. IPv6 addresses
that map IPv4 ones lie in a reserved range, whatever they map. What doesn't parse is no address: null.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls
from .freeform import let

# Private, loopback, link-local and reserved networks, and the networks within them that are public.
CLOSED4 = ("0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4")
OPEN4 = ("192.0.0.9/32", "192.0.0.10/32")
PRIVATE6 = ("::1/128", "::/128", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16", "fc00::/7", "fe80::/10")
OPEN6 = ("2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28")
RESERVED6 = ("::/8", "100::/8", "200::/7", "400::/6", "800::/5", "1000::/4", "4000::/3", "6000::/3", "8000::/3", "a000::/3", "c000::/3", "e000::/4", "f000::/5", "f800::/6", "fe00::/9")
LOCAL = ("localhost", "localhost.localdomain")


def _intervals(networks: tuple[str, ...], holes: tuple[str, ...] = ()) -> list[tuple[int, int]]:
    """Sorted, disjoint (first, last) of the networks less the holes."""
    spans = sorted((int(n[0]), int(n[-1])) for n in map(ipaddress.ip_network, networks))
    merged: list[list[int]] = []
    for a, b in spans:
        if merged and a <= merged[-1][1] + 1:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    out = [(a, b) for a, b in merged]
    for hole in map(ipaddress.ip_network, holes):
        x, y = int(hole[0]), int(hole[-1])
        out = [s for a, b in out for s in ([(a, b)] if y < a or b < x else [(a, x - 1), (y + 1, b)]) if s[0] <= s[1]]
    return out


def _joined(*lists: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(s for spans in lists for s in spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _within(x: Column, spans: list, form) -> Column:
    """Whether x lies in one of the sorted spans: a tree of comparisons, as deep as the logarithm of their number."""
    if not spans:
        return F.lit(False)
    mid = len(spans) // 2
    a, b = spans[mid]
    return F.when(x < form(a), _within(x, spans[:mid], form)).when(x > form(b), _within(x, spans[mid + 1 :], form)).otherwise(F.lit(True))


_SPANS4 = _intervals(CLOSED4, OPEN4)
_SPANS6 = _joined(_intervals(PRIVATE6, OPEN6), _intervals(RESERVED6))


_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"


def ipv4(host: Column) -> Column:
    """Four decimal numbers up to 255, without leading zeros, as one number."""
    number = lambda h: F.aggregate(F.split(h, r"\."), F.lit(0).cast("bigint"), lambda acc, p: acc * 256 + p.cast("bigint"))
    return let(host, lambda h: F.when(h.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"), number(h)))


def ipv6(host: Column) -> Column:
    """Eight groups, of which :: may leave out one run or more, the last two also as IPv4, and a zone after %; as 32 digits."""
    group = lambda v: F.lpad(F.lower(F.hex(v)), 4, "0")

    def plain(bare: Column) -> Column:
        """A dotted end as two groups."""
        head = lambda tail: F.substring(bare, F.lit(1), F.length(bare) - F.length(tail))
        grouped = lambda tail, low: F.when(low.isNotNull(), F.concat(head(tail), group(F.floor(low / 65536)), F.lit(":"), group(low % 65536)))
        dotted = let(F.substring_index(bare, ":", -1), lambda tail: let(ipv4(tail), lambda low: grouped(tail, low)))
        return F.when(F.contains(bare, F.lit(".")), dotted).otherwise(bare)

    def groups(half: Column) -> Column:
        return F.when(half == "", F.array().cast("array<string>")).otherwise(F.split(half, ":", -1))

    def expand(halves: Column) -> Column:
        more = F.when(F.size(halves) > 1, groups(F.get(halves, F.lit(1)))).otherwise(F.array().cast("array<string>"))
        return let(F.struct(groups(F.get(halves, F.lit(0))).alias("a"), more.alias("b"), F.size(halves).alias("n")), joined)

    def joined(parts: Column) -> Column:
        a, b, n = parts["a"], parts["b"], F.size(parts["a"]) + F.size(parts["b"])
        right = lambda half: F.forall(half, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
        fine = F.when(parts["n"] == 2, n <= 7).otherwise((parts["n"] == 1) & (n == 8)) & right(a) & right(b)
        return F.when(fine, F.array_join(F.transform(F.concat(a, F.array_repeat(F.lit("0"), 8 - n), b), lambda g: F.lpad(g, 4, "0")), ""))

    read = lambda h: let(let(F.regexp_replace(F.lower(h), "%[^%]+$", ""), plain), lambda t: let(F.split(t, "::", -1), expand))
    return let(host, lambda h: F.when(F.contains(h, F.lit(":")), read(h)))


def closed(host: Column) -> Column:
    """Whether an address is private, loopback, link-local or reserved; null for hosts that are no addresses."""
    in4 = lambda v: _within(v, _SPANS4, lambda n: F.lit(n).cast("bigint"))
    in6 = lambda h: _within(h, _SPANS6, lambda n: F.lit(f"{n:032x}"))
    four = lambda h: let(ipv4(h), lambda v: F.when(v.isNotNull(), in4(v)))
    six = lambda h: let(ipv6(h), lambda x: F.when(x.isNotNull(), in6(x)))
    return let(host, lambda h: F.when(F.contains(h, F.lit(":")), six(h)).otherwise(four(h)))


def public_url(url: Column) -> Column:
    """The http(s) url with its scheme in lower case, a path and no fragment; null where its host is missing, local or a closed address.

    Each part is worked out once: a part written into several places of a plan is computed in each.
    """
    named = lambda after: F.lower(F.when(after.startswith("["), F.regexp_extract(after, r"^\[([^\]]*)\](?::[0-9]*)?$", 1)).otherwise(F.regexp_extract(after, r"^([^:\]]*)", 1)))
    is_open = lambda name: (name != "") & ~name.isin(*LOCAL) & ~F.coalesce(closed(name), F.lit(False))

    def whole(u: Column, site: Column) -> Column:
        path = let(urls.path(u), lambda p: F.when(p != "", p).otherwise(F.lit("/")))
        query = let(urls.query(u), lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")))
        return F.concat(urls.scheme(u), F.lit("://"), site, path, query)

    def checked(u: Column, site: Column) -> Column:
        name = let(F.regexp_replace(site, "^.*@", ""), named)
        return F.when(let(name, is_open), whole(u, site))

    return let(F.trim(url), lambda u: F.when(urls.scheme(u).isin("http", "https"), let(urls.netloc(u), lambda site: checked(u, site))))
