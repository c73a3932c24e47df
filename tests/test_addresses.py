"""Address ranges: each one's ends and their neighbours, forms of IPv6, malformed ones, against the standard library."""

import ipaddress
import random

from pyspark.sql import functions as F

from newsloom.functions import addresses


def _closed(text):
    try:
        a = ipaddress.ip_address(text)
    except ValueError:
        return None
    return a.is_private or a.is_loopback or a.is_link_local or a.is_reserved


def _read(spark, hosts):
    df = spark.createDataFrame([(h,) for h in hosts], "h string").coalesce(2)
    return {r.h: r for r in df.select("h", addresses.closed(F.col("h")).alias("c"), addresses.ipv4(F.col("h")).alias("four"), addresses.ipv6(F.col("h")).alias("six")).collect()}


def test_every_range_and_its_neighbours(spark):
    hosts = set()
    for n in map(ipaddress.ip_network, (*addresses.CLOSED4, *addresses.OPEN4, "100.64.0.0/10", "224.0.0.0/4")):
        hosts |= {str(ipaddress.IPv4Address(v)) for e in (int(n[0]), int(n[-1])) for v in (e - 1, e, e + 1) if 0 <= v < 1 << 32}
    hosts |= {f"::ffff:{h}" for h in set(hosts)}
    for n in map(ipaddress.ip_network, (*addresses.PRIVATE6, *addresses.OPEN6, *addresses.RESERVED6, "ff00::/8", "2000::/3", "fec0::/10")):
        hosts |= {str(ipaddress.IPv6Address(v)) for e in (int(n[0]), int(n[-1])) for v in (e - 1, e, e + 1) if 0 <= v < 1 << 128}
    got = _read(spark, hosts)
    assert {h: got[h].c for h in hosts} == {h: _closed(h) for h in hosts} and len(hosts) > 150


def test_forms(spark):
    rng = random.Random(3)
    hosts = {"1.2.3.4", "01.2.3.4", "1.2.3", "1.2.3.256", "1.2.3.4.5", "1.2.3.4 ", "", "a.b", "::", "::1", "1::", ":", ":::", "1:::2", "::1::", ":1::", "1::2:", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1::3:4:5:6:7:8", "1:2:3:4::5:6:7:8", "12345::", "g::", "::1.2.3.4", "::ffff:10.0.0.1", "::FFFF:0A00:0001", "::ffff:1.2.3", "1.2.3.4::", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "fe80::1%eth0", "fe80::1%", "2001:DB8::A", "0:0:0:0:0:ffff:7f00:1"}
    for _ in range(300):
        v = rng.getrandbits(128) if rng.random() < 0.5 else rng.getrandbits(48)
        a = ipaddress.IPv6Address(v)
        hosts |= {a.compressed, a.exploded.upper()}
        hosts.add(str(ipaddress.IPv4Address(rng.getrandbits(32))))
    got = _read(spark, hosts)
    for h in hosts:
        try:
            a = ipaddress.ip_address(h)
        except ValueError:
            assert (got[h].four, got[h].six, got[h].c) == (None, None, None), h
            continue
        want = (int(a), None) if a.version == 4 else (None, f"{int(a):032x}")
        assert (got[h].four, got[h].six, got[h].c) == (*want, _closed(h)), h


def test_urls(spark):
    rows = {
        "HTTP://e.org": "http://e.org/", " https://e.org/a?b=1#c ": "https://e.org/a?b=1", "http://u:p@e.org:80/x": "http://u:p@e.org:80/x", "http://8.8.8.8/": "http://8.8.8.8/", "http://[2606:4700::1111]:443/x": "http://[2606:4700::1111]:443/x",
        "http://10.0.0.1/x": None, "http://u@192.168.1.9:8080/": None, "http://[::1]/": None, "http://[::ffff:127.0.0.1]:9/": None, "http://LOCALHOST/": None, "http://localhost.localdomain": None, "ftp://e.org/": None, "e.org": None, "http:///x": None, "": None, None: None,
    }
    df = spark.createDataFrame([(u,) for u in rows], "u string")
    assert {r.u: r.p for r in df.select("u", addresses.public_url(F.col("u")).alias("p")).collect()} == rows
