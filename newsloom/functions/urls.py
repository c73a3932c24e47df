"""URL functions: three canonical forms with their own rules, redaction, hosts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .freeform import let
from .unicode import unescaped

# Query keys that only track.
TRACKING = ("fbclid", "gclid", "mc_cid", "mc_eid", "ref", "ref_src", "spm")
IDENTITY_TRACKING = ("campaign", "fbclid", "gclid", "mc_cid", "mc_eid", "ref", "ref_src", "source", "spm", "src")
SECRET_KEYS = "(?i)(token|secret|password|api[_-]?key|cookie|auth)"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def host(url: Column) -> Column:
    """Lower-cased, without userinfo and port; null where there is none."""
    name = F.lower(F.regexp_replace(F.regexp_replace(netloc(url), r"^.*@", ""), r":[0-9]*$", ""))
    return F.when(name != "", name)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def is_public(url: Column) -> Column:
    """http or https with a host part."""
    return url.rlike("^(?i)https?://[^/?#]+")


def public_or_null(url: Column) -> Column:
    return F.when(is_public(url), url)


def _pairs(q: Column) -> Column:
    """The query's non-empty parts, each with its = sign."""
    return F.transform(F.filter(F.split(q, "&"), lambda x: x != ""), lambda x: F.when(F.contains(x, F.lit("=")), x).otherwise(F.concat(x, F.lit("="))))


def _decoded(part: Column) -> Column:
    """A query part's text: + as space, percent escapes decoded, broken ones left as they are."""
    return F.url_decode(F.regexp_replace(part, "%(?![0-9A-Fa-f]{2})", "%25"))


def _encoded(text: Column) -> Column:
    """Letters, digits and _.-~ stay, a space is +, all else is escaped."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _kept(q: Column, drop: tuple[str, ...]) -> Column:
    """(key, value) structs of a query, decoded, without tracking keys."""
    pairs = F.transform(_pairs(q), lambda x: F.struct(_decoded(F.substring_index(x, "=", 1)).alias("k"), _decoded(F.substring(x, F.instr(x, "=") + 1, F.length(x))).alias("v")))
    return F.filter(pairs, lambda p: ~(F.lower(p["k"]).startswith("utm_") | F.lower(p["k"]).isin(*drop)))


def _joined(pairs: Column) -> Column:
    return F.array_join(F.transform(pairs, lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")


def _netloc_without_default_port(url: Column) -> Column:
    n, s = F.lower(netloc(url)), scheme(url)
    return F.when(s == "http", F.regexp_replace(n, ":80$", "")).when(s == "https", F.regexp_replace(n, ":443$", "")).otherwise(n)


def _glue(s: Column, n: Column, p: Column, q: Column) -> Column:
    return F.concat(s, F.lit("://"), n, p, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")))


def envelope_url(url: Column) -> Column:
    """Form 1: entities decoded, tracking keys dropped, the others in order and encoded anew; no trailing slash, root path
    empty, no fragment."""

    def form(raw: Column) -> Column:
        out = _glue(scheme(raw), _netloc_without_default_port(raw), F.regexp_replace(path(raw), "/+$", ""), let(_kept(query(raw), TRACKING), _joined))
        return F.when(raw == "", None).when(is_public(raw), out).otherwise(raw)

    return let(F.trim(unescaped(url)), form)


def event_url(url: Column) -> Column:
    """Form 2, an event's identity: of form 1 more tracking keys dropped, the others sorted by key and value; root path /."""

    def form(raw: Column) -> Column:
        port = F.regexp_extract(netloc(raw), r":([0-9]+)$", 1)
        full = F.when(port != "", F.concat(host(raw), F.lit(":"), port)).otherwise(host(raw))
        root = let(F.regexp_replace(path(raw), "/+$", ""), lambda p: F.when(p == "", "/").otherwise(p))
        out = _glue(scheme(raw), full, root, let(F.array_sort(_kept(query(raw), IDENTITY_TRACKING)), _joined))
        bare = F.regexp_replace(F.lower(raw), "/+$", "")
        return F.when(is_public(raw), out).otherwise(F.when(bare != "", bare))

    return let(envelope_url(url), form)


def item_url(url: Column) -> Column:
    """Form 3, as stored: lower-cased host, default port, userinfo and fragment dropped, query kept as it is."""
    raw = F.trim(url)
    p = F.regexp_replace(path(raw), "/+$", "")
    port = F.regexp_extract(_netloc_without_default_port(raw), r":([0-9]+)$", 1)
    full = F.when(port != "", F.concat(host(raw), F.lit(":"), port)).otherwise(host(raw))
    # the query stands where a fragment would: after a #
    out = F.concat(scheme(raw), F.lit("://"), full, F.when(p == "", "/").otherwise(p), F.when(query(raw) != "", F.concat(F.lit("#"), query(raw))).otherwise(F.lit("")))
    return F.when(raw == "", None).when(raw.rlike("^https?://[^/?#]+"), out).otherwise(raw)


def redacted(url: Column, limit: int = 2000) -> Column:
    """Values of secret-looking query keys replaced, fragment dropped, cut at `limit`."""
    bare = F.regexp_extract(url, "^([^?#]*)", 1)
    pairs = F.transform(_pairs(query(url)), lambda x: F.when(F.substring_index(x, "=", 1).rlike(SECRET_KEYS), F.concat(F.substring_index(x, "=", 1), F.lit("=%5BREDACTED%5D"))).otherwise(x))
    q = F.array_join(pairs, "&")
    return F.when(url.isNull(), None).otherwise(F.substring(F.concat(bare, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit(""))), 1, limit))


def github_repo(url: Column) -> Column:
    """owner/repo in lower case of a repository's URL; null for others."""
    found = F.lower(F.regexp_extract(url, r"^(?i)https?://(?:www\.)?github\.com/([^/?#]+/[^/?#]+?)(?:\.git)?/?(?:[?#].*)?$", 1))
    return F.when(found != "", found)


def public_host_url(url: Column) -> Column:
    """The url where it is http(s) and its host isn't local: no localhost, no private, loopback, link-local, reserved or
    multicast IPv4 address, no IPv6 address of these kinds; else null."""
    name = F.regexp_replace(F.regexp_replace(F.lower(netloc(F.trim(url))), "^.*@", ""), r"(?<=\]|^[^:]*):[0-9]*$", "")
    parts = F.transform(F.split(name, "\\."), lambda x: x.try_cast("int"))
    a, b = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    ipv4 = name.rlike(r"^[0-9]+(\.[0-9]+){3}$")
    c = F.get(parts, F.lit(2))
    closed = a.isin(0, 10, 127) | (a >= 224) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 192) & (b == 0) & c.isin(0, 2)) | ((a == 198) & b.isin(18, 19)) | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113))
    closed6 = name.rlike(r"^\[(::1?|f[cd][0-9a-f]*:.*|fe[89ab][0-9a-f]*:.*|ff[0-9a-f]*:.*|::ffff:.*|2001:db8:.*)\]$")
    local = (name == "localhost") | name.endswith(".localhost") | name.endswith(".local") | (ipv4 & closed) | closed6
    return F.when(is_public(F.trim(url)) & (name != "") & ~F.coalesce(local, F.lit(False)), F.trim(url))


def repo_full_name(url: Column) -> Column:
    """owner/repo of a repository's URL in its own case; null for others."""
    found = F.regexp_extract(url, r"^(?i)https?://(?:www\.)?github\.com(?::[0-9]+)?/+([^/?#]+/+[^/?#]+)", 1)
    return F.when(found != "", F.regexp_replace(F.regexp_replace(found, "/+", "/"), r"\.git$", ""))
