"""Scalar functions over urls, with small tables of suffixes and address ranges as literals."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from pagetrail.functions.text import let, py_strip
from pagetrail.schema import GENERIC_ROUTING, GOV_SUFFIXES, PLATFORMS, ROUTING, USER_CONTROLLED, literal_map, literals, one_of

# Query keys that only track.
TRACKING = ("fbclid", "gclid", "gclsrc", "dclid", "msclkid", "mc_eid", "igshid", "ref", "ref_src")
# Schemes and hosts of the url policy.
REJECTED_SCHEMES = ("file", "ftp", "gopher", "data", "javascript", "blob", "ws", "wss", "mailto", "tel")
METADATA_HOSTS = ("169.254.169.254", "metadata.google.internal", "100.100.100.200", "fd00:ec2::254")

_URL = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
_PORT = r":([^:\]]*)$"


def _part(url: Column, k: int) -> Column:
    return F.regexp_extract(url, _URL, k)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def authority(url: Column) -> Column:
    """Host and port, without user-info."""
    return F.regexp_replace(_part(url, 2), r"^.*@", "")


def host(url: Column) -> Column:
    """Lower-cased, without port and brackets; '' if there is none."""
    return F.lower(let(authority(url), lambda a: F.when(a.startswith("["), F.regexp_extract(a, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_replace(a, r":[^:\]]*$", ""))))


def port(url: Column) -> Column:
    """The port's digits; '' without one."""
    return F.regexp_extract(authority(url), _PORT, 1)


def canonical_url(url: Column) -> Column:
    """Scheme and host lower-cased; user-info, default port, tracking keys, fragment and final slashes dropped; null for a bad port."""
    return let(let(py_strip(url), lambda u: F.struct(scheme(u).alias("kind"), host(u).alias("name"), port(u).alias("at"), _part(u, 3).alias("path"), _part(u, 4).alias("query"))), _canonical)


def _canonical(parts: Column) -> Column:
    kind, name, at, path = parts["kind"], parts["name"], parts["at"], parts["path"]
    number = F.try_to_number(F.nullif(at, F.lit("")), F.lit("99999"))
    bad = (at != "") & (~at.rlike(r"^[0-9]+$") | F.coalesce(number > 65535, F.lit(True)))
    shown = F.when((at == "") | (number == 0) | ((kind == "http") & (number == 80)) | ((kind == "https") & (number == 443)), name).otherwise(F.concat(name, F.lit(":"), number.cast("int").cast("string")))
    path = F.when(path.isin("", "/"), F.lit("/")).otherwise(F.regexp_replace(path, r"/+$", ""))
    key = lambda pair: F.lower(F.substring_index(pair, "=", 1))
    kept = F.filter(F.split(parts["query"], "&"), lambda p: (p != "") & ~one_of(key(p), TRACKING) & ~key(p).startswith("utm_"))
    query = F.when(parts["query"] == "", "").otherwise(let(F.array_join(kept, "&"), lambda q: F.when(q == "", "").otherwise(F.concat(F.lit("?"), q))))
    front = F.when(name != "", F.concat(F.when(kind == "", "").otherwise(F.concat(kind, F.lit(":"))), F.lit("//"), shown)).otherwise(F.when(kind == "", "").otherwise(F.concat(kind, F.lit(":"))))
    return F.when(bad, F.lit(None)).otherwise(F.concat(front, path, query))


#: A short list of public suffix rules, in the syntax of the public list: "*." stands for any one label, "!" excepts a name from such a rule.
SUFFIX_RULES = (
    "com", "org", "net", "edu", "gov", "mil", "int", "io", "co", "me", "info", "biz", "eu", "uk", "co.uk", "org.uk", "ac.uk", "gov.uk", "ltd.uk", "plc.uk", "me.uk",
    "de", "fr", "es", "it", "nl", "ch", "at", "be", "se", "au", "com.au", "org.au", "gov.au", "ca", "gc.ca", "us", "jp", "co.jp", "ne.jp", "social", "dev", "app",
    "*.kawasaki.jp", "!city.kawasaki.jp", "*.ck", "!www.ck", "*.bd", "br", "com.br", "in", "co.in", "nz", "co.nz", "za", "co.za", "tr", "com.tr", "github.io",
)
#: Rules that are taken as a literal: a list of this size is known to fit a plan.
MOST_RULES = 50_000


def read_suffix_rules(spark: SparkSession, path: str) -> tuple[str, ...]:
    """The rules of a file of the public list (a rule a line, what follows white space or "//" is a comment); over MOST_RULES an error."""
    rules = spark.read.text(path).select(F.lower(F.regexp_extract("value", r"^([^\s/][^\s]*)", 1)).alias("r")).where("r <> ''").distinct().limit(MOST_RULES + 1).collect()
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} suffix rules at {path}")
    return tuple(sorted(r[0] for r in rules))


def _is_rule(rules: Sequence[str]) -> Callable[[Column], Column]:
    """Whether a string is a rule: a hash table as one literal, whose buckets hold a few rules each."""
    n = max(1, len(rules) // 4)
    buckets: list[list[str]] = [[] for _ in range(n)]
    for r in rules:
        buckets[zlib.crc32(r.encode()) % n].append(r)
    literal = F.from_json(F.lit(json.dumps(buckets)), "array<array<string>>")  # folded into one constant
    return lambda s: F.array_contains(F.get(literal, (F.crc32(s.cast("binary")) % n).cast("int")), s)


def public_suffix_labels(name: Column, rules: Sequence[str] = SUFFIX_RULES) -> Column:
    """How many labels of a host are its public suffix: of the rules that fit the longest, an excepting one before all others; 0 if none fits."""
    return let(F.split(name, r"\."), lambda parts: _suffix_labels(parts, rules))


def _suffix_labels(parts: Column, rules: Sequence[str]) -> Column:
    fits = _is_rule(rules)
    size = F.size(parts)
    ends = F.transform(F.sequence(F.lit(1), size), lambda k: F.array_join(F.slice(parts, size - k + 1, k), "."))

    def of(ends: Column) -> Column:
        excepted = F.array_position(F.transform(ends, lambda e: fits(F.concat(F.lit("!"), e))), F.lit(True))
        # a wildcard takes one label more than what stands after it
        longest = F.array_max(F.transform(ends, lambda e, i: F.when(fits(e) | ((i > 0) & fits(F.concat(F.lit("*."), F.get(ends, i - 1)))), i + 1).otherwise(0)))
        return let(excepted, lambda x: F.when(x > 0, (x - 1).cast("int")).otherwise(longest))

    return let(ends, of)


def registrable(name: Column, rules: Sequence[str] = SUFFIX_RULES) -> Column:
    """The public suffix of a host and one label; the whole host if it has no known suffix or is one."""
    def of(name: Column, parts: Column) -> Column:
        size = F.size(parts)
        return let(_suffix_labels(parts, rules), lambda k: F.when((k > 0) & (k < size), F.array_join(F.slice(parts, size - k, k + 1), ".")).otherwise(name))

    return let(name, lambda n: let(F.split(n, r"\."), lambda parts: of(n, parts)))


def with_registrable_domain(df: DataFrame, url: str, rules: Sequence[str] = SUFFIX_RULES, out: str = "registrable_domain") -> DataFrame:
    """Adds the registrable domain of a url or host column, by an expression: no page meets another one of its host. Null or hostless gives ''."""
    name = F.regexp_replace(F.trim(F.lower(F.when(F.contains(F.col(url), F.lit("://")), host(py_strip(F.col(url)))).otherwise(F.col(url)))), r"^\[|\]$|\.+$", "")
    return df.withColumn(out, registrable(F.coalesce(name, F.lit("")), rules))


def is_gov(domain: Column) -> Column:
    out = F.lit(False)
    for s in GOV_SUFFIXES:
        out = out | domain.endswith(s)
    return out


def is_user_controlled(domain: Column, own: Column | None = None) -> Column:
    d = F.lower(domain)
    listed = one_of(d, USER_CONTROLLED)
    return listed if own is None else listed | F.coalesce(F.array_contains(F.transform(own, F.lower), d), F.lit(False))


_PLATFORM = r"(?:^|\.)(" + "|".join(d.replace(".", r"\.") for d, _ in PLATFORMS) + r")$"


def parse_social(url: Column) -> Column:
    """struct<platform, username> of a known platform's url, else null. The first path segment that doesn't route and has no dot is the handle."""
    routing = F.create_map(*[x for d, label in PLATFORMS for x in (F.lit(d), literals(ROUTING.get(label, GENERIC_ROUTING)))])

    def profile(domain: Column, words: Column) -> Column:
        segments = F.filter(F.split(_part(url, 3), "/"), lambda s: (s != "") & ~F.array_contains(words, F.lower(s)))
        handles = F.filter(F.transform(segments, lambda s: F.regexp_replace(s, "^@", "")), lambda s: (s != "") & ~F.contains(s, F.lit(".")))
        return F.struct(F.try_element_at(literal_map(dict(PLATFORMS)), domain).alias("platform"), F.get(handles, F.lit(0)).alias("username"))

    return let(F.regexp_extract(host(url), _PLATFORM, 1), lambda domain: F.when(domain != "", let(F.try_element_at(routing, domain), lambda words: profile(domain, words))))


#: IPv4 ranges that must never be fetched (fixed values: special-purpose address registry).
BLOCKED_V4 = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24",
    "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
)


def ipv4_number(ip: Column) -> Column:
    """A dotted quad as a number, else null."""
    quad = F.transform(F.split(ip, r"\."), lambda x: F.when(x.rlike(r"^[0-9]{1,3}$"), x.cast("long")))
    ok = ip.rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])$")
    return F.when(ok, F.aggregate(quad, F.lit(0).cast("long"), lambda n, x: n * 256 + x))


def is_blocked_ipv4(ip: Column) -> Column:
    """Whether a dotted quad lies in one of the blocked ranges; null if it is none."""
    n, out = ipv4_number(ip), F.lit(False)
    for block in BLOCKED_V4:
        base, _, bits = block.partition("/")
        low = sum(int(x) << (24 - 8 * k) for k, x in enumerate(base.split(".")))
        out = out | n.between(low, low + (1 << (32 - int(bits))) - 1)
    return F.when(n.isNotNull(), out | one_of(ip, METADATA_HOSTS))


def is_blocked_ipv6(ip: Column) -> Column:
    """Whether an IPv6 literal isn't global unicast (2000::/3 without the ranges kept for special use); null if there is no colon. What can't be read is blocked.

    A 6to4 address (2002::/16) is judged by the IPv4 address that it carries.
    """
    low = F.lower(ip)
    carried = [F.conv(F.regexp_extract(low, r"^2002:([0-9a-f]{1,4}):([0-9a-f]{1,4})(?::|$)", k), 16, 10).cast("int") for k in (1, 2)]
    quad = F.concat_ws(".", *(f(c).cast("string") for c in carried for f in (lambda c: F.shiftright(c, 8), lambda c: c.bitwiseAND(255))))
    plain = low.rlike(r"^[23][0-9a-f]{3}:[0-9a-f:]*$") & ~low.rlike(r"^(?:2001:(?:0{0,3}[0-9a-f]{0,1}:|0{0,2}[0-9a-f]{1,2}:|0?1[0-9a-f]{2}:|0?db8:|:)|2002:|3fff:)")
    return F.when(F.contains(ip, F.lit(":")), ~plain & F.coalesce(is_blocked_ipv4(quad), F.lit(True)))


def is_blocked_address(ip: Column) -> Column:
    """As is_blocked_ipv4, and for IPv6 literals as is_blocked_ipv6; null if it is neither."""
    return F.coalesce(is_blocked_ipv4(ip), is_blocked_ipv6(ip))


def url_policy(url: Column) -> Column:
    """ok, or why a url may not be fetched. Null counts as empty; IPv6 literals are judged as all others."""
    u = py_strip(F.coalesce(url, F.lit("")))
    kind, name = scheme(u), host(u)
    bare = F.regexp_replace(name, r"\.+$", "")
    blocked_name = one_of(bare, (*METADATA_HOSTS, "localhost", "localhost.localdomain")) | bare.endswith(".localhost")
    address = F.coalesce(is_blocked_ipv4(name), is_blocked_ipv6(F.regexp_replace(name, r"^\[|\]$", "")))
    return (
        F.when(u == "", "empty_url")
        .when(one_of(kind, REJECTED_SCHEMES), F.concat(F.lit("rejected_scheme:"), kind))
        .when(~one_of(kind, ("http", "https")), F.concat(F.lit("unsupported_scheme:"), F.coalesce(F.nullif(kind, F.lit("")), F.lit("none"))))
        .when(name == "", "missing_host")
        .when(blocked_name, "blocked_hostname")
        .when(F.coalesce(address, F.lit(False)), "blocked_ip_literal")
        .otherwise("ok")
    )


@F.pandas_udf(StringType())
def _urljoin(base: pd.Series, href: pd.Series) -> pd.Series:
    from urllib.parse import urljoin

    return pd.Series([None if b is None or h is None else urljoin(b, h) for b, h in zip(base, href)], dtype=object)


def resolve_link(base: Column, href: Column) -> Column:
    """An absolute url for a link on a page: absolute and root-relative links natively, others by urljoin in batches."""
    root = F.concat(scheme(base), F.lit("://"), _part(base, 2))
    simple = href.rlike(r"^/(?:[^/.]|$)") & ~F.contains(href, F.lit("/.")) & base.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://")
    return F.when(href.rlike(r"^https?://[^/]+/?[^.]*$"), href).when(simple, F.concat(root, href)).otherwise(_urljoin(base, href))
