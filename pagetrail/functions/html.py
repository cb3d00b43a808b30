"""HTML by expressions: visible text, title, meta tags, JSON-LD and links of a page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagetrail.functions.text import let, py_strip

# Entities that are decoded (numeric ones too, see unescape); others stay as they are.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&copy;", "©"), ("&ndash;", "–"), ("&mdash;", "—"), ("&hellip;", "…"), ("&rsquo;", "’"), ("&lsquo;", "‘"), ("&rdquo;", "”"), ("&ldquo;", "“"), ("&middot;", "·"), ("&eacute;", "é"), ("&amp;", "&"))

_HIDDEN = r"(?is)<!--.*?-->|<(script|style|noscript|template|svg)\b[^>]*>.*?</\1\s*>"
_ATTR = r"""\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""


def decode_body(body: Column) -> Column:
    """Bytes as UTF-8, or Latin-1 if they aren't."""
    return F.when(F.is_valid_utf8(body.cast("string")), body.cast("string")).otherwise(F.decode(body, "ISO-8859-1"))


def unescape(text: Column) -> Column:
    def decoded(text: Column) -> Column:
        out = text
        for name, char in ENTITIES:
            out = F.replace(out, F.lit(name), F.lit(char))
        return F.when(F.contains(text, F.lit("&")), out).otherwise(text)

    return let(text, decoded)


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value in a tag, unescaped; '' if it isn't there."""
    bare = lambda v: F.when(v.startswith('"') | v.startswith("'"), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)
    return unescape(let(F.regexp_extract(tag, rf"(?is)[\s\"']{name}{_ATTR}", 1), bare))


def lines(text: Column) -> Column:
    """Stripped lines, without blank ones."""
    return F.array_join(F.filter(F.transform(F.split(text, r"\r\n|[\n\r\u000b\u000c\u0085  ]"), py_strip), lambda x: x != ""), "\n")


def visible_text(html: Column) -> Column:
    """The body's text: hidden blocks dropped first, every tag a line break, blank lines dropped. Without a body tag, what follows the head."""
    shown = F.regexp_replace(html, _HIDDEN, "\n")
    body = F.regexp_replace(F.regexp_replace(shown, r"(?is)^.*?<body\b[^>]*>", ""), r"(?is)<head\b.*?</head\s*>|<title\b.*?</title\s*>", "\n")
    return lines(unescape(F.regexp_replace(body, r"(?s)<[!/A-Za-z?][^>]*>", "\n")))


def title(html: Column) -> Column:
    return let(py_strip(unescape(F.regexp_extract(F.regexp_replace(html, r"(?is)<!--.*?-->|<svg\b.*?</svg\s*>", ""), r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1))), lambda t: F.when(t != "", t))


def meta(html: Column) -> Column:
    """Lower-cased property (or name) to content; of several the last."""
    tags = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0)), lambda t: F.struct(F.lower(let(attribute(t, "property"), lambda p: F.when(p != "", p).otherwise(attribute(t, "name")))).alias("key"), attribute(t, "content").alias("value")))
    last = lambda kept: F.filter(kept, lambda t, i: ~F.exists(F.slice(kept, i + 2, F.size(kept)), lambda u: u["key"] == t["key"]))
    return F.map_from_entries(let(F.filter(tags, lambda t: (t["key"] != "") & (t["value"] != "")), last))


def jsonld_blocks(html: Column) -> Column:
    """The raw text of each JSON-LD script."""
    return F.regexp_extract_all(html, F.lit(r"""(?is)<script\b[^>]*type\s*=\s*["']?application/ld\+json["']?[^>]*>(.*?)</script\s*>"""), F.lit(1))


def jsonld_nodes(raw: Column) -> Column:
    """array<variant> of the objects in a JSON-LD text: lists flattened, @graph expanded, other values and bad JSON dropped."""
    v = F.try_parse_json(raw)
    items = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.when(v.isNotNull(), F.array(v)), F.array().cast("array<variant>"))
    objects = F.filter(items, lambda x: F.schema_of_variant(x).startswith("OBJECT"))
    each = F.transform(objects, lambda x: F.coalesce(F.try_variant_get(x, '$["@graph"]', "array<variant>"), F.array(x)))
    return F.filter(F.flatten(each), lambda x: F.coalesce(F.schema_of_variant(x).startswith("OBJECT"), F.lit(False)))


def links(html: Column) -> Column:
    """The href of each anchor, in order."""
    tags = F.regexp_extract_all(F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|template)\b[^>]*>.*?</\1\s*>", ""), F.lit(r"(?is)<a\s[^>]*>"), F.lit(0))
    return F.filter(F.transform(tags, lambda t: attribute(t, "href")), lambda h: h != "")


def parse_html(html: Column) -> Column:
    """struct<title, text, meta map, jsonld array<variant>, links array>."""
    return F.struct(title(html).alias("title"), visible_text(html).alias("text"), meta(html).alias("meta"), F.flatten(F.transform(jsonld_blocks(html), jsonld_nodes)).alias("jsonld"), links(html).alias("links"))
