"""Scalar functions over text: masks, redaction, tokens, names, phones, matches with their offsets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagetrail.schema import ACTIONABLE, SEVERITIES, literals, one_of

DOT = "•"

# The patterns of identifiers; (?U) makes \w, \d, \s and \b mean Unicode classes.
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
PHONE = r"(?U)(?<!\w)\+?\d[\d\s().\-]{6,}\d(?!\w)"
MONTHS = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*"
DATE = rf"(?iU)\b(?:\d{{1,2}}[ /\-]{MONTHS}[ /\-]\d{{2,4}}|{MONTHS}[ ]\d{{1,2}},?[ ]\d{{2,4}}|\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}/\d{{1,2}}/\d{{2,4}})\b"
POSTAL = r"(?U)\b\d{1,5}\s+[A-Z][A-Za-z.'\-]+(?:\s+[A-Z][A-Za-z.'\-]+){0,4}\s+(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Way|Square|Sq)\b"
DATE_SHAPED = r"(?U)^\(?\d{4}[-/.]\d{1,2}[-/.]\d{1,2}\)?$|^\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}$|^\d{4}[-–]\d{4}$"
PHONE_CUE = r"(?iU)\b(tel|telephone|phone|mobile|cell|call|fax|whatsapp|contact)\b"
NO_PHONE_BEFORE = r"(?iU)\b(isbn|issn|doi|ean|upc|vat|iban|swift|bic|asin|pmid|arxiv)\b[:\s]*$"
BIRTH_CUE = r"(?i)(date of birth|born on|born|d\.?o\.?b\.?)"
CONTEXT = 40

# Words of titles that name no person, and separators in order of preference.
NO_PERSON = (
    "wikipedia", "home", "welcome", "index", "page", "search", "login", "about", "contact", "directory", "staff", "team", "news",
    "blog", "domain", "domains", "reserved", "profile", "profiles", "results", "list", "archive", "help", "support", "privacy",
    "terms", "error", "not", "found", "company", "careers",
)
SEPARATORS = (" - ", " – ", " — ", " | ", " · ", ": ")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once a row: an expression that is named several times may be run as often, and inside a lambda again for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def py_strip(c: Column) -> Column:
    """Without white space at both ends, of any kind."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def digits(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\D", "")


def _dots(n: Column) -> Column:
    return F.repeat(F.lit(DOT), n.cast("int"))


def mask_email(value: Column) -> Column:
    """First letter and domain stay: j•••@example.com. Without "@" all dots; null stays null."""

    def mask(v: Column, at: Column) -> Column:
        local, domain = F.substring(v, F.lit(1), at - 1), F.substring(v, at + 1, F.length(v))
        some = F.concat(F.left(local, F.lit(1)), _dots(F.greatest(F.length(local) - 1, F.lit(3))), F.lit("@"), domain)
        return F.when(at == 0, _dots(F.greatest(F.length(v), F.lit(3)))).when(at == 1, F.concat(F.lit(f"{DOT * 3}@"), domain)).otherwise(some)

    return let(py_strip(value), lambda v: mask(v, F.instr(v, "@")))


def mask_phone(value: Column) -> Column:
    """The last two digits and a leading "+" stay; up to two digits: all dots."""
    plus = F.when(F.regexp_replace(value, r"(?U)^\s+", "").startswith("+"), "+").otherwise("")
    return let(digits(value), lambda d: F.when(F.length(d) <= 2, _dots(F.greatest(F.length(value), F.lit(3)))).otherwise(F.concat(plus, _dots(F.length(d) - 2), F.right(d, F.lit(2)))))


def redact(value: Column) -> Column:
    """Emails, then phones, then runs of seven digits or more replaced by tags; null gives ''."""
    out = F.regexp_replace(F.coalesce(value, F.lit("")), EMAIL, "[email]")
    out = F.regexp_replace(out, r"(?U)(?<!\w)\+?\d[\d\s().\-]{6,}\d(?!\w)", "[phone]")
    return F.regexp_replace(out, r"(?U)\b\d{7,}\b", "[digits]")


def redact_map(values: Column) -> Column:
    return F.transform_values(values, lambda k, v: redact(v))


def norm(value: Column) -> Column:
    """Lower-cased, each run of other characters than word characters one space."""
    return F.trim(F.regexp_replace(F.lower(value), r"(?U)[^\w]+", " "))


def tokens(value: Column) -> Column:
    return F.filter(F.split(norm(F.coalesce(value, F.lit(""))), " "), lambda t: t != "")


def name_match(candidate: Column, names: Column) -> Column:
    """Whether first and last token of any of the names (array of strings) stand in the candidate; both need two tokens or more."""
    cand = tokens(candidate)

    def one(name: Column) -> Column:
        t = tokens(name)
        return (F.size(t) >= 2) & F.array_contains(cand, F.get(t, F.lit(0))) & F.array_contains(cand, F.try_element_at(t, F.lit(-1)))

    return (F.size(cand) >= 2) & F.coalesce(F.exists(names, lambda n: F.coalesce(one(n), F.lit(False))), F.lit(False))


def phone_match(candidate: Column, phones: Column) -> Column:
    """Equal digits (seven or more), or equal last nine."""
    c = digits(candidate)

    def one(p: Column) -> Column:
        d = digits(p)
        return (d != "") & ((c == d) | ((F.length(c) >= 9) & (F.length(d) >= 9) & (F.right(c, F.lit(9)) == F.right(d, F.lit(9)))))

    return (F.length(c) >= 7) & F.coalesce(F.exists(phones, lambda p: F.coalesce(one(p), F.lit(False))), F.lit(False))


def phone_plausible(raw: Column) -> Column:
    """Seven to 15 digits, no date, no more separators than digits."""
    separators = F.length(raw) - F.length(F.translate(raw, " .-()", ""))
    return let(F.length(digits(raw)), lambda n: n.between(7, 15) & ~py_strip(raw).rlike(DATE_SHAPED) & (separators <= n))


def page_topic_name(title: Column) -> Column:
    """The person a title names, if any: what stands before the first separator, two to four capitalised words without digits, none of NO_PERSON. Else null."""
    whole = py_strip(title)
    head = whole
    for sep in reversed(SEPARATORS):
        head = F.when(F.contains(whole, F.lit(sep)), py_strip(F.substring_index(whole, sep, 1))).otherwise(head)
    words = F.filter(F.split(head, r"(?U)\s+"), lambda w: w != "")

    def fits(word: Column) -> Column:
        w = F.regexp_replace(word, r"^[.,'()]+|[.,'()]+$", "")
        return w.rlike(r"^\p{Lu}") & ~w.rlike(r"(?U)\d") & ~one_of(F.lower(w), NO_PERSON)

    return F.when(F.size(words).between(2, 4) & F.forall(words, fits), head)


def snippet(text: Column, needle: Column, width: int = 80) -> Column:
    """The needle with so many characters around it, cut marks where text is left out; the needle itself if it isn't there."""
    def cut(at: Column) -> Column:
        start = F.greatest(at - width, F.lit(0))
        end = F.least(at + F.length(needle) + width, F.length(text))
        around = F.concat(F.when(start > 0, "…").otherwise(""), py_strip(F.substring(text, start + 1, end - start)), F.when(end < F.length(text), "…").otherwise(""))
        return F.when(at < 0, F.left(needle, F.lit(2 * width))).otherwise(around)

    return let(F.instr(F.lower(text), F.lower(needle)) - 1, cut)


def found(text: Column, pattern: str) -> Column:
    """All matches as array<struct<hit, start, before>>: start from 0, before the CONTEXT characters in front.

    A match's start is the length of all gaps and matches before it, which one fold over both arrays sums up. A gap is
    what stands between the end of one match and the next one, found by the pattern again (split would compile it for each row).
    """
    gap = rf"(?s)\G(.*?)(?:{pattern})"
    kind = "array<struct<hit:string,start:int,before:string>>"
    init = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["g"])
        before = F.substring(text, F.greatest(start - CONTEXT, F.lit(0)) + 1, F.least(start, F.lit(CONTEXT)))
        item = F.struct(x["h"].alias("hit"), start.alias("start"), before.alias("before"))
        return F.struct((start + F.length(x["h"])).alias("at"), F.concat(acc["out"], F.array(item)).alias("out"))

    def places(hits: Column) -> Column:
        both = F.zip_with(F.regexp_extract_all(text, F.lit(gap), F.lit(1)), hits, lambda g, h: F.struct(g.alias("g"), h.alias("h")))
        return F.when(F.size(hits) == 0, F.array().cast(kind)).otherwise(F.aggregate(both, init, step, lambda acc: acc["out"]))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), places)


def severity_rank(s: Column) -> Column:
    """0 to 4; null for any other string."""
    return F.nullif(F.array_position(literals(SEVERITIES), s), F.lit(0)).cast("int") - 1


def severity_of(rank: Column) -> Column:
    return F.get(literals(SEVERITIES), rank)


def severity_bump(s: Column, steps: int) -> Column:
    rank = severity_rank(s)
    return F.when(rank.isNotNull(), severity_of(F.greatest(F.least(rank + steps, F.lit(4)), F.lit(0))))


def severity_max(a: Column, b: Column) -> Column:
    return severity_of(F.greatest(severity_rank(a), severity_rank(b)))


def severity_min(a: Column, b: Column) -> Column:
    return severity_of(F.least(severity_rank(a), severity_rank(b)))


def is_actionable(state: Column) -> Column:
    return one_of(state, ACTIONABLE)


def primary_name(names: Column) -> Column:
    """Of array<struct<value, is_primary>>: the flagged name, else the first, else null."""
    return F.coalesce(F.get(F.filter(names, lambda n: n["is_primary"]), F.lit(0))["value"], F.get(names, F.lit(0))["value"])


def location_text(city: Column, country: Column) -> Column:
    return F.concat_ws(", ", F.nullif(city, F.lit("")), F.nullif(country, F.lit("")))


def neutralize(value: Column) -> Column:
    """White space collapsed, prompt scaffolding marks replaced by a space."""
    out = py_strip(F.regexp_replace(F.coalesce(value, F.lit("")), r"(?U)\s+", " "))
    for mark in ("```", "<|", "|>"):
        out = F.replace(out, F.lit(mark), F.lit(" "))
    return out


def registry_expired(last_verified: Column, days: Column, today: Column) -> Column:
    return F.date_diff(today, last_verified) > days
