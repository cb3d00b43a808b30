"""Observations from pages: titles, JSON-LD, identifiers in text and links, and the enrolled subjects' own terms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagetrail.functions import html as H
from pagetrail.functions import text as T
from pagetrail.functions import urls as U
from pagetrail.operators.substrings import holding
from pagetrail.schema import EXTRACTOR_VERSION
from pagetrail.session import durable

HTML_TYPES = ("text/html", "application/xhtml+xml")
HIT = "struct<type:string,value:string,display:string,snippet:string,sensitive:boolean,extractor:string,extractor_rank:int,kind_rank:int,pos:int>"
NO_HITS = f"array<{HIT}>"


def _hit(kind: str, value: Column, display: Column, snippet: Column, extractor: str, rank: tuple[int, int], pos: Column, sensitive: bool = False) -> Column:
    return F.struct(F.lit(kind).alias("type"), value.alias("value"), display.alias("display"), snippet.alias("snippet"), F.lit(sensitive).alias("sensitive"), F.lit(extractor).alias("extractor"), F.lit(rank[0]).alias("extractor_rank"), F.lit(rank[1]).alias("kind_rank"), pos.cast("int").alias("pos")).cast(HIT)


def _each(items: Column, make: Callable[[Column, Column], Column]) -> Column:
    return F.transform(items, make)


def parse_pages(pages: DataFrame) -> DataFrame:
    """pages(source_id, content_type, html, ...) with a column parsed: of HTML by parse_html; other text as it is, without title or links.

    An unknown or missing type has an empty text. The raw html column goes.
    """
    kind = F.col("content_type")
    plain = F.struct(F.lit(None).cast("string").alias("title"), F.when(kind == "text/plain", F.col("html")).otherwise("").alias("text"), F.create_map().cast("map<string,string>").alias("meta"), F.array().cast("array<variant>").alias("jsonld"), F.array().cast("array<string>").alias("links"))
    parsed = F.when(kind.isin(*HTML_TYPES), H.parse_html(F.coalesce("html", F.lit("")))).otherwise(plain)
    return pages.withColumn("parsed", parsed).drop("html")


def title_hits(parsed: Column) -> Column:
    t = F.coalesce(parsed["title"], F.try_element_at(parsed["meta"], F.lit("og:title")))
    s = T.py_strip(t)
    return F.when(F.coalesce(t, F.lit("")) != "", F.array(_hit("PAGE_TITLE", F.lower(s), s, F.left(s, F.lit(160)), "metadata", (0, 0), F.lit(0)))).otherwise(F.array().cast(NO_HITS))


def _list(node: Column, name: str) -> Column:
    """A property's values as variants: a list's items, else the one value, else none."""
    path = f'$["{name}"]'
    one = F.try_variant_get(node, path, "variant")
    return F.coalesce(F.try_variant_get(node, path, "array<variant>"), F.when(one.isNotNull() & ~F.is_variant_null(one), F.array(one)), F.array().cast("array<variant>"))


def _strings(node: Column, name: str) -> Column:
    return F.transform(F.filter(_list(node, name), lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.variant_get(x, "$", "string"))


def _typed(node: Column, *names: str) -> Column:
    kinds = F.transform(_list(node, "@type"), lambda x: F.lower(F.try_variant_get(x, "$", "string")))
    return F.exists(kinds, lambda k: F.coalesce(k.isin(*names), F.lit(False)))


def format_address(node: Column) -> Column:
    """A string, or the five parts of a postal address joined."""
    parts = [F.try_variant_get(node, f"$.{k}", "string") for k in ("streetAddress", "addressLocality", "addressRegion", "postalCode", "addressCountry")]
    joined = F.concat_ws(", ", *(F.when(p != "", T.py_strip(p)) for p in parts))
    return F.when(F.schema_of_variant(node) == "STRING", T.py_strip(F.try_variant_get(node, "$", "string"))).otherwise(joined)


def person_hits(node: Column) -> Column:
    """Facts of a JSON-LD Person: names, titles, employers, emails, phones, birth dates, addresses, social profiles."""
    made, rank = "metadata", 1

    def add(values: Column, kind: str, value, display, snippet, order: int, sensitive: bool = False) -> Column:
        kept = F.filter(values, lambda v: F.coalesce(T.py_strip(v), F.lit("")) != "")
        return F.transform(kept, lambda v, i: _hit(kind, F.lower(T.py_strip(value(v))), T.py_strip(display(v)), F.left(snippet(v), F.lit(160)), made, (0, rank), F.lit(order * 1000) + i, sensitive))

    same = lambda v: v
    says = lambda text: lambda v: F.concat(F.lit(text), v)
    only = lambda text: lambda v: F.lit(text)
    employers = F.transform(_list(node, "worksFor"), lambda x: F.when(F.schema_of_variant(x).startswith("OBJECT"), F.try_variant_get(x, "$.name", "string")).when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")))
    emails = F.transform(F.filter(_strings(node, "email"), lambda v: F.contains(v, F.lit("@"))), lambda v: T.py_strip(F.replace(v, F.lit("mailto:"), F.lit(""))))
    addresses = F.transform(_list(node, "address"), format_address)
    urls = F.transform(F.filter(_strings(node, "sameAs"), lambda v: v.startswith("http")), lambda v: F.struct(v.alias("url"), U.parse_social(v).alias("s")))
    profiles = F.filter(urls, lambda x: x["s"].isNotNull())
    profile_hits = F.transform(profiles, lambda x, i: _hit("SOCIAL_LINK", F.lower(T.py_strip(x["url"])), F.concat_ws(": ", x["s"]["platform"], x["s"]["username"]), F.left(F.concat(F.lit("sameAs: "), x["url"]), F.lit(160)), made, (0, rank), F.lit(7000) + i))
    return F.concat(
        add(_strings(node, "name"), "NAME", same, same, says("schema.org Person name: "), 0),
        add(_strings(node, "jobTitle"), "JOB_TITLE", same, same, says("jobTitle: "), 1),
        add(employers, "EMPLOYER", same, same, says("worksFor: "), 2),
        add(emails, "EMAIL", same, T.mask_email, only("schema.org email"), 3, True),
        add(_strings(node, "telephone"), "PHONE", lambda v: F.regexp_replace(v, r"(?U)[^\d+]", ""), T.mask_phone, only("schema.org telephone"), 4, True),
        add(_strings(node, "birthDate"), "DATE_OF_BIRTH", same, same, says("birthDate: "), 5, True),
        add(addresses, "POSTAL_ADDRESS", same, same, says("schema.org address: "), 6, True),
        profile_hits,
    )


def organisation_hits(node: Column) -> Column:
    name = T.py_strip(F.when(F.schema_of_variant(F.try_variant_get(node, "$.name", "variant")) == "STRING", F.try_variant_get(node, "$.name", "string")))
    hit = _hit("ORGANISATION", F.lower(name), name, F.concat(F.lit("schema.org Organization: "), name), "metadata", (0, 1), F.lit(0))
    return F.when(F.coalesce(name, F.lit("")) != "", F.array(hit)).otherwise(F.array().cast(NO_HITS))


def jsonld_hits(nodes: Column) -> Column:
    def of(node: Column, i: Column) -> Column:
        hits = F.when(_typed(node, "person"), person_hits(node)).when(_typed(node, "organization", "corporation"), organisation_hits(node)).otherwise(F.array().cast(NO_HITS))
        return F.transform(hits, lambda h: h.withField("pos", h["pos"] + i * 10000))

    return F.flatten(F.transform(nodes, of))


def email_hits(text: Column) -> Column:
    values = F.regexp_extract_all(text, F.lit(T.EMAIL), F.lit(0))
    return _each(values, lambda v, i: _hit("EMAIL", F.lower(v), T.mask_email(v), T.snippet(text, v), "pii", (1, 0), i, True))


def phone_hits(text: Column) -> Column:
    """Plausible numbers, written with a plus or announced in the 40 characters before, and not as another kind of number."""
    raw = F.transform(T.found(text, T.PHONE), lambda x: F.struct(T.py_strip(x["hit"]).alias("hit"), x["before"].alias("before")))
    kept = F.filter(raw, lambda x: T.phone_plausible(x["hit"]) & ~x["before"].rlike(T.NO_PHONE_BEFORE) & (x["hit"].startswith("+") | x["before"].rlike(T.PHONE_CUE)))
    return F.transform(kept, lambda x, i: _hit("PHONE", F.regexp_replace(x["hit"], r"(?U)[^\d+]", ""), T.mask_phone(x["hit"]), T.snippet(text, x["hit"]), "pii", (1, 1), i, True))


def birth_hits(text: Column) -> Column:
    dates = F.when(text.rlike(T.BIRTH_CUE), T.found(text, T.DATE))  # most texts announce no birth, and aren't searched for dates
    kept = F.filter(F.coalesce(dates, F.array().cast("array<struct<hit:string,start:int,before:string>>")), lambda x: x["before"].rlike(T.BIRTH_CUE))
    return F.transform(kept, lambda x, i: _hit("DATE_OF_BIRTH", F.lower(x["hit"]), x["hit"], T.snippet(text, x["hit"]), "pii", (1, 2), i, True))


def postal_hits(text: Column) -> Column:
    values = F.regexp_extract_all(text, F.lit(T.POSTAL), F.lit(0))
    return _each(values, lambda v, i: _hit("POSTAL_ADDRESS", F.regexp_replace(F.lower(v), r"(?U)\s+", " "), v, T.snippet(text, v), "pii", (1, 3), i, True))


def link_hits(links: Column) -> Column:
    """mailto and tel links, and social profiles with their handles."""

    read = F.transform(links, lambda h: F.struct(h.alias("href"), F.when(F.lower(h).startswith("http"), U.parse_social(h)).alias("social")))

    def of(x: Column, i: Column) -> Column:
        href, social = x["href"], x["social"]
        low = F.lower(href)
        address = F.substring_index(F.substring(href, 8, 1 << 20), "?", 1)
        number = F.substring(href, 5, 1 << 20)
        label = F.concat_ws(": ", social["platform"], social["username"])
        profile = _hit("SOCIAL_LINK", low, label, F.concat(F.lit("link: "), href), "pii", (1, 4), i * 2)
        handle = _hit("USERNAME", F.lower(social["username"]), social["username"], F.concat(social["platform"], F.lit(" handle in "), href), "pii", (1, 4), i * 2 + 1)
        return (
            F.when(low.startswith("mailto:") & F.contains(address, F.lit("@")), F.array(_hit("EMAIL", F.lower(address), T.mask_email(address), F.concat(F.lit("mailto link: "), T.mask_email(address)), "pii", (1, 4), i * 2, True)))
            .when(low.startswith("tel:") & T.phone_plausible(number), F.array(_hit("PHONE", F.regexp_replace(number, r"(?U)[^\d+]", ""), T.mask_phone(number), F.concat(F.lit("tel link: "), T.mask_phone(number)), "pii", (1, 4), i * 2, True)))
            .when(low.startswith("http") & social["username"].isNotNull(), F.array(profile, handle))
            .when(low.startswith("http") & social.isNotNull(), F.array(profile))
            .otherwise(F.array().cast(NO_HITS))
        )

    return F.flatten(F.transform(read, of))


def once_each(hits: Column) -> Column:
    """A page's hits, of those of one type and value the first (see first_wins): sorted, so that a page of any number of hits takes no longer than its sort."""
    order = ("type", "value", "extractor_rank", "kind_rank", "pos", "snippet", "display", "sensitive", "extractor")

    def first(h: Column, i: Column, rows: Column) -> Column:
        last = F.get(rows, i - 1)
        return (i == 0) | ~(h["type"].eqNullSafe(last["type"]) & h["value"].eqNullSafe(last["value"]))

    return T.let(F.array_sort(F.transform(hits, lambda h: F.struct(*(h[c].alias(c) for c in order)))), lambda rows: F.filter(rows, lambda h, i: first(h, i, rows)))


def page_observations(parsed: DataFrame, once: bool = False) -> DataFrame:
    """parsed pages to observation rows of page facts (subject_id null): source_id and the fields of HIT. once: each row's hits by once_each.

    All kinds in one pass over the page: an array of hits for each kind, then a single explode. The page is parsed once
    even where parsing is part of the same plan.
    """

    def hits(p: Column) -> Column:
        people = F.when(F.size(p["jsonld"]) > 0, jsonld_hits(p["jsonld"])).otherwise(F.array().cast(NO_HITS))
        every = F.concat(title_hits(p), people, email_hits(p["text"]), phone_hits(p["text"]), birth_hits(p["text"]), postal_hits(p["text"]), link_hits(p["links"]))
        return once_each(every) if once else every

    return parsed.select("source_id", F.inline(T.let(F.col("parsed"), hits))).withColumn("subject_id", F.lit(None).cast("string"))


def subject_terms(subjects: DataFrame) -> DataFrame:
    """subjects to (subject_id, kind, value, norm, digits, last9, first_token, last_token): one row per identifier, nulls and blanks left out."""
    item = lambda kind, c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    all_terms = F.concat(
        item("NAME", F.col("names.value")), item("CITY", F.col("locations.city")), item("COUNTRY", F.col("locations.country")), item("EMPLOYER", F.col("employers.name")),
        item("USERNAME", F.col("usernames")), item("EMAIL", F.col("emails")), item("PHONE", F.col("phones")), item("DOMAIN", F.col("personal_domains")),
    )
    t = subjects.select("subject_id", F.inline(all_terms)).where("value IS NOT NULL AND trim(value) <> ''")
    d, names = T.digits(F.col("value")), T.tokens(F.col("value"))
    two = (F.col("kind") == "NAME") & (F.size(names) >= 2)
    return t.select("subject_id", "kind", "value", F.when(F.col("kind") == "EMPLOYER", T.norm(F.col("value"))).otherwise(F.lower("value")).alias("norm"), F.when(F.col("kind") == "PHONE", d).alias("digits"), F.when((F.col("kind") == "PHONE") & (F.length(d) >= 9), F.right(d, F.lit(9))).alias("last9"), F.when(two, F.get(names, F.lit(0))).alias("first_token"), F.when(two, F.try_element_at(names, F.lit(-1))).alias("last_token"))


#: Kinds of terms that are looked for in text, in the order in which first wins, and the observation each gives.
TOKEN_KINDS = {"NAME": ("NAME", 0), "CITY": ("LOCATION", 1), "COUNTRY": ("LOCATION", 1), "EMPLOYER": ("EMPLOYER", 2), "USERNAME": ("USERNAME", 3), "DOMAIN": ("URL", 4)}


#: Kinds that many subjects share: where a text holds one, that is a fact of the page, and no row for each of its subjects.
SHARED_KINDS = ("CITY", "COUNTRY", "EMPLOYER")
TOKENS = "subject_tokens"


def lone_name() -> Column:
    """Whether a term is a name of fewer than two tokens. Texts may hold it anywhere ("ent " stands in nearly half of all pages), yet it points to nobody (see name_matches) and gives no finding."""
    return (F.col("kind") == "NAME") & F.col("first_token").isNull()


def _needles(terms: DataFrame) -> DataFrame:
    return terms.where(F.length("value") >= 3).withColumn("needle", F.lower("value"))


def term_matches(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """texts(source_id, text), terms(subject_id, kind, value) to the pairs whose text holds the term (case-insensitive, three characters or more).

    A substring join without a nested loop (see holding): no text meets a term that it doesn't nearly hold, and one pass
    over the texts does for any number of terms. A text holds a term once, however often it stands there.
    """
    wanted = _needles(terms).select("subject_id", "kind", "value", "needle")
    return holding(texts, wanted.select("needle")).join(wanted, "needle").select("source_id", "subject_id", "kind", "value")


def term_counts(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """As term_matches, counted: (source_id, kind, n_terms, n_values) of the terms that each text holds.

    A text meets each different term once, with the number of subjects who have it, so a place that a third of all texts
    name and a third of all subjects live in makes no product of both.
    """
    wanted = _needles(terms).groupBy("kind", "needle").agg(F.count("*").alias("n"), F.count_distinct("value").alias("v"))
    return holding(texts, wanted.select("needle")).join(wanted, "needle").groupBy("source_id", "kind").agg(F.sum("n").alias("n_terms"), F.sum("v").alias("n_values"))


def subject_observations(parsed: DataFrame, terms: DataFrame) -> DataFrame:
    """Observations of the subjects' own names, usernames and domains where a page's text holds them, and of places and employers of any subject.

    The latter have no subject: a page that says "Germany" gives one row, however many subjects live there; resolve gives
    them to those of its subjects that something else points to.
    """
    wanted = _needles(terms.where(F.col("kind").isin(*TOKEN_KINDS)))
    found = holding(parsed.select("source_id", F.col("parsed.text").alias("text")), wanted.select("needle"))
    kind, order = F.lit(None).cast("string"), F.lit(0)
    for name, (observed, rank) in TOKEN_KINDS.items():
        kind, order = F.when(F.col("kind") == name, observed).otherwise(kind), F.when(F.col("kind") == name, rank).otherwise(order)
    typed = wanted.select("subject_id", "needle", "value", kind.alias("type"), order.alias("kind_rank"), F.col("kind").isin(*SHARED_KINDS).alias("shared"))
    # a text holds a needle once, so rows that are one for each subject, needle and type stay so, and nobody's snippets are shuffled to find that out
    own = typed.where("NOT shared").groupBy("subject_id", "needle", "type").agg(F.min(F.struct("kind_rank", "value")).alias("_first")).select("subject_id", "needle", "_first.value", "type", "_first.kind_rank")
    shared = typed.where("shared").groupBy("needle", "type", "kind_rank").agg(F.min("value").alias("value")).select(F.lit(None).cast("string").alias("subject_id"), "needle", "value", "type", "kind_rank")
    rows = found.join(own.unionByName(shared), "needle")
    return rows.select("source_id", "subject_id", "type", F.col("needle").alias("value"), F.col("value").alias("display"), "snippet", F.lit(False).alias("sensitive"), F.lit(TOKENS).alias("extractor"), F.lit(2).alias("extractor_rank"), "kind_rank", F.lit(0).alias("pos"))


FIELDS = ("source_id", "subject_id", "type", "value", "display", "snippet", "sensitive", "extractor", "extractor_rank", "kind_rank", "pos")


#: What a table function's rows may hold, and what stands where it gives no such column.
GIVEN = {"type": "string", "value": "string", "display": "string", "snippet": "string", "sensitive": "boolean", "kind_rank": "int", "pos": "int"}


def by_table_function(function: Callable[[Column], DataFrame], name: str, rank: int = 3) -> Callable[[DataFrame], DataFrame]:
    """An extractor, as observations() takes it, from a Python table function of a page's text.

    The function is joined laterally, so a page gives any number of rows. Its columns are checked before anything runs:
    type and value (strings) must be there, others of GIVEN may be, none else; display is the value where it is
    missing, snippet the display, kind_rank and pos 0. Rows with a null or empty type or value are dropped; values
    become lower case, as all extractors' are. An extractor of a smaller rank wins over one of a greater.
    """

    def more(parsed: DataFrame) -> DataFrame:
        rows = parsed.select("source_id", F.coalesce(F.col("parsed.text"), F.lit("")).alias("_text"))
        found = rows.lateralJoin(function(F.col("_text").outer())).drop("_text")
        given = dict(found.dtypes)
        given.pop("source_id")
        wrong = {c: t for c, t in given.items() if GIVEN.get(c) != t} | {c: "missing" for c in ("type", "value") if c not in given}
        if wrong:
            raise ValueError(f"the columns of {name} don't fit: {wrong}; they may be {GIVEN}")
        of = lambda c, other: F.coalesce(F.col(c), other) if c in given else other
        display = of("display", F.col("value"))
        made = found.where("type <> '' AND value <> ''").select("source_id", F.lit(None).cast("string").alias("subject_id"), "type", F.lower("value").alias("value"), display.alias("display"), of("snippet", display).alias("snippet"), of("sensitive", F.lit(False)).alias("sensitive"), F.lit(name).alias("extractor"), F.lit(rank).alias("extractor_rank"), of("kind_rank", F.lit(0)).alias("kind_rank"), of("pos", F.lit(0)).alias("pos"))
        return made.select(*FIELDS)

    return more


@F.udtf(returnType="type string, value string, snippet string, pos int")
class Residences:
    """Where a text says that somebody lives or is based: LOCATION rows, for by_table_function."""

    def eval(self, text: str):
        import re

        for m in re.finditer(r"\b(?:lives|living|resides|residing|based) in ((?:[A-Z][\w'-]+)(?: [A-Z][\w'-]+){0,2})", text or ""):
            yield "LOCATION", m[1], text[max(m.start() - 40, 0) : m.end() + 40].strip(), m.start()


def residences(parsed: DataFrame) -> DataFrame:
    """The places where pages say that somebody lives, as an extractor for observations()."""
    return by_table_function(Residences, "residences")(parsed)


def first_wins(hits: DataFrame) -> DataFrame:
    """One row per (source, subject, type, value): the first by extractor, kind and place; ties by snippet."""
    order = Window.partitionBy("source_id", "subject_id", "type", "value").orderBy("extractor_rank", "kind_rank", "pos", "snippet")
    return hits.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def observed(hits: DataFrame) -> DataFrame:
    """Hits with FIELDS as observation rows."""
    key = F.sha2(F.concat_ws("|", "source_id", F.coalesce("subject_id", F.lit("")), "type", "value"), 256)
    return hits.select(key.alias("obs_id"), "source_id", "subject_id", "type", F.col("value").alias("value_normalized"), F.col("display").alias("display_value"), F.col("snippet").alias("evidence_snippet"), "extractor", F.lit(EXTRACTOR_VERSION).alias("extractor_version"), F.col("sensitive").alias("is_sensitive"), F.struct("extractor_rank", "kind_rank", "pos").alias("seen_at"))


def observations(parsed: DataFrame, terms: DataFrame | None = None, extra: list[Callable[[DataFrame], DataFrame]] = (), unique: bool = False) -> DataFrame:
    """All observations of parsed pages, de-duplicated, as written observation rows with deterministic ids; seen_at orders those of a source as they were found.

    Page facts have no subject and are found once per page; subject rows come from terms. extra: functions from the
    parsed pages to further hits with FIELDS, checked against them. A subject's row, or that of a place or
    employer in the text, gives way to an equal page fact. unique: no two rows of parsed have one source_id; then page
    facts are de-duplicated where the page is read, and shuffled only where there are extra ones to compare them with.
    """
    hits = page_observations(parsed, once=True).select(*FIELDS)
    for more in extra:
        found = more(parsed)
        if missing := set(FIELDS) - set(found.columns):
            raise ValueError(f"an extractor lacks the columns {sorted(missing)}")
        hits = hits.unionByName(found.select(*FIELDS))
    facts = durable(observed(hits if unique and not extra else first_wins(hits)))
    return facts if terms is None else facts.unionByName(term_observations(parsed, terms, facts))


def term_observations(parsed: DataFrame, terms: DataFrame, facts: DataFrame) -> DataFrame:
    """The written observation rows of subject_observations(parsed, terms) that equal no row of facts."""
    equal = facts.where(F.col("type").isin(*{observed for observed, _ in TOKEN_KINDS.values()})).select("source_id", "type", F.col("value_normalized").alias("value"))
    own = subject_observations(parsed, terms).select(*FIELDS).join(equal, ["source_id", "type", "value"], "left_anti").select(*FIELDS)
    return durable(observed(own))


def script_shells(pages: DataFrame, obs: DataFrame, least: int = 400) -> DataFrame:
    """HTML pages whose joined evidence is shorter than so many characters: candidates for a rendered crawl."""
    joined = obs.groupBy("source_id").agg((F.sum(F.length("evidence_snippet")) + F.count("*") - 1).alias("n"))
    return pages.where(F.col("content_type").isin(*HTML_TYPES)).join(joined, "source_id", "left").where(F.coalesce("n", F.lit(0)) < least).select("source_id", F.coalesce("n", F.lit(0)).alias("evidence_chars"))


def pdf_text(pages: DataFrame, most_pages: int = 50) -> DataFrame:
    """pages(source_id, body binary) to (source_id, text): the first pages' text where pypdf is installed; '' otherwise and on any failure."""
    import pandas as pd

    @F.pandas_udf("string")
    def read(body: pd.Series) -> pd.Series:
        def one(data):
            try:
                import io

                import pypdf

                return "\n".join(p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(data)).pages[:most_pages])
            except Exception:  # any broken file reads as empty
                return ""

        return body.map(one)

    return pages.select("source_id", read("body").alias("text"))
