"""A whole scan: pages to sources, observations, matches and findings, for all enrolled subjects at once."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetrail.functions import urls as U
from pagetrail.functions.html import decode_body
from pagetrail.operators import assess, extract, resolve
from pagetrail.session import durable
from pagetrail.sources import tables


@dataclass
class Scan:
    sources: DataFrame
    parsed: DataFrame
    telling: DataFrame
    matches: DataFrame
    terms: DataFrame

    @cached_property
    def observations(self) -> DataFrame:
        """telling, and where pages hold a subject's name of one token. No match or finding needs those, of which there are as many as pages times names that they hold: sought and written when first asked for."""
        return self.telling.unionByName(extract.term_observations(self.parsed, self.terms.where(extract.lone_name()), self.telling))

    @cached_property
    def findings(self) -> DataFrame:
        """Worked out and written when first asked for: who only reads matches doesn't wait for them."""
        own = resolve.own_identifiers(self.telling, resolve.anchored(self.matches), self.terms)
        return durable(assess.findings_of(own, self.matches, self.sources))


def sources_of(pages: DataFrame, suffix_rules: Sequence[str] = U.SUFFIX_RULES) -> DataFrame:
    """pages(url, html or body, content_type, from_search) to sources with ids, canonical urls and domains; every page keeps a row and a status.

    body are a page's bytes as they came: UTF-8, or Latin-1 if they aren't (a PDF, whose bytes are no text, has an empty text).
    """
    if "body" in pages.columns:
        kind = tables.content_type_of(F.col("content_type"))
        pages = pages.withColumn("html", F.when(~kind.isin(*tables.PDF_TYPES), decode_body(F.col("body")))).drop("body")
    admitted = tables.admit_pages(pages)
    rows = U.with_registrable_domain(admitted.withColumn("canonical_url", U.canonical_url(F.col("url"))), "url", suffix_rules)
    return rows.withColumn("source_id", F.sha2(F.concat_ws("|", F.coalesce("scan_id", F.lit("")), F.coalesce("canonical_url", "url", F.lit(""))), 256))


def parsed_sources(pages: DataFrame, suffix_rules: Sequence[str] = U.SUFFIX_RULES) -> DataFrame:
    """sources_of(pages), parsed (if RETRIEVED) and written, one row of each source_id: of several that of the smallest content hash.

    Urls are read and pages parsed in one pass. What is asked of the ids afterwards is asked of the written rows: a
    filter on an id sinks below a shuffle, so it would read every url again, in the tasks of the input's few files.
    """
    rows = sources_of(pages, suffix_rules)
    rest = [c for c in rows.columns if c not in ("source_id", "html")]
    parsed = extract.parse_pages(rows.withColumn("_tied", F.xxhash64(*rest)))
    every = durable(parsed.withColumn("parsed", F.when(F.col("status") == "RETRIEVED", F.col("parsed"))))
    again = durable(every.groupBy("source_id").agg(F.count("*").alias("_n")).where("_n > 1").select("source_id"))
    if again.isEmpty():
        return every.drop("_tied")
    first = every.join(again, "source_id", "left_semi").groupBy("source_id").agg(F.min_by(F.struct(*rest, "parsed"), F.struct("content_hash", "_tied")).alias("_row"))
    return every.drop("_tied").join(again, "source_id", "left_anti").unionByName(durable(first.select("source_id", "_row.*")))


def scan(pages: DataFrame, subjects: DataFrame | None, extra=(), suffix_rules: Sequence[str] = U.SUFFIX_RULES, decisions: DataFrame | None = None, terms: DataFrame | None = None) -> Scan:
    """pages(scan_id, url, html or body, content_type, from_search), subjects to the four tables of a scan. terms: the subjects' terms, if they are at hand.

    Pages are parsed once and their facts found once, whatever the number of subjects; only retrieved pages are read,
    the others keep a source row with their status. Subjects meet pages by joins on identifiers. Raw pages end here.
    """
    kept = parsed_sources(pages, suffix_rules)
    parsed = kept.where("parsed IS NOT NULL").select("source_id", "content_type", "parsed")
    terms = durable(extract.subject_terms(subjects)) if terms is None else terms
    obs = extract.observations(parsed, terms.where(~extract.lone_name()), list(extra), unique=True)
    titles = obs.where("type = 'PAGE_TITLE'").groupBy("source_id").agg(F.min_by("display_value", "obs_id").alias("title"))
    sources = durable(kept.drop("parsed").join(titles, "source_id", "left"))
    matches = durable(resolve.resolve(sources, obs, terms))
    if decisions is not None:
        keyed = matches.join(sources.select("source_id", "canonical_url"), "source_id")
        matches = resolve.apply_decisions(keyed, decisions, ["subject_id", "canonical_url"]).select(*matches.columns)
    return Scan(sources, parsed, obs, matches, terms)
