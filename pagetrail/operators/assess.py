"""Findings: observations grouped by category, rated on four scales, with a priority and reason codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagetrail.functions import text as T
from pagetrail.functions import urls as U
from pagetrail.schema import BASE_RANKS, CATEGORY_OF, VERSIONS, literal_map

#: What a page shows, by category, and what somebody else could do with it.
SHOWN = {
    "CONTACT_EMAIL": ("one of your email addresses", "send you junk or fake login mails"),
    "CONTACT_PHONE": ("one of your phone numbers", "call you, text you, or try to take the number over"),
    "HOME_ADDRESS": ("where you live, down to the street", "turn up there, or use the address to pose as you"),
    "PERSONAL_LOCATION": ("the town or country you live in", "narrow down who and where you are"),
    "DATE_OF_BIRTH": ("the day you were born", "pass checks that ask for it"),
    "PROFESSIONAL_PROFILE": ("what you do and for whom", "write to you as if they knew your work"),
    "SOCIAL_PROFILE": ("one of your social media profiles", "tie it to what else carries your name"),
    "USERNAME": ("a handle that you use", "look for the same handle on other sites"),
    "PERSONAL_DOCUMENT": ("a document of yours", "read everything that stands in it"),
    "PUBLIC_RECORD": ("an official record that names you", "put it together with other records"),
    "COMPANY_RECORD": ("a company's record that names you", "add it to what is known of you"),
    "IMAGE_REFERENCE": ("a picture said to be of you", "find other pictures of the same face"),
    "OUTDATED_INFORMATION": ("something about you that no longer holds", "take it for the present state"),
    "INCORRECT_INFORMATION": ("something about you that is wrong", "believe it"),
    "OTHER_PERSONAL_INFORMATION": ("further details about you", "fill a gap in what they know of you"),
}
WHAT = {category: f"This page shows {what}." for category, (what, _) in SHOWN.items()}
WHY = {category: f"Whoever reads it can {use}." for category, (_, use) in SHOWN.items()}
#: What a match state says.
IDENTITY = {
    "CONFIRMED": "You told us that you are meant.",
    "HIGH_CONFIDENCE": "Several signs that don't depend on each other point to you.",
    "POSSIBLE": "Something points to you, but it could be somebody else.",
    "AMBIGUOUS": "Signs speak for and against you; please look for yourself.",
    "REJECTED": "You told us that somebody else is meant.",
}


def category_of(kind: Column) -> Column:
    return F.try_element_at(literal_map(CATEGORY_OF), kind)


def group_into_findings(obs: DataFrame) -> DataFrame:
    """obs(source_id, subject_id, type, obs_id) to one row per (source, subject, category) with the sorted observation ids; names, titles and urls give none."""
    kept = obs.withColumn("category", category_of(F.col("type"))).where("category IS NOT NULL")
    return kept.groupBy("source_id", "subject_id", "category").agg(F.array_sort(F.collect_set("obs_id")).alias("observation_ids"))


def with_page_categories(findings: DataFrame) -> DataFrame:
    """Adds the sorted categories found on the same page for the same subject."""
    page = Window.partitionBy("source_id", "subject_id")
    return findings.withColumn("categories_on_source", F.array_sort(F.collect_set("category").over(page)))


def assess(findings: DataFrame) -> DataFrame:
    """Adds four severities, overall_priority and explanation_codes to rows with category, from_search, registrable_domain, categories_on_source, match_state.

    Nulls: from_search false, domain '', no categories, a state that needs review.
    """
    base = {k: F.try_element_at(literal_map({c: r[i] for c, r in BASE_RANKS.items()}), F.col("category")) for i, k in enumerate(("s", "d", "m", "p"))}
    rank = {k: F.coalesce(v, F.lit(1)) for k, v in base.items()}
    search, domain = F.coalesce("from_search", F.lit(False)), F.coalesce("registrable_domain", F.lit(""))
    found = rank["d"] + search.cast("int")
    found = F.least(found, F.lit(4))
    beside = (F.col("category") == "HOME_ADDRESS") & F.coalesce(F.array_contains("categories_on_source", "CONTACT_PHONE"), F.lit(False))
    misuse = F.least(rank["m"] + beside.cast("int"), F.lit(4))
    worst = F.greatest(rank["s"], misuse)
    raised = (found >= 3) & (worst < 4)
    outdated = F.col("category") == "OUTDATED_INFORMATION"
    unsure = ~F.coalesce(T.is_actionable(F.col("match_state")), F.lit(False))
    priority = worst + raised.cast("int")
    priority = F.when(outdated, F.least(priority, F.lit(1))).otherwise(priority)
    priority = F.when((F.col("category") == "PROFESSIONAL_PROFILE") | unsure, F.least(priority, F.lit(2))).otherwise(priority)
    codes = F.array_compact(F.array(
        F.concat(F.lit("BASE_"), "category"), F.when(search, "SEARCH_INDEXED"), F.when(beside, "DIRECT_PHONE_PRESENT"), F.when(U.is_gov(domain), "GOVERNMENT_SOURCE"),
        F.when(U.is_user_controlled(domain) & (F.lower(domain) == domain), "USER_CONTROLLED"), F.when(raised, "HIGH_DISCOVERABILITY"), F.when(outdated, "OUTDATED_CAP"), F.when(unsure, "IDENTITY_UNCERTAIN"),
    ))
    return findings.select(
        "*", T.severity_of(rank["s"]).alias("sensitivity"), T.severity_of(found).alias("discoverability"), T.severity_of(misuse).alias("misuse_potential"), T.severity_of(rank["p"]).alias("persistence"),
        T.severity_of(priority).alias("overall_priority"), codes.alias("explanation_codes"),
    )


def findings_of(obs: DataFrame, matches: DataFrame, sources: DataFrame) -> DataFrame:
    """Finding rows: own observations (source_id, subject_id, type, obs_id) of anchored matches, rated.

    sources(source_id, registrable_domain, from_search).
    """
    grouped = with_page_categories(group_into_findings(obs))
    judged = matches.select("source_id", "subject_id", F.col("state").alias("match_state"), F.col("confidence").alias("identity_confidence"))
    rows = assess(grouped.join(judged, ["source_id", "subject_id"]).join(sources.select("source_id", "registrable_domain", "from_search"), "source_id"))
    key = F.sha2(F.concat_ws("|", "subject_id", "source_id", "category"), 256)
    return rows.select(
        key.alias("finding_id"), "subject_id", "source_id", "category", "sensitivity", "discoverability", "misuse_potential", "persistence", "overall_priority", F.lit(1.0).alias("assessment_confidence"), "identity_confidence",
        "match_state", "explanation_codes", F.element_at(literal_map(WHAT), F.col("category")).alias("summary"), "observation_ids", F.lit(VERSIONS["assessment_policy"]).alias("assessment_policy_version"),
    )


def explain(findings: DataFrame, matches: DataFrame) -> DataFrame:
    """finding_id, what, why, identity (with the supporting signals' names) and priority, in words."""
    names = matches.select("source_id", "subject_id", F.transform("supporting", lambda s: s["name"]).alias("signals"))
    rows = findings.join(names, ["source_id", "subject_id"], "left")
    said = F.coalesce(F.try_element_at(literal_map(IDENTITY), F.col("match_state")), F.lit(""))
    identity = F.when(F.size(F.coalesce("signals", F.array().cast("array<string>"))) > 0, F.concat(said, F.lit(" Signals: "), F.array_join("signals", ", "), F.lit("."))).otherwise(said)
    of = lambda d: F.coalesce(F.try_element_at(literal_map(d), F.col("category")), F.lit(d["OTHER_PERSONAL_INFORMATION"]))
    return rows.select("finding_id", of(WHAT).alias("what"), of(WHY).alias("why"), identity.alias("identity"), F.concat(F.lit("PRIORITY_"), "overall_priority", F.lit(" because: "), F.array_join("explanation_codes", " + ")).alias("priority"))


def supersede(findings: DataFrame) -> DataFrame:
    """findings(subject_id, canonical_url, scan_at, ...) of several scans: only the newest scan's of each page and subject; ties keep all."""
    newest = Window.partitionBy("subject_id", "canonical_url").orderBy(F.col("scan_at").desc())
    return findings.withColumn("_r", F.rank().over(newest)).where("_r = 1").drop("_r")
