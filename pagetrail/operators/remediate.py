"""Removal routes, drafts, cases: a finding's options, requests in words, and a checked state machine."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetrail.functions import text as T
from pagetrail.functions import urls as U
from pagetrail.schema import EU_EEA_UK, TEMPLATE_VERSION, TRANSITIONS, US, literal_map, literals

#: Reasons of routes.
OWN = "The page seems to be on an account of yours."
DROP = "You live in the US, where one request reaches the registered data brokers."
ERASURE = "You live where a right to erasure may hold (EU, EEA or UK)."
RECTIFY = "Wrong or old data can be corrected instead of deleted (EU, EEA or UK)."
DELIST = "Fewer people find a page that search results leave out."
PUBLISHER = "The owner of the site can be asked, without any claim."
PUBLIC = "The site looks official; what it publishes by law mostly stays."
NONE = "No known route covers this kind of data."

# The routes that ship, by what decides on them; a registry table with the same ids can be read in their place.
DEFAULT_REGISTRY = (
    ("california_drop", "California Privacy Protection Agency", "SOURCE_OPT_OUT", ("HOME_ADDRESS", "CONTACT_PHONE", "CONTACT_EMAIL", "PERSONAL_LOCATION", "DATE_OF_BIRTH", "PUBLIC_RECORD"), "https://consumer.drop.privacy.ca.gov/", 180, ("US-CA",)),
    ("generic_gdpr_erasure", "(the website's data controller)", "SOURCE_DELETE", ("CONTACT_EMAIL", "CONTACT_PHONE", "HOME_ADDRESS", "PERSONAL_LOCATION", "DATE_OF_BIRTH", "PERSONAL_DOCUMENT", "OTHER_PERSONAL_INFORMATION"), "https://gdpr-info.eu/art-17-gdpr/", 365, ("EU", "EEA", "UK")),
    ("generic_gdpr_rectification", "(the website's data controller)", "SOURCE_CORRECT", ("OUTDATED_INFORMATION", "INCORRECT_INFORMATION", "PROFESSIONAL_PROFILE"), "https://gdpr-info.eu/art-16-gdpr/", 365, ("EU", "EEA", "UK")),
    ("generic_publisher_contact", "(the website's owner)", "CONTACT_PUBLISHER", ("CONTACT_EMAIL", "CONTACT_PHONE", "HOME_ADDRESS", "PERSONAL_LOCATION", "DATE_OF_BIRTH", "SOCIAL_PROFILE", "USERNAME", "IMAGE_REFERENCE", "PUBLIC_RECORD", "COMPANY_RECORD", "OTHER_PERSONAL_INFORMATION"), "", 365, ("GLOBAL",)),
    ("google_personal_info", "Google", "SEARCH_DELIST", ("CONTACT_EMAIL", "CONTACT_PHONE", "HOME_ADDRESS", "DATE_OF_BIRTH", "PERSONAL_DOCUMENT"), "https://support.google.com/websearch/answer/12719076", 180, ("GLOBAL_LIMITED",)),
    ("user_controlled_remove", "(you)", "USER_CONTROLLED_REMOVE", ("SOCIAL_PROFILE", "USERNAME", "PROFESSIONAL_PROFILE", "CONTACT_EMAIL", "CONTACT_PHONE", "PERSONAL_LOCATION", "IMAGE_REFERENCE", "OTHER_PERSONAL_INFORMATION"), "", 365, ("GLOBAL",)),
)


def default_registry(spark: SparkSession) -> DataFrame:
    """The six routes that ship, in the registry's columns."""
    df = spark.createDataFrame(list(DEFAULT_REGISTRY), "id string, provider string, route_type string, applies_to array<string>, official_url string, expires_after_days int, jurisdictions array<string>")
    empty = F.array().cast("array<string>")
    return df.select("id", "provider", "route_type", F.lit("").alias("destination_kind"), "jurisdictions", "applies_to", "official_url", F.lit(None).cast("string").alias("portal_url"), empty.alias("required_inputs"), F.lit("").alias("side_effects"), (F.col("id") != "user_controlled_remove").alias("informational"), F.to_date(F.lit("2026-08-08")).alias("last_verified"), "expires_after_days", F.when(F.col("official_url") != "", F.array("official_url")).otherwise(F.array(F.lit("https://www.ftc.gov/business-guidance/privacy-security"))).alias("sources"))


def validate_registry(registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected with reason): needs provenance, safe urls, a jurisdiction, a category, and an id of its own."""
    unsafe = lambda c: (F.coalesce(c, F.lit("")) != "") & (U.url_policy(c) != "ok")
    repeated = registry.groupBy("id").agg(F.count("*").alias("_n"))
    rows = registry.join(repeated, "id", "left")
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    reason = (
        F.when(F.coalesce("id", F.lit("")) == "", "missing_id")
        .when(F.col("_n") > 1, "duplicate_id")
        .when(none("sources"), "no_provenance")
        .when(unsafe(F.col("official_url")) | unsafe(F.col("portal_url")) | F.exists("sources", lambda s: U.url_policy(s) != "ok"), "unsafe_url")
        .when(none("jurisdictions"), "no_jurisdiction")
        .when(none("applies_to"), "no_category")
    )
    rows = rows.withColumn("reason", reason)
    return rows.where("reason IS NULL").drop("reason", "_n"), rows.where("reason IS NOT NULL").drop("_n")


def countries(locations: Column) -> Column:
    return F.filter(F.transform(locations, lambda x: F.lower(F.trim(x["country"]))), lambda c: c.isNotNull() & (c != ""))


def routes(findings: DataFrame, subjects: DataFrame, registry: DataFrame, today: Column | None = None) -> DataFrame:
    """findings(finding_id, subject_id, category, registrable_domain) to options in order: finding_id, rank, registry_id, route, provider, recommended, reason, jurisdiction_relevant.

    Expired entries are left out. A finding on a government domain, or without any option, also gets NO_ACTION_AVAILABLE.
    """
    today = F.current_date() if today is None else today
    live = registry.where(~T.registry_expired(F.col("last_verified"), F.col("expires_after_days"), today)).select(F.col("id").alias("registry_id"), "provider", "route_type", F.explode("applies_to").alias("category"))
    who = subjects.select("subject_id", countries(F.col("locations")).alias("countries"), "personal_domains")
    domain = F.lower(F.coalesce("registrable_domain", F.lit("")))
    rows = findings.select("finding_id", "subject_id", "category", domain.alias("domain")).join(who.hint("merge"), "subject_id")  # never broadcast: a file of subjects is small, their arrays are not
    in_us, in_eu = F.arrays_overlap("countries", literals(US)), F.arrays_overlap("countries", literals(EU_EEA_UK))
    rows = rows.select("finding_id", "category", U.is_user_controlled(F.col("domain"), F.col("personal_domains")).alias("own"), U.is_gov(F.col("domain")).alias("gov"), in_us.alias("us"), in_eu.alias("eu"), (F.size("countries") > 0).alias("placed"))
    option = lambda rank, name, when, good, why, relevant: F.when(when, F.struct(F.lit(rank).alias("rank"), F.lit(name).alias("registry_id"), good.alias("recommended"), F.lit(why).alias("reason"), F.lit(relevant).alias("jurisdiction_relevant")))
    own, yes, no = F.col("own"), F.lit(True), F.lit(False)
    options = F.array_compact(F.array(
        option(1, "user_controlled_remove", own, yes, OWN, True), option(2, "california_drop", F.col("us"), ~own, DROP, True), option(3, "generic_gdpr_erasure", F.col("eu"), ~own, ERASURE, True),
        option(4, "generic_gdpr_rectification", F.col("eu"), no, RECTIFY, True), option(5, "google_personal_info", yes, ~(own | F.col("placed")), DELIST, False), option(6, "generic_publisher_contact", yes, no, PUBLISHER, False),
    ))
    # which routes a category has is known before the options are made, so no finding is shuffled to learn that it has none
    offered = live.groupBy("category").agg(F.collect_set("registry_id").alias("ids"))
    rows = rows.join(F.broadcast(offered), "category", "left").withColumn("options", F.filter(options, lambda o: F.coalesce(F.array_contains("ids", o["registry_id"]), F.lit(False))))
    each = rows.select("finding_id", "category", F.inline("options")).join(F.broadcast(live), ["registry_id", "category"])
    chosen = each.select("finding_id", "rank", "registry_id", F.col("route_type").alias("route"), "provider", "recommended", "reason", "jurisdiction_relevant")
    empty = rows.where("gov OR size(options) = 0")
    last = empty.select("finding_id", F.lit(7).alias("rank"), F.lit(None).cast("string").alias("registry_id"), F.lit("NO_ACTION_AVAILABLE").alias("route"), F.lit("(none)").alias("provider"), F.col("gov").alias("recommended"), F.when(F.col("gov"), PUBLIC).otherwise(NONE).alias("reason"), F.lit(False).alias("jurisdiction_relevant"))
    return chosen.unionByName(last)


#: The wording of the drafts, by route, with what fills it; the publisher's is for all other routes.
_LETTER = "Data protection contact of %s\n\nMy name is %s. On %s you publish data about me: %s. Please {0} and tell me when that is done.\n\nWith kind regards\n%s"
BODIES = {
    "SEARCH_DELIST": ("Open %s and enter the address of the result:\n\n    %s\n\nAs the reason, name your %s. What goes is the entry in the search engine; the page itself stays where it is.", ("to", "url", "detail")),
    "SOURCE_OPT_OUT": ("Sign up at %s. One request there reaches every listed broker that may hold your %s.", ("to", "detail")),
    "SOURCE_DELETE": (_LETTER.format("delete it under the right to erasure"), ("domain", "name", "url", "detail", "name")),
    "SOURCE_CORRECT": (_LETTER.format("put it right under the right to rectification"), ("domain", "name", "url", "detail", "name")),
    "USER_CONTROLLED_REMOVE": ("You have an account at %s, so nobody needs to be asked: log in and take the %s off this page:\n\n    %s", ("domain", "detail", "url")),
    "NO_ACTION_AVAILABLE": ("Nobody is bound to take down %s, as far as the routes that we know say. A search engine may still leave it out of its results.", ("url",)),
    "CONTACT_PUBLISHER": ("Operator of %s\n\nYour page %s contains my %s. I would be glad if you took it off. If you need anything from me for that, please let me know.\n\n%s", ("domain", "url", "detail", "name")),
}
LINES = {"SEARCH_DELIST": "Search result: please delist", "SOURCE_OPT_OUT": "Opt-out from data brokers", "SOURCE_DELETE": "Erasure of data about me", "SOURCE_CORRECT": "Correction of data about me", "USER_CONTROLLED_REMOVE": "To do on your own account", "CONTACT_PUBLISHER": "Data about me on your site", "NO_ACTION_AVAILABLE": "Nothing to send"}
DISCLAIMER = "Read it through before you send it; this is no legal advice."


def drafts(cases: DataFrame, findings: DataFrame, sources: DataFrame, subjects: DataFrame, registry: DataFrame) -> DataFrame:
    """cases(case_id, finding_id, registry_route_id) to a request draft each: route, destination_url, subject_line, body, required_inputs, side_effects, informational, disclaimer, template_version."""
    rows = cases.join(findings.select("finding_id", "subject_id", "source_id", "category"), "finding_id").join(sources.select("source_id", "url", "registrable_domain"), "source_id")
    rows = rows.join(subjects.select("subject_id", F.coalesce(T.primary_name(F.col("names")), F.lit("[your name]")).alias("name")), "subject_id")
    entry = registry.select(F.col("id").alias("registry_route_id"), "route_type", F.coalesce(F.nullif("portal_url", F.lit("")), "official_url", F.lit("")).alias("to"), "required_inputs", "side_effects", "informational")
    rows = rows.join(entry, "registry_route_id", "left")
    kind, detail = F.coalesce("route_type", F.lit("NO_ACTION_AVAILABLE")), F.lower(F.replace("category", F.lit("_"), F.lit(" ")))
    url, domain, name, to = F.col("url"), F.col("registrable_domain"), F.col("name"), F.col("to")
    none = F.array().cast("array<string>")
    told = {"to": to, "url": url, "domain": domain, "name": name, "detail": detail}
    body = F.lit(None).cast("string")
    for of, (wording, values) in BODIES.items():
        body = F.when(kind == of, F.format_string(wording, *(told[v] for v in values))).otherwise(body)
    wording, values = BODIES["CONTACT_PUBLISHER"]
    body = F.coalesce(body, F.format_string(wording, *(told[v] for v in values)))
    line = literal_map(LINES)
    return rows.select("case_id", kind.alias("route"), F.when(kind == "NO_ACTION_AVAILABLE", "").otherwise(to).alias("destination_url"), F.try_element_at(line, kind).alias("subject_line"), body.alias("body"), F.coalesce("required_inputs", none).alias("required_inputs"), F.coalesce("side_effects", F.lit("")).alias("side_effects"), F.coalesce("informational", F.lit(True)).alias("informational"), F.lit(DISCLAIMER).alias("disclaimer"), F.lit(TEMPLATE_VERSION).alias("template_version"))


def transitions(spark: SparkSession) -> DataFrame:
    """The allowed moves (state, target)."""
    return spark.createDataFrame([(a, b) for a, targets in TRANSITIONS.items() for b in targets], "state string, target string")


def can_transition(state: Column, target: Column) -> Column:
    moves = literal_map({f"{a}>{b}": True for a, targets in TRANSITIONS.items() for b in targets})
    return F.coalesce(F.try_element_at(moves, F.concat(state, F.lit(">"), target)), F.lit(False))


def allowed_events(events: DataFrame, spark: SparkSession) -> DataFrame:
    """events(state, target, ...) that the machine allows: a semi-join with its edges."""
    return events.join(F.broadcast(transitions(spark)), ["state", "target"], "left_semi")


def fold_case_events(events: DataFrame, start: str = "ACTION_SELECTED") -> DataFrame:
    """events(case_id, at, event_id, target_state) applied in order per case: case_id, state, submitted_at, n_applied, n_rejected.

    Illegal moves are counted and change nothing; submitted_at is the last legal move to USER_MARKED_SUBMITTED. Ties in
    time go by event_id; null targets are illegal.
    """
    item = F.struct("at", "event_id", F.col("target_state").alias("target"))
    per_case = events.groupBy("case_id").agg(F.array_sort(F.collect_list(item)).alias("events"))
    init = F.struct(F.lit(start).alias("state"), F.lit(None).cast("timestamp").alias("submitted_at"), F.lit(0).cast("long").alias("n_applied"), F.lit(0).cast("long").alias("n_rejected"))

    def step(acc: Column, e: Column) -> Column:
        ok = can_transition(acc["state"], e["target"])
        return F.struct(
            F.when(ok, e["target"]).otherwise(acc["state"]).alias("state"), F.when(ok & (e["target"] == "USER_MARKED_SUBMITTED"), e["at"]).otherwise(acc["submitted_at"]).alias("submitted_at"),
            (acc["n_applied"] + ok.cast("long")).alias("n_applied"), (acc["n_rejected"] + (~ok).cast("long")).alias("n_rejected"),
        )

    return per_case.select("case_id", F.aggregate("events", init, step).alias("x")).select("case_id", "x.*")


def new_cases(choices: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """choices(finding_id, route, registry_route_id, opened_at) to (cases, rejected): a registry route overrides the bare one; unknown ids are rejected."""
    entry = registry.select(F.col("id").alias("registry_route_id"), F.col("route_type").alias("_type"))
    rows = choices.join(F.broadcast(entry), "registry_route_id", "left")
    bad = F.col("registry_route_id").isNotNull() & F.col("_type").isNull()
    ok = rows.where(~bad).select(F.sha2(F.concat_ws("|", "finding_id", F.coalesce("registry_route_id", F.lit("")), F.coalesce("_type", "route")), 256).alias("case_id"), "finding_id", F.coalesce("_type", "route").alias("route"), "registry_route_id", F.lit("ACTION_SELECTED").alias("state"), "opened_at")
    return ok, rows.where(bad).select(*choices.columns)


# A case's lane, what to do next, and the state that follows.
STAGES = {
    "DISCOVERED": ("to_do", "Choose how to act", "ACTION_SELECTED"),
    "REVIEWED": ("to_do", "Choose how to act", "ACTION_SELECTED"),
    "ACTION_SELECTED": ("to_do", "Open the draft and send it", "REQUEST_PREPARED"),
    "REQUEST_PREPARED": ("to_do", "Send it, then mark it submitted", "USER_MARKED_SUBMITTED"),
    "USER_MARKED_SUBMITTED": ("waiting", "Sent — waiting on them", "AWAITING_RESPONSE"),
    "AWAITING_RESPONSE": ("waiting", "Waiting on them — check again", None),
    "SOURCE_CHANGED": ("verify", "The page changed — verify it", None),
    "VERIFICATION_PENDING": ("verify", "Ready to verify", None),
    "VERIFIED": ("done", "Verified removed", None),
    "REQUEST_DENIED": ("to_do", "They refused — try another route", "ACTION_SELECTED"),
    "REAPPEARED": ("to_do", "It came back — act again", "ACTION_SELECTED"),
    "SOURCE_UNREACHABLE": ("waiting", "Page unreachable — try later", None),
    "NOT_APPLICABLE": ("done", "No action available", None),
    "REJECTED": ("done", "Not you", None),
    "USER_ABANDONED": ("done", "You stopped this one", None),
}


def cleanup_board(cases: DataFrame) -> DataFrame:
    """Adds lane, next_label and next_state to cases with a state; a next state that the machine forbids is null."""
    of = lambda k: F.try_element_at(literal_map({s: v[k] for s, v in STAGES.items() if v[k]}), F.col("state"))
    follow = of(2)
    return cases.select("*", F.coalesce(of(0), F.lit("to_do")).alias("lane"), F.coalesce(of(1), F.lit("Review this")).alias("next_label"), F.when(can_transition(F.col("state"), follow), follow).alias("next_state"))


def case_timeline(events: DataFrame) -> DataFrame:
    """events(case_id, at, kind, detail) to one row a case with its events in time order."""
    return events.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("at", "kind", "detail"))).alias("events"))


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))
