"""Is a page about a subject? Evidence families, contradictions, and a state that abstains when in doubt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetrail.functions import text as T
from pagetrail.operators.extract import TOKENS
from pagetrail.schema import SIGNAL, VERSIONS
from pagetrail.session import durable

# Weights of evidence families, penalties and thresholds.
STRONG, USERNAME, NAME, LOCATION, EMPLOYER = 0.97, 0.62, 0.50, 0.20, 0.35
LOCATION_PENALTY, TOPIC_PENALTY = 0.45, 0.55
HIGH, POSSIBLE = 0.80, 0.35
LEAST_USERNAME = 4

FLAGS = ("has_strong_direct", "has_username", "has_name", "name_in_title", "location_match", "employer_match", "location_conflict", "topic_conflict")


def _sought(obs: DataFrame) -> Column:
    """Whether an observation is a subject's term that was sought in the text; observations of other origin may lack the column."""
    return F.coalesce(F.col("extractor") == TOKENS, F.lit(False)) if "extractor" in obs.columns else F.lit(False)


def identifier_matches(obs: DataFrame, terms: DataFrame) -> DataFrame:
    """(source_id, subject_id, signal, detail) of exact joins: email and username, by (kind, normalised value).

    Page facts meet every subject's terms; rows of a subject only its own.
    """
    left = obs.where("type IN ('EMAIL', 'USERNAME')").select("source_id", F.col("subject_id").alias("own"), F.col("type").alias("kind"), "display_value", F.col("value_normalized").alias("norm"))
    right = terms.where("kind IN ('EMAIL', 'USERNAME')").select("subject_id", "kind", "norm").distinct()
    both = left.join(right, ["kind", "norm"]).where(F.col("own").isNull() | (F.col("own") == F.col("subject_id")))
    both = both.where((F.col("kind") != "USERNAME") | (F.length("norm") >= LEAST_USERNAME))
    email = F.col("kind") == "EMAIL"
    signal = F.when(email, "email_match").otherwise("username_match")
    detail = F.when(email, "your email appears here").otherwise(F.concat(F.lit("your username '"), "display_value", F.lit("' appears here")))
    return both.select("source_id", "subject_id", signal.alias("signal"), detail.alias("detail")).distinct()


def attribute_terms(terms: DataFrame) -> DataFrame:
    """The subjects' places and employers: subject_id, type of the observation they match, norm, value in lower case."""
    kind = F.when(F.col("kind") == "EMPLOYER", "EMPLOYER").otherwise("LOCATION")
    return terms.where("kind IN ('CITY', 'COUNTRY', 'EMPLOYER')").select("subject_id", kind.alias("type"), "norm", F.lower("value").alias("low"))


def attribute_matches(obs: DataFrame, terms: DataFrame, pairs: DataFrame) -> DataFrame:
    """(source_id, subject_id, signal, detail) of places and employers, for pairs(source_id, subject_id) that something else points to.

    A page's facts meet the pairs of that page first, then each pair's own terms, so a place that a third of all pages
    name and a third of all subjects live in makes no product of both.
    """
    place = F.col("type") == "LOCATION"
    norm = F.when(place, F.col("value_normalized")).otherwise(T.norm(F.col("display_value")))
    facts = obs.where("type IN ('LOCATION', 'EMPLOYER', 'ORGANISATION')").select("source_id", F.col("subject_id").alias("own"), F.when(place, "LOCATION").otherwise("EMPLOYER").alias("type"), "display_value", norm.alias("norm"))
    both = facts.join(pairs.select("source_id", "subject_id"), "source_id").where("own IS NULL OR own = subject_id")
    met = both.join(attribute_terms(terms).select("subject_id", "type", "norm").distinct(), ["subject_id", "type", "norm"])
    detail = F.when(place, F.concat(F.lit("location '"), "display_value", F.lit("' matches yours"))).otherwise(F.concat(F.lit("employer '"), "display_value", F.lit("' matches yours")))
    return met.select("source_id", "subject_id", F.when(place, "location_match").otherwise("employer_match").alias("signal"), detail.alias("detail")).distinct()


def phone_matches(obs: DataFrame, terms: DataFrame) -> DataFrame:
    """(source_id, subject_id, obs_id) of equal digits, or of equal last nine: two exact joins, no pair of other numbers is looked at."""
    d = T.digits(F.col("value_normalized"))
    left = obs.where("type = 'PHONE'").select("source_id", "obs_id", d.alias("digits")).where(F.length("digits") >= 7)
    right = terms.where("kind = 'PHONE' AND digits <> ''").select("subject_id", "digits", "last9")
    whole = left.join(right.select("subject_id", "digits"), "digits").select("source_id", "subject_id", "obs_id")
    tail = left.where(F.length("digits") >= 9).withColumn("last9", F.right("digits", F.lit(9))).join(right.where("last9 IS NOT NULL").select("subject_id", "last9"), "last9").select("source_id", "subject_id", "obs_id")
    return whole.unionByName(tail).distinct()


#: Names that share a first token are met by that token alone up to so many; more are met by first and last token together.
COMMON_NAME = 64


def name_matches(obs: DataFrame, terms: DataFrame, common: int = COMMON_NAME) -> DataFrame:
    """(source_id, subject_id, in_title): observed names or titles that hold first and last token of a subject's name.

    A name's first token is met by an equi-join, its last one tested on what meets. First tokens that more than `common`
    names have (counted) are met by the pair of first and last token: only where one stands in an observed name are its
    pairs formed, so an observed "john" meets the names whose last token stands beside it, and not every John.
    """
    tokens = F.array_distinct(T.tokens(F.col("display_value")))
    named = obs.where(F.col("type").isin("NAME", "PAGE_TITLE")).select("source_id", F.col("subject_id").alias("own"), (F.col("type") == "PAGE_TITLE").alias("in_title"), tokens.alias("tokens"), F.size(T.tokens(F.col("display_value"))).alias("n"))
    each = named.where("n >= 2").select("*", F.explode("tokens").alias("first_token"))
    names = terms.where("first_token IS NOT NULL").select("subject_id", "first_token", "last_token").distinct()
    often = names.groupBy("first_token").agg(F.count("*").alias("k")).where(F.col("k") > common).select("first_token")
    rare = each.join(names.join(often, "first_token", "left_anti"), "first_token").where(F.expr("array_contains(tokens, last_token)"))
    pairs = each.join(often, "first_token", "left_semi").select("*", F.explode("tokens").alias("last_token"))
    both = rare.unionByName(pairs.join(names.join(often, "first_token", "left_semi"), ["first_token", "last_token"]))
    return both.where("own IS NULL OR own = subject_id").groupBy("source_id", "subject_id").agg(F.max("in_title").alias("in_title"))


def domain_matches(sources: DataFrame, terms: DataFrame) -> DataFrame:
    """(source_id, subject_id, registrable_domain) of sources on a subject's own domain."""
    own = terms.where("kind = 'DOMAIN'").select("subject_id", F.col("norm").alias("d")).distinct()
    return sources.where("registrable_domain <> ''").withColumn("d", F.lower("registrable_domain")).join(own, "d").select("source_id", "subject_id", "registrable_domain")


def _signal(kind: str, name: str, detail: Column, weight: float) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.lit(name).alias("name"), detail.alias("detail"), F.lit(weight).alias("weight")).cast(SIGNAL)


def signals(sources: DataFrame, obs: DataFrame, terms: DataFrame) -> DataFrame:
    """One row per (source, subject) with any evidence: the FLAGS, supporting and contradicting signals.

    Correlated signals count once: a family is a flag. Direct signals stand once per distinct detail; names, places and
    employers once. Places on a page that aren't the subject's contradict if a name matches and no place does; a title
    about another person contradicts if the name isn't in it. Places and employers alone point to nobody: pairs come from
    the other signals, and are then held against the page's places and employers.
    """
    rows = identifier_matches(obs, terms)
    rows = rows.unionByName(phone_matches(obs, terms).select("source_id", "subject_id", F.lit("phone_match").alias("signal"), F.lit("your phone number appears here").alias("detail")).distinct())
    named = name_matches(obs, terms)
    rows = rows.unionByName(named.select("source_id", "subject_id", F.when(F.col("in_title"), "name_in_title").otherwise("name_match").alias("signal"), F.lit("your name appears here").alias("detail")))
    rows = rows.unionByName(domain_matches(sources, terms).select("source_id", "subject_id", F.lit("owned_domain").alias("signal"), F.concat(F.lit("source is on your domain "), "registrable_domain").alias("detail")))
    rows = durable(rows)
    rows = rows.unionByName(attribute_matches(obs, terms, rows.select("source_id", "subject_id").distinct()))
    has = lambda *names: F.coalesce(F.bool_or(F.col("signal").isin(*names)), F.lit(False))
    of = lambda name: F.array_sort(F.collect_set(F.when(F.col("signal") == name, F.col("detail"))))
    pairs = rows.groupBy("source_id", "subject_id").agg(
        has("email_match", "phone_match", "owned_domain").alias("has_strong_direct"), has("username_match").alias("has_username"), has("name_match", "name_in_title").alias("has_name"), has("name_in_title").alias("name_in_title"),
        has("location_match").alias("location_match"), has("employer_match").alias("employer_match"),
        of("owned_domain").alias("domains"), of("email_match").alias("emails"), of("phone_match").alias("phones"), of("username_match").alias("usernames"), of("location_match").alias("places"), of("employer_match").alias("employers"),
    )
    # places of the subjects' own in the text don't contradict: only those that an extractor says the page is about
    places = obs.where(F.expr("type = 'LOCATION'") & ~_sought(obs)).select("source_id", F.col("subject_id").alias("own"), F.col("value_normalized").alias("place"))
    known = terms.where("kind IN ('CITY', 'COUNTRY')").groupBy("subject_id").agg(F.collect_set("norm").alias("known"))
    other = places.join(pairs.select("source_id", "subject_id"), "source_id").where("own IS NULL OR own = subject_id").join(known, "subject_id").where("NOT array_contains(known, place)").groupBy("source_id", "subject_id").agg(F.min("place").alias("elsewhere"))
    titles = obs.where("type = 'PAGE_TITLE'").groupBy("source_id").agg(F.min_by("display_value", "obs_id").alias("page_title"))
    names = terms.where("kind = 'NAME'").groupBy("subject_id").agg(F.collect_set("value").alias("all_names"))
    pairs = pairs.join(other, ["source_id", "subject_id"], "left").join(titles, "source_id", "left").join(names, "subject_id", "left")
    topic = T.page_topic_name(F.col("page_title"))
    pairs = pairs.withColumn("topic", topic)
    conflict = F.col("has_name") & F.col("elsewhere").isNotNull() & ~F.col("location_match")
    about_other = F.col("has_name") & ~F.col("name_in_title") & F.col("topic").isNotNull() & ~F.coalesce(T.name_match(F.col("topic"), F.col("all_names")), F.lit(False))
    pairs = pairs.withColumn("location_conflict", conflict).withColumn("topic_conflict", F.coalesce(about_other, F.lit(False)))
    each = lambda c, kind, name, weight: F.transform(F.col(c), lambda d: _signal(kind, name, d, weight))
    one = lambda c, kind, name, weight: F.transform(F.slice(F.col(c), 1, 1), lambda d: _signal(kind, name, d, weight))
    supporting = F.concat(
        each("domains", "DIRECT", "owned_domain", STRONG), each("emails", "DIRECT", "email_match", STRONG), each("phones", "DIRECT", "phone_match", STRONG), each("usernames", "DIRECT", "username_match", USERNAME),
        F.when(F.col("has_name"), F.array(_signal("IDENTITY", "name_match", F.lit("your name appears here"), NAME))).otherwise(F.array().cast(f"array<{SIGNAL}>")),
        one("places", "LOCATION", "location_match", LOCATION), one("employers", "PROFESSIONAL", "employer_match", EMPLOYER),
    )
    against = F.array_compact(F.array(F.when(F.col("location_conflict"), _signal("CONTRADICTION", "location_conflict", F.concat(F.lit("page places this person in '"), "elsewhere", F.lit("', which differs from your locations")), LOCATION_PENALTY)), F.when(F.col("topic_conflict"), _signal("CONTRADICTION", "page_topic_conflict", F.concat(F.lit("this page is about '"), "topic", F.lit("'; you are only mentioned on it")), TOPIC_PENALTY))))
    return pairs.select("source_id", "subject_id", *FLAGS, supporting.alias("supporting"), against.alias("contradicting"))


def confidence() -> Column:
    """Noisy-or over the families that hold, less the penalties, within 0 and 1."""
    families = F.array(*(F.when(F.col(c), w).otherwise(0.0) for c, w in (("has_strong_direct", STRONG), ("has_username", USERNAME), ("has_name", NAME), ("location_match", LOCATION), ("employer_match", EMPLOYER))))
    penalty = F.when(F.col("location_conflict"), LOCATION_PENALTY).otherwise(0.0) + F.when(F.col("topic_conflict"), TOPIC_PENALTY).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.aggregate(families, F.lit(0.0), lambda c, f: c + f - c * f) - penalty))


def state() -> Column:
    """HIGH_CONFIDENCE only on distinctive or corroborated evidence; contradicted soft evidence is AMBIGUOUS."""
    soft = F.col("location_match").cast("int") + F.col("employer_match").cast("int")
    against = F.col("location_conflict") | F.col("topic_conflict")
    sure = F.when(against, "AMBIGUOUS").otherwise("HIGH_CONFIDENCE")
    return (
        F.when(F.col("has_strong_direct"), F.when(F.col("location_conflict"), "POSSIBLE").otherwise("HIGH_CONFIDENCE"))
        .when(F.col("has_username") & (F.col("has_name") | (soft >= 1)), sure)
        .when(F.col("has_name") & (soft >= 2), sure)
        .when(F.col("has_name") & (soft == 1), F.when(against, "AMBIGUOUS").otherwise("POSSIBLE"))
        .when(F.col("has_name") | F.col("has_username"), "POSSIBLE")
        .otherwise("AMBIGUOUS")
    )


def judge(pairs: DataFrame) -> DataFrame:
    """Adds state and confidence, held to each other's range, to rows with FLAGS."""
    c = F.col("_c")
    clamped = F.when(F.col("state") == "HIGH_CONFIDENCE", F.greatest(c, F.lit(HIGH))).when(F.col("state") == "POSSIBLE", F.least(F.greatest(c, F.lit(POSSIBLE)), F.lit(HIGH - 0.01))).otherwise(F.least(c, F.lit(POSSIBLE)))
    return pairs.withColumn("_c", confidence()).withColumn("state", state()).withColumn("confidence", F.round(clamped, 3)).drop("_c")


def resolve(sources: DataFrame, obs: DataFrame, terms: DataFrame) -> DataFrame:
    """Match rows of every (source, subject) with any evidence."""
    out = judge(signals(sources, obs, terms))
    key = F.sha2(F.concat_ws("|", "source_id", "subject_id"), 256)
    return out.select(key.alias("match_id"), "source_id", "subject_id", "state", "confidence", "supporting", "contradicting", F.lit(VERSIONS["resolver"]).alias("resolution_version"), F.lit(False).alias("user_overridden"))


def anchored(matches: DataFrame) -> DataFrame:
    """Matches that may give findings: not rejected, with an identity or direct signal."""
    return matches.where((F.col("state") != "REJECTED") & F.exists("supporting", lambda s: s["kind"].isin("IDENTITY", "DIRECT")))


def apply_decisions(rows: DataFrame, decisions: DataFrame, keys: list[str], confidence_column: str = "confidence") -> DataFrame:
    """Overrides state and confidence by the newest decision (me, not_me, unsure) on the same keys; other words raise an error; unsure keeps the confidence."""
    newest = decisions.groupBy(*keys).agg(F.max_by("decision", "decided_at").alias("decision"))
    out = rows.join(newest, keys, "left")
    decided = F.when(F.col("decision") == "me", "CONFIRMED").when(F.col("decision") == "not_me", "REJECTED").when(F.col("decision") == "unsure", "AMBIGUOUS").when(F.col("decision").isNotNull(), F.raise_error(F.concat(F.lit("unknown decision: "), "decision")).cast("string"))
    sure = F.when(F.col("decision") == "me", 1.0).when(F.col("decision") == "not_me", 0.0)
    return out.withColumn("state", F.coalesce(decided, "state")).withColumn(confidence_column, F.coalesce(sure, confidence_column)).withColumn("user_overridden", F.col("decision").isNotNull()).drop("decision")


def own_identifiers(obs: DataFrame, pairs: DataFrame, terms: DataFrame) -> DataFrame:
    """Observations per (source, subject) pair, without other people's identifiers.

    Emails, usernames and phones stay only where they are the subject's, profiles where one of the subject's usernames
    stands in them, places and employers that were sought in the text where they are the subject's; all other kinds
    pass. Rows of one subject never reach another.
    """
    sought = F.col("subject_id").isNull() & _sought(obs)
    both = obs.withColumn("sought", sought).withColumnRenamed("subject_id", "own").join(pairs.select("source_id", "subject_id"), "source_id").where("own IS NULL OR own = subject_id").drop("own")
    of_pair = attribute_terms(terms).select("subject_id", "type", F.col("low").alias("value_normalized"))
    attributes = both.where("sought").join(of_pair, ["subject_id", "type", "value_normalized"], "left_semi").drop("sought")
    both = both.where("NOT sought").drop("sought")
    free = both.where(~F.col("type").isin("EMAIL", "USERNAME", "PHONE", "SOCIAL_LINK")).unionByName(attributes)
    key = terms.where("kind IN ('EMAIL', 'USERNAME')").select("subject_id", F.col("kind").alias("type"), F.col("norm").alias("value_normalized"))
    exact = both.where("type IN ('EMAIL', 'USERNAME')").join(key, ["subject_id", "type", "value_normalized"], "left_semi")
    phones = both.where("type = 'PHONE'").join(phone_matches(obs, terms).select("obs_id", "subject_id"), ["obs_id", "subject_id"], "left_semi")
    handles = terms.where("kind = 'USERNAME'").groupBy("subject_id").agg(F.collect_set("norm").alias("handles"))
    social = both.where("type = 'SOCIAL_LINK'").join(handles, "subject_id").where(F.exists("handles", lambda h: F.contains("value_normalized", h))).drop("handles")
    return free.unionByName(exact.select(*free.columns)).unionByName(phones.select(*free.columns)).unionByName(social.select(*free.columns))
