"""Registered queries: each runs an operator over the given tables, or over data that Spark derives from them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetrail.functions import html as H
from pagetrail.functions import sql
from pagetrail.functions import text as T
from pagetrail.functions import urls as U
from pagetrail.operators import assess, discover, extract, remediate, report, resolve, verify
from pagetrail.plans.scan import Scan, scan
from pagetrail.schema import TRANSITIONS
from pagetrail.session import shared_dir
from pagetrail.sources import tables
from pagetrail.streaming import jobs

STATES = tuple(TRANSITIONS)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt over as many tasks as a shuffle has: a small file of keys is one task's, but what is made of them below may be a thousand times its size."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


# Inputs that Spark derives from the given tables.


def crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as HTML and documents as plain text, as one crawl."""
    p = read(spark, sf_dir, "pages").select("url", "html", F.lit("text/html; charset=utf-8").alias("content_type"), (F.col("page_id") % 2 == 0).alias("from_search"), F.col("page_id").alias("position"))
    d = read(spark, sf_dir, "documents").select(F.concat(F.lit("https://docs.example.net/d/"), F.col("doc_id").cast("string")).alias("url"), F.col("text").alias("html"), F.lit("text/plain").alias("content_type"), (F.col("doc_id") % 2 == 0).alias("from_search"), F.col("doc_id").alias("position"))
    return p.unionByName(d).withColumn("scan_id", F.lit("s1"))


def enrolled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One subject per distinct email in documents: name and username from its local part, a country from nation."""
    emails = read(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(T.EMAIL), F.lit(0))).alias("e")).select(F.lower("e").alias("email")).distinct()
    local = F.substring_index("email", "@", 1)
    n = F.crc32(F.col("email").cast("binary")) % 25
    rows = emails.withColumn("nk", n).join(F.broadcast(read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("nk"), "n_name")), "nk")
    null = F.lit(None).cast("string")
    return rows.select(
        F.sha2("email", 256).alias("subject_id"), F.array(F.struct(F.initcap(F.regexp_replace(local, "[._0-9]+", " ")).alias("value"), F.lit(True).alias("is_primary"))).alias("names"),
        F.array(F.struct(null.alias("city"), F.initcap("n_name").alias("country"))).alias("locations"), F.array().cast("array<struct<name:string,domain:string,is_current:boolean>>").alias("employers"),
        F.array(local).alias("usernames"), F.array("email").alias("emails"), F.array().cast("array<string>").alias("phones"), F.array().cast("array<string>").alias("personal_domains"), F.lit(None).cast("timestamp").alias("created_at"),
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects from customer and nation, with two-part names, handles, emails, phones and places."""
    c = spread(read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey"), "c_custkey").join(F.broadcast(read(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey").cast("string")
    number = F.concat(F.lit("+44 20 "), F.substring(F.lpad(k, 9, "7"), 1, 4), F.lit(" "), F.substring(F.lpad(k, 9, "7"), 5, 5))
    return c.select(
        k.alias("subject_id"), F.array(F.struct(F.concat(F.lit(" "), F.initcap("c_mktsegment"), F.lit(" "), F.replace("c_name", F.lit("#"), F.lit("")), F.lit(" ")).alias("value"), F.lit(True).alias("is_primary"))).alias("names"),
        F.array(F.struct(F.lit("Springfield").alias("city"), F.initcap("n_name").alias("country")), F.struct(F.lit("springfield").alias("city"), F.upper("n_name").alias("country"))).alias("locations"),
        F.array(F.struct(F.concat(F.initcap("c_mktsegment"), F.lit(" Works")).alias("name"), F.lit(None).cast("string").alias("domain"), F.lit(True).alias("is_current"))).alias("employers"),
        F.array(F.concat(F.lit("user"), k)).alias("usernames"), F.array(F.concat(F.lit("c"), k, F.lit("@Mail.Example.com"))).alias("emails"), F.array(number).alias("phones"), F.array(F.concat(F.lit("C"), k, F.lit(".example.org"))).alias("personal_domains"), F.lit(None).cast("timestamp").alias("created_at"),
    )


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile page per customer: JSON-LD, meta tags, mail, phone and social links, a birth date and an address in its text."""
    c = read(spark, sf_dir, "customer").join(F.broadcast(read(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    k, name = F.col("c_custkey").cast("string"), F.concat(F.initcap("c_mktsegment"), F.lit(" "), F.replace("c_name", F.lit("#"), F.lit("")))
    page = F.concat(
        F.lit('<html><head><title>'), name, F.lit(' | Directory</title><meta property="og:title" content="'), name, F.lit('"><script type="application/ld+json">{"@type":"Person","name":"'), name,
        F.lit('","jobTitle":["Clerk"],"worksFor":{"name":"'), F.initcap("c_mktsegment"), F.lit(' Works"},"email":"mailto:c'), k, F.lit('@mail.example.com","birthDate":"1980-05-03","address":{"streetAddress":"'), k,
        F.lit(' Oak Street","addressCountry":"'), F.col("n_name"), F.lit('"},"sameAs":["https://github.com/user'), k, F.lit('"]}</script></head><body><p>Born 3 May 1980. Lives at '), k, F.lit(' Elm Tree Road, '), F.initcap("n_name"), F.lit('.</p><p>Phone: 020 7946 '), F.lpad(k, 6, "0"),
        F.lit('</p><a href="mailto:c'), k, F.lit('@mail.example.com?subject=x">mail</a><a href="tel:+4420'), F.lpad(k, 8, "7"), F.lit('">call</a><a href="https://www.linkedin.com/in/user'), k, F.lit('">in</a></body></html>'),
    )
    return spread(c.select("c_custkey", "c_name", "c_mktsegment", "n_name"), "c_custkey").select(F.concat(F.lit("https://people.example.org/c/"), k).alias("url"), page.alias("html"), F.lit("text/html").alias("content_type"), F.lit(True).alias("from_search"), F.lit("s2").alias("scan_id"), F.col("c_custkey").cast("long").alias("position"))


def case_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as case events: the user is the case, the event's number and type pick the target state."""
    target = F.element_at(F.array(*map(F.lit, STATES)), (F.col("event_id") % len(STATES) + 1).cast("int"))
    return read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("case_id"), F.col("ts").cast("timestamp").alias("at"), "event_id", F.when(F.col("event_type") == "purchase", "REQUEST_PREPARED").otherwise(target).alias("target_state"))


def rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A finding per order: category, domain, search flag and match state picked by its key."""
    o = read(spark, sf_dir, "orders")
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))
    k = F.col("o_orderkey")
    return o.select(
        k.cast("string").alias("finding_id"), F.col("o_custkey").cast("string").alias("subject_id"), pick(sorted(assess.WHAT), k).alias("category"), (k % 3 == 0).alias("from_search"), pick(("example.com", "agency.gov", "github.com", "data.europa.eu", "shop.example.org"), F.floor(k / 4)).alias("registrable_domain"),
        pick(("CONFIRMED", "HIGH_CONFIDENCE", "POSSIBLE", "AMBIGUOUS", "REJECTED"), F.floor(k / 8)).alias("match_state"), F.when(k % 2 == 0, F.array(F.lit("CONTACT_PHONE"))).otherwise(F.array().cast("array<string>")).alias("categories_on_source"), F.concat(F.lit("src"), (k % 1000).cast("string")).alias("source_id"),
    )


def flat(df: DataFrame, *names: str) -> DataFrame:
    """Arrays of strings joined by ";", so that engines agree on their form."""
    return df.withColumns({n: F.array_join(n, ";") for n in names})


# Queries. A name starts with the operators' ids in the survey.


def b1_canonical_url(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", U.canonical_url(F.col("url")).alias("canonical_url"))


def b2_registrable_domain(spark, sf_dir):
    return U.with_registrable_domain(read(spark, sf_dir, "pages").select("page_id", "url"), "url").select("page_id", "registrable_domain")


def b3_resolved_links(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select("page_id", "url", F.explode(H.links(F.col("html"))).alias("href"))
    return p.select("page_id", U.resolve_link(F.col("url"), F.col("href")).alias("link")).groupBy("page_id").agg(F.count("*").alias("n_links"), F.count_distinct("link").alias("n_distinct"))


def b4_url_policy(spark, sf_dir):
    kind = F.col("page_id") % 7
    u = F.when(kind == 0, F.replace("url", F.lit("http"), F.lit("ftp"))).when(kind == 1, F.lit("http://localhost/x")).when(kind == 2, F.concat(F.lit("http://10.0.0."), (F.col("page_id") % 250).cast("string"), F.lit("/"))).when(kind == 3, F.lit(" ")).otherwise(F.col("url"))
    return read(spark, sf_dir, "pages").select("page_id", U.url_policy(u).alias("policy"))


def b5_blocked_addresses(spark, sf_dir):
    e = F.col("event_id")
    ip = F.concat_ws(".", *((F.floor(e / d) * m % 256).cast("string") for d, m in ((1, 1), (256, 7), (64, 11), (1, 5))))
    return read(spark, sf_dir, "events").select("event_id", U.is_blocked_ipv4(ip).alias("blocked"))


def b6_b7_masks(spark, sf_dir):
    c = customers(spark, sf_dir)
    return c.select("subject_id", T.mask_email(F.col("emails")[0]).alias("email"), T.mask_phone(F.col("phones")[0]).alias("phone"))


def b8_redact(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.sha2(T.redact(F.col("text")), 256).alias("redacted"))


def b8_redact_documents(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", T.redact(F.col("text")).alias("redacted"))


def b9_redact_map(spark, sf_dir):
    m = T.redact_map(F.create_map(F.lit("role"), F.col("role"), F.lit("text"), F.concat(F.col("text"), F.lit(" a@b.com "), F.col("conv_id").cast("string"), F.lit("5550123456"))))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", m["role"].alias("role"), F.sha2(m["text"], 256).alias("redacted"))


def b10_parse_html(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select("page_id", H.parse_html(F.col("html")).alias("x"))
    return p.select("page_id", "x.title", F.length("x.text").alias("n_text"), F.size("x.links").alias("n_links"), F.size("x.meta").alias("n_meta"))


def b14_tokens(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select("item_id", T.norm(F.col("text")).alias("norm"), F.size(T.tokens(F.col("text"))).alias("n_tokens"))


def b15_name_match(spark, sf_dir):
    c = customers(spark, sf_dir)
    return c.select("subject_id", T.name_match(F.concat(F.lit("Customer "), F.col("names")[0]["value"]), F.transform("names", lambda n: n["value"])).alias("self"), T.name_match(F.lit("Building Customer000000001"), F.transform("names", lambda n: n["value"])).alias("first"))


def b20_severities(spark, sf_dir):
    s = F.element_at(F.array(*map(F.lit, T.SEVERITIES)), (F.col("l_linenumber") % 5 + 1).cast("int"))
    t = F.element_at(F.array(*map(F.lit, T.SEVERITIES)), (F.col("l_orderkey") % 5 + 1).cast("int"))
    rows = read(spark, sf_dir, "lineitem").select(s.alias("a"), t.alias("b"))
    return rows.groupBy("a", "b").agg(F.count("*").alias("n")).select("a", "b", "n", T.severity_bump(F.col("a"), 2).alias("bumped"), T.severity_max(F.col("a"), F.col("b")).alias("highest"), T.severity_min(F.col("a"), F.col("b")).alias("lowest"))


def a2_search_results(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    hit = F.struct(F.when(F.col("page_id") % 5 != 0, F.col("url")).alias("href"), F.concat(F.lit("t"), F.col("page_id")).alias("title"))
    raw = p.groupBy((F.col("page_id") % 17).alias("q")).agg(F.to_json(F.struct(F.array_sort(F.collect_list(hit)).alias("results"))).alias("payload"))
    return tables.normalize_search_results(raw.select(F.lit("s1").alias("scan_id"), F.lit("any").alias("provider"), F.col("q").cast("string").alias("query"), "payload")).select("query", "rank", "url", "title")


def a3_admit_pages(spark, sf_dir):
    pages = read(spark, sf_dir, "pages").select("page_id", "html", F.when(F.col("page_id") % 4 == 0, "image/png").when(F.col("page_id") % 4 == 1, "Text/HTML; charset=utf-8").when(F.col("page_id") % 4 == 2, "text/plain").alias("content_type"))
    return tables.admit_pages(pages, max_html=4000).select("page_id", "content_type", F.col("n_bytes").cast("long").alias("n_bytes"), "content_hash", "status")


def a4_classify_fetch(spark, sf_dir):
    e = F.element_at(F.array(*map(F.lit, ("", "read timeout", "too_large", "blocked by robots", "unsupported type", "reset"))), (F.col("event_id") % 6 + 1).cast("int"))
    return tables.classify_fetch(read(spark, sf_dir, "events").select("event_id", e.alias("fetch_error"))).select("event_id", "status")


def a6_clean_subjects(spark, sf_dir):
    s = tables.clean_subjects(customers(spark, sf_dir))
    return s.select("subject_id", T.primary_name(F.col("names")).alias("name"), F.size("locations").alias("n_places"), F.col("personal_domains")[0].alias("domain"))


def a1_f2_candidates(spark, sf_dir):
    p = read(spark, sf_dir, "pages")
    found = p.select((F.col("page_id") % 3).cast("string").alias("scan_id"), "url", F.lit("").alias("title"), F.col("page_id").alias("rank"))
    pasted = p.where("page_id % 2 = 0").select((F.col("page_id") % 3).cast("string").alias("scan_id"), F.concat("url", F.lit("#again")).alias("url"), F.col("page_id").alias("position"))
    kept, _ = tables.dedup_candidates(tables.candidates(found, pasted))
    return kept.select("scan_id", "canonical_url", "from_search", "position")


def f5_within_budget(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select((F.col("page_id") % 5).alias("scan_id"), "page_id", F.col("page_id").alias("position"), "url", F.octet_length("html").cast("long").alias("n_bytes"))
    return tables.within_budget(p, documents=100, size=60_000).select("page_id", "scan_id", "n_bytes")


def a8_f6_newest(spark, sf_dir):
    return tables.newest(read(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id")


def a13_search_outcomes(spark, sf_dir):
    s = F.element_at(F.array(*map(F.lit, (200, 401, 429, 500, 202))), (F.col("event_id") % 5 + 1).cast("int"))
    return tables.classify_search_outcome(read(spark, sf_dir, "events").select("event_id", F.lit("web").alias("provider"), s.alias("http_status"), F.when(F.col("event_id") % 11 == 0, "timeout").alias("error"))).groupBy("outcome").agg(F.count("*").alias("n"))


def i25_identifiers(spark, sf_dir):
    key = F.lit("0123456789abcdef")
    protected = tables.protect_identifiers(customers(spark, sf_dir), key, "pepper")
    return tables.reveal_identifiers(protected, key).select("subject_id", "kind", "value", "value_hash", "display")


def i24_subjects_public(spark, sf_dir):
    return flat(tables.subjects_public(tables.clean_subjects(customers(spark, sf_dir))), "names", "locations", "usernames", "emails", "phones", "personal_domains")


def d13_erase(spark, sf_dir):
    f, gone = rated(spark, sf_dir), customers(spark, sf_dir).where("cast(subject_id as long) % 3 = 0").select("subject_id")
    return tables.erase({"findings": f}, gone)["findings"].select("finding_id", "subject_id")


def c4_emails(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.inline(extract.email_hits(F.col("text"))))
    return d.groupBy("doc_id", "value", "display").agg(F.count("*").alias("n"))


def c5_phones(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select("page_id", F.inline(extract.phone_hits(H.visible_text(F.col("html")))))
    d = read(spark, sf_dir, "documents").select((-1 - F.col("doc_id")).alias("page_id"), F.inline(extract.phone_hits(F.col("text"))))
    return p.unionByName(d).groupBy("page_id", "value", "display").agg(F.count("*").alias("n"))


def c1_c9_profile_facts(spark, sf_dir):
    pages = profiles(spark, sf_dir).withColumn("source_id", F.col("url"))
    obs = extract.observations(extract.parse_pages(pages))
    return obs.groupBy("type").agg(F.count("*").alias("n"), F.count_distinct("value_normalized").alias("n_values"), F.min("value_normalized").alias("least"))


def c2_jsonld_people(spark, sf_dir):
    pages = profiles(spark, sf_dir).withColumn("source_id", F.col("url"))
    parsed = extract.parse_pages(pages).select("source_id", F.inline(extract.jsonld_hits(F.col("parsed.jsonld"))))
    return parsed.select("source_id", "type", "value", "display", "sensitive")


def c10_d1_subject_terms(spark, sf_dir):
    texts = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source_id"), "text")
    terms = extract.subject_terms(enrolled(spark, sf_dir)).where("kind = 'EMAIL'")
    return extract.term_matches(texts, terms).select("source_id", "value")


def _scan(spark, sf_dir) -> Scan:
    return scan(crawl(spark, sf_dir), enrolled(spark, sf_dir))


def scan_findings(spark, sf_dir):
    """The flagship: a scan of all pages and documents for all enrolled subjects, in the order of work."""
    s = _scan(spark, sf_dir)
    f = s.findings.join(s.sources.select("source_id", "canonical_url"), "source_id")
    return flat(f, "explanation_codes").select("subject_id", "canonical_url", "category", "overall_priority", "match_state", "identity_confidence", "explanation_codes")


def d2_i5_matches(spark, sf_dir):
    s = _scan(spark, sf_dir)
    m = s.matches.join(s.sources.select("source_id", "canonical_url"), "source_id")
    return m.select("subject_id", "canonical_url", "state", "confidence", F.size("supporting").alias("n_supporting"), F.size("contradicting").alias("n_contradicting"))


def i23_reports(spark, sf_dir):
    s = _scan(spark, sf_dir)
    cases = s.findings.select(F.sha2("finding_id", 256).alias("case_id"), "finding_id", F.lit("SEARCH_DELIST").alias("route"), F.lit("VERIFIED").alias("state"))
    return report.subject_reports(enrolled(spark, sf_dir), s.findings, s.sources, cases)


def e11_evaluation(spark, sf_dir):
    """Auto-confirmed matches of the customers' profile pages, each held against its owner and the next customer."""
    subjects = tables.clean_subjects(customers(spark, sf_dir))
    s = scan(profiles(spark, sf_dir), subjects)
    keyed = s.matches.join(s.sources.select("source_id", F.col("canonical_url").alias("key")), "source_id").select("subject_id", "key", "state")
    own = subjects.select("subject_id", F.concat(F.lit("https://people.example.org/c/"), "subject_id").alias("key"), F.lit(True).alias("is_match"), F.lit("own").alias("tag"))
    other = subjects.select("subject_id", F.concat(F.lit("https://people.example.org/c/"), (F.col("subject_id").cast("long") + 1).cast("string")).alias("key"), F.lit(False).alias("is_match"), F.lit("other").alias("tag"))
    return flat(report.evaluate(keyed, own.unionByName(other)), "offenders")


def i8_assess(spark, sf_dir):
    a = assess.assess(rated(spark, sf_dir))
    return flat(a, "explanation_codes").select("finding_id", "sensitivity", "discoverability", "misuse_potential", "persistence", "overall_priority", "explanation_codes")


def e4_dashboard(spark, sf_dir):
    return report.dashboard(assess.assess(rated(spark, sf_dir)))


def e5_report_summary(spark, sf_dir):
    return report.report_summary(assess.assess(rated(spark, sf_dir)))


def e13_quality_metrics(spark, sf_dir):
    f = rated(spark, sf_dir)
    sources = read(spark, sf_dir, "pages").select(F.when(F.col("page_id") % 3 == 0, "TIMEOUT").otherwise("RETRIEVED").alias("status"), U.canonical_url(F.col("url")).alias("canonical_url"), F.octet_length("html").alias("n_bytes"))
    ran = read(spark, sf_dir, "events").select((F.col("event_id") % 10 != 0).alias("ran"))
    return report.quality_metrics(f, sources, f.where("cast(finding_id as long) % 2 = 0").select("finding_id"), ran)


def i12_routes(spark, sf_dir):
    today = F.to_date(F.lit("2026-09-01"))
    return remediate.routes(rated(spark, sf_dir), tables.clean_subjects(customers(spark, sf_dir)), remediate.default_registry(spark), today)


def i15_transitions(spark, sf_dir):
    e = case_events(spark, sf_dir).select("event_id", F.element_at(F.array(*map(F.lit, STATES)), (F.col("event_id") % 13 + 1).cast("int")).alias("state"), F.col("target_state").alias("target"))
    return remediate.allowed_events(e, spark).select("event_id", "state", "target")


def i16_case_fold(spark, sf_dir):
    return remediate.fold_case_events(case_events(spark, sf_dir)).select("case_id", "state", "n_applied", "n_rejected")


def f10_timelines(spark, sf_dir):
    e = case_events(spark, sf_dir).select("case_id", "at", F.col("target_state").alias("kind"), F.col("event_id").cast("string").alias("detail"))
    return remediate.case_timeline(e).select("case_id", F.size("events").alias("n_events"), F.col("events")[0]["detail"].alias("first"), F.element_at("events", -1)["detail"].alias("last"))


def i17_i18_verify(spark, sf_dir):
    """Pages re-crawled: by number blocked, gone, blank, changed or the same; cases in re-checkable states advance."""
    n = F.col("page_id")
    p = read(spark, sf_dir, "pages")
    text = H.visible_text(F.col("html"))
    recorded = p.select(n.alias("key"), "page_id", F.col("url").alias("canonical_url"), F.sha2("html", 256).alias("content_hash"), F.when(n % 2 == 0, F.array(F.lit("x@example.com"))).otherwise(F.array().cast("array<string>")).alias("targets"))
    again = p.where(n % 13 != 0).select("page_id", F.when(n % 11 == 0, "RETRIEVAL_BLOCKED").when(n % 11 == 1, "TIMEOUT").otherwise("RETRIEVED").alias("status"), F.when(n % 11 == 2, 404).when(n % 11 == 3, 410).otherwise(200).alias("http_status"), F.sha2(F.when(n % 5 == 0, F.concat("html", F.lit("x"))).otherwise(F.col("html")), 256).alias("content_hash"), (n % 7 == 0).alias("is_blank"))
    seen = p.where(n % 4 == 0).select("page_id", F.lit("x@example.com").alias("value_normalized"))
    v = verify.verify_sources(recorded, again, seen, by="page_id")
    cases = p.select(n.alias("case_id"), F.element_at(F.array(*map(F.lit, STATES)), (n % len(STATES) + 1).cast("int")).alias("state"))
    return verify.advance_cases(cases, v.withColumnRenamed("key", "case_id"))


def e9_recheck_summary(spark, sf_dir):
    return verify.recheck_summary(i17_i18_verify(spark, sf_dir))


def d11_search_presence(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select("page_id", U.canonical_url(F.col("url")).alias("canonical_url"), (F.col("page_id") % 20).cast("string").alias("query"))
    failures = p.where("page_id % 20 = 7").select("query", F.lit("Timeout").alias("error"))
    return verify.search_presence(p.withColumnRenamed("page_id", "key"), p.where("page_id % 3 = 0").select("query", "canonical_url"), failures)


def g1_page_diff(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select(F.lit("s").alias("subject_id"), U.canonical_url(F.col("url")).alias("canonical_url"), "page_id")
    return verify.page_diff(p.where("page_id % 3 <> 0"), p.where("page_id % 3 <> 1")).select("canonical_url", "change")


def i10_plan_queries(spark, sf_dir):
    return discover.plan_queries(tables.clean_subjects(customers(spark, sf_dir)))


def i11_runnable(spark, sf_dir):
    plan = discover.plan_queries(tables.clean_subjects(customers(spark, sf_dir)))
    return discover.sensitive_counts(discover.runnable(plan, customers(spark, sf_dir).where("cast(subject_id as long) % 2 = 0")))


def e7_scan_stats(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("scan_id", (F.col("user_id") % 40).cast("string"))
    plan = e.select("scan_id", (F.col("event_id") % 5 == 0).alias("sensitive"), (F.col("event_id") % 10 != 0).alias("ran"))
    sources = e.select("scan_id", F.when(F.col("event_id") % 3 == 0, "RETRIEVED").when(F.col("event_id") % 3 == 1, "RETRIEVAL_BLOCKED").otherwise("TIMEOUT").alias("status"), F.col("event_id").alias("n_bytes"))
    out = report.scan_stats(plan, sources, e.where("event_id % 4 = 0").select("scan_id"), e.where("user_id % 40 < 5").select("scan_id", F.lit("web_timeout").alias("error")))
    return flat(out.withColumn("progress", report.progress_pct(F.lit("reading"))), "provider_errors")


def l1_sql_functions(spark, sf_dir):
    sql.register_functions(spark)
    read(spark, sf_dir, "documents").createOrReplaceTempView("pagetrail_documents")
    return spark.sql("SELECT doc_id, redact(text) AS redacted, severity_bump('LOW', cast(doc_id % 5 AS int)) AS bumped, mask_email(concat('user', doc_id, '@example.com')) AS masked FROM pagetrail_documents")


def k2_scan_progress_stream(spark, sf_dir):
    schema = read(spark, sf_dir, "events").schema
    src = spark.readStream.schema(schema).option("pathGlobFilter", "*").parquet(f"{sf_dir}/events.parquet*")
    rows = src.select(F.lit("s1").alias("scan_id"), F.when(F.col("event_id") % 3 == 0, "RETRIEVED").otherwise("RETRIEVAL_BLOCKED").alias("status"), F.col("event_id").alias("n_bytes"), F.col("ts").cast("timestamp").alias("at"))
    return _drain(spark, jobs.scan_progress(rows, "1 day"), "complete")


def k3_case_stream(spark, sf_dir):
    schema = read(spark, sf_dir, "events").schema
    jobs.use_rocksdb(spark)
    src = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    target = F.element_at(F.array(*map(F.lit, STATES)), (F.col("event_id") % len(STATES) + 1).cast("int"))
    rows = src.select(F.col("user_id").cast("string").alias("case_id"), F.col("ts").cast("timestamp").alias("at"), "event_id", F.when(F.col("event_type") == "purchase", "REQUEST_PREPARED").otherwise(target).alias("target_state"))
    done = _drain(spark, jobs.case_states(rows), "update")
    return done.groupBy("case_id").agg(F.max_by("state", F.struct("at", "event_id")).alias("state"), F.count_if("accepted").alias("n_applied"), F.count_if(~F.col("accepted")).alias("n_rejected"))


def k4_first_sights_stream(spark, sf_dir):
    schema = read(spark, sf_dir, "pages").schema
    src = spark.readStream.schema(schema).parquet(f"{sf_dir}/pages.parquet*")
    rows = src.select(F.lit("s1").alias("scan_id"), "url", F.timestamp_seconds(F.col("page_id") + 86400).alias("at"))
    return _drain(spark, jobs.first_sights(rows, "30 days"), "append").select("canonical_url")


def _drain(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over all that is there, batch by batch into a table in the shared folder, and reads the table."""
    base = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{base}/out/batch={n}")
    q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out").select(*stream.columns)


_HELPERS = {"read", "spread", "crawl", "enrolled", "customers", "profiles", "case_events", "rated", "flat", "scan"}
QUERIES = {k: f for k, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and not k.startswith("_") and k not in _HELPERS}
