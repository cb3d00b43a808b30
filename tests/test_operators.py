import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from pagetrail.operators import assess, discover, extract, remediate, report, resolve, verify
from pagetrail.plans.scan import scan
from pagetrail.schema import SUBJECTS
from pagetrail.sources import tables

PAGES = "scan_id string, url string, html string, content_type string, from_search boolean"


@pytest.fixture(scope="module")
def subjects(spark):
    rows = [
        ("s1", [("Maya Quill", True)], [("Lyon", "France")], [("Orchard Labs", None, True)], ["mayaq77"], ["Maya@quill.example"], ["+44 20 7946 0958"], ["quill.example.org"], None),
        ("s2", [("Tom Reed", True)], [(None, "USA")], [], [], [], [], [], None),
        ("s3", [], [], [], [], [], [], [], None),
    ]
    return tables.clean_subjects(spark.createDataFrame(rows, SUBJECTS))


@pytest.fixture(scope="module")
def result(spark, subjects):
    own = '<html><head><title>Maya Quill</title></head><body><p>maya@quill.example other@else.example</p><p>12 Elm Tree Road</p><p>tel 020 7946 0958</p><a href="https://github.com/mayaq77">g</a><a href="https://github.com/stranger">h</a></body></html>'
    pages = [
        ("x", "https://people.example.com/maya?utm_source=a", own, "text/html", True),
        ("x", "https://news.example.com/1", "<html><head><title>Ada Byron - News</title></head><body>Maya Quill of Orchard Labs in Lyon</body></html>", "text/html", False),
        ("x", "https://news.example.com/2", "<html><head><title>x</title></head><body>Maya Quill of Orchard Labs in Lyon</body></html>", "text/html", False),
        ("x", "https://news.example.com/3", "Maya Quill only", "text/plain", False),
        ("x", "https://img.example.com/4", "Maya Quill", "image/png", False),
        ("x", "https://none.example.com/5", "nobody here", "text/plain", False),
        ("x", "https://none.example.com/6", None, "text/html", None),
    ]
    return scan(spark.createDataFrame(pages, PAGES), subjects)


def test_scan_states(result):
    rows = result.matches.join(result.sources.select("source_id", "canonical_url"), "source_id").collect()
    got = {(r.subject_id, r.canonical_url.rsplit("/", 1)[1]): (r.state, r.confidence) for r in rows}
    assert got[("s1", "maya")][0] == "HIGH_CONFIDENCE"
    assert got[("s1", "1")][0] == "AMBIGUOUS"  # about somebody else
    assert got[("s1", "2")][0] == "HIGH_CONFIDENCE"
    assert got[("s1", "3")] == ("POSSIBLE", 0.5)
    assert not any(u in ("4", "5", "6") for _, u in got)


def test_scan_keeps_every_source(result):
    assert {r.status: r.n for r in result.sources.groupBy("status").agg(F.count("*").alias("n")).collect()} == {"RETRIEVED": 6, "UNSUPPORTED_TYPE": 1}


def test_scan_findings_hold_no_strangers(result):
    rows = result.findings.join(result.sources.select("source_id", "canonical_url"), "source_id").where("canonical_url LIKE '%/maya'").collect()
    by = {r.category: r for r in rows}
    assert set(by) == {"CONTACT_EMAIL", "CONTACT_PHONE", "HOME_ADDRESS", "SOCIAL_PROFILE", "USERNAME"}
    values = {r.obs_id: r.value_normalized for r in result.observations.collect()}
    assert [values[o] for o in by["CONTACT_EMAIL"].observation_ids] == ["maya@quill.example"]
    assert [values[o] for o in by["SOCIAL_PROFILE"].observation_ids] == ["https://github.com/mayaq77"]
    assert by["HOME_ADDRESS"].overall_priority == "CRITICAL" and "DIRECT_PHONE_PRESENT" in by["HOME_ADDRESS"].explanation_codes
    assert by["CONTACT_EMAIL"].explanation_codes[:2] == ["BASE_CONTACT_EMAIL", "SEARCH_INDEXED"]


def test_scan_is_idempotent(spark, subjects, result):
    again = scan(spark.createDataFrame([("x", "https://news.example.com/3", "Maya Quill only", "text/plain", False)], PAGES), subjects)
    assert {r.match_id for r in again.matches.collect()} <= {r.match_id for r in result.matches.collect()}


def test_jsonld_shapes(spark):
    def hits(node):
        html = f'<script type="application/ld+json">{json.dumps(node)}</script>'
        df = extract.parse_pages(spark.createDataFrame([("p", "text/html", html)], "source_id string, content_type string, html string"))
        return {(r.type, r.value) for r in extract.page_observations(df).collect()}

    assert hits({"@graph": [{"@type": ["Thing", "Person"], "name": "A B", "address": "1 X St", "worksFor": ["Acme", {"name": "Zed"}]}]}) == {("NAME", "a b"), ("POSTAL_ADDRESS", "1 x st"), ("EMPLOYER", "acme"), ("EMPLOYER", "zed")}
    assert hits([{"@type": "Organization", "name": "Org"}, {"@type": "Organization"}, 3]) == {("ORGANISATION", "org")}
    assert hits("text") == set()


def test_links_and_births(spark):
    def of(f, text, kind="string"):
        return {(h.type, h.value) for h in spark.createDataFrame([(text,)], f"v {kind}").select(f(F.col("v"))).first()[0]}

    assert of(extract.link_hits, ["mailto:A@b.co?subject=x", "mailto:broken", "tel:+44 20 7946 0958", "tel:123"], "array<string>") == {("EMAIL", "a@b.co"), ("PHONE", "+442079460958")}
    assert of(extract.birth_hits, "Date of birth: 3 May 1980. Published so long after that nobody minds: 4 May 1981") == {("DATE_OF_BIRTH", "3 may 1980")}


def test_term_matches_equal_brute_force(spark):
    texts = [("a", "The Quick fox"), ("b", "quicker"), ("c", None), ("d", ""), ("e", "fo")]
    terms = [("s1", "NAME", "quick"), ("s2", "NAME", "FOX"), ("s3", "NAME", "fo"), ("s4", "NAME", "zzz"), ("s1", "CITY", "ker")]
    got = extract.term_matches(spark.createDataFrame(texts, "source_id string, text string"), spark.createDataFrame(terms, "subject_id string, kind string, value string"))
    want = {(a, s, k, v) for a, t in texts for s, k, v in terms if t and len(v) >= 3 and v.lower() in t.lower()}
    assert {tuple(r) for r in got.select("source_id", "subject_id", "kind", "value").collect()} == want


@pytest.mark.parametrize("flags,want", [
    (dict(has_strong_direct=True), ("HIGH_CONFIDENCE", 0.97)), (dict(has_strong_direct=True, location_conflict=True, has_name=True), ("POSSIBLE", 0.535)), (dict(has_name=True), ("POSSIBLE", 0.5)),
    (dict(has_name=True, location_match=True, employer_match=True), ("HIGH_CONFIDENCE", 0.8)), (dict(has_name=True, employer_match=True, location_conflict=True), ("AMBIGUOUS", 0.225)),
    (dict(), ("AMBIGUOUS", 0.0)), (dict(has_username=True, has_name=True, topic_conflict=True), ("AMBIGUOUS", 0.26)), (dict(has_username=True), ("POSSIBLE", 0.62)),
])
def test_judge(spark, flags, want):
    row = [flags.get(f, False) for f in resolve.FLAGS]
    r = resolve.judge(spark.createDataFrame([row], ", ".join(f"{f} boolean" for f in resolve.FLAGS))).first()
    assert (r.state, r.confidence) == want


def test_location_conflict_on_injected_rows(spark, subjects):
    terms = extract.subject_terms(subjects)
    sources = spark.createDataFrame([("p", "example.com")], "source_id string, registrable_domain string")
    obs = spark.createDataFrame([("o1", "p", None, "NAME", "maya quill", "Maya Quill"), ("o2", "p", None, "LOCATION", "oslo", "Oslo"), ("o3", "p", None, "EMPLOYER", "orchard labs", "Orchard Labs")], "obs_id string, source_id string, subject_id string, type string, value_normalized string, display_value string")
    r = resolve.resolve(sources, obs, terms).first()
    assert (r.state, [s.name for s in r.contradicting]) == ("AMBIGUOUS", ["location_conflict"])


def test_decisions(spark):
    rows = spark.createDataFrame([("a", "POSSIBLE", 0.5), ("b", "POSSIBLE", 0.5), ("c", "POSSIBLE", 0.5), ("d", "POSSIBLE", 0.5)], "k string, state string, confidence double")
    made = spark.createDataFrame([("a", "not_me", 1), ("a", "me", 2), ("b", "not_me", 1), ("c", "unsure", 1)], "k string, decision string, decided_at int")
    assert {r.k: (r.state, r.confidence) for r in resolve.apply_decisions(rows, made, ["k"]).collect()} == {"a": ("CONFIRMED", 1.0), "b": ("REJECTED", 0.0), "c": ("AMBIGUOUS", 0.5), "d": ("POSSIBLE", 0.5)}
    with pytest.raises(Exception, match="unknown decision"):
        resolve.apply_decisions(rows, spark.createDataFrame([("a", "maybe", 1)], "k string, decision string, decided_at int"), ["k"]).collect()


def test_assess_caps(spark):
    rows = [("OUTDATED_INFORMATION", True, "x.com", "CONFIRMED"), ("PROFESSIONAL_PROFILE", True, "agency.gov", "CONFIRMED"), ("DATE_OF_BIRTH", True, "", "POSSIBLE"), ("NEW", None, None, None)]
    df = spark.createDataFrame(rows, "category string, from_search boolean, registrable_domain string, match_state string").withColumn("categories_on_source", F.array().cast("array<string>"))
    got = {r.category: r for r in assess.assess(df).collect()}
    assert got["OUTDATED_INFORMATION"].overall_priority == "LOW" and "OUTDATED_CAP" in got["OUTDATED_INFORMATION"].explanation_codes
    assert got["PROFESSIONAL_PROFILE"].overall_priority == "MODERATE" and "GOVERNMENT_SOURCE" in got["PROFESSIONAL_PROFILE"].explanation_codes
    assert got["DATE_OF_BIRTH"].overall_priority == "MODERATE" and "IDENTITY_UNCERTAIN" in got["DATE_OF_BIRTH"].explanation_codes
    assert got["NEW"].sensitivity == "LOW"


def test_routes(spark, subjects):
    f = spark.createDataFrame([("f1", "s1", "CONTACT_EMAIL", "shop.example"), ("f2", "s2", "CONTACT_EMAIL", "shop.example"), ("f3", "s1", "USERNAME", "github.com"), ("f4", "s2", "HOME_ADDRESS", "agency.gov"), ("f5", "s3", "CONTACT_EMAIL", "x.org"), ("f6", "s3", "COMPANY", "x.org")], "finding_id string, subject_id string, category string, registrable_domain string")
    today = F.lit(dt.date(2026, 9, 1))
    got = {}
    for r in remediate.routes(f, subjects, remediate.default_registry(spark), today).orderBy("finding_id", "rank").collect():
        got.setdefault(r.finding_id, []).append((r.registry_id, r.recommended))
    assert got["f1"][0] == ("generic_gdpr_erasure", True)
    assert got["f2"][0] == ("california_drop", True)
    assert got["f3"][0] == ("user_controlled_remove", True)
    assert got["f4"][-1] == (None, True)
    assert ("google_personal_info", True) in got["f5"]
    assert got["f6"] == [(None, False)]
    late = F.lit(dt.date(2030, 1, 1))
    assert {r.registry_id for r in remediate.routes(f, subjects, remediate.default_registry(spark), late).collect()} == {None}


def test_registry_validation(spark):
    good = remediate.default_registry(spark)
    bad = good.limit(1).withColumn("sources", F.array().cast("array<string>")).withColumn("id", F.lit("a")).unionByName(good.limit(1).withColumn("official_url", F.lit("http://localhost/")).withColumn("id", F.lit("b"))).unionByName(good.where("id = 'google_personal_info'")).unionByName(good)
    valid, rejected = remediate.validate_registry(bad)
    assert valid.count() == 5 and {r.id: r.reason for r in rejected.collect()} == {"a": "no_provenance", "b": "unsafe_url", "google_personal_info": "duplicate_id"}


def test_case_fold_and_board(spark):
    t = lambda n: dt.datetime(2026, 1, n)
    e = spark.createDataFrame([("c", t(2), 2, "USER_MARKED_SUBMITTED"), ("c", t(1), 1, "REQUEST_PREPARED"), ("c", t(3), 3, "VERIFIED"), ("d", t(1), 4, None)], "case_id string, at timestamp, event_id long, target_state string")
    got = {r.case_id: r for r in remediate.fold_case_events(e).collect()}
    assert (got["c"].state, got["c"].submitted_at, got["c"].n_applied, got["c"].n_rejected) == ("USER_MARKED_SUBMITTED", t(2), 2, 1)
    assert got["d"].state == "ACTION_SELECTED" and got["d"].n_rejected == 1
    board = {r.case_id: r for r in remediate.cleanup_board(remediate.fold_case_events(e)).collect()}
    assert board["c"].lane == "waiting" and board["d"].next_state == "REQUEST_PREPARED"
    assert remediate.cleanup_board(spark.createDataFrame([("DISCOVERED",)], "state string")).first().next_state is None


def test_verify_and_advance(spark):
    rec = spark.createDataFrame([(k, f"u{k}", "h", ["v"]) for k in range(8)], "key int, canonical_url string, content_hash string, targets array<string>")
    again = spark.createDataFrame([("u0", "RETRIEVED", 404, "x", False), ("u1", "RETRIEVAL_BLOCKED", None, None, None), ("u2", "TIMEOUT", None, None, None), ("u3", "RETRIEVED", 200, "e", True), ("u4", "RETRIEVED", 200, "n", False), ("u5", "RETRIEVED", 200, "h", False), ("u6", "RETRIEVED", 200, "n", False)], "canonical_url string, status string, http_status int, content_hash string, is_blank boolean")
    seen = spark.createDataFrame([("u5", "v"), ("u6", "v"), ("u4", "w")], "canonical_url string, value_normalized string")
    got = {r.key: r.source_status for r in verify.verify_sources(rec, again, seen).collect()}
    assert [got[k] for k in range(8)] == ["URL_GONE", "ACCESS_BLOCKED", "UNKNOWN", "CONTENT_REMOVED", "PERSONAL_DATA_REMOVED", "UNCHANGED", "CONTENT_CHANGED", "UNKNOWN"]
    cases = spark.createDataFrame([("a", "AWAITING_RESPONSE"), ("b", "VERIFIED"), ("c", "VERIFIED"), ("d", "REVIEWED")], "case_id string, state string")
    seen = spark.createDataFrame([("a", "URL_GONE"), ("b", "UNKNOWN"), ("c", "UNCHANGED"), ("d", "URL_GONE")], "case_id string, source_status string")
    changes = verify.advance_cases(cases, seen)
    assert {r.case_id: (r.state, r.reappeared_reason) for r in changes.collect()} == {"a": ("VERIFIED", None), "b": ("REAPPEARED", "unreachable"), "c": ("REAPPEARED", "seen")}
    assert tuple(verify.recheck_summary(changes).first()) == (3, 3, 1, 2)


def test_plan(spark, subjects):
    rows = discover.plan_queries(subjects).collect()
    mine = [r for r in rows if r.subject_id == "s1"]
    assert [r.rationale for r in sorted(mine, key=lambda r: r.position)] == ["name", "name+location", "name+location", "name+employer", "name+pdf", "username", "owned-domain", "email"]
    assert not any("7946" in r.text for r in rows) and not [r for r in rows if r.subject_id == "s3"]
    assert discover.plan_queries(subjects, 3).where("subject_id = 's1'").count() == 3


def test_packets_and_explanations(result, spark):
    p = [json.loads(r.packet) for r in report.packets(result.findings, result.sources, result.observations).collect()]
    assert p and all("maya@quill" not in json.dumps(x) for x in p)
    rows = spark.createDataFrame([("a", '{"explanation": "ok", "review_questions": ["q"]}'), ("b", '{"explanation": "ok", "more": 1}'), ("c", "not json"), ("d", '{"explanation": 3}'), ("e", None), ("f", json.dumps({"explanation": "x" * 1201}))], "finding_id string, output string")
    assert [tuple(r) for r in report.validate_explanations(rows).collect()] == [("a", "ok", ["q"])]


def test_reports(result, subjects, spark):
    cases = result.findings.limit(1).select(F.lit("c").alias("case_id"), "finding_id", F.lit("SEARCH_DELIST").alias("route"), F.lit("VERIFIED").alias("state"))
    got = {r.subject_id: json.loads(r.report) for r in report.subject_reports(subjects, result.findings, result.sources, cases).collect()}
    assert set(got) == {"s1", "s2", "s3"} and got["s1"]["summary"]["critical"] >= 1 and len(got["s1"]["cases"]) == 1


def test_sources(spark):
    raw = spark.createDataFrame([("x", "p", "q", '{"web":{"results":[{"url":"u","title":"t","description":"d"},{"title":"no"}]}}'), ("x", "p", "r", "bad"), ("x", "p", "s", '[{"href":"h","body":"b"}]')], "scan_id string, provider string, query string, payload string")
    assert {(r.query, r.rank, r.url, r.snippet) for r in tables.normalize_search_results(raw).collect()} == {("q", 1, "u", "d"), ("s", 1, "h", "b")}
    key = F.lit("0123456789abcdef")
    people = spark.createDataFrame([("s", ["a@x.com", "ab@x.com"], ["1"])], "subject_id string, emails array<string>, phones array<string>")
    kept = tables.reveal_identifiers(tables.protect_identifiers(people, key, "salt"), key).collect()
    assert {r.value for r in kept} == {"a@x.com", "ab@x.com", "1"}
    starts = spark.createDataFrame([("a", "s", 1), ("b", "s", 1), ("c", "s", 1)], "scan_id string, subject_id string, at int")
    ends = spark.createDataFrame([("a", 2, [], None), ("b", 2, ["e"], None)], "scan_id string, at int, errors array<string>, failure string")
    assert {r.scan_id: r.status for r in tables.scan_log(starts, ends).collect()} == {"a": "COMPLETE", "b": "INCOMPLETE", "c": "RUNNING"}


def test_erase(spark):
    t = {"findings": spark.createDataFrame([("f1", "s1"), ("f2", "s2")], "finding_id string, subject_id string"), "cases": spark.createDataFrame([("c1", "f1"), ("c2", "f2")], "case_id string, finding_id string"), "case_events": spark.createDataFrame([("c1", 1), ("c2", 2)], "case_id string, n int")}
    out = tables.erase(t, spark.createDataFrame([("s1",)], "subject_id string"))
    assert {k: [tuple(r) for r in df.collect()] for k, df in out.items()} == {"findings": [("f2", "s2")], "cases": [("c2", "f2")], "case_events": [("c2", 2)]}
