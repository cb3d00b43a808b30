import datetime as dt
import hashlib

import numpy as np
from pyspark.sql import functions as F

from pagetrail.operators import extract, remediate, substrings
from pagetrail.plans.scan import parsed_sources, scan
from pagetrail.streaming import jobs


def test_shared_terms_make_no_product(spark):
    n = 20_000  # texts that name a city, and as many subjects who live there: 400 million pairs
    texts = spark.range(n).select(F.col("id").cast("string").alias("source_id"), F.lit("All of Ghent and GHENT").alias("text"))
    terms = spark.range(n).select(F.col("id").cast("string").alias("subject_id"), F.lit("CITY").alias("kind"), F.when(F.col("id") % 2 == 0, "Ghent").otherwise("ghent").alias("value"))
    terms = terms.union(spark.createDataFrame([("0", "NAME", "Ghent"), ("0", "NAME", "gh"), ("1", "NAME", "Leeds")], terms.schema))
    got = extract.term_counts(texts, terms).groupBy("kind", "n_terms", "n_values").count().collect()
    assert {tuple(r) for r in got} == {("CITY", n, 2, n), ("NAME", 1, 1, n)}


def test_facts_of_a_page_parsed_in_the_same_plan(spark):
    html = '<html><head><title>Ada Quill</title><meta name="a" content="1"><meta name="a" content="2"></head><body><p>born 3 May 1980 a@b.example.com 12 Elm Tree Road, call +44 20 7946 0958.</p></body></html>'
    pages = spark.range(1).select(F.col("id").cast("string").alias("source_id"), F.lit("text/html").alias("content_type"), F.concat(F.col("id").cast("string"), F.lit(html)).alias("html"))
    obs = extract.page_observations(extract.parse_pages(pages))
    assert sorted((r.type, r.value) for r in obs.collect()) == [("DATE_OF_BIRTH", "3 may 1980"), ("EMAIL", "a@b.example.com"), ("PAGE_TITLE", "ada quill"), ("PHONE", "+442079460958"), ("POSTAL_ADDRESS", "12 elm tree road")]


def test_routes_broadcast_no_subjects(spark):
    findings = spark.createDataFrame([("f1", "s1", "OUTDATED_INFORMATION", "x.example"), ("f2", "s1", "CONTACT_EMAIL", "a.gov"), ("f3", "s1", None, None)], "finding_id string, subject_id string, category string, registrable_domain string")
    subjects = spark.createDataFrame([("s1", [("Oslo", "Chile")], [])], "subject_id string, locations array<struct<city:string,country:string>>, personal_domains array<string>")
    got = remediate.routes(findings, subjects, remediate.default_registry(spark), F.to_date(F.lit("2026-09-01")))
    assert sorted((r.finding_id, r["rank"]) for r in got.collect()) == [("f1", 7), ("f2", 5), ("f2", 6), ("f2", 7), ("f3", 7)]
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin [subject_id" in plan and "HashAggregate(keys=[finding_id" not in plan


def test_pages_are_read_once(spark, tmp_path):
    """Urls of pages from one small file aren't read again in its one task, and each source keeps its row of the smallest content hash."""
    pages = spark.range(40).select((F.col("id") % 30).alias("k"), F.concat(F.lit("http://EXAMPLE.com:80/"), (F.col("id") % 30).cast("string")).alias("url"), F.concat(F.lit("<p>"), F.col("id").cast("string")).alias("html"), F.lit("text/html").alias("content_type"), F.lit(True).alias("from_search"), F.lit("s").alias("scan_id"))
    pages.coalesce(1).write.parquet(f"{tmp_path}/pages")
    kept = parsed_sources(spark.read.parquet(f"{tmp_path}/pages").repartition(4, "k").drop("k"))
    assert "regexp" not in kept._jdf.queryExecution().optimizedPlan().toString()
    want = {f"http://example.com/{k}": min((f"<p>{i}" for i in (k, k + 30) if i < 40), key=lambda h: hashlib.sha256(h.encode()).hexdigest())[3:] for k in range(30)}
    assert sorted((r.canonical_url, r.text) for r in kept.select("canonical_url", "parsed.text").collect()) == sorted(want.items())


def test_findings_wait_until_asked_for(spark):
    pages = spark.createDataFrame([("http://a.example/", "mail a@b.example.com", "text/plain", True, "s")], "url string, html string, content_type string, from_search boolean, scan_id string")
    terms = spark.createDataFrame([("x", "EMAIL", "a@b.example.com", "a@b.example.com", None, None, None, None)], "subject_id string, kind string, value string, norm string, digits string, last9 string, first_token string, last_token string")
    s = scan(pages, None, terms=terms)
    assert s.matches.count() == 1 and "findings" not in vars(s)
    assert [r.category for r in s.findings.collect()] == ["CONTACT_EMAIL"] and s.findings is s.findings


def test_needles_are_dealt_out(spark, monkeypatch):
    """A few needles are one small file, but anchors are sought in as many tasks as a shuffle has; each is its needle's rarest place."""
    words = ["abc", "äöü", "ab", "abcdefgh", "xabcdefgh", "ärger und mehr", "zzzzzzzzzzzzzz", "日本語のテキスト"]
    tasks = []
    real = substrings.anchors
    monkeypatch.setattr(substrings, "anchors", lambda needles, *more: (tasks.append(len(needles.inputFiles())), real(needles, *more))[1])
    df = spark.createDataFrame([(w,) for w in words] * 3, "needle string").coalesce(1)
    texts = spark.createDataFrame([("t", " ".join(w.upper() for w in words))], "source_id string, text string")
    text = texts.first().text.lower()
    assert sorted((r.needle, r.at) for r in substrings.holding(texts, df).collect()) == sorted((w, text.index(w)) for w in words if len(w) > 2)
    assert tasks[0] > 1
    own = np.arange(len(substrings.WIDTHS) * substrings.SLOTS, dtype=np.int64).reshape(len(substrings.WIDTHS), -1) % 7
    got = real(df.where("length(needle) > 2").distinct(), own + 1, own).collect()
    for r in got:
        data = r.needle.encode()
        places = [p for p in range(len(data) - r.width + 1) if data[p] & 0xC0 != 0x80]
        keys = np.array([int.from_bytes(data[p : p + r.width], "little") for p in places], np.uint64)
        slots = substrings._slot(keys, r.width)
        row = substrings.WIDTHS.index(r.width)
        best = int(((own[row, slots] + 2.0) * own[row, slots]).argmin())
        assert (r.width, r.off, np.uint64(r.key % (1 << 64))) == (min(len(data), 8), len(data[: places[best]].decode()), keys[best])


def test_page_facts_are_not_shuffled(spark, monkeypatch):
    """a scan without further extractors finds each fact of a page once, the first, without a window over all hits."""
    said = "mail b@x.example.com, a@x.example.com or B@X.example.com. " * 20
    page = f'<html><head><title>Ada Quill</title></head><body><p>{said}</p><a href="mailto:a@x.example.com">a</a><a href="mailto:c@x.example.com">c</a></body></html>'
    parsed = extract.parse_pages(spark.createDataFrame([("p", "text/html", page), ("q", "text/html", page), ("r", "text/html", "")], "source_id string, content_type string, html string"))
    columns = ["source_id", "type", "value_normalized", "display_value", "evidence_snippet", "extractor", "seen_at", "obs_id"]
    want = sorted(map(str, extract.observations(parsed.union(parsed)).select(*columns).collect()))  # of repeated rows, by the window
    assert len(want) == 2 * (1 + 3)

    def refuse(hits):
        raise AssertionError("all hits are sorted")

    monkeypatch.setattr(extract, "first_wins", refuse)
    assert sorted(map(str, extract.observations(parsed, unique=True).select(*columns).collect())) == want
    pages = spark.createDataFrame([("http://a.example/", page, "text/html", True, "s")], "url string, html string, content_type string, from_search boolean, scan_id string")
    terms = spark.createDataFrame([("x", "EMAIL", "c@x.example.com", "c@x.example.com", None, None, None, None)], "subject_id string, kind string, value string, norm string, digits string, last9 string, first_token string, last_token string")
    assert scan(pages, None, terms=terms).matches.count() == 1


def test_known_crawls_are_not_scanned(spark, tmp_path, monkeypatch):
    """a batch of which nothing is new isn't scanned and writes nothing; one whose content is as before only moves the pages' times; the terms are the caller's."""
    scans = []
    monkeypatch.setattr(jobs, "scan", lambda *a, **k: (scans.append(1), scan(*a, **k))[1])
    pages = "url string, html string, content_type string, from_search boolean, at timestamp"
    terms = spark.createDataFrame([("x", "EMAIL", "a@b.example.com", "a@b.example.com", None, None, None, None)], "subject_id string, kind string, value string, norm string, digits string, last9 string, first_token string, last_token string")
    seen = []
    for day, said in ((2, "mail a@b.example.com"), (1, "older"), (3, "mail a@b.example.com"), (4, "gone")):
        spark.createDataFrame([("https://a.example.com/1", said, "text/plain", False, dt.datetime(2026, 1, day))], pages).write.mode("append").parquet(f"{tmp_path}/in")
        jobs.follow_pages(spark.readStream.schema(pages).parquet(f"{tmp_path}/in"), None, f"{tmp_path}/store", f"{tmp_path}/state", terms=terms).awaitTermination()
        known, findings = jobs.followed(spark, f"{tmp_path}/store")
        seen.append((len(scans), known.version()["number"], known.read().first()["at"].day, findings.read().count()))
    assert seen == [(1, 1, 2, 1), (1, 1, 2, 1), (1, 2, 3, 1), (2, 3, 4, 0)]
