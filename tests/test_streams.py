"""Streams over files, drained to the end, against their batch twins."""

import datetime as dt
import tempfile

import pytest

from pagetrail.operators import remediate
from pagetrail.schema import SUBJECTS
from pagetrail.streaming import jobs


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="pagetrail-stream-")


def test_monitor_pages(spark, folder):
    pages = "scan_id string, url string, html string, content_type string, from_search boolean"
    people = spark.createDataFrame([("s", [("Maya Quill", True)], [], [], [], ["maya@quill.example"], [], [], None)], SUBJECTS)
    for n, text in enumerate(("mail maya@quill.example", "nothing here")):
        spark.createDataFrame([(f"x{n}", f"https://a.example.com/{n}", text, "text/plain", False)], pages).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(pages).parquet(f"{folder}/in")
        jobs.monitor_pages(stream, people, f"{folder}/out", f"{folder}/state").awaitTermination()
    rows = spark.read.parquet(f"{folder}/out").collect()
    assert [(r.subject_id, r.canonical_url, r.category) for r in rows] == [("s", "https://a.example.com/0", "CONTACT_EMAIL")]


def test_case_states_equal_the_batch_fold(spark, folder):
    jobs.use_rocksdb(spark)
    schema = "case_id string, at timestamp, event_id long, target_state string"
    t = lambda n: dt.datetime(2026, 1, n)
    events = [("a", t(1), 1, "REQUEST_PREPARED"), ("a", t(2), 2, "VERIFIED"), ("b", t(1), 3, "USER_ABANDONED"), ("a", t(3), 4, "USER_MARKED_SUBMITTED"), ("b", t(4), 5, "ACTION_SELECTED")]
    seen = []
    for part in (events[:3], events[3:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        q = jobs.case_states(spark.readStream.schema(schema).parquet(f"{folder}/in")).writeStream.outputMode("update").foreachBatch(lambda df, n: seen.extend(df.collect())).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    last = {}
    for r in sorted(seen, key=lambda r: r.at):
        last[r.case_id] = r.state
    batch = {r.case_id: r for r in remediate.fold_case_events(spark.createDataFrame(events, schema)).collect()}
    assert last == {k: r.state for k, r in batch.items()}
    assert sum(not r.accepted for r in seen) == sum(r.n_rejected for r in batch.values()) == 1


def test_follow_pages(spark, folder):
    """Only pages of new content change the stored findings; one that can't be read, an older copy and a batch that runs again don't."""
    pages = "url string, html string, content_type string, from_search boolean, at timestamp"
    people = spark.createDataFrame([("s", [("Maya Quill", True)], [], [], [], ["maya@quill.example"], [], [], None)], SUBJECTS)
    t = lambda n: dt.datetime(2026, 1, n)
    one, two, three = "https://a.example.com/1", "https://a.example.com/2?utm_source=x", "https://a.example.com/3"
    said = "mail maya@quill.example"
    crawls = [
        ([(one, said, "text/plain", False, t(2)), (two, said, "text/plain", False, t(2)), (three, "nobody", "text/plain", False, t(2))], {"1", "2"}, 3),
        ([(one, "nothing any more", "text/plain", False, t(3)), (two, None, "image/png", False, t(3)), (three, "older " + said, "text/plain", False, t(1))], {"2"}, 1),
        ([(one, "nothing any more", "text/plain", False, t(4)), (three, said, "text/plain", False, t(4)), (three, "between", "text/plain", False, t(3))], {"2", "3"}, 2),
    ]
    for crawl, want, _ in crawls:
        spark.createDataFrame(crawl, pages).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        jobs.follow_pages(spark.readStream.schema(pages).parquet(f"{folder}/in"), people, f"{folder}/store", f"{folder}/state").awaitTermination()
        known, findings = jobs.followed(spark, f"{folder}/store")
        assert {r.canonical_url.rsplit("/", 1)[1] for r in findings.read().collect()} == want
    versions = known.version()["number"], findings.version()["number"]
    findings.replace(findings.read().select("source_id"), findings.read().limit(0), change="batch 2")  # the same change again counts once
    assert (known.version()["number"], findings.version()["number"]) == versions and findings.read().count() == 2
