"""Re-checks: what a later crawl shows of a recorded page, and what that means for a case."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetrail.schema import GONE, RECHECKABLE


def verify_sources(recorded: DataFrame, refetched: DataFrame, refetched_obs: DataFrame, by: str = "canonical_url") -> DataFrame:
    """What became of each recorded page: key, source_status, new_content_hash, note.

    recorded(key, canonical_url, content_hash, targets array<string>); refetched(canonical_url, status, http_status,
    content_hash, is_blank); refetched_obs(canonical_url, value_normalized). In this order: blocked; any other failure or
    no second crawl unknown; 404 or 410 gone; a blank page without observations removed; targets of which none is left
    data removed; the same hash unchanged; else changed. by: the column that says which page it is, for pages that share
    an address. Every recorded row gives one row: of several crawls of a page, that which shows most counts (retrieved,
    not gone, not blank, the smallest hash).
    """
    values = refetched_obs.groupBy(by).agg(F.collect_set("value_normalized").alias("present"))
    shows = F.struct(F.coalesce(F.col("status") != "RETRIEVED", F.lit(True)), F.coalesce(F.col("http_status").isin(404, 410), F.lit(False)), F.coalesce("is_blank", F.lit(False)), "content_hash", "status", "http_status")
    page = refetched.groupBy(by).agg(F.min_by(F.struct("status", "http_status", F.col("content_hash").alias("new_content_hash"), "is_blank"), shows).alias("_page")).select(by, "_page.*")
    rows = recorded.join(page, by, "left").join(values, by, "left")
    none = F.array().cast("array<string>")
    present, targets = F.coalesce("present", none), F.coalesce("targets", none)
    left = F.array_intersect(targets, present)
    status = (
        F.when(F.col("status") == "RETRIEVAL_BLOCKED", "ACCESS_BLOCKED")
        .when(F.coalesce("status", F.lit("")) != "RETRIEVED", "UNKNOWN")
        .when(F.col("http_status").isin(404, 410), "URL_GONE")
        .when(F.col("is_blank") & (F.size(present) == 0), "CONTENT_REMOVED")
        .when((F.size(targets) > 0) & (F.size(left) == 0), "PERSONAL_DATA_REMOVED")
        .when(F.col("new_content_hash") == F.col("content_hash"), "UNCHANGED")
        .otherwise("CONTENT_CHANGED")
    )
    note = F.when(status == "URL_GONE", F.concat(F.lit("http_"), F.col("http_status").cast("string"))).when(status == "UNKNOWN", F.lower(F.coalesce("status", F.lit("not_crawled")))).when(status == "ACCESS_BLOCKED", "blocked").otherwise("")
    return rows.select("key", status.alias("source_status"), F.when(F.col("status") == "RETRIEVED", F.col("new_content_hash")).alias("new_content_hash"), note.alias("note"), F.size(left).alias("n_left"))


def search_presence(targets: DataFrame, results: DataFrame, failures: DataFrame) -> DataFrame:
    """targets(key, query, canonical_url), results(query, canonical_url), failures(query, error): is the page seen in the re-run search? A failed search counts as present."""
    seen = results.select("query", "canonical_url").distinct().withColumn("seen", F.lit(True))
    failed = failures.groupBy("query").agg(F.min("error").alias("error"))
    rows = targets.join(seen, ["query", "canonical_url"], "left").join(failed, "query", "left")
    there = F.col("error").isNotNull() | F.coalesce("seen", F.lit(False))
    note = F.when(F.col("error").isNotNull(), F.concat(F.lit("search_failed:"), "error")).when(F.col("seen"), "observed in the tested search").otherwise("not observed in the tested search (does not prove universal delisting)")
    return rows.select("key", F.when(there, "SEARCH_RESULT_PRESENT").otherwise("SEARCH_RESULT_NOT_OBSERVED").alias("search_status"), F.lit("UNKNOWN").alias("source_status"), note.alias("note"))


def advance_cases(cases: DataFrame, verified: DataFrame) -> DataFrame:
    """cases(case_id, state), verified(case_id, source_status) to rows of re-checked cases: case_id, before, state, source_status, reappeared_reason.

    Only re-checkable states move: submitted or awaiting cases become pending, pending ones VERIFIED when the data is
    gone; a VERIFIED case whose data isn't seen gone becomes REAPPEARED, with the reason whether it was seen or merely
    unreachable.
    """
    rows = cases.where(F.col("state").isin(*RECHECKABLE)).join(verified.select("case_id", "source_status"), "case_id")
    gone = F.col("source_status").isin(*GONE)
    pending = F.when(F.col("state").isin("USER_MARKED_SUBMITTED", "AWAITING_RESPONSE"), "VERIFICATION_PENDING").otherwise(F.col("state"))
    after = F.when(F.col("state") == "VERIFIED", F.when(gone, "VERIFIED").otherwise("REAPPEARED")).when((pending == "VERIFICATION_PENDING") & gone, "VERIFIED").otherwise(pending)
    why = F.when((F.col("state") == "VERIFIED") & ~gone, F.when(F.col("source_status").isin("UNKNOWN", "ACCESS_BLOCKED"), "unreachable").otherwise("seen"))
    return rows.select("case_id", F.col("state").alias("before"), after.alias("state"), "source_status", why.alias("reappeared_reason"))


def recheck_summary(changes: DataFrame) -> DataFrame:
    """One row: checked, changed, resolved, reappeared."""
    moved = F.col("before") != F.col("state")
    return changes.agg(F.count("*").alias("checked"), F.count_if(moved).alias("changed"), F.count_if(moved & (F.col("state") == "VERIFIED")).alias("resolved"), F.count_if(moved & (F.col("state") == "REAPPEARED")).alias("reappeared"))


def page_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(subject_id, canonical_url) of two scans to those that are new or gone."""
    keys = ["subject_id", "canonical_url"]
    a, b = before.select(*keys).distinct(), after.select(*keys).distinct()
    return b.join(a, keys, "left_anti").withColumn("change", F.lit("new")).unionByName(a.join(b, keys, "left_anti").withColumn("change", F.lit("gone")))
