"""Readers of the input tables, admission of crawled pages, and the write side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetrail.functions import text as T
from pagetrail.functions import urls as U
from pagetrail.operators.ordered import before, first_rows
from pagetrail.schema import REGISTRY, SUBJECTS

# Types that are read, and byte caps.
HTML_TYPES, TEXT_TYPES, PDF_TYPES = ("text/html", "application/xhtml+xml"), ("text/plain",), ("application/pdf",)
MAX_HTML, MAX_PDF = 5 << 20, 15 << 20
SUPPORTED_DECISIONS = ("me", "not_me", "unsure")


def candidates(search_results: DataFrame, manual: DataFrame) -> DataFrame:
    """Search hits and pasted urls as one table (scan_id, url, title, from_search, position), blanks left out, unsafe urls kept."""
    hits = search_results.select("scan_id", F.trim("url").alias("url"), "title", F.lit(True).alias("from_search"), F.col("rank").cast("long").alias("position"))
    pasted = manual.select("scan_id", F.trim("url").alias("url"), F.lit("").alias("title"), F.lit(False).alias("from_search"), F.col("position").cast("long").alias("position"))
    return hits.unionByName(pasted).where("url <> ''")


def normalize_search_results(raw: DataFrame) -> DataFrame:
    """raw(scan_id, provider, query, payload JSON) to (scan_id, provider, query, rank, url, title, snippet).

    The hits are the list under web.results, results, or the payload itself; a hit's url may be called url or href, its
    snippet description, content or body. Hits without a url are dropped; bad JSON has none.
    """
    v = F.try_parse_json("payload")
    hits = F.coalesce(*(F.try_variant_get(v, p, "array<variant>") for p in ("$.web.results", "$.results", "$")), F.array().cast("array<variant>"))
    rows = raw.select("scan_id", "provider", "query", F.posexplode(hits).alias("k", "hit"))
    get = lambda *names: F.coalesce(*(F.nullif(F.try_variant_get("hit", f"$.{n}", "string"), F.lit("")) for n in names))
    return rows.select("scan_id", "provider", "query", (F.col("k") + 1).alias("rank"), get("url", "href").alias("url"), F.coalesce(get("title"), F.lit("")).alias("title"), F.coalesce(get("description", "content", "body", "snippet"), F.lit("")).alias("snippet")).where("url IS NOT NULL")


def content_type_of(header: Column) -> Column:
    return F.lower(F.trim(F.substring_index(F.coalesce(header, F.lit("")), ";", 1)))


def admit_pages(pages: DataFrame, max_html: int = MAX_HTML, max_pdf: int = MAX_PDF) -> DataFrame:
    """Adds content_type without parameters, n_bytes, content_hash and status RETRIEVED, UNSUPPORTED_TYPE or TOO_LARGE; no row goes. A missing type is admitted."""
    kind = content_type_of(F.col("content_type"))
    size = F.octet_length(F.coalesce("html", F.lit("")))
    cap = F.when(kind.isin(*PDF_TYPES), max_pdf).otherwise(max_html)
    status = F.when((kind != "") & ~kind.isin(*HTML_TYPES, *TEXT_TYPES, *PDF_TYPES), "UNSUPPORTED_TYPE").when(size > cap, "TOO_LARGE").otherwise("RETRIEVED")
    return pages.withColumns({"status": status, "n_bytes": size, "content_hash": F.sha2(F.coalesce("html", F.lit("")), 256), "content_type": kind})


def classify_fetch(log: DataFrame) -> DataFrame:
    """log(url, fetch_error, ...) with a status for every attempt: a failure stays a row and is never taken for an absent page."""
    e = F.lower(F.coalesce("fetch_error", F.lit("")))
    status = (
        F.when(e == "", "RETRIEVED")
        .when(e.rlike("timeout|timed out"), "TIMEOUT")
        .when(e.rlike("too_large|too large"), "TOO_LARGE")
        .when(e.rlike("unsupported"), "UNSUPPORTED_TYPE")
        .when(e.rlike("blocked|robots|rejected_scheme|unsupported_scheme|missing_host|policy|redirect"), "RETRIEVAL_BLOCKED")
        .otherwise("ERROR")
    )
    return log.withColumn("status", status)


def classify_search_outcome(log: DataFrame) -> DataFrame:
    """log(provider, http_status, error) with outcome: ok, or the failure's code; a failure never looks like zero results."""
    e, s = F.lower(F.coalesce("error", F.lit(""))), F.col("http_status")
    outcome = (
        F.when(e.rlike("timeout|timed out"), "timeout")
        .when(e.rlike("json|decode|parse"), "bad_json")
        .when(s.isin(401, 403), "unauthorized")
        .when(s.isin(202, 429), "rate_limited")
        .when(s >= 400, F.concat(F.lit("http_"), s.cast("string")))
        .when(e != "", "error")
        .otherwise("ok")
    )
    code = F.when(outcome == "ok", "ok").otherwise(F.concat_ws("_", "provider", outcome))
    return log.withColumn("outcome", code)


def _place_key(x: Column) -> Column:
    return F.lower(F.concat_ws("|", F.coalesce(x["city"], F.lit("")), F.coalesce(x["country"], F.lit(""))))


def clean_subjects(raw: DataFrame) -> DataFrame:
    """Enrolment rows with trimmed values, blanks dropped, one primary name first, domains lower-cased, places without case-insensitive repeats (first wins)."""
    strings = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), T.py_strip), lambda x: x != "")
    names = F.filter(F.transform("names", lambda n: F.struct(T.py_strip(n["value"]).alias("value"), F.coalesce(n["is_primary"], F.lit(False)).alias("is_primary"))), lambda n: n["value"] != "")
    names = F.concat(F.filter(names, lambda n: n["is_primary"]), F.filter(names, lambda n: ~n["is_primary"]))
    names = F.transform(names, lambda n, i: F.struct(n["value"].alias("value"), (i == 0).alias("is_primary")))
    blank = lambda c: F.nullif(F.coalesce(T.py_strip(c), F.lit("")), F.lit(""))
    places = F.filter(F.transform("locations", lambda x: F.struct(blank(x["city"]).alias("city"), blank(x["country"]).alias("country"))), lambda x: x["city"].isNotNull() | x["country"].isNotNull())
    places = F.filter(places, lambda x, i: ~F.exists(F.slice(places, 1, i), lambda y: _place_key(y) == _place_key(x)))
    employers = F.filter(F.transform("employers", lambda e: e.withField("name", T.py_strip(e["name"]))), lambda e: e["name"] != "")
    none = lambda c, like: F.coalesce(c, F.array().cast(raw.schema[like].dataType))
    return raw.withColumns({"names": none(names, "names"), "locations": none(places, "locations"), "employers": none(employers, "employers"), "usernames": strings("usernames"), "emails": strings("emails"), "phones": strings("phones"), "personal_domains": F.transform(strings("personal_domains"), F.lower)})


def read_subjects(spark: SparkSession, path: str, kind: str = "json") -> DataFrame:
    return clean_subjects(spark.read.schema(SUBJECTS).format(kind).load(path))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The removal-route table from JSON lines; an unreadable or empty one raises, since "no routes" must be a fact."""
    df = spark.read.schema(REGISTRY).json(path)
    if df.isEmpty():
        raise ValueError(f"no registry entries at {path}")
    return df


def protect_identifiers(subjects: DataFrame, key: Column, salt: str) -> DataFrame:
    """(subject_id, kind, value_enc, value_hash, display): emails and phones encrypted, masked, and keyed by a salted hash, so two values with one mask both stay."""
    item = lambda kind, c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    rows = subjects.select("subject_id", F.inline(F.concat(item("EMAIL", F.col("emails")), item("PHONE", F.col("phones"))))).where("value IS NOT NULL")
    masked = F.when(F.col("kind") == "EMAIL", T.mask_email(F.col("value"))).otherwise(T.mask_phone(F.col("value")))
    out = rows.select("subject_id", "kind", F.aes_encrypt("value", key).alias("value_enc"), F.sha2(F.concat(F.lit(salt), F.lower("value")), 256).alias("value_hash"), masked.alias("display"))
    return out.dropDuplicates(["subject_id", "kind", "value_hash"])


def reveal_identifiers(protected: DataFrame, key: Column) -> DataFrame:
    return protected.select("subject_id", "kind", F.aes_decrypt("value_enc", key).cast("string").alias("value"), "value_hash", "display")


def subjects_public(subjects: DataFrame) -> DataFrame:
    """The masked view of subjects: no raw email or phone."""
    return subjects.select("subject_id", T.primary_name(F.col("names")).alias("primary_name"), F.transform("names", lambda n: n["value"]).alias("names"), F.transform("locations", lambda x: T.location_text(x["city"], x["country"])).alias("locations"), "usernames", F.transform("emails", T.mask_email).alias("emails"), F.transform("phones", T.mask_phone).alias("phones"), "personal_domains")


def newest(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Insert-or-update: of rows with equal keys the one of the greatest version; ties by all columns' hash. An aggregate with partial results, not a sort of a key's rows."""
    order = F.struct(F.col(version), F.xxhash64(*rows.columns))
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), order).alias("_row"))
    return best.select(*keys, "_row.*").select(*rows.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    return newest(old.unionByName(new), keys, version)


def append(rows: DataFrame, path: str, partition: str = "scan_id") -> None:
    rows.write.mode("append").partitionBy(partition).parquet(path)


def lookup(spark: SparkSession, path: str, columns: list[str], **keys) -> DataFrame:
    """Rows with the given keys; filter and projection reach the scan."""
    df = spark.read.parquet(path)
    for k, v in keys.items():
        df = df.where(F.col(k) == v)
    return df.select(*columns)


def scan_log(starts: DataFrame, ends: DataFrame) -> DataFrame:
    """starts(scan_id, subject_id, at), ends(scan_id, at, errors array, failure) to one row a scan: RUNNING, COMPLETE, INCOMPLETE (search errors) or ERROR."""
    e = newest(ends, ["scan_id"], "at").select("scan_id", F.col("at").alias("finished_at"), "errors", "failure")
    out = newest(starts, ["scan_id"], "at").join(e, "scan_id", "left")
    status = F.when(F.col("finished_at").isNull(), "RUNNING").when(F.col("failure").isNotNull(), "ERROR").when(F.size(F.coalesce("errors", F.array().cast("array<string>"))) > 0, "INCOMPLETE").otherwise("COMPLETE")
    return out.select("scan_id", "subject_id", F.col("at").alias("started_at"), "finished_at", status.alias("status"), F.col("failure").alias("error"))


def dedup_candidates(rows: DataFrame, most: int = 100) -> tuple[DataFrame, DataFrame]:
    """candidates to (kept, rejected): the first of each canonical url per scan (search before pasted, then position), at most `most` a scan; rejected are urls that can't be read.

    The first of a url is an aggregate with partial results, a scan's first a bounded top-k of each task, so neither a
    url nor a scan that has a third of all rows is sorted in one task.
    """
    names = rows.columns
    rows = rows.withColumn("canonical_url", U.canonical_url(F.col("url")))
    pasted = ~F.coalesce("from_search", F.lit(False))
    order = F.struct(pasted, "position", "url", F.xxhash64(*names))
    first = rows.where("canonical_url IS NOT NULL").groupBy("scan_id", "canonical_url").agg(F.min_by(F.struct(*(c for c in names if c != "scan_id")), order).alias("_row"))
    one = first.select("scan_id", "canonical_url", "_row.*").withColumn("_pasted", ~F.coalesce("from_search", F.lit(False)))
    kept = first_rows(one, "scan_id", ["_pasted", "position", "url"], most).select(*names, "canonical_url")
    return kept, rows.where("canonical_url IS NULL").drop("canonical_url")


def within_budget(pages: DataFrame, documents: int = 100, size: int = 100_000_000) -> DataFrame:
    """pages(scan_id, position, n_bytes, ...) up to a scan's document and byte budgets; the page that crosses the bytes is still in. A null size counts 0."""
    counted = before(pages, "scan_id", ["position", "url"], "n_bytes")
    return counted.where((F.col("_sum") < size) & (F.col("_n") < documents)).select(*pages.columns)


def erase(tables: dict[str, DataFrame], subjects: DataFrame) -> dict[str, DataFrame]:
    """Each table without the given subjects' rows (subject_id), and without what hangs on them: observations of theirs, cases and events of their findings."""
    out = {}
    findings = tables.get("findings")
    gone_findings = findings.join(subjects.select("subject_id"), "subject_id", "left_semi").select("finding_id") if findings is not None else None
    gone_cases = tables["cases"].join(gone_findings, "finding_id", "left_semi").select("case_id") if gone_findings is not None and "cases" in tables else None
    for name, df in tables.items():
        if name == "cases" and gone_findings is not None:
            df = df.join(gone_findings, "finding_id", "left_anti")
        elif name == "case_events" and gone_cases is not None:
            df = df.join(gone_cases, "case_id", "left_anti")
        elif "subject_id" in df.columns:
            df = df.join(subjects.select("subject_id").distinct(), "subject_id", "left_anti").select(*df.columns)
        out[name] = df.select(*tables[name].columns)
    return out
