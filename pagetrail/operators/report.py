"""Reads for people: dashboards, page cards, quality and evaluation figures, packets and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetrail.functions import text as T
from pagetrail.operators.ordered import before, first_rows
from pagetrail.schema import ACTIONABLE, VERSIONS
from pagetrail.session import durable


def _seen(obs: DataFrame) -> Column:
    """Where an observation stands in the order in which a source's were found; null where the table doesn't say."""
    return (F.col("seen_at") if "seen_at" in obs.columns else F.lit(None).cast("int")).alias("seen_at")


def _sure() -> Column:
    return F.coalesce(T.is_actionable(F.col("match_state")), F.lit(False))


def dashboard(findings: DataFrame) -> DataFrame:
    """Per subject: high (with critical), moderate, low, needs_review; an uncertain finding counts in needs_review alone."""
    p = F.col("overall_priority")
    return findings.groupBy("subject_id").agg(F.count("*").alias("total"), F.count_if(_sure() & p.isin("HIGH", "CRITICAL")).alias("high"), F.count_if(_sure() & (p == "MODERATE")).alias("moderate"), F.count_if(_sure() & ~p.isin("HIGH", "CRITICAL", "MODERATE")).alias("low"), F.count_if(~_sure()).alias("needs_review"))


def report_summary(findings: DataFrame) -> DataFrame:
    """Per subject: a count for each priority of sure findings, critical apart, and needs_review."""
    of = lambda k: F.count_if(_sure() & (F.col("overall_priority") == k.upper())).alias(k)
    return findings.groupBy("subject_id").agg(*(of(k) for k in ("critical", "high", "moderate", "low", "none")), F.count_if(~_sure()).alias("needs_review"))


def observation_counts(sources: DataFrame, obs: DataFrame) -> DataFrame:
    """Every source with its number of observations, none included."""
    return sources.join(obs.groupBy("source_id").agg(F.count("*").alias("n")), "source_id", "left").select("source_id", F.coalesce("n", F.lit(0)).alias("n_observations"))


def scan_quality(findings: DataFrame, sources: DataFrame, obs: DataFrame) -> DataFrame:
    """One row: findings, needs_review, sources with findings, unreadable pages (retrieved, one observation at most), unfetchable pages."""
    a = findings.agg(F.count("*").alias("total_findings"), F.count_if(~_sure()).alias("needs_review"), F.count_distinct("source_id").alias("sources_with_findings"))
    counted = observation_counts(sources, obs).join(sources.select("source_id", "status"), "source_id")
    b = counted.agg(F.count_if((F.col("status") == "RETRIEVED") & (F.col("n_observations") <= 1)).alias("unreadable_pages"), F.count_if(F.col("status") != "RETRIEVED").alias("unfetchable_pages"))
    return a.join(b, F.lit(True))


def scan_stats(plan: DataFrame, sources: DataFrame, findings: DataFrame, errors: DataFrame) -> DataFrame:
    """Counters per scan_id from plan(scan_id, sensitive, ran), sources(scan_id, status, n_bytes), findings(scan_id), errors(scan_id, error); status INCOMPLETE if there was a search error."""
    a = plan.groupBy("scan_id").agg(F.count("*").alias("queries_planned"), F.count_if("ran").alias("queries_run"), F.count_if(F.col("sensitive") & ~F.col("ran")).alias("sensitive_skipped"))
    got = F.col("status") == "RETRIEVED"
    b = sources.groupBy("scan_id").agg(F.count("*").alias("candidates"), F.count_if(got).alias("retrieved"), F.count_if(F.col("status") == "RETRIEVAL_BLOCKED").alias("blocked"), F.count_if(~F.col("status").isin("RETRIEVED", "RETRIEVAL_BLOCKED")).alias("failed"), F.sum(F.when(got, F.col("n_bytes")).otherwise(0)).alias("bytes_downloaded"))
    c = findings.groupBy("scan_id").agg(F.count("*").alias("findings"))
    d = errors.groupBy("scan_id").agg(F.array_sort(F.collect_set("error")).alias("provider_errors"))
    out = a.join(b, "scan_id", "full").join(c, "scan_id", "left").join(d, "scan_id", "left")
    zero = [c for c in out.columns if c not in ("scan_id", "provider_errors")]
    out = out.fillna(0, zero).withColumn("provider_errors", F.coalesce("provider_errors", F.array().cast("array<string>")))
    return out.withColumn("status", F.when(F.size("provider_errors") > 0, "INCOMPLETE").otherwise("COMPLETE"))


def progress_pct(phase: Column) -> Column:
    """0 to 100 from scan_stats' counters: search is the first 30, reading the next 69."""
    planned = F.greatest(F.col("queries_planned") - F.col("sensitive_skipped"), F.lit(1))
    done = F.col("retrieved") + F.col("blocked") + F.col("failed")
    search = F.least(F.lit(30), F.floor(30 * F.col("queries_run") / planned))
    reading = 30 + F.least(F.lit(69), F.floor(69 * done / F.col("candidates")))
    some = F.col("candidates") > 0
    return F.when(phase == "done", 100).when(phase == "searching", search).when(some & (phase == "reading"), reading).otherwise(F.when(some, 30).otherwise(5)).cast("int")


def page_cards(findings: DataFrame, sources: DataFrame, obs: DataFrame) -> DataFrame:
    """One row per (subject, source): url, domain, title, the highest priority, identity, the distinct values found, in the order of work (work_order).

    The identity is that of the newest finding (created_at, if findings have it; ties by finding_id); items stand in the
    order in which they were first seen (seen_at, if observations have it, then obs_id).
    """
    at = F.col("created_at") if "created_at" in findings.columns else F.lit(None).cast("timestamp")
    each = findings.select("subject_id", "source_id", "category", F.explode("observation_ids").alias("obs_id")).join(obs.select("obs_id", "display_value", "is_sensitive", _seen(obs)), "obs_id")
    first = each.groupBy("subject_id", "source_id", "category", "display_value", "is_sensitive").agg(F.min(F.struct("seen_at", "obs_id")).alias("seen"))
    listed = F.array_sort(F.collect_list(F.struct("seen", "category", F.col("display_value").alias("value"), F.col("is_sensitive").alias("sensitive"))))
    items = first.groupBy("subject_id", "source_id").agg(F.transform(listed, lambda x: F.struct(x["category"].alias("category"), x["value"].alias("value"), x["sensitive"].alias("sensitive"))).alias("items"))
    cards = findings.groupBy("subject_id", "source_id").agg(F.max(T.severity_rank(F.col("overall_priority"))).alias("_rank"), F.max_by("match_state", F.struct(at, "finding_id")).alias("identity_state"), F.max_by("identity_confidence", F.struct(at, "finding_id")).alias("identity_confidence"), F.count("*").alias("n_findings"))
    out = cards.join(sources.select("source_id", "url", "registrable_domain", "title"), "source_id").join(items, ["subject_id", "source_id"], "left")
    review = ~F.coalesce(F.col("identity_state").isin(*ACTIONABLE), F.lit(False))
    return out.select("subject_id", "source_id", "url", "registrable_domain", "title", T.severity_of(F.col("_rank")).alias("priority"), "identity_state", "identity_confidence", review.alias("needs_review"), "n_findings", "items", (F.when(review, 0).otherwise(10) + 4 - F.col("_rank")).alias("work_order"))


def newest_first(rows: DataFrame, at: str, key: str) -> DataFrame:
    """rows with place, from 1: the newest first, ties by key; null dates come last. Places are counted by ranges (see ordered.before), so no task sorts all rows."""
    listed = rows.withColumns({"_all": F.lit(1), "_undated": F.col(at).isNull(), "_age": -F.unix_micros(F.col(at).cast("timestamp"))})
    return before(listed, "_all", ["_undated", "_age", key], "_all").select(*rows.columns, (F.col("_n") + 1).alias("place"))


def finding_details(findings: DataFrame, sources: DataFrame, matches: DataFrame, obs: DataFrame) -> DataFrame:
    """Each finding with its source, match and observations."""
    each = findings.select("finding_id", F.explode("observation_ids").alias("obs_id")).join(obs.select("obs_id", "type", "display_value", "evidence_snippet", "is_sensitive"), "obs_id")
    seen = each.groupBy("finding_id").agg(F.array_sort(F.collect_list(F.struct("type", "display_value", "evidence_snippet", "is_sensitive"))).alias("observations"))
    out = findings.join(sources.select("source_id", "url", "registrable_domain", "title", "status"), "source_id", "left")
    return out.join(matches.select("source_id", "subject_id", "supporting", "contradicting"), ["source_id", "subject_id"], "left").join(seen, "finding_id", "left")


def board_counts(board: DataFrame) -> DataFrame:
    """Cases per lane, and of all lanes (lane null)."""
    return board.rollup("lane").agg(F.count("*").alias("n_cases"))


def _judged(matches: DataFrame, labels: DataFrame) -> DataFrame:
    rows = labels.join(matches.select("subject_id", "key", "state"), ["subject_id", "key"], "left")
    sure = F.coalesce(F.col("state").isin(*ACTIONABLE), F.lit(False))
    return rows.select("tag", "is_match", sure.alias("sure"), F.concat_ws("|", "subject_id", "key").alias("pair"))


def offenders(matches: DataFrame, labels: DataFrame) -> DataFrame:
    """(tag, pair) of every auto-confirmed match that the labels say is none: all of them, one row each."""
    return _judged(matches, labels).where("sure AND NOT is_match").select("tag", "pair")


def evaluate(matches: DataFrame, labels: DataFrame, most: int = 100) -> DataFrame:
    """matches(subject_id, key, state), labels(subject_id, key, is_match, tag): tp, fp, fn, precision, recall of auto-confirmed matches, overall (tag null) and by tag.

    offenders: the first `most` keys of false positives, sorted, for people to look at (fp counts all; offenders() lists all).
    """
    rows = _judged(matches, labels)
    out = rows.rollup("tag").agg(F.count_if(F.col("sure") & F.col("is_match")).alias("tp"), F.count_if(F.col("sure") & ~F.col("is_match")).alias("fp"), F.count_if(~F.col("sure") & F.col("is_match")).alias("fn"))
    wrong = rows.where("sure AND NOT is_match").select("tag", "pair")
    listed = first_rows(wrong.unionByName(wrong.withColumn("tag", F.lit(None).cast("string"))), "tag", ["pair"], most)
    named = listed.groupBy("tag").agg(F.array_sort(F.collect_list("pair")).alias("offenders"))
    out = out.join(named.withColumnRenamed("tag", "_tag"), F.col("tag").eqNullSafe(F.col("_tag")), "left").drop("_tag")
    return out.select("tag", "tp", "fp", "fn", F.try_divide("tp", F.col("tp") + F.col("fp")).alias("precision"), F.try_divide("tp", F.col("tp") + F.col("fn")).alias("recall"), F.coalesce("offenders", F.array().cast("array<string>")).alias("offenders"))


#: The least precision of auto-confirmed matches (fixed value).
PRECISION_GATE = 0.98


def gate(evaluation: DataFrame, least: float = PRECISION_GATE) -> DataFrame:
    """An evaluation with passes: whether the precision, overall and of each tag, is `least` or more; without any auto-confirmed match there is nothing to fail."""
    return evaluation.withColumn("passes", F.coalesce(F.col("precision") >= least, F.lit(True)))


def state_distribution(matches: DataFrame) -> DataFrame:
    return matches.groupBy("state").agg(F.count("*").alias("n_matches"))


def quality_metrics(findings: DataFrame, sources: DataFrame, cases: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """One row: share of uncertain findings, of retrieved sources, of sources with a repeated canonical url, of findings with a case; bytes_used of retrieved sources (n_bytes, 0 without the column) and queries_used, the queries(ran) that ran."""
    a = findings.agg(F.try_divide(F.count_if(~_sure()), F.count("*")).alias("ambiguous_rate"), F.count("*").alias("n_findings"))
    got = F.col("status") == "RETRIEVED"
    size = F.coalesce(F.sum(F.when(got, F.col("n_bytes"))), F.lit(0)).cast("long") if "n_bytes" in sources.columns else F.lit(0).cast("long")
    b = sources.agg(F.try_divide(F.count_if(got), F.count("*")).alias("retrieval_success"), (1 - F.try_divide(F.count_distinct("canonical_url"), F.count("*"))).alias("duplicate_rate"), size.alias("bytes_used"))
    c = cases.agg(F.count_distinct("finding_id").alias("n_with_case"))
    ran = queries.agg(F.count_if("ran").alias("queries_used")) if queries is not None else cases.agg((F.count("*") * 0).alias("queries_used"))
    rows = a.join(b, F.lit(True)).join(c, F.lit(True)).join(ran, F.lit(True))
    return rows.select("ambiguous_rate", "retrieval_success", "duplicate_rate", F.try_divide("n_with_case", "n_findings").alias("remediation_coverage"), "bytes_used", "queries_used")


def packets(findings: DataFrame, sources: DataFrame, obs: DataFrame, snippets: int = 6, most: int = 20) -> DataFrame:
    """(finding_id, packet JSON): masked and bounded; the first snippets that aren't sensitive, the first observations, scaffolding marks removed."""
    seen = finding_observations(findings, obs)
    rows = findings.select("finding_id", "source_id", "category").join(sources.select("source_id", "title"), "source_id", "left").join(seen, "finding_id", "left")
    none = F.array().cast("array<struct<obs_id:string,type:string,display_value:string,evidence_snippet:string,is_sensitive:boolean>>")
    items = F.coalesce("observations", none)
    kept = F.transform(F.slice(F.filter(items, lambda o: ~o["is_sensitive"]), 1, snippets), lambda o: T.neutralize(o["evidence_snippet"]))
    shown = F.transform(F.slice(items, 1, most), lambda o: F.struct(o["type"].alias("type"), T.neutralize(o["display_value"]).alias("display_value")))
    packet = F.struct(F.left(T.neutralize(F.col("title")), F.lit(160)).alias("page_title"), F.col("category").alias("finding_category"), kept.alias("relevant_snippets"), shown.alias("observations"))
    return rows.select("finding_id", F.to_json(packet).alias("packet"))


def finding_observations(findings: DataFrame, obs: DataFrame) -> DataFrame:
    each = findings.select("finding_id", F.explode("observation_ids").alias("obs_id")).join(obs.select("obs_id", "type", "display_value", "evidence_snippet", "is_sensitive", _seen(obs)), "obs_id")
    listed = F.array_sort(F.collect_list(F.struct("seen_at", "obs_id", "type", "display_value", "evidence_snippet", "is_sensitive")))
    return each.groupBy("finding_id").agg(F.transform(listed, lambda o: o.dropFields("seen_at")).alias("observations"))


def validate_explanations(rows: DataFrame) -> DataFrame:
    """rows(finding_id, output JSON) that fit: explanation of at most 1200 characters, at most five review questions, no other field, all strings."""
    v = F.try_parse_json("output")
    keys = F.json_object_keys("output")
    text = F.try_variant_get(v, "$.explanation", "variant")
    questions = F.coalesce(F.try_variant_get(v, "$.review_questions", "array<variant>"), F.array().cast("array<variant>"))
    listed = ~F.coalesce(F.array_contains(keys, "review_questions"), F.lit(False)) | F.try_variant_get(v, "$.review_questions", "array<variant>").isNotNull()
    explanation = F.try_variant_get(v, "$.explanation", "string")
    ok = F.schema_of_variant(v).startswith("OBJECT") & (F.size(F.array_except(keys, F.array(F.lit("explanation"), F.lit("review_questions")))) == 0) & (F.schema_of_variant(text) == "STRING") & (F.length(explanation) <= 1200) & (F.size(questions) <= 5) & listed & F.forall(questions, lambda q: F.schema_of_variant(q) == "STRING")
    return rows.where(F.coalesce(ok, F.lit(False))).select("finding_id", explanation.alias("explanation"), F.transform(questions, lambda q: F.variant_get(q, "$", "string")).alias("review_questions"))


def subject_reports(subjects: DataFrame, findings: DataFrame, sources: DataFrame, cases: DataFrame) -> DataFrame:
    """(subject_id, report JSON): findings and cases nested, a summary, and the versions that made them."""
    f = findings.join(sources.select("source_id", "url", "registrable_domain", "title"), "source_id", "left")
    block = F.struct("finding_id", "category", F.col("overall_priority").alias("priority"), F.struct("sensitivity", "discoverability", "misuse_potential", "persistence").alias("dimensions"), F.struct(F.col("match_state").alias("state"), F.col("identity_confidence").alias("confidence")).alias("identity"), "explanation_codes", "summary", F.struct("url", F.col("registrable_domain").alias("domain"), "title").alias("source"))
    a = f.groupBy("subject_id").agg(F.array_sort(F.collect_list(block)).alias("findings"))
    c = cases.join(findings.select("finding_id", "subject_id"), "finding_id").groupBy("subject_id").agg(F.array_sort(F.collect_list(F.struct("case_id", "finding_id", "route", "state"))).alias("cases"))
    out = subjects.select("subject_id", T.primary_name(F.col("names")).alias("primary_name")).join(a, "subject_id", "left").join(c, "subject_id", "left").join(report_summary(findings), "subject_id", "left")
    summary = F.struct(*(F.coalesce(k, F.lit(0)).alias(k) for k in ("critical", "high", "moderate", "low", "none", "needs_review")))
    report = F.struct("subject_id", "primary_name", F.struct(*(F.lit(v).alias(k) for k, v in VERSIONS.items())).alias("provenance"), summary.alias("summary"), "findings", "cases")
    return out.select("subject_id", F.to_json(report).alias("report"))


#: Bytes of reports in a file.
REPORT_FILE = 64 << 20


def write_reports(reports: DataFrame, path: str, file_bytes: int = REPORT_FILE) -> DataFrame:
    """Writes reports(subject_id, report JSON) as lines of JSON in files of about file_bytes, sorted by subject, and an index of them; returns the index.

    The index (file, first, last: subject ids, n) has a row a file and lies beside the files, so one subject's report is
    read from the one file that may hold it. Subjects are dealt out by ranges of a sample, so no file is many times as
    large as others. Null reports are left out; a subject's reports, if several, stay all.
    """
    rows = durable(reports.select("subject_id", "report").where("report IS NOT NULL AND subject_id IS NOT NULL"))
    size = rows.agg(F.sum(F.octet_length("report").cast("long"))).first()[0] or 0
    ranged = rows.repartitionByRange(max(1, -(-size // file_bytes)), "subject_id").sortWithinPartitions("subject_id")
    ranged.write.mode("overwrite").json(f"{path}/files", compression="gzip")
    written = rows.sparkSession.read.schema("subject_id string, report string").json(f"{path}/files")
    index = written.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min("subject_id").alias("first"), F.max("subject_id").alias("last"), F.count("*").alias("n"))
    index.write.mode("overwrite").parquet(f"{path}/index")
    return rows.sparkSession.read.parquet(f"{path}/index")


def read_reports(spark: SparkSession, path: str, subject_ids: list[str]) -> DataFrame:
    """The stored reports of a few subjects (subject_id, report), from the files alone that may hold them."""
    index = spark.read.parquet(f"{path}/index")
    may = F.lit(False)
    for s in subject_ids:
        may = may | F.lit(s).between(F.col("first"), F.col("last"))
    files = [r["file"] for r in index.where(may).select("file").distinct().collect()]  # a file or two for each of the ids
    if not files:
        return spark.createDataFrame([], "subject_id string, report string")
    return spark.read.schema("subject_id string, report string").json(files).where(F.col("subject_id").isin(*subject_ids))
