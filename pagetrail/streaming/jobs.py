"""Streams: pages as they are crawled, progress per window, cases by their events, and first sights of urls."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from pagetrail.functions import urls as U
from pagetrail.operators.extract import subject_terms
from pagetrail.plans.scan import scan, sources_of
from pagetrail.schema import TRANSITIONS
from pagetrail.session import durable
from pagetrail.sources.stored import Stored


def monitor_pages(stream: DataFrame, subjects: DataFrame, sink: str, checkpoint: str, on_batch: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Scans each micro-batch of a stream of pages (scan_id, url, html, content_type, from_search) and writes its findings under the batch's number.

    A batch that runs again overwrites its own folder, so each page's findings stand once; assess.supersede picks the
    newest per page and subject when the table is read. The subjects' terms are prepared once, when the stream starts.
    """
    terms = durable(subject_terms(subjects))

    def run(batch: DataFrame, number: int) -> None:
        found = scan(batch, None, terms=terms)
        rows = found.findings.join(found.sources.select("source_id", "canonical_url", "scan_id"), "source_id")
        rows.write.mode("overwrite").parquet(f"{sink}/batch={number}")
        if on_batch:
            on_batch(rows, number)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


FOLLOWED = "source_id string, canonical_url string, content_hash string, at timestamp"
FOUND = "source_id string, canonical_url string, finding_id string, subject_id string, category string, overall_priority string, match_state string, identity_confidence double, at timestamp"


def followed(spark: SparkSession, path: str) -> tuple[Stored, Stored]:
    """The stored tables of follow_pages: the pages as they were last read, and the findings on them."""
    kind = lambda schema: spark.createDataFrame([], schema).schema
    return Stored(spark, f"{path}/pages", ["source_id"], kind(FOLLOWED)), Stored(spark, f"{path}/findings", ["source_id"], kind(FOUND))


def follow_pages(stream: DataFrame, subjects: DataFrame | None, path: str, checkpoint: str, extra: Sequence = (), terms: DataFrame | None = None) -> StreamingQuery:
    """Keeps the findings of a stream of pages (url, html, content_type, from_search, at timestamp) up to date in stored tables (see followed).

    Each page, known by its canonical url, has one state: the hash and time of its newest content. Of a micro-batch only
    pages whose content is new go on to be parsed and matched; their findings take the place of the page's older ones,
    and where nothing is found any more the older ones go. A page that couldn't be read, or a copy older than the one
    known, changes nothing. Only buckets of the stored tables that hold such pages are rewritten. Both tables take a
    batch under its number, so one that runs again, whole or in part, counts once. A batch without new content is not
    scanned, one of which all is known writes nothing. Terms are prepared once a stream, if they aren't at hand. extra, terms: as in scan().
    """
    spark = stream.sparkSession
    pages, findings = followed(spark, path)
    terms = durable(subject_terms(subjects)) if terms is None else terms

    def run(batch: DataFrame, number: int) -> None:
        rows = sources_of(batch.withColumn("scan_id", F.lit(""))).where("status = 'RETRIEVED'")
        rows = durable(rows.select("source_id", "canonical_url", "content_hash", "at", "scan_id", "url", "html", "content_type", "from_search"))
        seen = rows.select("source_id", "canonical_url", "content_hash", "at")
        last = seen.groupBy("source_id").agg(F.max_by(F.struct("canonical_url", "content_hash", "at"), F.struct("at", "content_hash")).alias("x")).select("source_id", "x.*")
        known = pages.read().select("source_id", F.col("content_hash").alias("_hash"), F.col("at").alias("_at"))
        newer = durable(last.join(known, "source_id", "left").where("_at IS NULL OR at > _at").withColumn("changed", F.coalesce(F.col("content_hash") != F.col("_hash"), F.lit(True))).drop("_hash", "_at"))
        if newer.isEmpty():
            return
        fresh = newer.where("changed")
        if not fresh.isEmpty():
            follow(rows, fresh, number)
        pages.upsert(newer, "at", change=f"batch {number}")

    def follow(rows: DataFrame, fresh: DataFrame, number: int) -> None:
        changed = rows.join(fresh.select("source_id", "content_hash", "at"), ["source_id", "content_hash", "at"], "left_semi").select("scan_id", "url", "html", "content_type", "from_search")
        found = scan(changed, None, extra, terms=terms).findings
        out = found.join(fresh.select("source_id", "canonical_url", "at"), "source_id").select(*(f.split()[0] for f in FOUND.split(", ")))
        findings.replace(fresh.select("source_id"), out, change=f"batch {number}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def scan_progress(stream: DataFrame, window: str = "10 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """stream(scan_id, status, n_bytes, at timestamp) to counters per scan and window (tumbling, or sliding by slide); rows later than the watermark are dropped."""
    span = F.window("at", window, slide) if slide else F.window("at", window)
    got = F.col("status") == "RETRIEVED"
    out = stream.withWatermark("at", late).groupBy(span.alias("w"), "scan_id").agg(F.count("*").alias("candidates"), F.count_if(got).alias("retrieved"), F.count_if(F.col("status") == "RETRIEVAL_BLOCKED").alias("blocked"), F.sum(F.when(got, F.col("n_bytes")).otherwise(0)).alias("bytes_downloaded"))
    return out.select(F.col("w.start").alias("window_start"), "scan_id", "candidates", "retrieved", "blocked", "bytes_downloaded")


CASE_STATE = "case_id string, at timestamp, event_id long, target_state string, state string, accepted boolean"


class CaseMachine(StatefulProcessor):
    """A case's state, moved by its events in order of time within a batch; illegal events leave it and come out as not accepted."""

    def __init__(self, start: str = "ACTION_SELECTED"):
        self.start = start

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "state string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["at", "event_id"])
        state, out = (self.state.get()[0] if self.state.exists() else self.start), []
        for r in batch.itertuples():
            ok = r.target_state in TRANSITIONS.get(state, ())
            state = r.target_state if ok else state
            out.append((key[0], r.at, r.event_id, r.target_state, state, ok))
        self.state.update((state,))
        yield pd.DataFrame(out, columns=["case_id", "at", "event_id", "target_state", "state", "accepted"])

    def close(self) -> None:
        pass


def case_states(stream: DataFrame, start: str = "ACTION_SELECTED") -> DataFrame:
    """stream(case_id, at, event_id, target_state) to each event with the case's state after it (CASE_STATE). Needs the RocksDB state store."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the state worker starts before shipped files are on its path
    return stream.groupBy("case_id").transformWithStateInPandas(statefulProcessor=CaseMachine(start), outputStructType=CASE_STATE, outputMode="Update", timeMode="None")


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def first_sights(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """stream(scan_id, url, at timestamp) to the first row of each canonical url of a scan within the watermark; urls that can't be read are dropped."""
    rows = stream.withColumn("canonical_url", U.canonical_url(F.col("url"))).where("canonical_url IS NOT NULL")
    return rows.withWatermark("at", late).dropDuplicatesWithinWatermark(["scan_id", "canonical_url"])
