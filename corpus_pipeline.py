"""A training-data pipeline over documents: language ID, near-dedup, substring dedup, decontamination, packing."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetrail.llm import decontam, langid, packing, simhash, substring
from pagetrail.llm.common import durable, table, unused

#: Documents whose calibrated language probability is lower are rejected, as are those without a letter.
LANGUAGE_SURE = 0.5


def _set_aside(docs: DataFrame, *names: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with columns of these names called otherwise, and what gives a result docs' own columns again."""
    taken = list(docs.columns)
    aside = {}
    for c in docs.columns:
        if c.lower() in names:
            aside[c] = unused(c, [*taken, *names])
            taken.append(aside[c])
    return docs.withColumnsRenamed(aside), lambda out: out.select(*(F.col(aside.get(c, c)).alias(c) for c in docs.columns))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a learned language: at least one letter, and a probability of LANGUAGE_SURE or more. Null and letterless texts go; repeated rows are judged alike; an empty table stays empty. Columns of docs that are called as the prediction's keep their values."""
    rows, back = _set_aside(docs, "lang_pred", "score")
    judged = langid.predict(rows, langid.fit(rows))
    return back(judged.where((judged.lang_pred != langid.UNKNOWN) & (judged.score >= LANGUAGE_SURE)))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document (the smallest doc_id) of each group of near-duplicates: five-word shingles, similarity 0.8 or more. Texts without words (null, blank) are all kept; of rows with one doc_id and text one stays; an empty table stays empty."""
    return simhash.near_dedup(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated runs of sentences from the texts; no document goes, n_chars stays that of the source. A null text stays null."""
    rows, back = _set_aside(docs, "n_removed", "removed_words")
    return back(substring.substring_dedup(rows))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which benchmark windows cover a twentieth of the words or more."""
    return decontam.remove(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences of 1024: one row per piece with its ids (little-endian uint32)."""
    return packing.best_fit_packing(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES = [
    ("language_id", language_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("decontamination", decontamination_stage),
    ("best_fit_packing", packing_stage),
]

#: SQL can't express the stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
