"""Substring dedup: every run of several consecutive sentences is hashed, joined globally, and sentences covered by a non-first repeated run go."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetrail.llm.common import discard, durable, if_few, in_batches, row_ids, texts_of, unused
from pagetrail.llm.tally import ASKED, RANGE, ask, batch_of, mixed, tally, totals_of

#: A run has at least so many sentences and so many words.
SENTENCES = 2
WORDS = 20
#: A sentence is cut before a word whose hash is the smallest of the so many words on each side, if both parts have at least MARGIN words; the parts count as sentences.
NEAR = 3
MARGIN = 8
#: Sentences in a block of texts.
BLOCK = 400_000
_ODD = np.uint64(0x9E3779B97F4A7C17)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))

_END = re.compile(rb"[.!?]+(?=\s)\s*|\n\s*")
_WORD = re.compile(rb"\S+")


def cuts(words: list[bytes]) -> list[int]:
    """Where a sentence of these words is cut. Only the MARGIN words on each side of a place decide, so a passage is cut alike whatever surrounds it."""
    n = len(words)
    if n < 2 * MARGIN:
        return []
    hashes = np.fromiter(map(zlib.crc32, words), np.int64, n)
    least = np.lib.stride_tricks.sliding_window_view(hashes, 2 * NEAR + 1).min(axis=1)
    at = np.arange(MARGIN, n - MARGIN + 1)
    return at[hashes[at] == least[at - NEAR]].tolist()


def units(text: bytes) -> tuple[list[tuple[int, int]], list[list[bytes]]]:
    """Byte ranges of the sentences, which cover the text, and their lower-cased words. A sentence ends at marks before white space, or at a line's end; a long one is cut where its words say so."""
    ranges, parts, low = [], [], text.lower()
    ends = [m.end() for m in _END.finditer(low)]
    for a, b in zip([0, *ends], [*ends, len(text)]):
        if a == b:
            continue
        words = low[a:b].split()
        at = cuts(words)
        if at:
            places = [m.start() for m in _WORD.finditer(low, a, b)]
            starts = [places[k] for k in at]
            ranges += zip([a, *starts], [*starts, b])
            parts += [words[i:j] for i, j in zip([0, *at], [*at, len(words)])]
        else:
            ranges.append((a, b))
            parts.append(words)
    return ranges, parts


def runs(text: bytes, least: int = SENTENCES, words: int = WORDS) -> list[tuple[int, int, int]]:
    """(hash, first, end) of the runs of sentences: from every sentence on, and up to every sentence, the shortest with enough sentences and words."""
    parts = units(text)[1]
    hashes = np.array([xxhash.xxh3_64_intdigest(b" ".join(p)) for p in parts], np.uint64)
    h, first, end = span_hashes(hashes, np.array([len(p) for p in parts], np.int64), np.array([len(parts)], np.int64), least, words)
    return list(zip(h.tolist(), first.tolist(), end.tolist()))


def span_hashes(hashes: np.ndarray, sizes: np.ndarray, counts: np.ndarray, least: int, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first, end), by place, of the runs of several texts' sentences, which stand one text after another.

    hashes and sizes (in words) are the sentences', counts their number in each text. A run of any length is hashed from
    two sums over its sentences' hashes, so none is written out.
    """
    n = len(hashes)
    stop = np.repeat(np.cumsum(counts), counts)  # of each sentence's text
    start = stop - np.repeat(counts, counts)
    i, upto = np.arange(n), np.concatenate([[0], np.cumsum(sizes)])
    end = np.maximum(np.searchsorted(upto, upto[:-1] + words), i + least)
    first = np.minimum(np.searchsorted(upto, upto[1:] - words, side="right") - 1, i + 1 - least)
    a, b = np.concatenate([i[end <= stop], first[first >= start]]), np.concatenate([end[end <= stop], i[first >= start] + 1])
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.append(True, (np.diff(a) != 0) | (np.diff(b) != 0))[: len(a)]
    a, b = a[new], b[new]
    # sums of the hashes, each times a power of an odd number, from the run's first sentence on
    power = np.cumprod(np.full(n + 1, _ODD)) * _INVERSE
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * power[:n])])
    inverse = np.cumprod(np.full(n + 1, _INVERSE)) * _ODD
    return mixed((total[b] - total[a]) * inverse[a] + (b - a).astype(np.uint64)), a, b


def sentence_blocks(docs: DataFrame) -> DataFrame:
    """docs(rid, d, text) to blocks of about BLOCK sentences: block, n, and the numbers of its rows packed: rid, d, counts, hashes, sizes."""

    def run(batches):
        ids, held = row_ids(), []

        def out():
            rid, d, counts, hashes, sizes = (np.concatenate(c) for c in zip(*held))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([next(ids)]), pa.array([len(hashes)]), *(pa.array([np.ascontiguousarray(x).astype(t).tobytes()], pa.binary()) for x, t in ((rid, "<i8"), (d, "<i8"), (counts, "<i8"), (hashes, "<u8"), (sizes, "<i4")))], names=["block", "n", "rid", "d", "counts", "hashes", "sizes"])

        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                hashes, sizes, counts = [], [], []
                for text in texts_of(batch):
                    parts = units(text)[1] if text else []
                    counts.append(len(parts))
                    sizes += map(len, parts)
                    hashes += [xxhash.xxh3_64_intdigest(b" ".join(p)) for p in parts]
                held.append((batch.column("rid").to_numpy(), batch.column("d").to_numpy(), np.array(counts, np.int64), np.array(hashes, np.uint64), np.array(sizes, np.int64)))
                if sum(len(h[3]) for h in held) >= BLOCK:
                    yield out()
        if held:
            yield out()

    return in_batches(docs, run, "block long, n long, rid binary, d binary, counts binary, hashes binary, sizes binary")


def _spans(row: dict, least: int, words: int) -> tuple[np.ndarray, ...]:
    """(hash, rid, d, first, end) of a block's runs, first and end counted in their text."""
    rid, d, counts, hashes, sizes = (np.frombuffer(row[c], t) for c, t in (("rid", "<i8"), ("d", "<i8"), ("counts", "<i8"), ("hashes", "<u8"), ("sizes", "<i4")))
    h, a, b = span_hashes(hashes, sizes.astype(np.int64), counts, least, words)
    of = np.repeat(np.arange(len(rid)), counts)[a]
    start = (np.cumsum(counts) - counts)[of]
    return h, rid[of], d[of], a - start, b - start


def repeated_spans(docs: DataFrame, least: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """docs(doc_id, text) to spans(rid, first, end) of non-first repeated runs; rid is xxhash64(doc_id, text).

    Every block of texts asks how often the hash of each of its runs occurs anywhere; only the runs that occur twice
    or more become rows, and are joined on their hash with the first place. The first of equal runs is the one in the
    smallest (doc_id, place in the text); documents without an id come last.
    """
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("rid"), F.coalesce("doc_id", F.lit((1 << 63) - 1)).cast("long").alias("d"), "text")
    blocks = durable(sentence_blocks(keyed))
    parts = max(1, -(-2 * (blocks.agg(F.sum("n")).first()[0] or 0) // RANGE))

    def asking(batches):
        for batch in batches:
            for row in batch.to_pylist():
                keys, counts = np.unique(_spans(row, least, words)[0], return_counts=True)
                yield batch_of(list(ask(row["block"], 1, keys, np.minimum(counts, 2), 64, parts)))

    def picking(left: pa.Table, right: pa.Table) -> pa.Table:
        h, rid, d, first, end = _spans(left.to_pylist()[0], least, words)
        keys = np.unique(h)
        often = keys[totals_of(right, 1) > 1]
        at = np.isin(h, often)
        return pa.table([pa.array(h[at].view(np.int64)), pa.array(rid[at]), pa.array(d[at]), pa.array(first[at].astype(np.int32)), pa.array(end[at].astype(np.int32))], names=["h", "rid", "d", "first", "end"])

    answers = tally(in_batches(blocks, asking, ASKED))
    flat = durable(blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(picking, "h long, rid long, d long, first int, end int"))
    discard(blocks)
    where = F.struct("d", "rid", "first")
    once = durable(flat.groupBy("h").agg(F.min(where).alias("original")))
    out = flat.join(once, "h").where(where != F.col("original")).select("rid", "first", "end")
    out.reads = (flat, once)
    return out


def by_document(spans: DataFrame) -> DataFrame:
    """(rid, first, end) to (rid, spans array<struct<first, end>>): the ranges of sentences that a text's spans cover, in order, none touching the next. A text of n sentences has at most 2n spans."""
    last = lambda acc: F.try_element_at(acc, F.lit(-1))
    grown = lambda acc, x: F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last(acc)["first"].alias("first"), F.greatest(last(acc)["end"], x["end"]).alias("end"))))
    none = F.array().cast("array<struct<first:int,end:int>>")
    merged = F.aggregate("spans", none, lambda acc, x: F.when((F.size(acc) > 0) & (last(acc)["end"] >= x["first"]), grown(acc, x)).otherwise(F.concat(acc, F.array(x))))
    return spans.groupBy("rid").agg(F.array_sort(F.collect_set(F.struct("first", "end"))).alias("spans")).select("rid", merged.alias("spans"))


def cut(text: bytes, parts: list[int]) -> bytes:
    """The text without the given sentences."""
    gone = set(parts)
    return b"".join(text[a:b] for k, (a, b) in enumerate(units(text)[0]) if k not in gone)


def substring_dedup(docs: DataFrame, least: int = SENTENCES, words: int = WORDS) -> DataFrame:
    """docs(doc_id, text, ...) with its columns, text without the repeated sentences, and n_removed int (sentences), removed_words long.

    The first place of a repeated run keeps it, all others lose every sentence that such a run covers; text without
    repeats stays byte for byte. Equal texts under other ids are repeats: all but the first become short or empty, none
    is dropped. Rows with the same id and text are one document, and each gets the same cuts. Null text stays null; a
    null doc_id is later than any id; texts of fewer sentences than a run hold none; an empty table gives no rows.
    Columns called n_removed or removed_words are replaced.
    """
    docs = docs.drop("n_removed", "removed_words")
    spans = repeated_spans(docs, least, words)
    hits = durable(by_document(spans))
    discard(*spans.reads)
    schema, names = docs.select("*", F.lit(0).alias("n_removed"), F.lit(0).cast("long").alias("removed_words")).schema, docs.columns
    rid, at = unused("rid", docs.columns), unused("spans", docs.columns)
    joined = docs.withColumn(rid, F.xxhash64("doc_id", "text")).join(if_few(hits.select(F.col("rid").alias(rid), F.col("spans").alias(at)), 4 + 4 * F.size(at)), rid, "left").drop(rid)

    def run(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                batch = whole.slice(k, 512)
                texts, removed, lost = [], [], []
                for text, spans in zip(texts_of(batch), batch.column(at).to_pylist()):
                    parts = [k for x in spans or [] for k in range(x["first"], x["end"])]
                    out = text if text is None or not parts else cut(text, parts)
                    texts.append(out)
                    removed.append(len(parts))
                    lost.append(0 if out is text else len(text.split()) - len(out.split()))
                columns = [pa.array(texts, pa.binary()).cast(pa.string()) if c == "text" else batch.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(removed, pa.int32()), pa.array(lost, pa.int64())], names=[*names, "n_removed", "removed_words"])

    return in_batches(joined, run, schema)
