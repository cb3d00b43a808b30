"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over document token windows."""

from __future__ import annotations

import functools
import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetrail.llm.common import ALNUM, discard, durable, in_batches, texts_of, unused

WINDOW = 13
#: Item words in one broadcast set, eight bytes of text more counting as another; more items are scanned in further blocks. A block takes 20 bytes a word and its vocabulary.
BLOCK_WORDS = 250_000
_MUL = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(ALNUM).split()


class Windows:
    """The windows of some items' words, packed: a vocabulary, all words as numbers, and for each length of window the hashes of the distinct ones in order, a place of each and the items that hold it."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.vocab: dict[bytes, int] = {}
        names: dict[str, int] = {}
        ids, places, base = [np.zeros(0, np.uint32)], {}, 0
        for item, words in items:
            n = min(window, len(words))
            if n:
                ids.append(np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words], np.uint32))
                starts = np.arange(base, base + len(words) - n + 1)
                places.setdefault(n, []).append((starts, np.full(len(starts), names.setdefault(item, len(names)))))
                base += len(words)
        self.items, self.ids = list(names), np.concatenate(ids)
        self.tables = {n: self._table(n, *map(np.concatenate, zip(*found))) for n, found in places.items()}

    def _table(self, n: int, starts: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, ...]:
        """(hashes, a place of each, ends of its items, items). Windows of one hash and other words have an entry each."""
        hashes = self.roll([self.ids[starts + k].astype(np.uint64) for k in range(n)])
        order = np.lexsort((owner, hashes))
        hashes, starts, owner = hashes[order], starts[order], owner[order]
        new = np.append(True, hashes[1:] != hashes[:-1])
        for k in range(n):
            words = self.ids[starts + k]
            new[1:] |= words[1:] != words[:-1]
        first = np.flatnonzero(new)
        return hashes[first], starts[first].astype(np.uint32), np.append(first, len(new)).astype(np.uint32), owner.astype(np.uint32)

    @staticmethod
    def roll(columns: list[np.ndarray]) -> np.ndarray:
        """A hash of each window; columns are the windows' first words, their second, and so on."""
        out = np.zeros(len(columns[0]), np.uint64)
        for column in columns:
            out = (out ^ column) * _MUL
            out ^= out >> np.uint64(29)
        return out

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """The words that stand in a window (boolean), and the items with occurring windows. Windows of only known words are looked up by hash, and all their words compared."""
        edge, found = np.zeros(len(words) + 1, np.int64), []
        get = self.vocab.get
        ids = np.fromiter((get(w, 0) for w in words), np.uint64, len(words))
        gaps = np.concatenate([[0], np.cumsum(ids == 0)])
        for n, (known, place, ends, owner) in self.tables.items():
            full = np.flatnonzero(gaps[n:] == gaps[:-n]) if len(ids) >= n else ()
            if not len(full):
                continue
            rolled = self.roll([ids[k : len(ids) - n + 1 + k] for k in range(n)])[full]
            at = np.searchsorted(known, rolled)
            while len(full):  # once more for each further entry of the same hash
                there = np.append(known, 0)[at] == rolled
                there &= at < len(known)
                full, rolled, at = full[there], rolled[there], at[there]
                same = np.ones(len(full), bool)
                for k in range(n):
                    same &= self.ids[place[at] + np.uint32(k)] == ids[full + k]
                np.add.at(edge, full[same], 1)
                np.add.at(edge, full[same] + n, -1)
                found += [owner[ends[c] : ends[c + 1]] for c in np.unique(at[same]).tolist()]
                at = at + 1
        return np.cumsum(edge[:-1]) > 0, {self.items[k] for k in (np.unique(np.concatenate(found)).tolist() if found else ())}


def _runs(hit: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def blocks_of(benchmark: DataFrame, most_words: int, window: int):
    """The items' words in blocks of at most so many words (or eight bytes of text each), held by the driver in turn. A longer item is cut into pieces that share window - 1 words, so that each of its windows stands in one."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    block, size, step = [], 0, max(1, most_words - window + 1)
    for r in rows.toLocalIterator():
        words = words_of(bytes(r.text))
        for at in range(0, max(1, len(words) - window + 1), step):
            piece = words[at : at + step + window - 1]
            here = len(piece) + sum(map(len, piece)) // 8
            if block and size + here > most_words:
                yield block
                block, size = [], 0
            block.append((r.item, piece))
            size += here
    yield block


ROW = "rid long, doc_id long, n_words long, spans array<struct<s:int,e:int>>, items array<string>"


def _scanned(docs: DataFrame, shared, every: bool) -> DataFrame:
    """docs(rid, doc_id, text) to ROW by one broadcast block of windows: for every row, or for those with hits."""

    def run(batches):
        windows = shared.value
        for batch in batches:
            rows = []
            for rid, doc, text in zip(batch.column("rid").to_pylist(), batch.column("doc_id").to_pylist(), texts_of(batch)):
                words = words_of(text or b"")
                hit, items = windows.scan(words)
                if every or items:
                    rows.append({"rid": rid, "doc_id": doc, "n_words": len(words), "spans": [{"s": s, "e": e} for s, e in _runs(hit)], "items": sorted(items)})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))), ("items", pa.list_(pa.string()))]))

    return in_batches(docs.select("rid", "doc_id", "text"), run, ROW)


def _blocks_hits(placed: DataFrame, blocks, window: int) -> DataFrame:
    """placed(rid, doc_id, text), written, against one block of items after the other, to ROW of the rows with hits in any, spans merged. One block is held at a time."""
    sc, found = placed.sparkSession.sparkContext, []
    for block in blocks:
        shared = sc.broadcast(Windows(block, window))
        found.append(durable(_scanned(placed, shared, False)))
        shared.destroy()
    every = functools.reduce(DataFrame.unionByName, found)
    joined = every.groupBy("rid", "doc_id", "n_words").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    # in order of their starts, a span either goes on with the last one or is new
    last = lambda acc: F.try_element_at(acc, F.lit(-1))
    grown = lambda acc, x: F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last(acc)["s"].alias("s"), F.greatest(last(acc)["e"], x["e"]).alias("e"))))
    merged = F.aggregate("spans", F.array().cast("array<struct<s:int,e:int>>"), lambda acc, x: F.when((F.size(acc) > 0) & (last(acc)["e"] >= x["s"]), grown(acc, x)).otherwise(F.concat(acc, F.array(x))))
    out = durable(joined.withColumn("spans", merged))
    discard(*found)
    return out


def _first_two(blocks):
    """The only block and None, or None and all blocks, one at a time."""
    first = next(blocks)
    second = next(blocks, None)
    return (first, None) if second is None else (None, itertools.chain([first, second], blocks))


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs(doc_id, text), benchmark(item_id, text) to (rid, doc_id, n_words, spans array<struct<s,e>>, items array<string>), one row per document.

    spans are the maximal runs of hit words, [s, e) in words. The set of test windows is broadcast while it has at most
    block_words words; a larger benchmark is scanned block by block over a written copy of the documents, with the same
    result. Null text has no words; null item ids or texts are left out; equal items count one each; a benchmark
    without words hits nothing; an item longer than a block is scanned in pieces, with the same result; repeated rows each stay; extra columns of docs are ignored; no documents, no rows.
    """
    one, blocks = _first_two(blocks_of(benchmark, block_words, window))
    placed = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    if one is not None:
        return _scanned(placed, docs.sparkSession.sparkContext.broadcast(Windows(one, window)), True)
    placed = durable(placed)
    found = _blocks_hits(placed, blocks, window)
    every = _scanned(placed, docs.sparkSession.sparkContext.broadcast(Windows([], window)), True).select("rid", "doc_id", "n_words")
    none = F.array()
    return every.join(found.select("rid", "spans", "items"), "rid", "left").select("rid", "doc_id", "n_words", F.coalesce("spans", none.cast("array<struct<s:int,e:int>>")).alias("spans"), F.coalesce("items", none.cast("array<string>")).alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, per_words: int = 20) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans; contaminated: n_hit > 0 and per_words * n_hit >= n_words.

    Nulls, repeated rows, extra columns and empty tables are as in scan(); a share of exactly one in per_words counts.
    """
    found = scan(docs, benchmark, window, block_words)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + (x["e"] - x["s"]).cast("long"))
    return found.withColumn("n_hit", n_hit).select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (per_words * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "spans")


def remove(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, per_words: int = 20, whole: bool = True) -> DataFrame:
    """docs without contaminated documents (whole), or with the hit words of every document cut out of its text (whole=False); all columns stay, whatever their names.

    A document with fewer hits than the rule's share stays as it is under whole=True. Spans are cut once, from the
    original text, whatever the number of blocks. Null text is kept; repeated rows are each judged; no documents, no rows.
    """
    sc, names, schema = docs.sparkSession.sparkContext, docs.columns, docs.schema
    one, blocks = _first_two(blocks_of(benchmark, block_words, window))
    if one is not None:
        shared = sc.broadcast(Windows(one, window))

        def drop(batches):
            for batch in batches:
                clean = []
                for text in texts_of(batch):
                    words = words_of(text or b"")
                    n = int(shared.value.scan(words)[0].sum())
                    clean.append(not (n and per_words * n >= len(words)))
                yield batch.filter(pa.array(clean, pa.bool_()))

        def cut(batches, at=names.index("text")):
            for batch in batches:
                out = [None if t is None else blank(t, _runs(shared.value.scan(words_of(t))[0])) for t in texts_of(batch)]
                yield batch.set_column(at, "text", pa.array(out, pa.string()))

        return in_batches(docs, drop if whole else cut, schema)
    rid, at = unused("rid", names), unused("spans", names)
    placed = durable(docs.withColumn(rid, F.monotonically_increasing_id()))
    found = _blocks_hits(placed.select(F.col(rid).alias("rid"), F.lit(None).cast("long").alias("doc_id"), "text"), blocks, window)
    if whole:
        n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + (x["e"] - x["s"]).cast("long"))
        return placed.join(found.where(per_words * n_hit >= F.col("n_words")).select(F.col("rid").alias(rid)), rid, "left_anti").select(*names)

    def cut_spans(batches, text=names.index("text")):
        for batch in batches:
            out = [None if t is None else blank(t, [(x["s"], x["e"]) for x in spans or []]) for t, spans in zip(texts_of(batch), batch.column(at).to_pylist())]
            yield batch.set_column(text, "text", pa.array(out, pa.string())).select(names)

    return in_batches(placed.join(found.select(F.col("rid").alias(rid), F.col("spans").alias(at)), rid, "left").select(*names, at), cut_spans, schema)


def blank(text: bytes, spans: list[tuple[int, int]]) -> str:
    """The text without these runs of words (each from its first word's first to its last word's last byte)."""
    if not spans:
        return text.decode("utf-8", "replace")
    is_word = np.frombuffer(text.translate(ALNUM), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate([[0], is_word.astype(np.int8), [0]])))
    starts, ends, out, last = edge[::2], edge[1::2], [], 0
    for s, e in spans:
        out.append(text[last : starts[s]])
        last = ends[e - 1]
    return b"".join([*out, text[last:]]).decode("utf-8", "replace")


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
