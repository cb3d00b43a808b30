"""A substring join of texts and needles: rare anchors of the needles are sought in the texts, and what meets is verified."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetrail.session import durable

#: Bytes of an anchor: as many as the needle has, or the most. A needle has three characters or more.
WIDTHS = (3, 4, 5, 6, 7, 8)
#: Frequencies of anchors are kept in so many slots for each width, from so many texts; they steer which anchor a needle takes, never what is found.
SLOTS, SAMPLE = 1 << 14, 2000
#: Bits of the filter for each anchor, at least and at most (powers of two). An anchor sets two of them.
FILTER_BITS, LEAST_BITS, MOST_BITS = 64, 1 << 23, 1 << 28
#: A key that stands in the texts so often (by the sample) has its rows dealt out over several, at most MOST_SALTS.
HOT, MOST_SALTS = 100_000, 64
#: Characters left and right of a needle in its snippet.
AROUND = 80
#: Bytes of text that are looked at together.
PIECE = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
HIT = "source_id string, width int, key long, salt int, at int, lead int, low string, around string, around_lead int, n_chars int"
ANCHOR = "needle string, width int, key long, off int, hash long, salts int"


def _windows(data: np.ndarray) -> np.ndarray:
    """At each place the next eight bytes as a number, with zeros after the end."""
    out = np.zeros(len(data), np.uint64)
    for j in range(min(8, len(data))):
        out[: len(data) - j] |= data[j:].astype(np.uint64) << np.uint64(8 * j)
    return out


def _keys(windows: np.ndarray, width: int) -> np.ndarray:
    return windows if width == 8 else windows & np.uint64((1 << 8 * width) - 1)


def _hashes(keys: np.ndarray, width: int) -> np.ndarray:
    x = (keys + np.uint64(width)) * _ODD
    x ^= x >> np.uint64(29)
    return x * _ODD


def _slot(keys: np.ndarray, width: int) -> np.ndarray:
    return (_hashes(keys, width) >> np.uint64(50)).astype(np.int64)


def width_of(n_bytes: int) -> int:
    return min(n_bytes, WIDTHS[-1])


def _frequencies(texts: DataFrame, column: str) -> np.ndarray:
    """How often the anchors of each slot stand in the texts: one row of SLOTS numbers for each width. A task sends its non-zero slots."""

    def run(batches):
        total = np.zeros((len(WIDTHS), SLOTS), np.int64)
        for batch in batches:
            whole = _Batch(batch.column(0))
            for a, windows, _ in whole.pieces():
                left = whole.starts[np.searchsorted(whole.starts, np.arange(a, a + len(windows)), side="right")] - np.arange(a, a + len(windows))
                for i, w in enumerate(WIDTHS):
                    total[i] += np.bincount(_slot(_keys(windows[left >= w], w), w), minlength=SLOTS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.reshape(-1)[at])], names=["slot", "n"])

    out = np.zeros(len(WIDTHS) * SLOTS, np.int64)
    sums = texts.select(column).mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # at most the slots, whatever the input
    out[sums.column("slot").to_numpy()] = sums.column("n").to_numpy()
    return out.reshape(len(WIDTHS), SLOTS)


def _salts(frequency: np.ndarray) -> np.ndarray:
    return np.clip(-(-frequency // HOT), 1, MOST_SALTS).astype(np.int32)


def anchors(needles: DataFrame, texts: np.ndarray, own: np.ndarray) -> DataFrame:
    """needles(needle) with its anchor: the place whose bytes are rarest in the texts and among the needles, by the given frequencies."""

    def run(batches):
        for batch in batches:
            whole = _Batch(batch.column("needle"))
            first, size = whole.starts[:-1], np.diff(whole.starts)
            windows, inside = _windows(whole.data), (whole.data & 0xC0) == 0x80  # inside: not where a character begins
            width = np.minimum(size, WIDTHS[-1])
            places = size - width + 1
            begin = np.cumsum(places) - places
            row = np.repeat(np.arange(len(size)), places)
            at = first[row] + np.arange(len(row)) - begin[row]
            keys, slots, hashes, cost = windows[at], np.zeros(len(at), np.int64), np.zeros(len(at), np.uint64), np.zeros(len(at))
            for i, w in enumerate(WIDTHS):
                of = np.flatnonzero(width[row] == w)
                keys[of] = _keys(keys[of], w)
                slots[of], hashes[of] = _slot(keys[of], w), _hashes(keys[of], w)
                cost[of] = (texts[i, slots[of]] + 1.0) * own[i, slots[of]]
            cost[inside[at]] = np.inf
            least = np.flatnonzero(cost == np.minimum.reduceat(cost, begin)[row]) if len(cost) else np.zeros(0, np.int64)
            best = least[np.searchsorted(least, begin)] if len(cost) else least  # of equal ones a needle's first
            chars = np.append(0, np.cumsum(~inside))
            salts = np.zeros(len(best), np.int32)
            for i, w in enumerate(WIDTHS):
                salts[width == w] = _salts(texts[i, slots[best[width == w]]])
            columns = (width.astype(np.int32), keys[best].astype(np.int64), (chars[at[best]] - chars[first]).astype(np.int32), hashes[best].astype(np.int64), salts)
            yield pa.RecordBatch.from_arrays([batch.column("needle"), *map(pa.array, columns)], names=["needle", "width", "key", "off", "hash", "salts"])

    return needles.mapInArrow(run, ANCHOR)


def _filter(found: DataFrame, bits: int) -> np.ndarray:
    """Two bits of each anchor's hash, its lowest and those from the 33rd, as bytes; built by Spark's bitmap aggregates, at most MOST_BITS."""
    rows = found.select(F.explode(F.array(F.col("hash"), F.shiftrightunsigned("hash", 33))).alias("hash")).select((F.col("hash").bitwiseAND(F.lit(bits - 1)) + 1).alias("bit"))
    parts = rows.groupBy(F.bitmap_bucket_number("bit").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    out = np.zeros(bits // 8, np.uint8)
    for row in parts.toLocalIterator():
        start = (row["part"] - 1) * 4096
        out[start : start + 4096] = np.frombuffer(row["bits"], np.uint8)
    return out


def _has(held: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return held[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1


class _Batch:
    """The texts of an Arrow batch as one run of bytes."""

    def __init__(self, low: pa.Array):
        low = low.cast(pa.large_binary()).fill_null(b"")
        at = np.frombuffer(low.buffers()[1], np.int64)[low.offset : low.offset + len(low) + 1]
        self.data = np.frombuffer(low.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
        self.starts = at - at[0]

    def pieces(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of each piece: its first place, the windows there, and how many characters begin before each place."""
        before = 0
        for a in range(0, len(self.data), PIECE):
            part = self.data[a : a + PIECE + 7]
            n = min(PIECE, len(self.data) - a)
            begins = (part[:n] & 0xC0) != 0x80
            chars = before + np.cumsum(begins) - begins
            before += int(begins.sum())
            yield a, _windows(part)[:n], chars


def hits(texts: DataFrame, widths: list[int], filters: tuple[np.ndarray, np.ndarray], bits: int, frequency: np.ndarray, longest: int) -> DataFrame:
    """texts(source_id, text, low) to the places where an anchor may begin, each with what surrounds it: enough of the text for any needle of `longest` characters and its snippet.

    filters: the bits of all anchors, and of those that are part of a longer needle. Of the others, which are whole
    needles, only a text's first place counts.
    """
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast((*filters, frequency))

    def run(batches):
        held, parts, known = shared.value
        mask = np.uint64(bits - 1)
        for batch in batches:
            low, text, ids = batch.column("low"), batch.column("text"), batch.column("source_id")
            whole = _Batch(low)
            first_char = np.zeros(len(low), np.int64)
            rows, strings = [], (-1, "", "")
            for a, windows, chars in whole.pieces():
                inside = np.searchsorted(whole.starts[:-1], [a, a + len(windows)])
                own = np.arange(*inside)
                first_char[own] = chars[whole.starts[own] - a]
                for w in widths:
                    keys = _keys(windows, w)
                    h = _hashes(keys, w)
                    at = np.flatnonzero(_has(held, h & mask))
                    at = at[_has(held, h[at] >> np.uint64(33) & mask).astype(bool)]
                    doc = np.searchsorted(whole.starts, at + a, side="right") - 1
                    fits = at + a + w <= whole.starts[doc + 1]
                    at, doc = at[fits], doc[fits]
                    order = np.lexsort((at, keys[at], doc))
                    again = np.append(False, (np.diff(doc[order]) == 0) & (np.diff(keys[at[order]].astype(np.int64)) == 0))[: len(at)]
                    longer = (_has(parts, h[at[order]] & mask) & _has(parts, h[at[order]] >> np.uint64(33) & mask)).astype(bool)
                    at, doc = at[order][longer | ~again], doc[order][longer | ~again]
                    salts = _salts(known[WIDTHS.index(w), _slot(keys[at], w)])
                    for place, d, key, s, c in zip(at.tolist(), doc.tolist(), keys[at].astype(np.int64).tolist(), salts.tolist(), chars[at].tolist()):
                        if strings[0] != d:
                            strings = (d, low[d].as_py(), text[d].as_py() or "")
                        c -= int(first_char[d])
                        lead, wide = min(c, longest), min(c, longest + AROUND)
                        rows.append((ids[d].as_py(), w, key, (d * 31 + place) % s, c, lead, strings[1][c - lead : c + longest], strings[2][c - wide : c + longest + AROUND], wide, len(strings[2])))
                if len(rows) > 5000:
                    yield _rows(rows)
                    rows = []
            yield _rows(rows)

    return texts.select("source_id", "text", "low").mapInArrow(run, HIT)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 10
    types = (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[f.split()[0] for f in HIT.split(", ")])


def holding(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """texts(source_id, text), needles(needle, lower case, three characters or more) to (source_id, needle, at, snippet): the needles that a lower-cased text holds, each once, at its first place.

    No text meets a needle that it doesn't nearly hold: each needle has an anchor, its 3 to 8 bytes that are rarest by a
    sample of the texts and among the needles, and the texts' places that a bitmap of all anchors lets through are
    joined with the needles on the anchor's bytes and compared. Neither needles nor texts pass the driver; it holds the
    bitmap and the frequencies, both of bounded size, so the passes over the texts are one whatever the number of
    needles. Keys that the sample finds often in texts are salted. Null texts hold nothing.
    """
    texts = texts.select(F.col("source_id").cast("string").alias("source_id"), "text").where("text <> ''")
    low = texts.withColumn("low", F.lower("text"))
    # dealt over as many tasks as a shuffle has: needles are few bytes, but what is done with each is much more than reading it
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    needles = durable(needles.select("needle").where(F.char_length("needle") >= 3).distinct().repartition(parts, "needle"))
    count, longest = needles.agg(F.count("*"), F.max(F.char_length("needle"))).first()
    if not count:
        return texts.sparkSession.createDataFrame([], "source_id string, needle string, at int, snippet string")
    own = _frequencies(needles, "needle")
    every = texts.count()
    share = min(1.0, SAMPLE / max(every, 1))
    frequency = (_frequencies(low.sample(share, 7) if share < 1 else low, "low") / share).astype(np.int64)
    found = durable(anchors(needles, frequency, own))
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << int(FILTER_BITS * count - 1).bit_length()))
    widths = sorted(r[0] for r in found.select("width").distinct().collect())  # at most those of WIDTHS
    part = F.octet_length("needle") > F.col("width")
    seen = hits(low, widths, (_filter(found, bits), _filter(found.where(part), bits)), bits, frequency, longest)
    keyed = found.select("needle", "width", "key", "off", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    n = F.char_length("needle")
    met = seen.join(keyed, ["width", "key", "salt"]).where((F.col("lead") >= F.col("off")) & (F.substring("low", F.col("lead") - F.col("off") + 1, n) == F.col("needle")))
    at = F.col("at") - F.col("off")
    start, end = F.greatest(at - AROUND, F.lit(0)), F.least(at + n + AROUND, F.col("n_chars"))
    middle = F.trim(F.substring("around", start - (F.col("at") - F.col("around_lead")) + 1, end - start))
    snippet = F.concat(F.when(start > 0, "…").otherwise(""), middle, F.when(end < F.col("n_chars"), "…").otherwise(""))
    first = met.groupBy("source_id", "needle").agg(F.min(F.struct(at.alias("at"), snippet.alias("snippet"))).alias("x"))
    return first.select("source_id", "needle", "x.at", "x.snippet")
