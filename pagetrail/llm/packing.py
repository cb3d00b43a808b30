"""Best-fit packing: a configuration linear program over the length histogram, by multiplicative weights, then rounded."""

from __future__ import annotations

import json
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagetrail.llm.common import durable, in_batches

CAPACITY = 1024
END = 2
#: Rounds of pricing that one solution of the program may take, and the distance from its bound at which it is good enough.
ROUNDS, GAP = 400, 0.01
#: Patterns that a round adds, steps that it takes, and how fast weights fall in a step.
NEW, STEPS, RATE = 32, 200, 0.1
#: Shares of the program that are tried.
SHARES = (1.0, 0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1, 0.0)
#: Patterns that leave over a larger share of a bin are not taken.
WASTE = 0.004
SALTS = 256

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def byte_ranks(tokenizer: dict) -> dict[bytes, int] | None:
    """Byte strings and ids of a byte-level BPE file if its merges are in the order of their ids, else None."""
    model, split = tokenizer["model"], tokenizer.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or tokenizer.get("normalizer"):
        return None
    # the byte-level alphabet: printable Latin-1 stands for itself, other bytes for the code points from 256 on
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letters = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    special = {t["content"] for t in tokenizer.get("added_tokens", [])}
    ranks = {bytes(letters[c] for c in w): i for w, i in model["vocab"].items() if w not in special}
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    ids = [model["vocab"][w] for w in merged]
    return ranks if ids == sorted(ids) and len(ids) + 256 == len(ranks) else None


class Encoder:
    """Token ids of whole texts as little-endian uint32 bytes, equal to those of the tokenizers library for the given file.

    A byte-level BPE file whose merges are ranked by id is encoded by tiktoken, which gives the same ids from the same
    vocabulary in a quarter of the time; any other file, and any text that holds a special token's string, goes to
    the tokenizers library.
    """

    #: The byte-level pre-tokenizer's pattern (fixed values of the format).
    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t["content"] for t in held.get("added_tokens", [])]
        ranks = byte_ranks(held)
        self.fast = ranks and tiktoken.Encoding("file", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        if not self.fast or any(s in text for s in self.special):
            return self.whole(text)
        return array("I", self.fast(text)).tobytes()


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int | None = END) -> DataFrame:
    """docs(doc_id, text) to one row per piece: doc_id, piece, start, length, ids_crc32 and ids (little-endian uint32 bytes).

    A null text is empty; each document ends with the id end (None: it doesn't, and an empty one has no pieces). Only
    longer ones are cut, into pieces of capacity ids, of which the first may be shorter.
    """

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, tail = Encoder(tokenizer), b"" if end is None else np.uint32(end).astype("<u4").tobytes()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                rows = []
                for doc, ids in zip(batch.column("doc_id").to_pylist(), map(encoder.encode, (t or "" for t in batch.column("text").to_pylist()))):
                    ids += tail
                    n, start = len(ids) // 4, 0
                    cut = n % capacity or min(n, capacity)
                    k = 0
                    while start < n:
                        part = ids[4 * start : 4 * cut]
                        rows.append((doc, k, start, cut - start, zlib.crc32(part), part))
                        start, cut, k = cut, cut + capacity, k + 1
                columns = list(zip(*rows)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return in_batches(docs.select("doc_id", "text"), run, f"{PIECE}, ids binary")


def knapsack(values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The most valuable multisets of sizes 1..len(values) for every room up to capacity, by dynamic programming: their worth, and a size of each (0: it is that of a smaller room)."""
    sizes = np.flatnonzero(values > 0) + 1
    worth = values[sizes - 1]
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    upto = np.searchsorted(sizes, np.arange(capacity + 1), side="right").tolist()
    for room in range(1, capacity + 1):
        n = upto[room]
        if n:
            total = worth[:n] + best[room - sizes[:n]]
            k = n - 1 - int(total[::-1].argmax())  # of equal values the largest size: small pieces are the easier to place later
            if total[k] > best[room - 1]:
                best[room], took[room] = total[k], sizes[k]
                continue
        best[room] = best[room - 1]
    return best, took


def pattern_of(took: np.ndarray, filled: np.ndarray, room: int, n: int) -> np.ndarray:
    """The multiset that a knapsack has for a room, as counts of sizes 1..n. filled: for each room the largest one not over it in which a size was taken."""
    counts = np.zeros(n, np.int64)
    while (room := int(filled[room])) > 0:
        counts[took[room] - 1] += 1
        room -= int(took[room])
    return counts


def refilled(counts: np.ndarray, histogram: np.ndarray, capacity: int, price: np.ndarray) -> np.ndarray:
    """A pattern with no more of a size than there are; what that leaves free goes to the pieces worth most by price and size."""
    counts = np.minimum(counts, histogram)
    sizes = np.arange(1, len(counts) + 1)
    room = capacity - int((counts * sizes).sum())
    while room > 0:
        fits = np.flatnonzero(histogram[:room] > counts[:room])
        if not len(fits):
            break
        k = int(fits[np.argmax(price[fits] / sizes[fits] + fits * 1e-12)])
        n = int(min(histogram[k] - counts[k], room // (k + 1)))
        counts[k] += n
        room -= n * (k + 1)
    return counts


def configurations(histogram: np.ndarray, capacity: int, gap: float = GAP, rounds: int = ROUNDS) -> tuple[list[tuple[np.ndarray, float]], float]:
    """A fractional packing that covers the histogram (pieces of size k + 1 at k) by patterns of at most capacity, (counts, times), and a bound: no packing has fewer bins.

    Multiplicative weights for the covering program: a size's weight falls exponentially with how often it is covered,
    its price is the weight over its demand, at first its share of the capacity. Each round prices patterns by a
    knapsack with dynamic programming, which gives the best one and, from the same table, the best ones that hold each
    of the NEW sizes covered least; then STEPS steps take the best of all patterns priced so far, each so often that
    the size it covers fastest is covered once more, and lower prices. The steps so far, over how often the size
    covered least is covered, are a solution; any prices bound the program from below by the worth of all pieces over
    that of the best pattern. The best solution is returned, once it is within `gap` of the bound or after `rounds`.
    """
    live = np.flatnonzero(histogram)
    if not len(live):
        return [], 0.0
    need, sizes = histogram[live].astype(float), live + 1
    seen: dict[bytes, int] = {}
    table, times = np.zeros((len(live), 256), np.float32), np.zeros(256)  # of the sizes that are there, how many each pattern has
    bound, best, best_total, used = float(-(-int((need * sizes).sum()) // capacity)), [], np.inf, 0.0
    log_w, covered = np.log(sizes / capacity * need), np.zeros(len(live))
    for _ in range(rounds):
        log_w -= log_w.max()
        price = np.exp(log_w) / need
        full = np.zeros(len(histogram))
        full[live] = price
        worth, took = knapsack(full, capacity)
        bound = max(bound, float((price * need).sum() / worth[capacity]))
        filled = np.maximum.accumulate(np.where(took > 0, np.arange(capacity + 1), 0))
        fresh = [pattern_of(took, filled, capacity, len(full))]
        for k in live[np.argsort(covered, kind="stable")[:NEW]].tolist():
            one = pattern_of(took, filled, capacity - k - 1, len(full))
            one[k] += 1
            fresh.append(one)
        for counts in fresh:
            counts = refilled(counts, histogram, capacity, full)[live]
            k = seen.setdefault(counts.tobytes(), len(seen))
            if k == len(times):
                table, times = np.concatenate([table, np.zeros_like(table)], axis=1), np.concatenate([times, np.zeros_like(times)])
            table[:, k] = counts
        held = table[:, : len(seen)]
        value = price @ held
        for _ in range(STEPS):
            k = int(value.argmax())
            at = np.flatnonzero(held[:, k])
            row = held[at, k].astype(float)
            often = float((need[at] / row).min())
            times[k] += often
            used += often
            rise = row * often / need[at]
            covered[at] += rise
            log_w[at] -= RATE * rise
            lower = np.exp(log_w[at]) / need[at]
            value += (lower - price[at]).astype(np.float32) @ held[at]
            price[at] = lower
        least = covered.min()
        if least > 0 and used / least < best_total:
            best_total, best = used / least, [(k, t / least) for k, t in enumerate(times[: len(seen)]) if t > 0]
            if best_total <= (1 + gap) * bound:
                break
    out = []
    for k, t in best:
        counts = np.zeros(len(histogram), np.int64)
        counts[live] = table[:, k].astype(np.int64)
        out.append((counts, t))
    return out, bound


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns (counts per size, times) by best fit, largest first, on the histogram itself: many equal bins at a time, so the work is bounded by the number of sizes, not of pieces."""
    left, out = left.copy(), []
    while left.any():
        # one bin: the largest piece, then always the largest that fits; repeated as often as pieces allow
        counts, room = np.zeros(len(left), np.int64), capacity
        while room > 0:
            fits = np.flatnonzero(left[:room] > counts[:room])
            if not len(fits):
                break
            k = int(fits[-1])
            n = int(min(left[k] - counts[k], room // (k + 1)))
            counts[k] += n
            room -= n * (k + 1)
        held = counts > 0
        times = int((left[held] // counts[held]).min())
        out.append((counts, times))
        left -= counts * times
    return out


def rounded(patterns: list[tuple[np.ndarray, float]], histogram: np.ndarray, capacity: int, share: float) -> tuple[list[tuple[np.ndarray, int]], np.ndarray]:
    """Whole-number patterns from so much of a fractional packing, and the histogram of what they leave.

    Times are rounded up with the chance of their fraction, in an order of chance (the same on every run), as far as
    pieces are left; patterns that leave over more than WASTE of a bin are not taken.
    """
    left, out, random = histogram.copy(), [], np.random.default_rng(0)
    sizes = np.arange(1, len(left) + 1)
    for k in random.permutation(len(patterns)):
        counts, times = patterns[k]
        held = counts > 0
        whole = min(int(np.floor(share * times + random.random())), int((left[held] // counts[held]).min()))
        if whole > 0 and capacity - int((counts * sizes).sum()) <= WASTE * capacity:
            out.append((counts, whole))
            left -= counts * whole
    return out, left


def plan(histogram: np.ndarray, capacity: int, rounds: int = ROUNDS) -> list[tuple[np.ndarray, int]]:
    """Whole-number patterns (counts per size, times) that hold exactly the histogram.

    The program is solved and rounded; what that leaves goes by best fit. Of the SHARES of the program that may be
    rounded, the one whose packing has the fewest bins is taken, of equal ones the largest: pieces that all patterns
    need to be full are the better left to best fit, and how many these are depends on the histogram.
    """
    left, out = histogram.copy(), []
    if len(left) >= capacity and left[capacity - 1]:
        one = np.zeros(len(left), np.int64)
        one[capacity - 1] = 1
        out.append((one, int(left[capacity - 1])))
        left[capacity - 1] = 0
    patterns = configurations(left, capacity, rounds=rounds)[0]
    best, fewest = None, None
    for share in SHARES:
        taken, rest = rounded(patterns, left, capacity, share)
        whole = taken + best_fit(rest, capacity)
        bins = sum(times for _, times in whole)
        if best is None or bins < fewest:
            best, fewest = whole, bins
    return out + best


def _slots(patterns: list[tuple[np.ndarray, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, from, to, first sequence, pieces a sequence, offset): which pieces of a length, by rank, go where."""
    rows, used, first = [], {}, 0
    for counts, times in patterns:
        offset = 0
        for k in np.flatnonzero(counts)[::-1].tolist():
            n, length = int(counts[k]), k + 1
            lo = used.get(length, 0)
            rows.append((length, lo, lo + n * times, first, n, offset))
            used[length] = lo + n * times
            offset += n * length
        first += times
    return rows


def pack(found: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS, salts: int = SALTS) -> DataFrame:
    """Adds sequence_id and offset to pieces (a table with doc_id, piece, start, length; lengths 1 to capacity).

    Full pieces need no place. The others are read twice: once for their histogram (at most capacity numbers), once to be numbered within (length,
    salt), so that pieces of one frequent length meet in no single task. The slots (a row for each size of a pattern,
    of which there are at most as many as rounds plus what rounding leaves) go to each task with its code.
    Equal pieces are interchangeable; ties fall by doc_id and piece. No pieces give no rows.
    """
    keep = found.columns
    schema = found.select(*keep, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema
    # a full piece is a sequence of its own, with a negative number
    full = found.where(F.col("length") == capacity).select(*keep, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    found = found.where(F.col("length") < capacity).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(salts)).cast("int"))
    counts = found.groupBy("length", "salt").agg(F.count("*").alias("n")).toPandas()  # at most capacity * salts numbers, whatever the input
    n = np.zeros((capacity, salts), np.int64)
    n[counts["length"].to_numpy(np.int64) - 1, counts["salt"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
    before = np.cumsum(n, axis=1) - n
    rows = _slots(plan(n.sum(axis=1), capacity, rounds))
    by_length: dict[int, list] = {}
    for row in rows:
        by_length.setdefault(row[0], []).append(row[1:])
    tables = {k: np.array(v, np.int64) for k, v in by_length.items()}
    shared = found.sparkSession.sparkContext.broadcast((before, tables))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start")) - 1)

    def place(batches):
        before, tables = shared.value
        for batch in batches:
            length, salt, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("length", "salt", "rank"))
            at = before[length - 1, salt] + rank
            sequence, offset = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            order = np.argsort(length, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                t = tables[int(length[rows[0]])]
                slot = t[np.searchsorted(t[:, 0], at[rows], side="right") - 1]
                inner = at[rows] - slot[:, 0]
                sequence[rows] = slot[:, 2] + inner // slot[:, 3]
                offset[rows] = slot[:, 4] + inner % slot[:, 3] * length[rows]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(sequence), pa.array(offset)], names=[*keep, "sequence_id", "offset"])

    return in_batches(ranked, place, schema).unionByName(full)


def best_fit_packing(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int | None = END, rounds: int = ROUNDS, with_ids: bool = False) -> DataFrame:
    """docs(doc_id, text) to one row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    Pieces stand gapless from offset 0 in their sequence, none longer than capacity. Rows with a null doc_id or repeated
    rows are documents of their own; extra columns are ignored; an empty table gives no rows.
    """
    found = pieces(docs, tokenizer, capacity, end)
    return pack(durable(found if with_ids else found.drop("ids")), capacity, rounds)
