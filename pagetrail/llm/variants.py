"""Spelling variants: words one edit apart, found through bit-sliced position indexes over blocks of the vocabulary."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetrail.llm.common import LOWER, discard, durable, if_few, in_batches, in_groups, release

#: A word, as a maximal run of these letters; A-Z count as a-z.
RUN = "[A-Za-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: Different words that a task counts before it hands them on.
HELD_WORDS = 400_000
#: Rows that an index block has on average, and from which a key is cut into tiles.
BLOCK = 1024
#: Words of a block that step through its index together.
TOGETHER = 512

COUNTED = "word string, n long"
NEAR = "word string, n_near long, form_n long, form string"


def altered(doc_id: int, run: str, every: int) -> str:
    """The run, without its code point h % length if `every` divides h, the crc32 of "<doc_id>:<run>"."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, least: int = LEAST_LENGTH, delete_every: int | None = None) -> DataFrame:
    """docs(doc_id, text) to (word, n): the words of `least` code points or more in whole texts, and how often they occur.

    With delete_every, some runs lose a letter first (see altered); a run of a null doc_id doesn't. A null text has no
    words. Tasks count their own words, at most HELD_WORDS at once, before any is shuffled, so a word that every text
    holds sends a row or a few for each task.
    """
    find = re.compile(RUN).findall

    def run(batches):
        held: Counter = Counter()

        def out():
            words = list(held)
            batch = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            ids = batch.column("doc_id").to_pylist() if delete_every else [None] * batch.num_rows
            for doc, text in zip(ids, batch.column("text").cast(pa.binary())):
                if (text := text.as_py()) is None:
                    continue
                found = find(text.translate(LOWER).decode("utf-8", "replace"))
                if doc is None:
                    held.update(w for w in found if len(w) >= least)
                    continue
                # a shorter run stays too short, whether it loses a letter or not
                for w, n in Counter(w for w in found if len(w) >= least).items():
                    w = altered(doc, w, delete_every)
                    if len(w) >= least:
                        held[w] += n
            if len(held) >= HELD_WORDS:
                yield out()
        yield out()

    return in_batches(docs.select("doc_id", "text"), run, COUNTED).groupBy("word").agg(F.sum("n").alias("n"))


def bits(rows: np.ndarray) -> np.ndarray:
    """Booleans packed 64 to a number along the last axis, the first in the lowest bit."""
    packed = np.packbits(rows, axis=-1, bitorder="little")
    short = -packed.shape[-1] % 8
    if short:
        packed = np.concatenate([packed, np.zeros((*packed.shape[:-1], short), np.uint8)], axis=-1)
    return np.ascontiguousarray(packed).view(np.uint64)


def sets_of(codes: np.ndarray, n: int) -> np.ndarray:
    """For each code 0..n-1 the bitset of the rows that have it."""
    flags = np.zeros((n, len(codes)), bool)
    flags[codes, np.arange(len(codes))] = True
    return bits(flags)


class Index:
    """Bitsets over a block's words: for every (position, letter) those that have the letter there, for every length and key those of it."""

    def __init__(self, words: list[str]):
        self.lengths = np.fromiter(map(len, words), np.int64, len(words))
        longest = int(self.lengths.max())
        points = np.array(words, f"U{longest}").view(np.uint32).reshape(len(words), longest)
        letters, self.codes = np.unique(points, return_inverse=True)
        # a word's codes after its end are those of the filler, or (no word is shorter) never looked at
        self.codes = self.codes.reshape(points.shape)
        inside = np.arange(longest) < self.lengths[:, None]
        self.at = []
        for p in range(longest):
            flags = np.zeros((len(letters), len(words)), bool)
            flags[self.codes[:, p], np.arange(len(words))] = inside[:, p]
            self.at.append(bits(flags))
        self.at.append(np.zeros_like(self.at[0]))  # no word has a letter after the longest one's end

    def near(self, rows: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each of the rows the bitsets of the words among `among` (a bitset for each) with one letter replaced, one less, one more.

        rows: by falling length. All of them step through their letters together, and for each four sets move at once
        with word-parallel operations: the words whose letters so far are the same (no error), and those with one error
        already, which are read at the same place (a letter replaced), one place behind (the row's letter isn't in
        them) or one ahead (they have a letter more).
        """
        lengths = self.lengths[rows]
        same, replaced, less, more = among.copy(), np.zeros_like(among), np.zeros_like(among), among.copy()
        for i in range(int(lengths[0])):
            n = int(np.searchsorted(-lengths, -i))  # rows that have a letter here
            c = self.codes[rows[:n], i]
            here, ahead = self.at[i][c], self.at[i + 1][c]
            less[:n] = same[:n] if i == 0 else less[:n] & self.at[i - 1][c] | same[:n]
            replaced[:n] = replaced[:n] & here | same[:n] & ~here
            same[:n] &= here
            more[:n] = more[:n] & ahead | same[:n]
        return replaced, less, more


def first_bits(sets: np.ndarray) -> np.ndarray:
    """The place of the lowest bit of each bitset (any number for an empty one)."""
    word = (sets != 0).argmax(axis=1)
    value = sets[np.arange(len(sets)), word]
    low = value & (~value + np.uint64(1))
    return word * 64 + np.bitwise_count(low - np.uint64(1)).astype(np.int64)


def block_near(words: list[str], n: np.ndarray, key: np.ndarray, other: np.ndarray, tile: np.ndarray, cross: np.ndarray, short: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the words of a block: how many near ones they have in it, and the place and count of that of largest n (ties: the first in order).

    Only words of the same key are compared, a pair of longer words (not short) never; a row with other >= 0 leaves out
    those of the same other; in a block of two tiles (cross), those of its own tile.
    """
    order = np.array(sorted(range(len(words)), key=lambda i: (-n[i], words[i])), np.int64)  # so the lowest bit is the best form
    words = [words[i] for i in order]
    key, other, tile, cross, short, n = (x[order] for x in (key, other, tile, cross, short, n))
    index = Index(words)
    keys = sets_of(*_coded(key))
    code, (others, names), (tiles, tile_names) = _coded(key)[0], _coded(other), _coded(tile)
    other_sets, tile_sets = sets_of(others, names), sets_of(tiles, tile_names)
    lengths = {int(k): bits(index.lengths[None, :] == k)[0] for k in np.unique(index.lengths)}
    none = np.zeros(keys.shape[1], np.uint64)
    count, best, best_n = np.zeros(len(words), np.int64), np.full(len(words), -1), np.zeros(len(words), np.int64)
    by_length = np.argsort(-index.lengths, kind="stable")
    for start in range(0, len(words), TOGETHER):
        rows = by_length[start : start + TOGETHER]
        among = keys[code[rows]]
        held = other[rows] >= 0
        among[held] &= ~other_sets[others[rows[held]]]
        held = cross[rows]
        among[held] &= ~tile_sets[tiles[rows[held]]]
        replaced, less, more = index.near(rows, among)
        of = index.lengths[rows]
        near = np.zeros_like(among)
        for k in np.unique(of).tolist():
            at = of == k
            shorter = at & short[rows]
            near[shorter] |= replaced[shorter] & lengths[k]
            near[at] |= less[at] & lengths.get(k - 1, none) | more[at] & lengths.get(k + 1, none)
        total = np.bitwise_count(near).sum(axis=1)
        found = np.flatnonzero(total)
        count[rows] = total
        best[rows[found]] = first_bits(near[found])
        best_n[rows[found]] = n[best[rows[found]]]
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    best = np.where(best >= 0, order[best], -1)
    return count[back], best[back], best_n[back]


def _coded(values: np.ndarray) -> tuple[np.ndarray, int]:
    names, codes = np.unique(values, return_inverse=True)
    return codes, len(names)


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """words(word, n), each word once, of two code points or more, to (word, n_near, form, form_n): how many are exactly one edit away, and that of largest n (ties: the smallest in code-point order). Words without any are absent.

    Of two words one edit apart, with m code points in the shorter one, the first or else the last m // 2 are equal. So
    a word goes to four keys (its own length and one less as m, each from the front and from the back), and only words
    of one key are compared: a block of keys has one index, in which a key is one more bitset. A pair that both keys
    have counts by its front alone. A key of more than `block` words is cut into tiles, and its blocks are pairs of
    tiles, so no task holds an unbounded key and no pair is lost; pairs never become rows, a word sends one row from
    every block.
    """
    length = F.char_length("word")
    ways = [(m, side) for m in (0, 1) for side in ("front", "back")]
    half = lambda m: F.floor((length - m) / 2).cast("int")
    front = lambda m: F.substring("word", F.lit(1), half(m))
    back = lambda m: F.substring("word", length - half(m) + 1, half(m))
    key = lambda m, side: F.struct((length - m).alias("m"), F.lit(side).alias("side"), (front(m) if side == "front" else back(m)).alias("part"), (F.lit(None).cast("string") if side == "front" else front(m)).alias("other"))
    keyed = durable(words.select("word", "n", F.explode(F.array(*(key(*w) for w in ways))).alias("k")).select("word", "n", "k.*").withColumn("short", length == F.col("m")))
    names = ["m", "side", "part"]
    rows, longest = keyed.agg(F.count("*"), F.max("m")).first()
    blocks = max(1, -(-rows // block))
    hot = if_few(durable(keyed.groupBy(*names).agg(F.count("*").alias("of_key")).where(F.col("of_key") > block)))
    hashed = F.xxhash64(*names)
    tiles = F.ceil(F.col("of_key") * 2 / block).cast("int")
    joined = keyed.join(hot, names, "left").withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("word"), "tiles").cast("int"))
    plain = joined.where("tiles IS NULL").select("word", "n", hashed.alias("key"), "other", "short", F.lit(0).alias("tile"), F.lit(False).alias("crossed"), F.pmod(hashed, F.lit(blocks)).alias("cell"), F.lit(0).alias("low"), F.lit(0).alias("high"))
    pairs = joined.where("tiles IS NOT NULL").withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    low, high = F.least("tile", "with"), F.greatest("tile", "with")
    cut = pairs.select("word", "n", hashed.alias("key"), "other", "short", "tile", (low != high).alias("crossed"), hashed.alias("cell"), low.alias("low"), high.alias("high"))

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        found = group.column("word").to_pylist()
        columns = {c: group.column(c).to_numpy() for c in ("n", "key", "short", "tile", "crossed")}
        others = [-1 if o is None else o for o in group.column("other").to_pylist()]
        numbers = {o: i for i, o in enumerate(dict.fromkeys(others))}
        other = np.array([-1 if o == -1 else numbers[o] for o in others], np.int64)
        count, best, best_n = block_near(found, columns["n"], columns["key"], other, columns["tile"], columns["crossed"].astype(bool), columns["short"].astype(bool))
        at = np.flatnonzero(count)
        return pa.table({"word": pa.array([found[i] for i in at], pa.string()), "n_near": pa.array(count[at]), "form_n": pa.array(best_n[at]), "form": pa.array([found[i] for i in best[at]], pa.string())})

    # a block that only part of a hot key reaches is known by its key and tiles; the others by their number
    found = in_groups(plain.unionByName(cut).groupBy("cell", "low", "high", F.col("crossed").alias("two")), compare, NEAR)
    best = F.min(F.struct((-F.col("form_n")).alias("n"), F.col("form").alias("form")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.n")).alias("form_n"))


def roots(links: DataFrame) -> DataFrame:
    """links(word, form), each word once and without a cycle, to (word, root): from each word along its forms to the last.

    Every round each word's root becomes its root's root, so a chain of k links takes about log2(k) rounds; a form has
    several times the occurrences of its word, so chains are short whatever the input.
    """
    now = durable(links.select("word", F.col("form").alias("root")))
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = durable(now.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        discard(now)
        now = moved
        if not now.where("_moved").limit(1).count():
            return now.drop("_moved")


def variant_groups(words: DataFrame, ratio: int = RATIO, block: int = BLOCK) -> DataFrame:
    """words(word, n), each word once, to (word, form, root, n, n_near, form_n), one row per word.

    form is the word's near word of largest n (ties: the smallest in code-point order) if that n is at least `ratio`
    times the word's own; root is the last of its forms, the word itself if it has none; n_near counts the near words,
    0 if none. An empty table gives no rows; null words are left out; extra columns are ignored. ratio must be over 1.
    """
    words = durable(words.select("word", F.col("n").cast("long").alias("n")).where("word IS NOT NULL"))
    near = near_words(words, block)
    with_form = F.col("form_n") >= F.lit(ratio) * F.col("n")
    pick = lambda c: F.when(with_form, F.col(c)).alias(c)
    found = durable(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), pick("form"), pick("form_n")))
    ends = if_few(roots(found.where("form IS NOT NULL").select("word", "form")))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, delete_every: int | None = None, least_count: int = LEAST_COUNT) -> DataFrame:
    """docs(doc_id, text) to variant_groups of the words of LEAST_LENGTH code points and least_count occurrences or more.

    Null and empty texts have no words, long texts are read whole; repeated rows each count; extra columns are ignored;
    an empty table gives no rows.
    """
    return variant_groups(word_counts(docs, delete_every=delete_every).where(F.col("n") >= least_count))
