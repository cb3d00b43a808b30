"""Language-model scoring: a weighted backoff automaton of all smoothed n-grams, walked once from left to right."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetrail.llm.common import durable, in_batches, mod_crc32, release, row_ids
from pagetrail.llm.tally import ASKED, RANGE, ask, batch_of, mixed, tally, totals_of, word_hashes

ADD = 0.1
ORDER = 3
#: What the shorter context's probability weighs, in occurrences, in a state of one and of two words (chosen on held-out documents).
BACKOFF = (None, 60.0, 4.0)
#: Bytes of text in a block.
BLOCK = 12 << 20
#: Longer n-grams' keys have so many bits more than the number of n-grams needs, so that two of them share a key with a chance of 2**-SPARE, at every size; a word's key has all 64.
SPARE = 22
END, START = (mixed(np.array([k], np.uint64))[0] for k in (3, 5))


def longer(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The 64-bit keys of n-grams, from those of their contexts and last words."""
    return mixed(context * np.uint64(0x9E3779B97F4A7C15) + word)


class Runs:
    """The n-grams of texts: keys by order at each place of START, the text's words, END; place is the place in its text."""

    def __init__(self, texts: pa.Array | pa.ChunkedArray):
        words, counts = word_hashes(texts)
        self.sizes = counts + 2
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.place = np.arange(int(self.sizes.sum())) - np.repeat(self.starts, self.sizes)
        x = np.empty(len(self.place), np.uint64)
        x[self.starts], x[self.starts + self.sizes - 1] = START, END
        x[(self.place > 0) & (self.place < np.repeat(self.sizes, self.sizes) - 1)] = words
        self.words, self.last = x, x

    def grow(self) -> np.ndarray:
        """Keys of the n-grams one word longer that end at each place; those at the first places of a text are void."""
        self.last = longer(np.concatenate([self.last[:1], self.last[:-1]]), self.words)
        return self.last


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their counts."""
    keys = np.sort(keys)
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.diff(np.append(at, len(keys)))


def numbered(keys: np.ndarray) -> np.ndarray:
    """The place of each key among the sorted distinct ones."""
    order = np.argsort(keys)
    keys = keys[order]
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(np.append(False, keys[1:] != keys[:-1])) if len(keys) else 0
    return out


def packed(docs: DataFrame, size: int) -> DataFrame:
    """docs(doc_id, held_out, text) in blocks of about `size` bytes of text, each compressed: block, tokens, train_tokens, train_docs, data."""

    def run(batches):
        ids, held, bytes_held = row_ids(), [], 0

        def out():
            table = pa.Table.from_batches(held)
            _, words = word_hashes(table.column("text"))
            train = ~table.column("held_out").to_numpy()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as writer:
                writer.write_table(table)
            numbers = (next(ids), int((words + 1).sum()), int((words + 1)[train].sum()), int(train.sum()))
            held.clear()
            return pa.RecordBatch.from_arrays([*(pa.array([n], pa.int64()) for n in numbers), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "tokens", "train_tokens", "train_docs", "data"])

        for batch in batches:
            batch = pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), batch.column("text").cast(pa.large_string())], names=["doc_id", "held_out", "text"])
            step = max(1, batch.num_rows * (size >> 3) // max(batch.nbytes, 1))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                held.append(part)
                bytes_held += part.get_total_buffer_size() * part.num_rows // batch.num_rows
                if bytes_held >= size:
                    yield out()
                    bytes_held = 0
        if held:
            yield out()

    return in_batches(docs, run, "block long, tokens long, train_tokens long, train_docs long, data binary")


def unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(data)).read_all()


@dataclass
class Model:
    """What the walk needs besides the n-grams' own counts: training tokens, different words, documents, and how keys are cut."""

    tokens: int
    distinct: int
    docs: int
    bits: int
    backoff: tuple = BACKOFF

    def unigram(self, c):
        return (c + ADD) / (self.tokens + ADD * (self.distinct + 1))


#: Words of a text that the walk reads one after the other; a longer text is read in so long parts side by side, each after the ORDER - 1 words before it, which is all that a state depends on.
PART = 256
ROOT = 0


class Automaton:
    """The weighted backoff automaton of a block's n-grams, as arrays.

    States: ROOT, then the one-word contexts, START last of them, then the two-word contexts, of which only those seen
    in training are ever entered. A state has a failure arc, to the state of its context without the first word, with
    the log10 weight backoff / (count + backoff). An n-gram is the arc that leaves its context's state with its last
    word; if it was seen, its log10 weight is that of its smoothed probability, (count + backoff * p) / (count of the
    context + backoff), p being the probability from the context's failure state; it leads to the state of the longest
    seen context that ends the n-gram. ROOT has an arc for every word, seen or not.
    """

    def __init__(self, model: Model, counts: list[np.ndarray], last: list[np.ndarray], context: list[np.ndarray]):
        """counts: of the distinct n-grams of each order; last, context: for orders over 1, each n-gram's number, as one of the order below, without its first and without its last word (context -1: START)."""
        words, pairs = len(counts[0]), len(counts[1])
        self.pair_state, states = words + 2, words + 2 + pairs
        start = words + 1
        total = np.concatenate([[0], counts[0], [model.docs], counts[1]])
        self.depth = np.repeat([0, 1, 2], [1, words + 1, pairs])
        self.failure = np.zeros(states, np.int64)
        self.failure[self.pair_state :] = 1 + last[1]
        backoff = np.array([0.0, *model.backoff[1:]])[self.depth]
        with np.errstate(divide="ignore"):
            self.failure_weight = np.where(self.depth > 0, np.log10(backoff / np.maximum(total + backoff, 1)), 0.0)
        self.start = start if model.docs else ROOT
        p = model.unigram(counts[0])
        self.base = np.log10(p)
        self.seen, self.weight = [np.ones(words, bool)], [self.base]
        self.target = [np.where(counts[0] > 0, 1 + np.arange(words), ROOT)]
        for n in range(1, ORDER):
            of = np.where(context[n] < 0, start, context[n] + (1 if n == 1 else self.pair_state))
            p = (counts[n] + model.backoff[n] * p[last[n]]) / np.maximum(total[of] + model.backoff[n], 1)
            self.seen.append(counts[n] > 0)
            self.weight.append(np.log10(p, where=counts[n] > 0, out=np.zeros(len(p))))
            self.target.append(self.pair_state + (np.arange(pairs) if n == 1 else last[n]))

    def walk(self, arcs: list[np.ndarray], runs: Runs) -> np.ndarray:
        """The texts' log10 probabilities. arcs: for each order the n-gram that ends at each place of runs.

        All parts of all texts read their words from left to right together, place by place, each carrying its state:
        where the state has no arc for the word, the failure arc is taken, and its weight, until there is one.
        """
        n_words = runs.sizes - 1
        parts = -(-n_words // PART)
        text = np.repeat(np.arange(len(parts)), parts)
        number = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
        before = np.where(number > 0, ORDER - 1, 0)  # words that only lead to the state
        at = runs.starts[text] + 1 + number * PART - before
        length = np.minimum(PART, n_words[text] - number * PART) + before
        order = np.argsort(-length, kind="stable")
        text, before, at, length = text[order], before[order], at[order], length[order]
        state = np.where(before > 0, ROOT, self.start)
        score = np.zeros(len(text))
        for i in range(int(length[0]) if len(length) else 0):
            n = int(np.searchsorted(-length, -i))  # parts that have a word here
            place, s, step = at[:n] + i, state[:n].copy(), np.zeros(n)
            for depth in range(ORDER - 1, 0, -1):
                here = np.flatnonzero(self.depth[s] == depth)
                fails = here[~self.seen[depth][arcs[depth][place[here]]]]
                step[fails] += self.failure_weight[s[fails]]
                s[fails] = self.failure[s[fails]]
            after, depth = np.empty(n, np.int64), self.depth[s]
            for k in range(ORDER):
                here = np.flatnonzero(depth == k)
                arc = arcs[k][place[here]]
                step[here] += self.weight[k][arc]
                after[here] = self.target[k][arc]
            state[:n] = after
            score[:n] += np.where(i >= before[:n], step, 0)
        return np.bincount(text, score, minlength=len(runs.sizes))


def automaton_of(runs: Runs, counts: list[np.ndarray], numbers: list[np.ndarray], model: Model) -> Automaton:
    """The automaton of a block. numbers: for each order the number of the n-gram that ends at each place, -1 where none does; counts: of the n-grams, by number."""
    last, context = [None], [None]
    for n in range(1, ORDER):
        at = np.flatnonzero(numbers[n] >= 0)
        place = np.empty(len(counts[n]), np.int64)
        place[numbers[n][at]] = at  # any place where the n-gram ends
        last.append(numbers[n - 1][place])
        context.append(numbers[n - 1][place - 1])
    return Automaton(model, counts, last, context)


def held_out_scores(docs: DataFrame, block: int | None = None) -> DataFrame:
    """docs(doc_id, text): a model from the rows whose crc32(doc_id) mod 10 isn't 0, and its scores of all rows.

    Columns: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; one row per input row. The texts are
    written once, in compressed blocks. Every block asks for the training counts of its different n-grams of 1 to ORDER
    words; each count is summed over all blocks and goes back to those that asked; of these the block builds its part of the
    automaton (Automaton), and its texts are walked.
    So every n-gram of the corpus counts, at any size, and no task holds more than a block or a range of keys.

    A null doc_id counts as not held out; null text is empty; repeated rows each stay and count; extra columns are
    ignored; ties don't arise; a text longer than a block is a block of its own; an empty table gives no rows. Without
    training rows every score is 0 (the one class of unseen words has probability 1).
    """
    spark = docs.sparkSession
    held = (mod_crc32("doc_id", 10) == 0).alias("held_out")
    blocks = durable(packed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held, "text"), block or BLOCK))
    every, tokens, trained = (x or 0 for x in blocks.agg(F.sum("tokens"), F.sum("train_tokens"), F.sum("train_docs")).first())
    bits = min(64, SPARE + int(ORDER * every + 1).bit_length())
    parts = max(1, -(-every // RANGE))
    cut = np.uint64(64 - bits)

    def asking(batches):
        for batch in batches:
            for number, data in zip(batch.column("block").to_pylist(), batch.column("data")):
                table = unpacked(data.as_py())
                runs = Runs(table.column("text"))
                train = np.repeat(~table.column("held_out").to_numpy(), runs.sizes)
                for n in range(ORDER):
                    keys = runs.grow() >> cut if n else runs.words
                    real = runs.place >= max(n, 1)
                    own, c = distinct(keys[real & train])
                    others, _ = distinct(keys[real & ~train])
                    merged, _ = distinct(np.concatenate([own, others]))
                    sums = np.zeros(len(merged), np.int64)
                    sums[np.searchsorted(merged, own)] = c
                    yield batch_of(list(ask(number, n + 1, merged, sums, bits if n else 64, parts)))

    answers = durable(tally(in_batches(blocks.select("block", "data"), asking, ASKED)))
    seen = answers.where("kind = 1").agg(F.sum("seen")).first()[0] or 0
    model = Model(tokens, seen, trained, bits, BACKOFF)

    def stepping(left: pa.Table, right: pa.Table) -> pa.Table:
        out = walked(left, right)
        release()
        return out

    def walked(left: pa.Table, right: pa.Table) -> pa.Table:
        table = unpacked(left.column("data")[0].as_py())
        runs, counts, numbers = Runs(table.column("text")), [], []
        for n in range(ORDER):
            keys = runs.grow() >> cut if n else runs.words
            real = np.flatnonzero(runs.place >= max(n, 1))
            number = np.full(len(keys), -1)
            number[real] = numbered(keys[real])
            numbers.append(number)
            counts.append(totals_of(right, n + 1).astype(np.int64))
        automaton = automaton_of(runs, counts, numbers, model)
        real = np.flatnonzero(runs.place > 0)
        text = np.repeat(np.arange(len(runs.sizes)), runs.sizes)[real]
        known = np.bincount(text, counts[0][numbers[0][real]] > 0, minlength=len(runs.sizes)).astype(np.int64)
        base = np.bincount(text, automaton.base[numbers[0][real]], minlength=len(runs.sizes))
        columns = {c: table.column(c) for c in ("doc_id", "held_out")}
        columns |= {"n_tokens": pa.array(runs.sizes - 1), "n_known": pa.array(known), "train_tokens": pa.array(np.full(len(runs.sizes), model.tokens, np.int64))}
        return pa.table(columns | {"base_score": pa.array(base), "score": pa.array(automaton.walk(numbers, runs))})

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.select("block", "data").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(stepping, schema)
