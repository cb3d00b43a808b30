"""Quality classifier: ordinal cumulative-link regression on graded ratings, shared hashed-text weights with ordered thresholds."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetrail.llm.common import ALNUM, durable, in_batches, texts_of

BITS = 18
#: The model is fitted on at most so many rated texts per grade, those of the smallest hash.
SAMPLE = 4000
#: Kept: texts whose probability of a grade above the lowest is at least this.
KEEP = 0.5


def hashed(text: bytes) -> np.ndarray:
    """Buckets (sorted, distinct) of the words of a whole text, and of its shape: shares of upper-case letters, marks, digits and repeats in tenths."""
    words = text.translate(ALNUM).split()
    distinct = set(words)
    out = [xxhash.xxh32_intdigest(w) >> (32 - BITS) for w in distinct]
    n = max(len(text), 1)
    raw = np.frombuffer(text, np.uint8)
    letters = ((raw | 32) >= 97) & ((raw | 32) <= 122)
    shape = {
        "upper": int(10 * (((raw >= 65) & (raw <= 90)).sum() / max(letters.sum(), 1))),
        "marks": int(20 * ((raw > 32) & (raw < 128) & ~letters & ~((raw >= 48) & (raw <= 57))).sum() / n),
        "digits": int(20 * ((raw >= 48) & (raw <= 57)).sum() / n),
        "repeats": int(10 * (1 - len(distinct) / max(len(words), 1))),
        "length": len(words).bit_length(),
    }
    out += [xxhash.xxh32_intdigest(f"\0{k}={v}") >> (32 - BITS) for k, v in shape.items()]
    return np.unique(np.array(out, np.int64))


@dataclass
class Model:
    """P(grade > k) = sigmoid(score - cuts[k]); one score for all grades."""

    weights: np.ndarray
    cuts: np.ndarray

    def tails(self, at: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weights[at].sum() - self.cuts, -40, 40)))


def fit_rows(rows: list[tuple[np.ndarray, int]], grades: int, epochs: int = 8, alpha: float = 1.0, beta: float = 1.0, l1: float = 8.0, l2: float = 0.1, least: int = 3) -> Model:
    """Maximum likelihood of the cumulative-link model, text by text: follow-the-regularised-leader for the weights (L1 keeps chance words at 0), adaptive steps for the thresholds. Grades count alike whatever their shares; buckets of fewer than `least` texts stay 0."""
    dims = 1 << BITS
    z, n, w = np.zeros(dims), np.zeros(dims), np.zeros(dims)
    seen = np.zeros(dims, np.int64)
    for at, _ in rows:
        seen[at] += 1
    rows = [(at[seen[at] >= least], y) for at, y in rows]
    gaps, gg = np.array([-1.0] + [0.5] * (grades - 2)), np.full(grades - 1, 1.0)  # the first cut, then logs of the steps up
    share = np.array([max(1, sum(y == k for _, y in rows)) for k in range(grades)], float)
    balance = len(rows) / (grades * share)

    def cuts():
        return gaps[0] + np.concatenate([[0], np.cumsum(np.exp(gaps[1:]))])

    order = np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, y = rows[i]
            w[at] = np.where(np.abs(z[at]) <= l1, 0, -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))
            t = 1 / (1 + np.exp(-np.clip(w[at].sum() - cuts(), -40, 40)))
            upper = np.concatenate([[1.0], t])  # P(grade >= k)
            lower = np.concatenate([t, [0.0]])  # P(grade > k)
            p = max(upper[y] - lower[y], 1e-9)
            du, dl = upper[y] * (1 - upper[y]), lower[y] * (1 - lower[y])
            g = -balance[y] * (du - dl) / p  # by the score
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w[at]
            n[at] += g * g
            by_cut = np.zeros(grades - 1)
            if y > 0:
                by_cut[y - 1] += balance[y] * du / p
            if y < grades - 1:
                by_cut[y] -= balance[y] * dl / p
            chain = np.array([by_cut.sum(), *(by_cut[k:].sum() * np.exp(gaps[k]) for k in range(1, grades - 1))])
            gg += chain * chain
            gaps -= 0.1 * chain / np.sqrt(gg)
    w = np.where(np.abs(z) <= l1, 0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    return Model(w, cuts())


def fit(docs: DataFrame, rated: DataFrame, grades: int, sample: int = SAMPLE) -> Model | None:
    """The model from docs(doc_id, text) and rated(doc_id, grade 0..grades-1; an id once), on at most `sample` texts a grade (SAMPLE, those of the smallest text hash); rows with nulls are left out. None if there are none.

    Ratings meet ids and hashes first; texts are read for the chosen ones alone.
    """
    keyed = docs.where("text IS NOT NULL").select("doc_id", "text", F.xxhash64("text").alias("h"))
    narrow = durable(keyed.select("doc_id", "h").join(rated.where("grade IS NOT NULL"), "doc_id"))
    n = {r["grade"]: r["n"] for r in narrow.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    if not n:
        return None
    share = F.create_map(*[x for y, c in n.items() for x in (F.lit(y), F.lit(float(min(1.0, 1.2 * sample / c + 50 / c))))])
    # about 1.2 * sample + 50 rows a grade (more only where so many texts are equal)
    chosen = durable(narrow.where(F.col("h").cast("double") / F.lit(2.0**64) + 0.5 < share[F.col("grade")]).groupBy("h").agg(F.min("grade").alias("grade")))
    some = keyed.join(F.broadcast(chosen), "h").groupBy("h").agg(F.min("grade").alias("grade"), F.min("text").alias("text"))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("grade").cast(pa.int32()), batch.column("h"), pa.array([hashed(t).tolist() for t in texts_of(batch)], pa.list_(pa.int32()))], names=["grade", "h", "at"])

    left, rows = dict.fromkeys(n, sample), []
    for r in sorted(in_batches(some, run, "grade int, h long, at array<int>").toPandas().itertuples(), key=lambda r: (r.h, r.grade)):
        if left[r.grade] > 0:
            left[r.grade] -= 1
            rows.append((np.asarray(r.at, np.int64), int(r.grade)))
    return fit_rows(rows, grades)


def score(docs: DataFrame, model: Model | None, grades: int, keep: float = KEEP) -> DataFrame:
    """docs with expected_grade double, tails array<double> (P(grade >= 1), ...) and keep boolean added; other columns stay, but earlier ones of these names are replaced.

    Whole texts. A null text counts as empty; without a model every row has expected_grade null and is kept.
    """
    docs = docs.drop("expected_grade", "tails", "keep")
    if model is None:
        return docs.select("*", F.lit(None).cast("double").alias("expected_grade"), F.lit(None).cast("array<double>").alias("tails"), F.lit(True).alias("keep"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS numbers, whatever the input
    schema = docs.select("*", F.lit(0.0).alias("expected_grade"), F.array(F.lit(0.0)).alias("tails"), F.lit(True).alias("keep")).schema

    def run(batches):
        for batch in batches:
            tails = [shared.value.tails(hashed(t or b"")) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([float(t.sum()) for t in tails], pa.float64()), pa.array([t.tolist() for t in tails], pa.list_(pa.float64())), pa.array([bool(t[0] >= keep) for t in tails], pa.bool_())], names=[*batch.schema.names, "expected_grade", "tails", "keep"])

    return in_batches(docs, run, schema)


def graded(labels: DataFrame) -> DataFrame:
    """labels(doc_id, quality, toxic) to (doc_id, grade): 0 toxic, 1 poor, 2 good; several ratings of a document count with their lowest, nulls as not toxic or poor."""
    grade = F.when(F.coalesce("toxic", F.lit(0)) == 1, 0).when(F.col("quality") == 1, 2).otherwise(1)
    return labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(grade).alias("grade"))


def quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, keep: float = KEEP) -> DataFrame:
    """docs(doc_id, text), labels to doc_id, expected_grade (0 to 2), p_acceptable, p_good, keep, one row per document.

    keep is false for texts that the model takes for toxic (P(grade >= 1) < keep). A null text counts as empty, and an
    empty one is graded by the thresholds alone; long texts are read whole; each row is judged alone, so equal texts have
    equal grades and repeated rows each stay; a null doc_id is judged but never learned from; of several labels of an id
    the lowest grade holds; extra columns are ignored, whatever their names. Without documents there are no rows, without
    labels expected_grade is null and all are kept.
    """
    model = fit(docs.select("doc_id", "text"), graded(labels), 3, sample)
    out = score(docs.select("doc_id", "text"), model, 3, keep)
    return out.select("doc_id", "expected_grade", F.try_element_at("tails", F.lit(1)).alias("p_acceptable"), F.try_element_at("tails", F.lit(2)).alias("p_good"), "keep")
