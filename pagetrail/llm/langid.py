"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams (FTRL, elastic net), then temperature calibration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetrail.llm.common import in_batches, mod_crc32, release

DIMS = 1 << 15
ORDERS = (1, 2, 3)
#: The classifier is fitted on at most so many labelled texts per language, those of the smallest hash.
SAMPLE = 1500
UNKNOWN = "und"


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character 1- to 3-grams of the lower-cased letters, other runs as one space: (buckets, counts). No letters: empty."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    return _grams(points)


_LETTER: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER["is"] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTER["is"]


def _grams(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    alpha = _letters()[points]
    if not alpha.any():
        return np.zeros(0, np.int64), np.zeros(0)
    keep = alpha | np.concatenate([[False], alpha[:-1]])  # the first of a run of other characters stands for the run
    p = np.concatenate([[32], np.where(alpha, points, 32)[keep], [32]]).astype(np.uint64)
    total = np.zeros(DIMS)
    for n in ORDERS:
        h = np.full(max(len(p) - n + 1, 0), n, np.uint64)
        for k in range(n):
            h = (h ^ p[k : len(p) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
        total += np.bincount((h >> np.uint64(49)).astype(np.int64), minlength=DIMS)
    at = np.flatnonzero(total)
    return at, total[at]


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # DIMS x languages
    bias: np.ndarray
    temperature: float

    def features(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        return self.weighted(*grams(text))

    def weighted(self, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        v = (1 + np.log(n)) * self.idf[at] if len(at) else n
        return at, v / (np.sqrt((v * v).sum()) or 1)

    def predict(self, text: str | None) -> tuple[str, float]:
        at, v = self.features(text or "")
        if not len(at) or not self.languages:
            return UNKNOWN, 0.0
        p = softmax((v @ self.weights[at] + self.bias) / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many non-null texts each bucket occurs, over all rows: DIMS numbers from every task, summed by Spark."""

    def run(batches):
        seen, n = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            for text in batch.column("text"):
                seen[grams(text.as_py())[0]] += 1
                n += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(seen[at], n), pa.int64())], names=["bucket", "n"])

    rows = in_batches(docs.select("text").where("text IS NOT NULL"), run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # at most DIMS + 1 rows
    out, total = np.zeros(DIMS, np.int64), 0
    for r in rows:
        if r["bucket"] < 0:
            total = r["n"]
        else:
            out[r["bucket"]] = r["n"]
    return out, total


def sample_of(docs: DataFrame, label: str, most: int) -> list[tuple[np.ndarray, np.ndarray, str]]:
    """At most so many different texts of each label, as (buckets, counts, label): those with the smallest hash.

    Copies of a text count as one and are reduced to it before any reaches the driver; so do only the buckets and
    counts of the chosen, packed, at most DIMS numbers of each a text however long it is.
    """
    keyed = docs.where(F.col("text").isNotNull() & F.col(label).isNotNull()).select("text", F.col(label).alias("y"), F.xxhash64("text").alias("h"))
    n = {r["y"]: r["n"] for r in keyed.groupBy("y").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}
    # a share of the hash range that holds about 1.2 times the bound; the rest of the cut is exact, on the driver
    share = F.create_map(*[x for y, c in n.items() for x in (F.lit(y), F.lit(float(min(1.0, 1.2 * most / max(c, 1) + 50 / max(c, 1)))))]) if n else F.create_map(F.lit(0), F.lit(0.0))
    unit = F.col("h").cast("double") / F.lit(2.0**64) + 0.5

    def run(batches):
        for batch in batches:
            found = [grams(t.as_py()) for t in batch.column("text")]
            at, counts = (pa.array([f[k].astype("<i4").tobytes() for f in found], pa.binary()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("y"), at, counts], names=["h", "y", "at", "n"])

    schema = keyed.select("h", "y", F.lit(b"").alias("at"), F.lit(b"").alias("n")).schema
    rows = in_batches(keyed.where(unit < share[F.col("y")]).dropDuplicates(["y", "h"]), run, schema).collect() if n else []
    out, left = [], dict.fromkeys(n, most)
    for r in sorted(rows, key=lambda r: (r["h"], r["y"])):
        if left[r["y"]] > 0:
            left[r["y"]] -= 1
            out.append((np.frombuffer(r["at"], "<i4"), np.frombuffer(r["n"], "<i4"), r["y"]))
    return out


def fit(train: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> Model:
    """The model from train(text, lang); rows with a null text or language are left out, an empty table gives a model that answers und.

    Document frequencies come from every row; the weights are fitted on at most `sample` different texts a language (SAMPLE), of
    which every fifth is kept aside for the temperature. Training is follow-the-regularised-leader, text by text.
    """
    docs = train.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    df, total = document_frequencies(docs)
    idf = np.log((1 + total) / (1 + df)) + 1
    rows = sample_of(docs, "lang", sample)
    languages = sorted({y for _, _, y in rows})
    k = len(languages)
    model = Model(languages, idf, np.zeros((DIMS, k)), np.zeros(k), 1.0)
    if not k:
        return model
    data = [(*model.weighted(at, n), languages.index(y)) for at, n, y in rows]
    del rows
    held, data = data[::5], [d for i, d in enumerate(data) if i % 5] or data
    z, n, w = np.zeros((DIMS + 1, k)), np.zeros((DIMS + 1, k)), np.zeros((DIMS + 1, k))
    order = np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(len(data)):
            at, v, y = data[i]
            at, v = np.append(at, DIMS), np.append(v, 1.0)
            w[at] = np.where(np.abs(z[at]) <= l1, 0, -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))
            p = softmax(v @ w[at])
            p[y] -= 1
            g = v[:, None] * p[None, :]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w[at]
            n[at] += g * g
    w = np.where(np.abs(z) <= l1, 0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    model.weights, model.bias = w[:-1], w[-1]
    scores = [(v @ model.weights[at] + model.bias, y) for at, v, y in held if len(at)]
    if scores:
        losses = {t: -sum(np.log(max(softmax(s / t)[y], 1e-12)) for s, y in scores) for t in np.geomspace(0.05, 5, 60)}
        model.temperature = float(min(losses, key=losses.get))
    del data, held, scores, z, n, w
    release()
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred string and score double added; all other columns stay (but earlier ones of these names).

    Whole texts, however long; null or letterless text: und, 0.0. Ties fall to the language that sorts first. Each row
    is judged alone: repeated rows each stay; an empty table gives no rows.
    """
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIMS * languages numbers, whatever the input
    schema = docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def run(batches):
        m = shared.value
        for batch in batches:
            out = [m.predict(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return in_batches(docs, run, schema)


def held_out_language_id(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs(doc_id, text, lang) to doc_id, held_out, lang_pred, score for every row, learned from those whose crc32(doc_id) mod 3 isn't 1.

    A null doc_id counts as not held out; repeated rows each stay; extra columns are ignored. Null and letterless texts
    are und, long ones are read whole, ties fall to the language that sorts first; an empty table gives no rows.
    """
    held = (mod_crc32("doc_id", 3) == 1).alias("held_out")
    docs = docs.select("doc_id", held, "text", "lang")
    model = fit(docs.where("NOT held_out"), sample=sample)
    return predict(docs.select("doc_id", "held_out", "text"), model).drop("text")
