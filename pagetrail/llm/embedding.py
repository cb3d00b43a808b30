"""Embedding near-duplicates: spherical-cap filters from structured random product codes, list-decoded, joined and verified."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetrail.llm.common import Forest, durable, in_batches, in_groups
from pagetrail.llm.components import EDGE, components

#: A direction joins one codeword of each block; CODEWORDS ** BLOCKS directions in all.
BLOCKS = 4
CODEWORDS = 16
#: Random unit vectors exceed so many directions' threshold on average; every vector takes its best LEAST at any rate.
LIST = 16
LEAST = 6
TILE = 512


class Codes:
    """Directions for vectors of one dimension, and the threshold that random unit vectors pass LIST times on average."""

    def __init__(self, dim: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.rotation = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        self.edges = np.linspace(0, dim, min(BLOCKS, dim) + 1).astype(int)
        self.words = []
        for a, b in zip(self.edges, self.edges[1:]):
            w = rng.normal(size=(CODEWORDS, b - a))
            self.words.append(w / np.linalg.norm(w, axis=1, keepdims=True))
        probe = rng.normal(size=(400, dim))
        probe /= np.linalg.norm(probe, axis=1, keepdims=True)
        scores = np.concatenate([self.all_scores(s) for s in self.partial(probe)])
        self.threshold = float(np.partition(scores, -LIST * len(probe))[-LIST * len(probe)])

    def partial(self, x: np.ndarray) -> list[list[np.ndarray]]:
        """Per vector, the scores of each block's codewords."""
        y = x @ self.rotation
        blocks = [y[:, a:b] @ w.T for a, b, w in zip(self.edges, self.edges[1:], self.words)]
        return [[b[i] for b in blocks] for i in range(len(x))]

    @staticmethod
    def all_scores(parts: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(1)
        for p in parts:
            out = (out[:, None] + p[None, :]).ravel()
        return out

    def decode(self, parts: list[np.ndarray]) -> np.ndarray:
        """Numbers of all directions whose score is at least the threshold (or the LEAST best): half-sums of the blocks, one half sorted, so only exceeding pairs are listed."""
        half = len(parts) // 2
        a, b = self.all_scores(parts[:half]), self.all_scores(parts[half:])
        order = np.argsort(-b, kind="stable")
        limit = self.threshold
        n = np.searchsorted(-b[order], a - limit, side="right")  # b >= limit - a
        if n.sum() < LEAST:
            top = (a[:, None] + b[None, :]).ravel()
            return np.sort(np.argpartition(-top, min(LEAST, len(top)) - 1)[:LEAST])
        at = np.flatnonzero(n)
        return np.sort(np.concatenate([i * len(b) + order[: n[i]] for i in at.tolist()]))


def _links(left: np.ndarray, right: np.ndarray, cosine: float) -> np.ndarray:
    """Which rows have at least this cosine, in double precision."""
    nl, nr = np.sqrt((left * left).sum(axis=1)), np.sqrt((right * right).sum(axis=1))
    c = (left @ right.T) / nl[:, None] / nr[None, :]
    for i, j in np.argwhere(np.abs(c - cosine) < 1e-12):  # a product of matrices may round otherwise than a dot product
        c[i, j] = float(np.dot(left[i], right[j])) / float(np.sqrt(np.dot(left[i], left[i])) * np.sqrt(np.dot(right[j], right[j])))
    return c >= cosine


def near_vectors(rows: DataFrame, cosine: float) -> tuple[DataFrame, DataFrame]:
    """rows(id, grp, v array<float>, times) of distinct vectors to (edges, counts): a forest of the links, and (id, n) how many rows of others each is linked with.

    A bucket is a (group, direction); one of over TILE vectors is cut into tiles by hash, and each pair of tiles is one
    task's group. A pair counts in the smallest direction that both vectors have, so once; a group returns one edge a
    vector and sums, never pairs.
    """

    def decode(batches):
        codes: dict[int, Codes] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                filters = []
                for v in batch.column("v").to_pylist():
                    x = np.array(v, float)
                    if len(x) not in codes:
                        codes[len(x)] = Codes(len(x))
                    code = codes[len(x)]
                    filters.append(code.decode(code.partial((x / np.linalg.norm(x))[None, :])[0]).tolist())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(filters, pa.list_(pa.int32()))], names=[*batch.schema.names, "filters"])

    found = durable(in_batches(rows, decode, rows.select("*", F.array(F.lit(0)).alias("filters")).schema))
    narrow = found.select("grp", F.explode("filters").alias("f"))
    large = durable(narrow.groupBy("grp", "f").agg(F.ceil(F.count("*") / TILE).cast("int").alias("k")).where("k > 1"))
    dealt = found.select("id", "grp", "v", "times", "filters", F.explode("filters").alias("f"))
    dealt = dealt.join(large, ["grp", "f"], "left").withColumn("k", F.coalesce("k", F.lit(1)))
    own = F.pmod(F.xxhash64("id"), F.col("k").cast("long")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: F.struct(F.least("c", j).alias("i"), F.greatest("c", j).alias("j")))
    dealt = dealt.withColumn("c", own).select("id", "grp", "v", "times", "filters", "f", "c", F.explode(pairs).alias("t")).select("id", "grp", "v", "times", "filters", "f", "c", "t.*")

    def compare(group: pa.Table) -> pa.Table:
        ids, times, c = (group.column(k).to_numpy() for k in ("id", "times", "c"))
        f, i, j = (group.column(k)[0].as_py() for k in ("f", "i", "j"))
        vectors = group.column("v").combine_chunks()
        v = vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(ids), -1)
        left = np.flatnonzero(c == i)
        right = left if i == j else np.flatnonzero(c == j)
        near = _links(v[left], v[right], cosine)
        if i == j:
            np.fill_diagonal(near, False)
        n, forest = np.zeros(len(ids), np.int64), Forest(len(ids))
        if near.any():
            lists = group.column("filters").combine_chunks()
            size = np.diff(lists.offsets.to_numpy())
            flat, owner = lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(ids)), size)
            earlier = flat < f
            names, at = np.unique(flat[earlier], return_inverse=True)
            if len(names):
                has = np.zeros((len(ids), len(names)), np.float32)
                has[owner[earlier], at] = 1
                near &= (has[left] @ has[right].T) == 0
            np.add.at(n, left, near @ times[right])
            if i != j:
                np.add.at(n, right, near.T @ times[left])
            for row in np.flatnonzero(near.any(axis=1)).tolist():
                forest.join(left[row], right[near[row]])
        child, root = forest.edges()
        told = np.flatnonzero(n)
        return pa.table({"a": pa.array(np.concatenate([ids[child], ids[told]]), pa.int64()), "b": pa.array(np.concatenate([ids[root], ids[told]]), pa.int64()), "n": pa.array(np.concatenate([np.zeros(len(child), np.int64), n[told]]), pa.int64())})

    out = durable(in_groups(dealt.groupBy("grp", "f", "i", "j"), compare, f"{EDGE}, n long"))
    return out.where("a <> b").select("a", "b"), out.where("a = b").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))


def embedding_components(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """vectors(vec_id, embedding, label) to vec_id, n_links, component_id, kept, one row per input row.

    Rows link if their labels are equal and not null and their cosine is at least the given one. Vectors that are null,
    empty, zero or hold null or non-finite components link with nothing (n_links 0, component_id = vec_id). Vectors of
    different lengths never link. Equal vectors collapse to one before any comparison and link with each other; repeated
    rows count as links of each other. A null vec_id keeps its row, counts as a link, and has component_id null if
    nothing in its component has an id. An empty table gives no rows.
    """
    ok = F.coalesce(F.col("label").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))) & F.exists("v", lambda x: x != 0), F.lit(False))
    # -0.0 and 0.0 are the same component; the group is the label and the length
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0))
    rows = vectors.select("vec_id", "label", v.alias("v")).withColumn("ok", ok).withColumn("grp", F.concat_ws("/", F.size("v"), F.col("label").cast("string")))
    classes = durable(rows.where("ok").groupBy("grp", "v").agg(F.count("*").alias("times"), F.min("vec_id").alias("low")).withColumn("id", F.xxhash64("grp", "v")))
    edges, counts = near_vectors(classes.select("id", "grp", "v", "times"), cosine)
    linked = components(edges)
    whole = durable(classes.select("id", "low", "times").join(linked, "id", "left").withColumn("c", F.coalesce("component_id", "id")).drop("component_id").join(counts, "id", "left"))
    lowest = durable(whole.groupBy("c").agg(F.min("low").alias("component_id")))
    of = durable(whole.join(lowest, "c").select("id", (F.col("times") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id"))
    out = rows.withColumn("id", F.when(F.col("ok"), F.xxhash64("grp", "v"))).select("vec_id", "ok", "id").join(of, "id", "left")
    component = F.when(F.col("ok"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
