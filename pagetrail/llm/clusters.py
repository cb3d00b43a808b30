"""Centroid clustering on dictionary-encoded vectors: exact centroid distances of distinct subvectors, summed by code."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetrail.llm.common import durable, in_batches, release

DIMENSIONS, CLUSTERS, ROUNDS, SEED = 64, 40, 5, 2
SCALE = 256
#: Larger components (after scaling) would let a squared distance leave a long; vectors with one are left out.
MOST = 1 << 27
#: Dimensions of a subvector, and vectors that share dictionaries.
WIDTH, TOGETHER = 2, 16_384

BLOCK = "vec_ids binary, nulls binary, n int, data binary"
SUMS = "cluster int, n long, sums array<long>"
ASSIGNED = "vec_id long, cluster int, distance long"


def kept_vectors(embeddings: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """embeddings(vec_id, embedding) to (vec_id, x array<long>): vectors of exactly so many components, none null or non-finite, each component floor(scale * x) in double precision."""
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != F.lit(float("inf"))) & (F.abs(x.cast("double")) <= F.lit(MOST / scale)))
    return embeddings.where(e.isNotNull() & (F.size(e) == dimensions)).where(finite).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(e, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long")).alias("x"))


def encode(x: np.ndarray, width: int = WIDTH) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Dictionaries and codes of whole-number vectors: for each `width` dimensions the distinct subvectors, and each vector's place among them. Lossless."""
    dictionaries, codes = [], []
    for at in range(0, x.shape[1], width):
        part = np.ascontiguousarray(x[:, at : at + width])
        low = part.min(axis=0)
        span = (part.max(axis=0) - low + 1).tolist()
        total = 1
        for s in span:
            total *= s
        if total < 1 << 62:  # one number for each subvector
            number = np.zeros(len(part), np.int64)
            for d, s in enumerate(span):
                number = number * s + (part[:, d] - low[d])
            _, first, code = np.unique(number, return_index=True, return_inverse=True)
            distinct = part[first]
        else:
            distinct, code = np.unique(part, axis=0, return_inverse=True)
        code = code.reshape(-1)
        dictionaries.append(distinct)
        codes.append(code.astype(np.uint16 if len(distinct) <= 1 << 16 else np.uint32))
    return dictionaries, codes


def encoded_blocks(vectors: DataFrame, width: int = WIDTH, together: int = TOGETHER) -> DataFrame:
    """vectors(vec_id, x) as blocks of up to `together` vectors, each with its own dictionaries and codes: the block is the unit of memory, and copies of a vector add codes but no entries."""

    def run(batches):
        ids, rows, held = [], [], 0

        def out():
            x = np.concatenate(rows)
            numbers = pa.concat_arrays(ids)
            dictionaries, codes = encode(x, width)
            schema = [pa.array([d.astype("<i8").tobytes() for d in dictionaries], pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([c.itemsize for c in codes], pa.int32())]
            sink = pa.BufferOutputStream()
            table = pa.RecordBatch.from_arrays(schema, names=["dictionary", "codes", "bytes"])
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=1))) as writer:
                writer.write_batch(table)
            ids.clear(), rows.clear()
            none = numbers.is_null().to_numpy(zero_copy_only=False)
            columns = [numbers.fill_null(0).to_numpy().astype("<i8").tobytes(), np.packbits(none).tobytes(), len(x), sink.getvalue().to_pybytes()]
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(columns, (pa.binary(), pa.binary(), pa.int32(), pa.binary()))], names=["vec_ids", "nulls", "n", "data"])

        for batch in batches:
            if not batch.num_rows:
                continue
            ids.append(batch.column("vec_id").cast(pa.int64()))
            rows.append(batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
            held += batch.num_rows
            if held >= together:
                yield out()
                held = 0
        if held:
            yield out()

    return in_batches(vectors.select("vec_id", "x"), run, BLOCK)


def decoded(data: bytes) -> tuple[list[np.ndarray], list[np.ndarray], int]:
    """A block's dictionaries (distinct subvectors as rows) and codes, and the dimensions in all."""
    table = pa.ipc.open_stream(pa.py_buffer(data)).read_all()
    codes = [np.frombuffer(c, np.uint16 if b == 2 else np.uint32) for c, b in zip(table.column("codes").to_pylist(), table.column("bytes").to_pylist())]
    dictionaries = []
    for raw, c in zip(table.column("dictionary").to_pylist(), codes):
        flat = np.frombuffer(raw, "<i8")
        entries = int(c.max()) + 1
        dictionaries.append(flat.reshape(entries, -1))
    return dictionaries, codes, sum(d.shape[1] for d in dictionaries)


def nearest(dictionaries: list[np.ndarray], codes: list[np.ndarray], centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's nearest centroid (ties: the smaller number) and the squared distance.

    An entry's distance to the centroids' part is computed once, in whole numbers, and a vector's is the sum over its codes.
    """
    total = np.zeros((len(codes[0]), len(centroids)), np.int64)
    at = 0
    for entries, code in zip(dictionaries, codes):
        part = centroids[:, at : at + entries.shape[1]]
        table = np.zeros((len(entries), len(centroids)), np.int64)
        for d in range(entries.shape[1]):
            gap = entries[:, d, None] - part[None, :, d]
            table += gap * gap
        total += table[code]
        at += entries.shape[1]
    cluster = total.argmin(axis=1)
    return cluster, total[np.arange(len(total)), cluster]


def sums_of(dictionaries: list[np.ndarray], codes: list[np.ndarray], cluster: np.ndarray, k: int) -> np.ndarray:
    """The vectors' sum for each cluster, from how often each entry is in it."""
    out = []
    for entries, code in zip(dictionaries, codes):
        times = np.bincount(cluster * len(entries) + code, minlength=k * len(entries)).reshape(k, -1)
        out.append(times.astype(np.int64) @ entries)
    return np.concatenate(out, axis=1)


def first_centroids(vectors: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The vectors whose sha256("<seed>:<vec_id>") is smallest, in that order (ties: by components; a null vec_id comes last)."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select("x", order.alias("order")).orderBy(F.col("order").asc_nulls_last(), "x").limit(clusters).collect()  # at most `clusters` rows
    return np.array([r["x"] for r in rows], np.int64)


def assign(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Each vector of the blocks with its cluster and squared distance."""

    def run(batches):
        for batch in batches:
            for ids, nulls, n, data in zip(*(batch.column(c).to_pylist() for c in ("vec_ids", "nulls", "n", "data"))):
                dictionaries, codes, _ = decoded(data)
                cluster, distance = nearest(dictionaries, codes, centroids)
                none = np.unpackbits(np.frombuffer(nulls, np.uint8), count=n).astype(bool)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(ids, "<i8"), pa.int64(), mask=none), pa.array(cluster, pa.int32()), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return in_batches(blocks, run, ASSIGNED)


def moved(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: floor(sum / count) of their vectors, an empty one as it was. Each task sends a row for each centroid."""
    k, width = centroids.shape

    def run(batches):
        counts, sums = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for batch in batches:
            for data in batch.column("data").to_pylist():
                dictionaries, codes, _ = decoded(data)
                cluster, _ = nearest(dictionaries, codes, centroids)
                counts += np.bincount(cluster, minlength=k)
                sums += sums_of(dictionaries, codes, cluster, k)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(counts[held]), pa.array(sums[held].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    parts = in_batches(blocks.select("data"), run, SUMS)
    # decimals: a sum over all vectors may leave a long
    each = [F.sum(F.col("sums")[d].cast("decimal(20,0)")).alias(f"s{d}") for d in range(width)]
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *each).collect()  # one row per centroid at most
    out = centroids.copy()
    for row in rows:
        out[row["cluster"]] = [int(row[f"s{d}"]) // row["n"] for d in range(width)]
    return out


def _literal(values: dict[int, object], key: Column, kind: str) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))[key].cast(kind)


def centroid_clusters(embeddings: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, width: int = WIDTH, seed: int = SEED, together: int = TOGETHER) -> DataFrame:
    """embeddings(vec_id, embedding) to vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: one row per kept vector.

    Vectors are kept and made whole numbers by kept_vectors, dictionary-encoded once (a written table of blocks), and
    assigned `rounds` times and once more; all arithmetic is exact. A round is one pass over the blocks, in which a
    task sends one row per centroid; the driver holds the centroids alone.

    Vectors that are null, of other length, or hold null, non-finite or very large components (over 2^27 / 256) are
    left out; a null vec_id stays and is never among the first centroids unless there are too few others; repeated rows
    are vectors of their own; with fewer vectors than clusters there are as many centroids as vectors; an empty table
    gives no rows; extra columns are ignored.
    """
    vectors = kept_vectors(embeddings, dimensions)
    centroids = first_centroids(vectors, clusters, seed)
    spark = embeddings.sparkSession
    schema = f"{ASSIGNED}, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return spark.createDataFrame([], schema)
    blocks = durable(encoded_blocks(vectors, width, together))
    for _ in range(rounds):
        centroids = moved(blocks, centroids)
    found = durable(assign(blocks, centroids))
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}  # one row per centroid at most
    hashes = {c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest() for c in sums}
    at = F.col("cluster")
    return found.select("*", _literal(sums, at, "long").alias("cluster_inertia"), F.lit(sum(sums.values())).cast("long").alias("inertia"), _literal(hashes, at, "string").alias("centroid_sha256"))
