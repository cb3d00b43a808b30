"""SimHash near-duplicates: tiled exact comparison of fingerprints with exclusive-or and bit counts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetrail.llm.common import LOWER, Forest, discard, durable, if_few, in_batches, in_groups, row_ids, texts_of, unused
from pagetrail.llm.components import EDGE, components

SEED = 42
TILE = 2048
TILES = 24
TILE_MOST = 1 << 21


def shingles(text: bytes, words: int) -> list[bytes]:
    """Runs of so many words joined by one space, repeats included; a shorter text is one run; no words, none."""
    parts = text.translate(LOWER).split()
    if len(parts) <= words:
        return [b" ".join(parts)] if parts else []
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [joined[a:b] for a, b in zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist())]


def fingerprint(text: bytes, words: int, lanes: int = 1) -> np.ndarray:
    """The fingerprint of the text's shingles, repeats included."""
    return sketch(shingles(text, words), lanes)


def sketch(runs: list[bytes], lanes: int) -> np.ndarray:
    """uint64 per lane; lane k hashes with seed SEED + k. A bit is 1 if set in over half the hashes."""
    out = np.zeros(lanes, np.uint64)
    digest = xxhash.xxh64_intdigest
    for k in range(lanes if runs else 0):
        total = np.zeros(64, np.int64)
        for at in range(0, len(runs), 1 << 15):
            hashes = np.array([digest(r, SEED + k) for r in runs[at : at + (1 << 15)]], np.uint64)
            total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(2 * total > len(runs), bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(docs: DataFrame, words: int, lanes: int = 1) -> DataFrame:
    """docs(doc_id, text) to (rid long, doc_id long, fp array<long>), one row per input row; null text has no words."""

    def run(batches):
        ids = row_ids()
        for batch in batches:
            fps = [fingerprint(t or b"", words, lanes).view(np.int64).tolist() for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([pa.array([next(ids) for _ in fps], pa.int64()), batch.column("doc_id").cast(pa.int64()), pa.array(fps, pa.list_(pa.int64()))], names=["rid", "doc_id", "fp"])

    return in_batches(docs.select("doc_id", "text"), run, "rid long, doc_id long, fp array<long>")


def _bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of every row of a against every row of b, lane by lane."""
    out = np.bitwise_count(a[:, None, 0] ^ b[None, :, 0])
    for k in range(1, a.shape[1]):
        out = out.astype(np.uint16) + np.bitwise_count(a[:, None, k] ^ b[None, :, k])
    return out


def matches(a: np.ndarray, b: np.ndarray, wa: np.ndarray, wb: np.ndarray, radius: int, reach: int, same: bool):
    """Yields (row of a, rows of b) at most radius bits apart; sub-tiles whose weights differ by more than reach are skipped. Both are sorted by weight."""
    for at in range(0, len(a), 64):
        end = min(at + 64, len(a))
        lo, hi = np.searchsorted(wb, wa[at] - reach), np.searchsorted(wb, wa[end - 1] + reach, side="right")
        for start in range(max(lo, at) if same else lo, hi, 4096):
            i, j = np.nonzero(_bits(a[at:end], b[start : min(start + 4096, hi)]) <= radius)
            i, j = i + at, j + start
            if same:
                i, j = i[i < j], j[i < j]
            if len(i):
                rows, cut = np.unique(i, return_index=True)
                yield from zip(rows.tolist(), np.split(j, cut[1:]))


def near_links(prints: DataFrame, radius: int, reach: int, lanes: int = 1) -> DataFrame:
    """prints(id long, fp array<long>, w int), ids distinct, to edges (a, b): a forest whose components are those of all pairs at most radius bits apart.

    w is a weight of which linked rows differ by at most reach (the bit count: by radius). Rows fall into bands of
    weights, reach wide, so only the same and the next band can link; bands are cut into tiles by hash, and each pair
    of tiles is one group, compared exactly. A tile grows with the rows (rows / TILES, TILE to TILE_MOST), so a row is
    copied to about as many groups at any size. A group returns at most one edge a row.
    """
    prints = prints.withColumn("band", F.floor(F.col("w") / max(1, reach)).cast("int"))
    sizes = {r.band: r.n for r in prints.groupBy("band").agg(F.count("*").alias("n")).collect()}  # a few dozen weights' bands
    tile = min(max(TILE, sum(sizes.values()) // TILES), TILE_MOST)
    chunks = {b: -(-n // tile) for b, n in sizes.items()}
    if not chunks:
        return prints.sparkSession.createDataFrame([], EDGE)
    of = F.create_map(*[F.lit(x) for b in chunks for x in (b, chunks[b])])
    k = F.pmod(F.xxhash64("id", F.lit(7)), of[F.col("band")].cast("long")).cast("int")
    own = F.transform(F.sequence(F.lit(0), of[F.col("band")] - 1), lambda j: F.struct(F.col("band").alias("p"), F.col("band").alias("q"), F.least("k", j).alias("i"), F.greatest("k", j).alias("j"), F.lit(0).alias("side")))
    up = F.transform(F.sequence(F.lit(0), of[F.col("band") + 1] - 1), lambda j: F.struct(F.col("band").alias("p"), (F.col("band") + 1).alias("q"), F.col("k").alias("i"), j.alias("j"), F.lit(0).alias("side")))
    down = F.transform(F.sequence(F.lit(0), of[F.col("band") - 1] - 1), lambda j: F.struct((F.col("band") - 1).alias("p"), F.col("band").alias("q"), j.alias("i"), F.col("k").alias("j"), F.lit(1).alias("side")))
    # within a band, the row's own chunk tells its side of the pair
    own = F.transform(own, lambda s: s.withField("side", F.when((s["i"] != s["j"]) & (s["j"] == F.col("k")), 1).otherwise(0)))
    none = F.array().cast("array<struct<p:int,q:int,i:int,j:int,side:int>>")
    pairs = F.concat(own.cast("array<struct<p:int,q:int,i:int,j:int,side:int>>"), F.coalesce(up.cast("array<struct<p:int,q:int,i:int,j:int,side:int>>"), none), F.coalesce(down.cast("array<struct<p:int,q:int,i:int,j:int,side:int>>"), none))
    dealt = prints.withColumn("k", k).select("id", "fp", "w", F.explode(pairs).alias("t")).select("id", "fp", "w", "t.*")

    def compare(group: pa.Table) -> pa.Table:
        ids, w, side = (group.column(k).to_numpy() for k in ("id", "w", "side"))
        fps = group.column("fp").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), lanes).view(np.uint64)
        same = group.column("p")[0] == group.column("q")[0] and group.column("i")[0] == group.column("j")[0]
        order = np.lexsort((ids, w))
        left, right = order[side[order] == 0], order[side[order] == 1]
        right = left if same else right
        forest = Forest(len(ids))
        for i, js in matches(fps[left], fps[right], w[left], w[right], radius, reach, same):
            forest.join(left[i], right[js])
        child, root = forest.edges()
        return pa.table({"a": pa.array(ids[child], pa.int64()), "b": pa.array(ids[root], pa.int64())})

    return in_groups(dealt.groupBy("p", "q", "i", "j"), compare, EDGE)


def simhash_components(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """docs(doc_id, text) to (doc_id long, fingerprint string, component_id long), one row per input row.

    Two rows link if their 64-bit fingerprints differ in at most radius bits; component_id is the smallest doc_id that
    links reach. Null or blank text has fingerprint zero, linked like any other. Rows with equal fingerprints collapse
    to one before any comparison. A null doc_id keeps its row and takes the component of its fingerprint, which is null
    if no row in it has an id. Repeated rows each stay; extra columns are ignored; an empty table gives no rows.
    """
    prints = durable(fingerprints(docs, words))
    classes = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("low"), F.min("rid").alias("id")))
    linked = components(near_links(classes.select("id", "fp", F.bit_count(F.col("fp")[0]).cast("int").alias("w")), radius, radius))
    whole = durable(classes.join(linked, "id", "left").select("fp", "low", F.coalesce("component_id", "id").alias("c")))
    lowest = durable(whole.groupBy("c").agg(F.min("low").alias("component_id")))
    of = durable(whole.join(lowest, "c").select("fp", "component_id"))
    return prints.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex(F.col("fp")[0]), 16, "0")).alias("fingerprint"), "component_id")


#: near_dedup: fingerprints of so many 64-bit lanes, and the bits within which texts of Jaccard similarity 0.8 lie (19.4 expected of 128, deviation 4.1).
LANES = 2
RADIUS = 32
CHUNK = 512


def _prints(docs: DataFrame, words: int) -> DataFrame:
    """docs(key, text) with words to (key, same, fp, w): same is a hash of the set of shingles, fp its fingerprint without repeats, w 1000 times the logarithm of its size."""

    def run(batches):
        for batch in batches:
            rows = []
            for k, t in zip(batch.column("key").to_pylist(), texts_of(batch)):
                if t and t.split():
                    runs = list(set(shingles(t, words)))
                    own = _set(runs)
                    rows.append((k, xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63), sketch(runs, LANES).view(np.int64).tolist(), int(1000 * np.log(len(own)))))
            key, same, fp, w = zip(*rows) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(same, pa.int64()), pa.array(fp, pa.list_(pa.int64())), pa.array(w, pa.int32())], names=["key", "same", "fp", "w"])

    return in_batches(docs, run, "key long, same long, fp array<long>, w int")


def _set(runs) -> np.ndarray:
    """The sorted hashes of distinct shingles."""
    return np.unique(np.array([xxhash.xxh64_intdigest(r, SEED) for r in runs], np.uint64)).view(np.int64)


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """docs(id, c, text) to (id, c, shingles array<long>): the sorted hashes of the distinct shingles."""

    def run(batches):
        for batch in batches:
            hashes = [_set(set(shingles(t, words))) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("c"), pa.array(hashes, pa.list_(pa.int64()))], names=["id", "c", "shingles"])

    return in_batches(docs, run, "id long, c long, shingles array<long>")


def similar(flat: np.ndarray, sizes: np.ndarray, jaccard: float, left: np.ndarray, forest: Forest) -> None:
    """Joins in the forest every pair (left, any) of sets with at least this similarity; pairs already together are not compared."""
    names, at = np.unique(flat, return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    mark = np.zeros(len(names), np.int64)
    everyone = np.arange(len(sizes))
    for i in left.tolist():
        roots = forest.find(everyone)
        if (roots == roots[i]).all():
            break
        own = at[starts[i] : starts[i] + sizes[i]]
        mark[own] = 1
        shared = np.add.reduceat(mark[at], starts)
        mark[own] = 0
        forest.join(i, np.flatnonzero(shared >= jaccard * (sizes[i] + sizes - shared) - 1e-9))


def verified_links(members: DataFrame, jaccard: float) -> DataFrame:
    """members(id, c, shingles) of candidate groups c, written, to edges (a, b): they join two members of a group if and only if a chain of pairs of at least this Jaccard similarity does.

    Groups of over CHUNK members are cut into chunks by hash. Each chunk is compared within itself; then the heads, one
    for each set of members already joined, with each other; then only members that are still apart from their group's
    largest set, with everyone else in the group. So a group of copies of one text costs in proportion to its members,
    and no link is lost in any group. Chunks are compared in pairs, so no task holds more than two.
    """

    def compare(group: pa.Table) -> pa.Table:
        ids, sets, label = group.column("id").to_numpy(), group.column("shingles").combine_chunks(), group.column("label").to_numpy()
        flat, sizes = sets.flatten().to_numpy(zero_copy_only=False), np.diff(sets.offsets.to_numpy())
        forest = Forest(len(ids))
        order = np.argsort(label, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(label[order])) + 1):
            if len(rows) > 1:
                forest.join(rows[0], rows[1:])
        similar(flat, sizes, jaccard, np.argsort(ids, kind="stable"), forest)
        child, root = forest.edges()
        return pa.table({"a": pa.array(ids[child], pa.int64()), "b": pa.array(ids[root], pa.int64())})

    def chunks(n: str) -> Column:
        return F.ceil(F.col(n) / CHUNK).cast("int")

    def dealt(rows: DataFrame, targets: Column) -> DataFrame:
        return in_groups(rows.select("id", "c", "shingles", "label", F.explode(targets).alias("t")).groupBy("c", "t"), compare, EDGE)

    def chunk(k: Column) -> Column:
        return F.pmod(F.xxhash64("id"), k.cast("long")).cast("int")

    def pair(kind: int, i: Column, j: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))

    def upto(k: Column, make) -> Column:
        return F.transform(F.sequence(F.lit(0), k - 1), make)

    def pairs(own: Column, k: Column) -> Column:
        return upto(k, lambda j: pair(0, F.least(own, j), F.greatest(own, j)))

    large = durable(members.groupBy("c").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK))
    rows = members.join(large, "c", "left").withColumn("k", F.coalesce(chunks("n"), F.lit(1)))
    rows = rows.withColumn("own", chunk(F.col("k"))).withColumn("label", F.col("id"))
    first = durable(dealt(rows, F.array(pair(0, F.col("own"), F.col("own")))))
    if large.isEmpty():
        discard(large)
        return first
    inside = members.join(large, "c")
    heads = inside.join(first.select(F.col("a").alias("id")), "id", "left_anti").select("id", "c", "shingles", F.col("id").alias("label"))
    many = durable(heads.groupBy("c").agg(F.count("*").alias("n")))
    heads = heads.join(many, "c").withColumn("k", chunks("n")).withColumn("own", chunk(F.col("k")))
    second = durable(dealt(heads, pairs(F.col("own"), F.col("k"))))
    together = components(first.unionByName(second))
    whole = durable(inside.join(together, "id", "left").select("id", "c", "shingles", F.coalesce("component_id", "id").alias("label")))
    sets = whole.groupBy("c", "label").agg(F.count("*").alias("n")).groupBy("c").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("n"))
    apart = durable(sets.where("n > most").select("c", "main", "most", (F.col("n") - F.col("most")).alias("rest")))
    rows = whole.join(apart, "c").withColumns({"km": chunks("most"), "kr": chunks("rest"), "is_main": F.col("label") == F.col("main")})
    rows = rows.withColumn("own", chunk(F.when(F.col("is_main"), F.col("km")).otherwise(F.col("kr"))))
    of_main = upto(F.col("kr"), lambda i: pair(1, i, F.col("own")))
    of_rest = F.concat(pairs(F.col("own"), F.col("kr")), upto(F.col("km"), lambda j: pair(1, F.col("own"), j)))
    third = durable(dealt(rows, F.when(F.col("is_main"), of_main).otherwise(of_rest)))
    discard(large, many, whole, apart)
    return together.select(F.col("id").alias("a"), F.col("component_id").alias("b")).unionByName(third)


def near_dedup(docs: DataFrame, words: int = 5, jaccard: float = 0.8) -> DataFrame:
    """docs(doc_id, text, ...) without near-duplicates: of each group of texts that links join, the row with the smallest doc_id stays, whole.

    Texts link if their sets of 5-word shingles have a Jaccard similarity of at least 0.8. Candidates are found by
    tiled comparison of 128-bit SimHash fingerprints of those sets within RADIUS bits, tiles whose set sizes rule a link out being
    skipped; every candidate group is then verified on whole sets. Only texts with equal sets collapse to one before
    that; equal fingerprints are no more than candidates. Texts without
    words (null, blank) are all kept; of rows with the same id and text one stays; a null doc_id comes after any id; an
    empty table gives no rows; other columns stay, whatever their names.
    """
    names = docs.columns
    key = unused("key", names)
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    prints = durable(_prints(keyed.select(F.col(key).alias("key"), "text"), words))
    classes = durable(prints.groupBy("same").agg(F.min("key").alias("id"), F.min("fp").alias("fp"), F.min("w").alias("w")))
    reach = int(np.ceil(1000 * np.log(1 / jaccard))) + 1
    near = components(near_links(classes.select("id", "fp", "w"), RADIUS, reach, LANES))
    candidates = durable(near.select("id", F.col("component_id").alias("c")))
    texts = keyed.select(F.col(key).alias("id"), "text").join(if_few(candidates), "id").dropDuplicates(["id"])
    sets = durable(_sets(texts, words))
    linked = components(verified_links(sets, jaccard))
    whole = durable(classes.join(linked, "id", "left").select("same", F.coalesce("component_id", "id").alias("c")))
    of = prints.select("key", "same").distinct().join(whole, "same").select("key", "c")
    member = durable(docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key")).distinct().join(of, "key").select("key", "c", F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("d"), F.col("key").alias("k")).alias("o")))
    first = durable(member.groupBy("c").agg(F.min("o").alias("o")).select(F.col("o.k").alias("key")))
    later = durable(member.select("key").join(first, "key", "left_anti").select(F.col("key").alias(key)))
    discard(prints, classes, candidates, sets, whole, member, first)
    return one_of_each(keyed.join(if_few(later), key, "left_anti"), key).select(*names)


def one_of_each(keyed: DataFrame, key: str) -> DataFrame:
    """Of rows that share a key (the same id and text) only one; where no rows do, none is shuffled with its text."""
    twice = durable(keyed.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key))
    if twice.isEmpty():
        return keyed
    return keyed.join(twice, key, "left_anti").unionByName(keyed.join(twice, key, "left_semi").dropDuplicates([key]))
