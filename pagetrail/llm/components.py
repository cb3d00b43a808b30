"""Connected components of links, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetrail.llm.common import Forest, discard, durable, in_batches

EDGE = "a long, b long"


def _contract(batches):
    """Per Arrow batch: a spanning forest of the links, each member with its smallest."""
    for batch in batches:
        a, b = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("a", "b"))
        ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        forest = Forest(len(ids))
        at = at.reshape(2, -1)
        order = np.argsort(at[0], kind="stable")
        x, y = at[0][order], at[1][order]
        cut = np.flatnonzero(np.diff(x)) + 1
        for rows in np.split(np.arange(len(x)), cut) if len(x) else []:
            forest.join(x[rows[0]], y[rows])
        child, root = forest.edges()
        yield pa.RecordBatch.from_arrays([pa.array(ids[child], pa.int64()), pa.array(ids[root], pa.int64())], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """edges(a long, b long) to (id long, component_id long): each linked id with the smallest id that its links reach.

    Ids without links are absent; nulls and self-links are ignored; repeated links count once; no edges give no rows.
    Every round is one aggregate and one join per star, on keys whose rows Spark may split; nothing is collected but
    two sums that tell whether a round changed the links. Links first shrink to a forest within each Arrow batch.
    """
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    now = durable(in_batches(edges, _contract, EDGE).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
    before = mark(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = durable(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        older, now = now, durable(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        discard(older, large)
        after = mark(now)
        if after == before:
            break
        before = after
    ends = now.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
    return ends.unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct())
