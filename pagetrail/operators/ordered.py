"""Firsts and running sums of ordered groups, for groups of any size: no task holds or sorts a whole group."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagetrail.session import durable

SALTS = 32


def first_rows(rows: DataFrame, group: str, order: list[str], most: int, salts: int = SALTS) -> DataFrame:
    """The first `most` rows of each group by the given columns, nulls first (ties by the row's hash).

    Each group is dealt out over salts by its rows' hash, the first of every (group, salt) are found by a bounded
    top-k (Spark keeps `most` rows of a key in each task before it shuffles), and a group's salts * most rows at most
    meet in one aggregate. A null group is a group.
    """
    names = rows.columns
    hashed = rows.withColumn("_tied", F.xxhash64(*names)).withColumn("_salt", F.pmod("_tied", F.lit(salts)))
    near = Window.partitionBy(group, "_salt").orderBy(*order, "_tied")
    few = hashed.withColumn("_n", F.row_number().over(near)).where(F.col("_n") <= most)
    ranked = few.select(F.col(group).alias("_group"), F.struct(*(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)), "_tied", F.struct(*names).alias("_row")).alias("_key"))
    firsts = ranked.groupBy("_group").agg(F.slice(F.array_sort(F.collect_list("_key")), 1, most).alias("_rows"))
    return firsts.select(F.inline("_rows")).select("_row.*")


def before(rows: DataFrame, group: str, order: list[str], summed: str, parts: int | None = None) -> DataFrame:
    """rows with _n and _sum: how many rows of the same group come before, and their sum of `summed` (long; null counts 0).

    Prefix sums in two levels: rows are dealt out by ranges of (group, order) and written with their sums within the
    range, then each range gets what the ranges before it hold of the group, one number for each of a group's ranges.
    So a group that is a third of all rows is a third of the ranges. Ties stand in the order of the rows' hash.
    """
    spark, names = rows.sparkSession, rows.columns
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tied = F.xxhash64(*names)
    ranged = rows.withColumn("_tied", tied).repartitionByRange(parts, group, *order, "_tied").sortWithinPartitions(group, *order, "_tied").withColumn("_part", F.spark_partition_id())
    schema = ranged.drop("_tied").withColumns({"_n": F.lit(0).cast("long"), "_sum": F.lit(0).cast("long")}).schema
    kept = [*names, "_part"]

    def run(batches):
        last, count, total = None, 0, 0  # the group that the batch before ended in, and what it had
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(group)
            codes = pc.dictionary_encode(keys, null_encoding="encode").indices.to_numpy()
            value = pc.fill_null(batch.column(summed).cast(pa.int64()), 0).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
            sizes = np.diff(np.append(starts, len(codes)))
            n = np.arange(len(codes)) - np.repeat(starts, sizes)
            sums = np.cumsum(value) - value
            sums = sums - np.repeat(sums[starts], sizes)
            if last is not None and keys[0].as_py() == last[0]:
                n[: sizes[0]] += count
                sums[: sizes[0]] += total
            last = (keys[-1].as_py(),)
            count, total = int(n[-1]) + 1, int(sums[-1] + value[-1])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(n), pa.array(sums)], names=[*kept, "_n", "_sum"])

    local = durable(ranged.drop("_tied").mapInArrow(run, schema))
    sizes = local.groupBy(group, "_part").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.col(summed), F.lit(0)).cast("long")).alias("s"))
    of_group = sizes.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("_part", "n", "s"))).alias("ranges"))
    kind = "array<struct<_part:int,n:bigint,s:bigint>>"
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("s"), F.array().cast(kind).alias("out"))
    step = lambda a, x: F.struct((a["n"] + x["n"]).alias("n"), (a["s"] + x["s"]).alias("s"), F.concat(a["out"], F.array(F.struct(x["_part"].alias("_part"), a["n"].alias("n"), a["s"].alias("s")))).alias("out"))
    earlier = of_group.select(F.col(group).alias("_group"), F.inline(F.aggregate("ranges", start, step)["out"])).withColumnsRenamed({"n": "_n0", "s": "_s0", "_part": "_part0"})
    joined = local.join(earlier, local[group].eqNullSafe(earlier["_group"]) & (local["_part"] == earlier["_part0"]), "left")
    return joined.select(*names, (F.col("_n") + F.col("_n0")).alias("_n"), (F.col("_sum") + F.col("_s0")).alias("_sum"))
