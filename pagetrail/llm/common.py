"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z on UTF-8 bytes; other bytes stay.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: As LOWER, and every ASCII byte that is no letter or digit becomes a space.
ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or (unset, on one machine, as in tests) a temporary one; on a cluster it must be set."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = f"file://{tempfile.mkdtemp(prefix='pagetrail-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage is cut, lost executors cost no more than a reread."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.durable_path = path
    return out


def discard(*written: DataFrame) -> None:
    """Deletes tables that durable() wrote, once everything that reads them is itself written."""
    for df in written:
        jvm = df.sparkSession.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(df.durable_path)
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: A written table of at most so many numbers (8 bytes each, and as much again for a hash table) is broadcast.
FEW = 4_000_000


def if_few(written: DataFrame, cells: Column | None = None) -> DataFrame:
    """The table marked for broadcast if its cells (those of a row: columns, or the given sum) are FEW at most; else as it is, for a shuffled join. They are counted, not estimated."""
    one = F.lit(len(written.columns)) if cells is None else cells
    n = written.agg(F.sum(one.cast("long"))).first()[0] or 0
    return F.broadcast(written) if n <= FEW else written


def unused(name: str, taken: list[str]) -> str:
    """A name for a helper column that no column has, in any case."""
    taken = {t.lower() for t in taken}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Rows of a batch that a task's Python holds at once; whole texts are some kilobytes, long ones a hundred.
BATCH = 2000
BATCH_BYTES = 4 << 20


def release() -> None:
    """Gives memory that Python and Arrow have freed back to the system: Spark uses a worker again for many tasks, and it would keep the most that any of them took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def in_batches(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(run, schema) with at most BATCH rows and about BATCH_BYTES a batch. These are the session's settings, which count when the plan runs; lower ones stay. Workers release memory after each task."""
    conf = df.sparkSession.conf
    for key, most in (("maxRecordsPerBatch", BATCH), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = conf.get(key).lower().rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(key, str(most))

    def task(batches):
        yield from run(batches)
        release()

    return df.mapInArrow(task, schema)


#: A group whose table is larger has its worker release memory after it.
GROUP_BYTES = 1 << 22


def in_groups(grouped, compare, schema) -> DataFrame:
    """grouped.applyInArrow(compare, schema); workers release memory after a large group."""

    def group(table: pa.Table) -> pa.Table:
        size = table.nbytes
        out = compare(table)
        del table
        if size > GROUP_BYTES:
            release()
        return out

    return grouped.applyInArrow(group, schema)


def row_ids():
    """Numbers that are unique over all tasks of a stage; stable once written."""
    base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
    while True:
        yield base
        base += 1


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """A string column as UTF-8 bytes."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def mod_crc32(column: str, n: int):
    """crc32(column as text) mod n; a null id counts as remainder n - 1."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % n, F.lit(n - 1))


class Forest:
    """Union-find over 0..n-1 in numpy; a root is the smallest index of its set."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        r = self.up[x]
        while True:
            s = self.up[r]
            if (s == r).all():
                break
            r = s
        self.up[x] = r
        return r

    def join(self, i: int, others: np.ndarray) -> None:
        """Puts i and all others in one set."""
        roots = np.unique(self.find(np.append(others, i)))
        self.up[roots] = roots[0]

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Each member that isn't a root, and its root."""
        r = self.find(np.arange(len(self.up)))
        at = np.flatnonzero(r != np.arange(len(r)))
        return at, r[at]
