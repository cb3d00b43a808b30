"""Stored tables that are updated in place of their rows: buckets by key, of which a change rewrites only those that it touches."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET = "_bucket"


class Conflict(RuntimeError):
    """Somebody else published the version that a change was about to."""


class Stored:
    """A table below `path`, one row per key, in `buckets` folders by the keys' hash.

    A version is a small file that names each bucket's folder; folders are never changed once written. A change reads
    the newest version, writes new folders for the buckets it touches, and publishes the next version by an atomic
    rename that fails if it exists, so of two changes at once one raises Conflict, readers always see a whole version,
    and a job that dies leaves folders that no version names (vacuum removes them). Untouched buckets' files stay
    as they are, byte by byte. `change` names a change: one that was published before is left out, so a batch that a
    stream runs again counts once.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: StructType, buckets: int = 64):
        self.spark, self.path, self.keys, self.schema, self.buckets = spark, path.rstrip("/"), keys, schema, buckets
        self._jvm = spark.sparkContext._jvm
        self._files = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        return [f.getPath().getName() for f in self._files.listStatus(self._at(folder))] if self._files.exists(self._at(folder)) else []

    def version(self) -> dict:
        """The newest version: number, folders by bucket, the change that made it and those before."""
        numbers = [int(n) for n in self._names("versions") if n.isdigit()]
        if not numbers:
            return {"number": 0, "folders": {}, "change": None}
        stream = self._files.open(self._at(f"versions/{max(numbers):012d}"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def _publish(self, folders: dict[str, str], number: int, change: str | None) -> None:
        draft = self._at(f"drafts/{uuid.uuid4().hex}")
        out = self._files.create(draft, False)
        out.write(json.dumps({"number": number, "folders": folders, "change": change}).encode())
        out.close()
        final = self._at(f"versions/{number:012d}")
        self._files.mkdirs(final.getParent())
        if self._files.exists(final) or not self._files.rename(draft, final):
            raise Conflict(f"version {number} of {self.path} exists")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def read(self, buckets: list[str] | None = None) -> DataFrame:
        """The newest version's rows, or those of some buckets."""
        return self._read(self.version(), buckets)

    def _read(self, version: dict, buckets: list[str] | None = None) -> DataFrame:
        folders = [f for b, f in version["folders"].items() if buckets is None or b in buckets]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{f}" for f in folders))

    def _change(self, rows: DataFrame, merged, change: str | None) -> int:
        """Rewrites the buckets of `rows` as merged(old rows of these, rows); returns the version's number."""
        version = self.version()
        if change is not None and change == version["change"]:
            return version["number"]
        incoming = f"drafts/{uuid.uuid4().hex}"
        rows.withColumn(BUCKET, self._bucket()).write.parquet(f"{self.path}/{incoming}")
        new = self.spark.read.parquet(f"{self.path}/{incoming}")
        touched = sorted(str(r[0]) for r in new.select(BUCKET).distinct().collect())  # at most the buckets
        folder = f"data/{uuid.uuid4().hex}"
        out = merged(self._read(version, touched), new.drop(BUCKET)).select(*self.schema.names).withColumn(BUCKET, self._bucket())
        out.repartition(max(1, len(touched)), BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
        written = {n.partition("=")[2]: f"{folder}/{n}" for n in self._names(folder) if n.startswith(f"{BUCKET}=")}
        kept = {b: f for b, f in version["folders"].items() if b not in touched}
        self._publish(kept | written, version["number"] + 1, change)
        self._files.delete(self._at(incoming), True)
        return version["number"] + 1

    def upsert(self, rows: DataFrame, version: str, change: str | None = None) -> int:
        """Inserts rows, or puts them in the place of those with their keys: of several the one of the greatest `version` column."""
        from pagetrail.sources.tables import newest

        return self._change(rows.select(*self.schema.names), lambda old, new: newest(old.unionByName(new), self.keys, version), change)

    def update(self, rows: DataFrame, columns: list[str], change: str | None = None) -> int:
        """Sets `columns` of the stored rows with the keys of rows(keys, columns); keys that aren't stored are left out, of repeated keys one row holds (the greatest values)."""
        new_names = {c: f"_new_{c}" for c in columns}

        def merged(old: DataFrame, new: DataFrame) -> DataFrame:
            once = new.groupBy(*self.keys).agg(F.max(F.struct(*columns)).alias("_set")).select(*self.keys, F.lit(True).alias("_hit"), *(F.col("_set")[c].alias(n) for c, n in new_names.items()))
            joined = old.join(once, self.keys, "left")
            return joined.select(*(F.when(F.col("_hit"), F.col(new_names[c])).otherwise(F.col(c)).cast(self.schema[c].dataType).alias(c) if c in columns else F.col(c) for c in self.schema.names))

        return self._change(rows.select(*self.keys, *columns), merged, change)

    def replace(self, keys: DataFrame, rows: DataFrame, change: str | None = None) -> int:
        """Puts rows in the place of all stored ones whose keys are in keys (or in rows); here a key may have several rows."""
        both = keys.select(*self.keys).distinct().withColumn("_row", F.lit(None).cast(self.schema)).unionByName(rows.select(*self.keys, F.struct(*self.schema.names).cast(self.schema).alias("_row")))

        def merged(old: DataFrame, new: DataFrame) -> DataFrame:
            return old.join(new.select(*self.keys).distinct(), self.keys, "left_anti").select(*self.schema.names).unionByName(new.where("_row IS NOT NULL").select("_row.*"))

        return self._change(both, merged, change)

    def vacuum(self, versions: int = 1) -> None:
        """Deletes folders that none of the newest so many versions names, and older versions. Not while others read or change the table."""
        numbers = sorted(int(n) for n in self._names("versions") if n.isdigit())
        named = set()
        for n in numbers[-versions:]:
            stream = self._files.open(self._at(f"versions/{n:012d}"))
            named |= {f.removeprefix("data/") for f in json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["folders"].values()}
            stream.close()
        for folder in self._names("data"):
            for part in self._names(f"data/{folder}"):
                if f"{folder}/{part}" not in named:
                    self._files.delete(self._at(f"data/{folder}/{part}"), True)
        for n in numbers[:-versions]:
            self._files.delete(self._at(f"versions/{n:012d}"), False)
        self._files.delete(self._at("drafts"), True)
