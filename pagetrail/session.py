"""What a session needs to run the library on executors."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application, as spark-submit --py-files would."""
    sc = spark.sparkContext
    if getattr(sc, "_pagetrail_shipped", False):
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="pagetrail-")) / "pagetrail.zip"
    with zipfile.ZipFile(path, "w") as out:
        for p in sorted(root.rglob("*.py")):
            out.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(path))
    sc._pagetrail_shipped = True


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
    """Writes df as Parquet in the shared folder and reads it back, so that what several queries read is computed once and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
