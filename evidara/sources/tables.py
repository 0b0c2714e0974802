"""Tables on shared storage: versions, appends, replacements and checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which the driver and all executors share; a temporary one only in local mode."""
    context = spark.sparkContext
    folder = context._jsc.sc().getCheckpointDir()
    if folder.isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="evidara-checkpoint-"))
        folder = context._jsc.sc().getCheckpointDir()
    return folder.get()


def durable(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read again.

    A table rather than ``checkpoint()``, which keeps its plan's estimated size: in a loop of joins those multiply.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append(rows: DataFrame, path: str, *partitions: str) -> None:
    """Append-only results: nothing is updated, the newest row wins on reading."""
    rows.write.mode("append").partitionBy(*partitions).parquet(path)


def replaced(stored: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Stored rows with those of every key that ``fresh`` has taken out and the fresh ones put in."""
    return stored.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def replace_partitions(rows: DataFrame, path: str, key: str) -> None:
    """The same in place: only the partitions of keys among ``rows`` are overwritten."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def save_version(rows: DataFrame, path: str) -> int:
    """Writes the next version of a derived table; readers of older versions are not disturbed."""
    version = (latest_version(rows.sparkSession, path) or 0) + 1
    rows.write.parquet(f"{path}/version={version}")
    return version


def _versions(spark: SparkSession, path: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(folder):
        return []
    done = [f.getPath() for f in system.listStatus(folder) if system.exists(jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    return sorted(int(p.getName().split("=")[1]) for p in done if p.getName().startswith("version="))


def latest_version(spark: SparkSession, path: str) -> int | None:
    """Newest version whose write was finished."""
    return max(_versions(spark, path), default=None)


def load_version(spark: SparkSession, path: str, held: tuple[int, DataFrame] | None = None) -> tuple[int, DataFrame] | None:
    """(version, rows) of the newest version; the held copy if it is still the newest or reading the new one fails."""
    version = latest_version(spark, path)
    if version is None or (held and held[0] == version):
        return held
    try:
        return version, spark.read.parquet(f"{path}/version={version}")
    except Exception:
        if held:
            return held
        raise


def rebuilt_index(evidence: DataFrame) -> DataFrame:
    """id, value of the hash index: one row an id, malformed and empty hashes left out."""
    from evidara.functions.hashing import hash_from_hex

    return evidence.select("id", hash_from_hex(F.col("phash")).alias("value")).filter("value is not null").groupBy("id").agg(F.min("value").alias("value"))


def index_changes(index: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries to add, ids to remove) that bring the index to the evidence."""
    wanted = rebuilt_index(evidence)
    return wanted.join(index, ["id", "value"], "left_anti"), index.select("id").join(wanted, "id", "left_anti")


def rebuilt_vectors(embeddings: DataFrame, dims: int) -> DataFrame:
    """id, value of the vector index: unit vectors, one row an id; other lengths, NULL or infinite entries and zero vectors left out."""
    from evidara.functions.hashing import dot, unit

    whole = embeddings.select("id", F.col("value").cast("array<double>").alias("value")).filter((F.size("value") == dims) & F.forall("value", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))))
    real = whole.filter(dot(F.col("value"), F.col("value")) > 0)
    return real.groupBy("id").agg(F.min("value").alias("value")).select("id", unit(F.col("value")).alias("value"))


def vector_changes(index: DataFrame, embeddings: DataFrame, dims: int) -> tuple[DataFrame, DataFrame]:
    """(entries to add, ids to remove) that bring a stored vector index to the embeddings; an entry whose vector changed is both."""
    wanted = rebuilt_vectors(embeddings, dims)
    return wanted.join(index, ["id", "value"], "left_anti"), index.join(wanted, ["id", "value"], "left_anti").select("id")
