"""Files as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.functions.files import safe_filename, sniff

#: Bytes read at both ends of a file for signature search.
HEAD, TAIL = 4 << 20, 512 << 10


def media_files(spark: SparkSession, path: str, most_bytes: int = 200 << 20) -> DataFrame:
    """path, length, sha256, mime, media_type, extension, filename, content of files within the size limit.

    Empty and oversized files are left out by their length before any byte is read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter((F.col("length") > 0) & (F.col("length") <= most_bytes))
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"), sniff(F.col("content")).alias("kind"), safe_filename(F.col("path")).alias("filename"), "content").select("path", "length", "sha256", "kind.mime", F.col("kind.media").alias("media_type"), F.col("kind.ext").alias("extension"), "filename", "content")


def windowed(content, head: int = HEAD, tail: int = TAIL):
    """First and last bytes of a binary column."""
    return F.when(F.length(content) <= head + tail, content).otherwise(F.concat(F.substring(content, 1, head), F.substring(content, -tail, tail)))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row an item of a corpus manifest, with the manifest's header columns."""
    whole = spark.read.option("multiLine", True).json(path)
    return whole.select("dataset", "manifest_version", F.explode("items").alias("item")).select("dataset", "manifest_version", "item.*")


def new_items(items: DataFrame, known: DataFrame, key: str = "evidence_id", limit: int | None = None) -> DataFrame:
    """Items that are not known yet: a second import adds nothing."""
    fresh = items.dropDuplicates([key]).join(known.select(key), key, "left_anti")
    return fresh if limit is None else fresh.orderBy(key).limit(limit)


def labelled_list(spark: SparkSession, path: str) -> DataFrame:
    """file, label of a CSV without header; other labels than 0 and 1 are left out."""
    return spark.read.schema("file string, label int").csv(path).filter("label in (0, 1)")


def with_files(rows: DataFrame, files: DataFrame, key: str = "file") -> tuple[DataFrame, DataFrame]:
    """(rows whose file is among ``files`` (filename, path), with its path; one row n_missing of those without)."""
    both = rows.join(files.select(F.col("filename").alias(key), "path").dropDuplicates([key]), key, "left")
    return both.filter("path is not null"), both.agg(F.count_if(F.col("path").isNull()).alias("n_missing"))


def web_detection(spark: SparkSession, path: str) -> DataFrame:
    """category, position, url, title of a web detection answer in snake or camel case."""
    page = "array<struct<url:string,pageTitle:string,page_title:string>>"
    names = {"full": ("fullMatchingImages", "full_matching_images"), "partial": ("partialMatchingImages", "partial_matching_images"), "page": ("pagesWithMatchingImages", "pages_with_matching_images"), "similar": ("visuallySimilarImages", "visually_similar_images")}
    schema = ", ".join(f"{n} {page}" for pair in names.values() for n in pair)
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    parts = [raw.select(F.lit(k).alias("category"), F.posexplode(F.coalesce(*pair)).alias("position", "hit")) for k, pair in names.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("category", "position", "hit.url", F.coalesce("hit.pageTitle", "hit.page_title").alias("title")).filter("url is not null")


def verified(files: DataFrame, manifest_rows: DataFrame) -> DataFrame:
    """path, ok of each manifest row (path, sha256, size): NULL if there is no file to check."""
    both = manifest_rows.withColumnRenamed("sha256", "_want").withColumnRenamed("size", "_size").join(files.select("path", "sha256", "length"), "path", "left")
    return both.select("path", F.when(F.col("sha256").isNotNull(), (F.col("sha256") == F.col("_want")) & (F.col("length") == F.col("_size"))).alias("ok"))
