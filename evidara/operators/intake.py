"""Files taken in as evidence: duplicates and refusals told apart, audit rows linked, all in one commit."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidara import schema
from evidara.operators import chain
from evidara.operators.skew import salted_join
from evidara.sources.commits import Store
from evidara.sources.tables import durable

#: What is known of a file, and what the log calls each step.  Fixed values.
FILE = ("id", "case_id", "path", "filename", "sha256", "length", "mime", "media_type", "phash", "dhash", "ahash")
INGESTED, HASHED, PERCEPTUAL, DUPLICATE, REFUSED = "EVIDENCE_INGESTED", "HASH_CALCULATED", "PERCEPTUAL_HASHED", "EVIDENCE_DUPLICATE", "EVIDENCE_REFUSED"


def judged(files: DataFrame, stored: DataFrame, scope: list[str]) -> DataFrame:
    """files (case_id, path, sha256, media_type and more) with outcome and existing_id.

    ACCEPTED; DUPLICATE of what is stored, or of an earlier path of the same batch, within the same values of ``scope``
    ([]: of all that is stored); REFUSED without a known media type.
    """
    key = F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in [*scope, "sha256"]]))
    fit = files.withColumn("_fit", F.col("media_type").isNotNull()).withColumn("_key", key)
    known = stored.select(key.alias("_key"), "id").groupBy("_key").agg(F.min("id").alias("_known"))
    first = fit.filter("_fit").groupBy("_key").agg(F.min(F.struct("path", "id")).alias("_first"))
    # very many files may have the same bytes
    both = salted_join(fit, first.join(known, "_key", "full_outer"), ["_key"], F.col("path"), "left")
    again = F.col("_known").isNotNull() | (F.col("_first.path") != F.col("path"))
    outcome = F.when(~F.col("_fit"), "REFUSED").when(again, "DUPLICATE").otherwise("ACCEPTED")
    return both.withColumn("outcome", outcome).withColumn("existing_id", F.when(F.col("outcome") == "DUPLICATE", F.coalesce("_known", "_first.id"))).drop("_fit", "_first", "_known", "_key")


def events(rows: DataFrame, steps: list[tuple[str, Column, list[str]]], actor: str, now: datetime.datetime) -> DataFrame:
    """case_id, event, timestamp, actor, details of each step (name, when, the fields that its details have), in order."""
    each = [F.when(when, F.struct(F.lit(i).alias("step"), F.lit(name).alias("event"), F.to_json(F.struct(*sorted(fields))).alias("details"))) for i, (name, when, fields) in enumerate(steps)]
    found = rows.select(F.coalesce("case_id", F.lit("")).alias("case_id"), "path", F.explode(F.array_compact(F.array(*each))).alias("e"))
    return found.select("case_id", "path", "e.step", "e.event", F.lit(now.strftime("%Y-%m-%dT%H:%M:%SZ")).alias("timestamp"), F.lit(actor).alias("actor"), "e.details")


def linked(new: DataFrame, log: DataFrame) -> DataFrame:
    """Audit rows of ``new`` (case_id, event, timestamp, actor, details and an order by path, step) that continue the log's chains.

    Every case has its own chain; its new rows are numbered and linked from its head on, cases side by side.
    """
    heads = log.groupBy("case_id").agg(F.max("seq").alias("_seq"), F.max_by("row_hash", "seq").alias("_start"))
    rows = new.join(heads, "case_id", "left")
    content = F.to_json(F.struct("event", "timestamp", "actor", "details"))
    done = chain.numbered(rows, content, ["path", "step"], F.col("case_id"), F.coalesce("_start", F.lit(chain.GENESIS)), ["case_id", "event", "timestamp", "actor", "details", "_seq"])
    done = done.withColumn("seq", F.coalesce("_seq", F.lit(0)) + F.col("_place")).withColumn("audit_id", F.concat_ws("-", "case_id", F.col("seq").cast("string")))
    return schema.migrated(done, schema.AUDIT).select(*[c.split()[0] for c in schema.AUDIT.split(", ")])


def content_of(log: DataFrame) -> DataFrame:
    """The log with the content that its hashes cover."""
    return log.withColumn("content", F.to_json(F.struct("event", "timestamp", "actor", "details")))


def take_in(store: Store, files: DataFrame, batch: str, actor: str, now: datetime.datetime, scope: tuple[str, ...] = ("case_id",)) -> int:
    """Evidence, refusals and audit rows of a batch of files as one commit; the same batch again changes nothing.

    ``files`` has id, case_id, path, filename, sha256, length, mime, media_type and the hashes of images (phash, dhash,
    ahash, NULL where there are none).  An accepted file is told in the log as taken in, hashed and, for images,
    perceptually hashed; a duplicate and a refused file leave one row each and no evidence.
    """
    evidence = store.read("evidence", schema.EVIDENCE)
    # judging reads the files three times: what they are made from, their bytes above all, is read once
    found = durable(judged(durable(files.select(*dict.fromkeys([*FILE, *scope]))), evidence, list(scope)))
    fresh, again, bad = (F.col("outcome") == x for x in ("ACCEPTED", "DUPLICATE", "REFUSED"))
    steps = [
        (INGESTED, fresh, ["id", "filename", "path", "mime", "media_type", "length"]),
        (HASHED, fresh, ["id", "sha256"]),
        (PERCEPTUAL, fresh & F.col("phash").isNotNull(), ["id", "phash", "dhash", "ahash"]),
        (DUPLICATE, again, ["sha256", "existing_id", "filename"]),
        (REFUSED, bad, ["filename", "sha256", "length"]),
    ]
    log = linked(events(found, steps, actor, now), store.read("audit_log", schema.AUDIT))
    accepted = found.filter(fresh).select("id", "case_id", "filename", F.col("path").alias("stored_path"), "media_type", F.col("mime").alias("mime_type"), F.col("length").alias("size_bytes"), "sha256", F.lit(now).cast("timestamp").alias("ingested_at"), "phash", "dhash", "ahash", F.lit("CASE_EVIDENCE").alias("role"), F.lit(False).alias("indexed"))
    rows = schema.migrated(accepted, schema.EVIDENCE).select(*[c.split()[0] for c in schema.EVIDENCE.split(", ")])
    return store.commit(batch, {"evidence": rows, "audit_log": log})
