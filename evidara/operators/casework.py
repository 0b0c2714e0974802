"""Cases analysed end to end: integrity gate, stages, near-duplicate search, fusion and the stored verdict, in one commit.

Every stage is a table of results of all items at once (evidence_id, kind, status, score, payload), computed only for items
that have none stored unless it is asked for anew, so an analysis that is repeated costs a read.  What an analysis adds
(results, matches, audit rows) becomes visible together or not at all.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidara import schema
from evidara.functions import files as names
from evidara.functions import hashing, scores
from evidara.media import containers, pixels, profiles
from evidara.operators import fusion, intake, latest, lineage, neighbours, skew
from evidara.sources.commits import Store
from evidara.sources.tables import durable

#: What results and log rows are called.  Fixed values.
METADATA, PROVENANCE, FORENSICS, DETECTOR, FUSION = "metadata", "provenance", "forensics", "detector", "fusion"
KINDS = (METADATA, DETECTOR, PROVENANCE, FORENSICS, FUSION)
EVENTS = {METADATA: "METADATA_EXTRACTED", DETECTOR: "DETECTOR_RUN", PROVENANCE: "PROVENANCE_INSPECTED", FORENSICS: "FORENSICS_RUN", FUSION: "FUSION_COMPLETED"}
POOL = 15
RESULT = ["evidence_id", "kind", "status", "score", "payload"]
#: Payloads that fusion reads back.
PAYLOADS = {
    METADATA: "status string, editor string, generative string, modified_after boolean, camera boolean, captured boolean",
    PROVENANCE: "state string, declares_generative boolean",
    FORENSICS: "n_outliers long, n_tiles long, off_grid boolean",
    DETECTOR: "abstained boolean",
}


def facts(stored_files: DataFrame) -> DataFrame:
    """What is read from the bytes of files (path, content) where they lie, so that bytes never leave their task: path, recomputed
    (digest), tags, xmp, icc, has_manifest and declared (NULL without a manifest: only then the whole text is searched)."""
    content = F.col("content")
    read = stored_files.select("path", "content", F.sha2(content, 256).alias("recomputed"), containers.exif_tags(content).alias("tags"), profiles.xmp(content).alias("xmp"), profiles.icc(content).alias("icc"), containers.credentials(content).alias("has_manifest"))
    return read.withColumn("declared", F.when(F.col("has_manifest"), containers.declared_details(content))).drop("content")


def gate(evidence: DataFrame, read: DataFrame) -> DataFrame:
    """evidence with its files' facts and gate: OK, CHANGED (the bytes aren't those taken in: nothing is analysed) or MISSING."""
    both = evidence.join(read.withColumnRenamed("path", "stored_path"), "stored_path", "left")
    return both.withColumn("gate", F.when(F.col("recomputed").isNull(), "MISSING").when(F.col("recomputed") == F.col("sha256"), "OK").otherwise("CHANGED"))


def _result(rows: DataFrame, kind: str, status: Column, score: Column, payload: Column) -> DataFrame:
    return rows.select(F.col("id").alias("evidence_id"), F.lit(kind).alias("kind"), status.alias("status"), score.cast("double").alias("score"), F.to_json(payload).alias("payload"))


def _readable(status: Column | str) -> Column:
    return F.when(F.col("gate") == "MISSING", "ERROR").otherwise(status)


def metadata_stage(items: DataFrame) -> DataFrame:
    """Tags, XMP, ICC, hints of editors and generators, and what the declared times say."""
    software = F.coalesce("tags.software", "xmp.creator_tool")
    captured, modified = names.parse_exif(F.col("tags.datetime_original")), names.parse_exif(F.col("tags.datetime"))
    whole = containers.completeness({"make": F.col("tags.make"), "model": F.col("tags.model"), "software": software, "captured": F.col("tags.datetime_original"), "xmp": F.col("xmp.document_id")})
    payload = F.struct(
        _readable("OK").alias("status"), software.alias("software"), names.software_hint(software, names.EDITOR_HINTS).alias("editor"), names.software_hint(software, names.GENERATIVE_HINTS).alias("generative"),
        (modified > captured).alias("modified_after"), (F.col("tags.make").isNotNull() | F.col("tags.model").isNotNull()).alias("camera"), captured.isNotNull().alias("captured"),
        "xmp", "icc", whole.alias("presence"),
    )
    return _result(items, METADATA, _readable("OK"), F.lit(None), payload)


def provenance_stage(items: DataFrame) -> DataFrame:
    """State of the content credentials; without a validator a manifest is never more than UNVERIFIED."""
    found = containers.provenance_state(F.col("gate") == "OK", F.col("has_manifest"), F.lit(None).cast("boolean"))
    read = items.withColumn("s", found)
    payload = F.struct("s.state", "s.manifest_present", F.when(F.col("s.manifest_present"), F.col("declared.declares_generative")).otherwise(False).alias("declares_generative"), F.when(F.col("s.manifest_present"), F.col("declared")).alias("declared"))
    return _result(read, PROVENANCE, F.col("s.status"), F.lit(None), payload)


def forensics_stage(items: DataFrame, decoded: DataFrame) -> DataFrame:
    """Share of tiles whose recompression their texture doesn't explain, and the block grid's phase, as a capped score."""
    few = decoded.join(items.filter("gate = 'OK'").select(F.col("stored_path").alias("origin")), "origin", "left_semi")
    tiles = pixels.residual_report(few).select(F.col("origin").alias("stored_path"), "n_outliers", "n_tiles", "p99")
    grid = pixels.grid_phases(few).select(F.col("origin").alias("stored_path"), "phase", "ratio", "off_grid")
    seen = few.select(F.col("origin").alias("stored_path"), F.lit(True).alias("decoded"))
    both = items.join(seen, "stored_path", "left").join(tiles, "stored_path", "left").join(grid, "stored_path", "left")
    score = F.round(scores.forensic_score(F.col("n_outliers") / F.col("n_tiles"), F.coalesce("off_grid", F.lit(False))), 4)
    status = F.when(F.col("media_type") != "image", "UNSUPPORTED_MEDIA").when(F.col("decoded").isNull(), "ERROR").when(F.col("n_tiles").isNull(), "INSUFFICIENT_DATA").otherwise("OK")
    return _result(both, FORENSICS, status, F.when(status == "OK", score), F.struct("n_outliers", "n_tiles", "p99", "phase", "ratio", "off_grid"))


def detector_stage(items: DataFrame, detections: DataFrame | None) -> DataFrame:
    """What detectors said (evidence_id, score, status, abstained); an item without an answer is UNAVAILABLE."""
    none = items.sparkSession.createDataFrame([], "evidence_id string, score double, status string, abstained boolean")
    said = (none if detections is None else detections).select(F.col("evidence_id").alias("id"), F.col("score").alias("_score"), F.col("status").alias("_status"), F.col("abstained").alias("_abstained"))
    both = items.join(said, "id", "left")
    return _result(both, DETECTOR, F.coalesce("_status", F.lit("UNAVAILABLE")), F.col("_score"), F.struct(F.col("_abstained").alias("abstained")))


def search(items: DataFrame, index: DataFrame, top_k: int, most: int = hashing.POSSIBLE_DISTANCE) -> DataFrame:
    """Ranked candidates of every item with a hash among ``index`` (id, sha256, phash, dhash, ahash), the item itself left out.

    A pool of the nearest by the first hash and all of equal bytes is verified: equal bytes count as distance 0, else the first hash or
    the nearest of all three has to be within ``most``.  Order: equal bytes, distance, similarity, second hash, id.
    """
    own = items.select("id", "sha256", "phash", "dhash", "ahash").filter("phash is not null")
    value = lambda df: df.select("id", hashing.hash_from_hex(F.col("phash")).alias("value")).filter("value is not null")
    # ids are texts: numbers stand for them in the search
    numbered = durable(own.select("id").unionByName(index.select("id")).distinct().select("id", F.monotonically_increasing_id().alias("n")))
    number = lambda df: value(df).join(numbered, "id").select(F.col("n").alias("id"), "value")
    # only a second hash can bring in what is further off by the first
    reach = most if own.filter("dhash is not null or ahash is not null").isEmpty() else None
    near = neighbours.hamming_top_k(number(index), number(own), POOL, most=reach).select("query", "candidate")
    query, candidate = numbered.toDF("query_id", "query"), numbered.toDF("candidate_id", "candidate")
    pool = near.join(query, "query").join(candidate, "candidate").select("query_id", "candidate_id")
    # of very many copies only the smallest ids can rank, as all of them tie
    few = index.select("id", "sha256").withColumn("_n", F.row_number().over(Window.partitionBy("sha256").orderBy("id"))).filter(F.col("_n") <= top_k + 1)
    copies = few.groupBy("sha256").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    equal = skew.salted_join(own.select(F.col("id").alias("query_id"), "sha256"), copies, ["sha256"], F.col("query_id"))
    same = equal.select("query_id", F.explode(F.slice(F.filter("ids", lambda x: x != F.col("query_id")), 1, top_k)).alias("candidate_id"))
    sides = [x.select("id", "sha256", "phash", "dhash", "ahash").toDF(f"{s}_id", f"{s}_sha", f"{s}_p", f"{s}_d", f"{s}_a") for x, s in ((own, "query"), (index, "candidate"))]
    both = pool.union(same).distinct().join(sides[0], "query_id").join(sides[1], "candidate_id")
    far = lambda c: hashing.hamming(hashing.hash_from_hex(F.col(f"query_{c}")), hashing.hash_from_hex(F.col(f"candidate_{c}")))
    judged = both.select("query_id", "candidate_id", (F.col("query_sha") == F.col("candidate_sha")).alias("same_bytes"), far("p").alias("phash_distance"), far("d").alias("dhash_distance"), far("a").alias("ahash_distance"))
    judged = judged.withColumn("distance", hashing.effective_distance(F.col("same_bytes"), F.col("phash_distance"), F.col("dhash_distance"), F.col("ahash_distance"), most)).filter("distance is not null")
    order = Window.partitionBy("query_id").orderBy(F.col("same_bytes").desc(), "distance", F.coalesce("dhash_distance", F.lit(999)), "candidate_id")
    ranked = judged.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k)
    basis = hashing.match_basis(F.col("same_bytes"), F.col("distance"), F.col("phash_distance"), F.col("dhash_distance"), F.col("ahash_distance"), F.lit(None).cast("double"))
    return ranked.withColumn("similarity", hashing.similarity(F.col("distance"))).withColumn("confidence_band", hashing.band(F.col("distance"))).withColumn("method", basis)


def signals_of(items: DataFrame, results: DataFrame, matches: DataFrame) -> DataFrame:
    """Signal table of items from their newest results and their ranked matches."""
    newest = results.groupBy("evidence_id").pivot("kind", list(PAYLOADS)).agg(F.first(F.struct("status", "score", "payload")))
    best = matches.groupBy(F.col("query_id").alias("evidence_id")).agg(F.count(F.lit(1)).alias("n_candidates"), F.bool_or("same_bytes").alias("same_bytes"), F.min("distance").alias("near"))
    base = items.select(F.col("id").alias("evidence_id"), "media_type", F.col("phash").isNotNull().alias("hashed")).join(newest, "evidence_id", "left").join(best, "evidence_id", "left")
    # parsed once an item, in a step of its own: the fields are named in many places below
    base = base.select("*", *[F.from_json(F.col(f"{kind}.payload"), ddl).alias(f"_{kind}") for kind, ddl in PAYLOADS.items()])
    payload = {kind: F.col(f"_{kind}") for kind in PAYLOADS}
    meta, origin = payload[METADATA], payload[PROVENANCE]
    ai = fusion.ai_detection({"score": F.col("detector.score"), "status": F.col("detector.status"), "abstained": payload[DETECTOR]["abstained"]})
    near = fusion.perceptual(F.when(F.col("hashed"), F.coalesce("n_candidates", F.lit(0))), F.coalesce("same_bytes", F.lit(False)), F.col("near"))
    tags = fusion.metadata(meta["status"], meta["generative"].isNotNull(), meta["editor"].isNotNull(), meta["modified_after"], meta["camera"], meta["captured"])
    signed = fusion.provenance(F.when(F.col("provenance.status") == "ERROR", "ERROR").otherwise(origin["state"]), origin["declares_generative"])
    packed = fusion.forensics(F.col("forensics.status"), F.col("forensics.score"))
    none = F.lit(None).cast("string")
    table = {"ai_detection": (*ai, F.lit("DECISIVE"), none), "perceptual_duplication": (*near, F.lit("DESCRIPTIVE"), none), "metadata_integrity": (*tags, F.lit("DESCRIPTIVE"), none), "provenance_c2pa": signed, "compression_forensics": (*packed, F.lit("DESCRIPTIVE"), none)}
    each = [F.struct(F.lit(k).alias("signal_id"), v[0].cast("double").alias("score"), v[1].alias("status"), v[2].alias("role"), v[3].cast("string").alias("execution_status")) for k, v in table.items()]
    return fusion.build_signals(items.select(F.col("id").alias("evidence_id"), "media_type"), base.select("evidence_id", F.explode(F.array(*each)).alias("s")).select("evidence_id", "s.*"))


def fusion_stage(items: DataFrame, results: DataFrame, matches: DataFrame) -> DataFrame:
    found = fusion.rationale(fusion.assess(signals_of(items, results, matches)))
    payload = F.struct("state", "verdict", "confidence", "coverage", "signal_coverage", "reasons", "execution_status", "signals_available", "signals_total", "rationale")
    return found.select("evidence_id", F.lit(FUSION).alias("kind"), F.col("execution_status").alias("status"), "score", F.to_json(payload).alias("payload"), "verdict")


def stored_results(results: DataFrame) -> DataFrame:
    """The newest result of every item and kind."""
    return latest.latest_per_key(results, ["evidence_id", "kind"], ["created_at", "id"])


def analyse(store: Store, cases: DataFrame, stored_files: DataFrame, decoded: DataFrame, run: str, actor: str, now: datetime.datetime, detections: DataFrame | None = None, refresh: bool = False, top_k: int = 10) -> int:
    """Analyses all items of ``cases`` (case_id) and commits results, matches and audit rows as ``run``; its number.

    ``stored_files`` has path and content, ``decoded`` origin and image (media.pixels.images).  Items whose bytes have changed
    since they were taken in are refused, which the log tells; those whose file is gone are analysed as far as that goes.
    The search covers all evidence with a hash.  Stages that have a stored result are read back unless ``refresh``.
    """
    evidence = store.read("evidence", schema.EVIDENCE)
    held = store.read("analysis_results", schema.ANALYSIS)
    own = durable(gate(evidence.join(cases.select("case_id").distinct(), "case_id", "left_semi"), facts(stored_files)))
    fit, refused = own.filter("gate <> 'CHANGED'"), own.filter("gate = 'CHANGED'")
    before = durable(stored_results(held.join(fit.select(F.col("id").alias("evidence_id")), "evidence_id", "left_semi")))

    def todo(kind: str) -> DataFrame:
        done = before.filter(F.col("kind") == kind).select(F.col("evidence_id").alias("id"))
        return fit if refresh else fit.join(done, "id", "left_anti")

    stages = [metadata_stage(todo(METADATA)), detector_stage(todo(DETECTOR), detections), provenance_stage(todo(PROVENANCE)), forensics_stage(todo(FORENSICS), decoded)]
    fresh = stages[0]
    for stage in stages[1:]:
        fresh = fresh.unionByName(stage)
    fresh = durable(fresh)
    matches = durable(search(fit, evidence.filter("phash is not null"), top_k))
    kept = before.filter(F.col("kind") != FUSION).select(*RESULT).join(fresh.select("evidence_id", "kind"), ["evidence_id", "kind"], "left_anti")
    verdicts = durable(fusion_stage(todo(FUSION), fresh.unionByName(kept), matches))
    case_of = own.select(F.col("id").alias("evidence_id"), "case_id")
    all_new = fresh.withColumn("verdict", F.lit(None).cast("string")).unionByName(verdicts)
    rows = all_new.join(case_of, "evidence_id").withColumn("id", F.concat_ws(":", F.lit(run), "evidence_id", "kind")).withColumn("created_at", F.lit(now).cast("timestamp"))
    results = schema.migrated(rows, schema.ANALYSIS).select(*[c.split()[0] for c in schema.ANALYSIS.split(", ")])
    said = rows.select("case_id", F.col("evidence_id").alias("path"), F.col("kind").alias("k"), "status", "score", "verdict")
    steps = [(EVENTS[kind], F.col("k") == kind, ["path", "status", "score", "verdict"]) for kind in KINDS]
    told = intake.events(said, steps, actor, now)
    no = refused.select("case_id", F.col("id").alias("path"), F.col("sha256").alias("recorded_sha256"), F.col("recomputed").alias("recomputed_sha256"))
    told = told.unionByName(intake.events(no, [("ANALYSIS_REFUSED", F.lit(True), ["path", "recorded_sha256", "recomputed_sha256"])], actor, now))
    # the completion of a case comes last: its path sorts after all ids
    whole = own.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_items"), F.count_if(F.col("gate") == "CHANGED").alias("n_refused")).withColumn("path", F.lit("\U0010ffff"))
    told = told.unionByName(intake.events(whole, [("ANALYSIS_COMPLETED", F.lit(True), ["n_items", "n_refused"])], actor, now))
    log = intake.linked(told, store.read("audit_log", schema.AUDIT))
    found = matches.join(fit.select(F.col("id").alias("query_id"), "case_id"), "query_id").select(F.concat_ws(":", F.lit(run), "query_id", "candidate_id").alias("id"), "case_id", F.col("query_id").alias("query_evidence_id"), F.col("candidate_id").alias("candidate_evidence_id"), "phash_distance", "dhash_distance", "distance", "similarity", "confidence_band", "rank", "method", F.lit(now).cast("timestamp").alias("created_at"))
    return store.commit(run, {"analysis_results": results, "matches": found, "audit_log": log})


def examined(items: DataFrame, decoded: DataFrame, detections: DataFrame | None = None) -> DataFrame:
    """Stage results and assessment of files that are no evidence, without storing anything: evidence_id, kind, status, score, payload, verdict.

    ``items`` has id, stored_path, media_type, content and phash; there is no search, so no candidates either.
    """
    read = facts(items.filter("content is not null").select(F.col("stored_path").alias("path"), "content"))
    held = durable(gate(items.withColumn("sha256", F.sha2("content", 256)).drop("content"), read))
    rows = metadata_stage(held).unionByName(detector_stage(held, detections)).unionByName(provenance_stage(held)).unionByName(forensics_stage(held, decoded))
    rows = durable(rows)
    none = items.sparkSession.createDataFrame([], "query_id string, same_bytes boolean, distance int")
    return rows.withColumn("verdict", F.lit(None).cast("string")).unionByName(fusion_stage(held.select("id", "media_type", F.lit(None).cast("string").alias("phash")), rows, none))


def verdicts(store: Store, case_id: str) -> DataFrame:
    """evidence_id, verdict, score, pending, leading of a case: stored verdicts only, the item with the highest score leads."""
    evidence = store.read("evidence", schema.EVIDENCE).filter(F.col("case_id") == case_id).select(F.col("id").alias("evidence_id"), "ingested_at")
    found = stored_results(store.read("analysis_results", schema.ANALYSIS)).filter(F.col("kind") == FUSION).select("evidence_id", "verdict", "score")
    both = evidence.join(found, "evidence_id", "left")
    first = both.agg(F.max_by("evidence_id", F.struct(F.col("score").isNotNull(), "score", (-F.unix_micros("ingested_at")).alias("t"), "evidence_id")).alias("_lead"), F.count("verdict").alias("_n"))
    return both.join(F.broadcast(first)).select("evidence_id", "verdict", "score", F.col("verdict").isNull().alias("pending"), ((F.col("_n") > 0) & (F.col("evidence_id") == F.col("_lead"))).alias("leading"))


def matches_of(store: Store, case_id: str) -> DataFrame:
    """The newest stored candidates of every item of a case, with their rank and basis."""
    rows = store.read("matches", schema.MATCHES).filter(F.col("case_id") == case_id)
    newest = rows.groupBy("query_evidence_id").agg(F.max("created_at").alias("created_at"))
    return rows.join(newest, ["query_evidence_id", "created_at"]).select("query_evidence_id", "candidate_evidence_id", "distance", "similarity", "confidence_band", "rank", "method")


def spread(store: Store, case_id: str) -> DataFrame:
    """The reconstruction of a case from its stored matches: one row, with the earliest known instance."""
    evidence = store.read("evidence", schema.EVIDENCE)
    nodes = lineage.timestamps(evidence).select("id", "parent_id", "source_id", "generation", "platform", "timestamp")
    case = evidence.filter(F.col("case_id") == case_id).select("id", F.col("phash").isNotNull().alias("hashed"))
    found = matches_of(store, case_id).select(F.col("query_evidence_id").alias("query"), F.col("candidate_evidence_id").alias("candidate"), "distance")
    return lineage.reconstruct(case, found, nodes)
