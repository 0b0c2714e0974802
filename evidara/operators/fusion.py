"""Signals of an item fused into one assessment, NULL-aware throughout.

A signal table has one row an item and signal: evidence_id, media_type, signal_id, score, status, role,
execution_status (may be NULL).  Scores that are missing or no numbers in 0..1 are left out, never taken for zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidara.functions.scores import usable

#: Declared weights and thresholds.  Fixed values.
WEIGHTS = {"ai_detection": 0.35, "perceptual_duplication": 0.20, "metadata_integrity": 0.20, "provenance_c2pa": 0.15, "compression_forensics": 0.10}
MANIPULATED, AUTHENTIC, COVERAGE = 0.65, 0.35, 0.30
ELIGIBLE = ("ai_detection", "provenance_c2pa")
#: Signals that apply to a media type; an unknown type counts as image.
APPLICABLE = {
    "image": tuple(WEIGHTS),
    "video": ("ai_detection", "metadata_integrity", "provenance_c2pa"),
    "audio": ("ai_detection",),
}
STATUS_TO_CHECK = {"OK": "COMPLETED", "INCONCLUSIVE": "ABSTAINED", "UNAVAILABLE": "UNAVAILABLE", "ERROR": "FAILED", "UNSUPPORTED_MEDIA": "NOT_APPLICABLE"}
VERDICTS = {"INDICATORS_DETECTED": "MANIPULATED", "NO_INDICATORS_DETECTED": "AUTHENTIC"}


def _looked_up(column: Column, pairs: dict, default) -> Column:
    table = F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
    return F.coalesce(F.try_element_at(table, column), F.lit(default))


def weight_of(signal: Column) -> Column:
    return _looked_up(signal, WEIGHTS, 0.0)


def applicable(spark: SparkSession) -> DataFrame:
    """media_type, signal_id, weight."""
    rows = [(m, s, WEIGHTS[s]) for m, signals in APPLICABLE.items() for s in signals]
    return spark.createDataFrame(rows, "media_type string, signal_id string, weight double")


def build_signals(items: DataFrame, payloads: DataFrame) -> DataFrame:
    """Every applicable signal of every item; one without a payload is there as UNAVAILABLE."""
    kind = F.when(F.col("media_type").isin(*APPLICABLE), F.col("media_type")).otherwise("image")
    wanted = items.select("evidence_id", "media_type", kind.alias("_kind")).join(F.broadcast(applicable(items.sparkSession).withColumnRenamed("media_type", "_kind")), "_kind").drop("_kind")
    out = wanted.join(payloads.drop("media_type", "weight"), ["evidence_id", "signal_id"], "left")
    return out.withColumn("status", F.coalesce("status", F.lit("UNAVAILABLE"))).withColumn("role", F.coalesce("role", F.when(F.col("signal_id") == "ai_detection", "DECISIVE").otherwise("DESCRIPTIVE")))


def direction(score: Column) -> Column:
    return F.when(score >= MANIPULATED, "INDICATORS_DETECTED").when(score <= AUTHENTIC, "NO_INDICATORS_DETECTED").otherwise("INCONCLUSIVE")


def ai_detection(payload: dict[str, Column]) -> tuple[Column, Column]:
    """(score, status) from a detector's score, status and abstained columns; no status: it never ran."""
    score = usable(payload["score"])
    ran = (payload["status"] == "OK") & ~F.coalesce(payload["abstained"], F.lit(False))
    status = F.when(payload["status"].isNull(), "UNAVAILABLE").when(ran & score.isNotNull(), "OK").when(ran, "ERROR").when(F.coalesce(payload["abstained"], F.lit(False)), "INCONCLUSIVE").when(payload["status"] == "UNSUPPORTED_MEDIA", "UNSUPPORTED_MEDIA").when(payload["status"] == "DISABLED", "UNAVAILABLE").otherwise("ERROR")
    return F.when(status == "OK", score), status


#: The scores of the three descriptive signals below.  Fixed values.
def perceptual(n_candidates: Column, same_bytes: Column, distance: Column) -> tuple[Column, Column]:
    score = F.when(same_bytes, 0.15).when(n_candidates > 0, F.least(0.15 + 0.04 * distance, F.lit(0.60)))
    return score, F.when(n_candidates.isNull(), "UNAVAILABLE").when(score.isNotNull(), "OK").otherwise("INCONCLUSIVE")


def metadata(status: Column, generative: Column, editor: Column, modified_after: Column, camera: Column, captured: Column) -> tuple[Column, Column]:
    """The strongest indicator, else camera and capture time together; absence is never scored."""
    yes = lambda c, v: F.when(F.coalesce(c, F.lit(False)), v)
    score = F.coalesce(F.greatest(yes(generative, 0.85), yes(editor, 0.55), yes(modified_after, 0.60)), yes(camera & captured, 0.25))
    bad = ~F.coalesce(status, F.lit("")).isin("OK", "")
    return F.when(~bad, score), F.when(status.isNull(), "UNAVAILABLE").when(bad, "ERROR").when(score.isNotNull(), "OK").otherwise("INCONCLUSIVE")


def provenance(state: Column, generative: Column) -> tuple[Column, Column, Column, Column]:
    """(score, status, role, execution status) of a signed manifest's state."""
    gen = F.coalesce(generative, F.lit(False))
    score = F.when((state == "VERIFIED") & gen, 0.85).when(state == "VERIFIED", 0.15).when(state == "INVALID", 0.70).when((state == "UNVERIFIED") & gen, 0.60)
    status = F.when(score.isNotNull(), "OK").when(state == "ERROR", "ERROR").when(state.isin("UNVERIFIED", "ABSENT"), "INCONCLUSIVE").otherwise("UNAVAILABLE")
    return score, status, F.when(state == "VERIFIED", "DECISIVE").otherwise("DESCRIPTIVE"), F.when(status == "INCONCLUSIVE", "UNAVAILABLE")


#: How a measurement's status reads as a signal's.  Fixed values.
FORENSIC_STATUS = {"UNSUPPORTED_MEDIA": "UNSUPPORTED_MEDIA", "INSUFFICIENT_DATA": "INCONCLUSIVE", "ERROR": "ERROR"}


def forensics(status: Column, score: Column) -> tuple[Column, Column]:
    """(score, status) of a compression measurement; no status: it never ran, one that isn't known or has no score: ERROR."""
    good = (status == "OK") & usable(score).isNotNull()
    return F.when(good, usable(score)), F.when(status.isNull(), "UNAVAILABLE").when(good, "OK").otherwise(_looked_up(status, FORENSIC_STATUS, "ERROR"))


def marked(signals: DataFrame) -> DataFrame:
    """Adds usable, weight, check_status, measured, eligible, contributing and check_state."""
    decided = F.coalesce("execution_status", _looked_up(F.col("status"), STATUS_TO_CHECK, "UNAVAILABLE"))
    return (
        signals.withColumn("usable", usable(F.col("score")))
        .withColumn("weight", weight_of(F.col("signal_id")))
        .withColumn("check_status", decided)
        .withColumn("measured", (F.col("status") == "OK") & F.col("usable").isNotNull() & (F.col("weight") > 0))
        .withColumn("eligible", F.col("signal_id").isin(*ELIGIBLE))
        .withColumn("contributing", F.col("eligible") & (F.col("role") == "DECISIVE") & (F.col("check_status") == "COMPLETED") & F.col("usable").isNotNull() & (F.col("weight") > 0))
        .withColumn("check_state", F.when(F.col("contributing"), direction(F.col("usable"))))
    )


def assess(signals: DataFrame) -> DataFrame:
    """One row an item: coverage, state, first reason, published score, verdict, execution status, confidence, counts."""
    m = marked(signals)
    when = lambda c, v=F.lit(1): F.when(c, v)
    lost = F.col("eligible") & ~F.col("contributing") & ~((F.col("role") != "DECISIVE") & (F.col("check_status") == "COMPLETED"))
    sums = m.groupBy("evidence_id").agg(
        F.coalesce(F.sum(when(F.col("eligible"), F.col("weight"))), F.lit(0.0)).alias("eligible_weight"),
        F.coalesce(F.sum(when(F.col("contributing"), F.col("weight"))), F.lit(0.0)).alias("contributed_weight"),
        F.sum(when(F.col("contributing"), F.col("weight") * F.col("usable"))).alias("weighted"),
        F.sum("weight").alias("declared_weight"),
        F.coalesce(F.sum(when(F.col("measured"), F.col("weight"))), F.lit(0.0)).alias("measured_weight"),
        F.count_if("contributing").alias("signals_available"),
        F.count_if("measured").alias("signals_measured"),
        F.count_if(F.col("status") != "UNAVAILABLE").alias("signals_evaluated"),
        F.count(F.lit(1)).alias("signals_total"),
        F.count_if(F.col("check_state") == "INDICATORS_DETECTED").alias("up"),
        F.count_if(F.col("check_state") == "NO_INDICATORS_DETECTED").alias("down"),
        F.count_if(lost & (F.col("check_status") == "ABSTAINED")).alias("abstained"),
        F.count_if(lost & (F.col("check_status") == "FAILED")).alias("failed_eligible"),
        F.count_if(lost & ~F.col("check_status").isin("ABSTAINED", "FAILED", "NOT_APPLICABLE")).alias("missing"),
        F.count_if(F.col("check_status") == "FAILED").alias("failed"),
    )
    c = F.col
    coverage = F.when(c("eligible_weight") > 0, F.round(c("contributed_weight") / c("eligible_weight"), 6)).otherwise(0.0)
    none, low = c("signals_available") == 0, c("coverage") < COVERAGE
    state = (
        F.when(none, F.when(c("abstained") > 0, "INCONCLUSIVE").otherwise("NOT_ASSESSED"))
        .when(low, "NOT_ASSESSED")
        .when((c("up") > 0) & (c("down") > 0), "INCONCLUSIVE")
        .when(c("up") > 0, "INDICATORS_DETECTED")
        .when(c("down") > 0, "NO_INDICATORS_DETECTED")
        .otherwise("INCONCLUSIVE")
    )
    lack = F.array_compact(F.array(when(c("abstained") > 0, F.lit("DETECTOR_ABSTAINED")), when(c("failed_eligible") > 0, F.lit("PROCESSING_FAILURE")), when(c("missing") > 0, F.lit("DETECTOR_UNAVAILABLE"))))
    short = F.array(F.lit("INSUFFICIENT_ELIGIBLE_EVIDENCE"))
    lead = F.when((c("up") > 0) & (c("down") > 0), "CONFLICTING_RESULTS").when(c("up") > 0, "ABOVE_THRESHOLD").when(c("down") > 0, "BELOW_THRESHOLD").otherwise("INTERMEDIATE_SCORE")
    reasons = F.when(none & (c("abstained") > 0), lack).when(none | low, F.concat(lack, short)).otherwise(F.concat(F.array(lead), lack))
    score = F.when(~none & ~low, c("weighted") / c("contributed_weight"))
    margin = F.least(F.abs(c("score") - MANIPULATED), F.abs(c("score") - AUTHENTIC))
    conclusive = c("state").isin(*VERDICTS) & c("score").isNotNull()
    return (
        sums.withColumn("coverage", coverage)
        .withColumn("signal_coverage", F.when(c("declared_weight") > 0, F.round(c("measured_weight") / c("declared_weight"), 6)).otherwise(0.0))
        .withColumn("state", state)
        .withColumn("reasons", F.array_join(reasons, ","))
        .withColumn("score", score)
        .withColumn("verdict", _looked_up(c("state"), VERDICTS, "INSUFFICIENT_EVIDENCE"))
        .withColumn("execution_status", F.when(c("failed") == 0, "COMPLETED").when(c("failed") == c("signals_total"), "FAILED").otherwise("PARTIAL"))
        .withColumn("confidence", F.when(conclusive, F.when((c("coverage") >= 0.70) & (margin >= 0.15), "moderate").otherwise("low")).otherwise("none"))
        .select("evidence_id", "coverage", "signal_coverage", "state", "reasons", "score", "verdict", "execution_status", "confidence", "signals_total", "signals_available", "signals_measured", "signals_evaluated")
    )


def contributions(signals: DataFrame) -> DataFrame:
    """Each signal's share of the published score; 0 and NULL where it took no part."""
    m = marked(signals)
    total = m.filter("contributing").groupBy("evidence_id").agg(F.sum("weight").alias("_total"))
    share = F.when(F.col("contributing"), F.round(F.col("weight") / F.col("_total"), 6)).otherwise(0.0)
    out = m.join(total, "evidence_id", "left").withColumn("effective_weight", share)
    return out.withColumn("contribution", F.when(F.col("contributing"), F.round(F.col("usable") * F.col("effective_weight"), 6))).select("evidence_id", "signal_id", "weight", "measured", F.col("contributing").alias("included"), "effective_weight", "contribution")


def leading_contributor(shares: DataFrame) -> DataFrame:
    """The signal with the largest contribution of each item (first by name of equals)."""
    return shares.filter("included").groupBy("evidence_id").agg(F.min(F.struct((-F.col("contribution")).alias("minus"), "signal_id")).alias("m")).select("evidence_id", F.col("m.signal_id").alias("signal_id"), (-F.col("m.minus")).alias("contribution"))


def rationale(assessed: DataFrame) -> DataFrame:
    """A sentence rendered from the state."""
    shown = F.coalesce(F.format_number("score", 4), F.lit("none"))
    text = F.concat(F.lit("State "), "state", F.lit(" from "), F.col("signals_available").cast("string"), F.lit(" contributing checks; eligible coverage "), F.format_number("coverage", 2), F.lit("; score "), shown, F.lit("; reasons "), "reasons")
    return assessed.withColumn("rationale", text)
