import datetime

import pytest
from pyspark.sql import functions as F

from evidara.operators import chain, fusion, latest, lifecycle, lineage, listing, windows
from evidara.schema import SIGNALS, migrated

DAY = datetime.datetime(2026, 1, 2)


def assessed(spark, rows):
    df = spark.createDataFrame([("e", "image", *r) for r in rows], SIGNALS)
    return fusion.assess(df).first()


@pytest.mark.parametrize(
    "rows, state, reasons, score, verdict",
    [
        ([("ai_detection", 0.65, "OK", "DECISIVE", None)], "INDICATORS_DETECTED", "ABOVE_THRESHOLD", 0.65, "MANIPULATED"),
        ([("ai_detection", 0.35, "OK", "DECISIVE", None)], "NO_INDICATORS_DETECTED", "BELOW_THRESHOLD", 0.35, "AUTHENTIC"),
        ([("ai_detection", 0.5, "OK", "DECISIVE", None)], "INCONCLUSIVE", "INTERMEDIATE_SCORE", 0.5, "INSUFFICIENT_EVIDENCE"),
        ([("ai_detection", None, "INCONCLUSIVE", "DECISIVE", None)], "INCONCLUSIVE", "DETECTOR_ABSTAINED", None, "INSUFFICIENT_EVIDENCE"),
        ([("ai_detection", float("nan"), "OK", "DECISIVE", None)], "NOT_ASSESSED", "DETECTOR_UNAVAILABLE,INSUFFICIENT_ELIGIBLE_EVIDENCE", None, "INSUFFICIENT_EVIDENCE"),
        ([("metadata_integrity", 0.9, "OK", "DECISIVE", None)], "NOT_ASSESSED", "INSUFFICIENT_ELIGIBLE_EVIDENCE", None, "INSUFFICIENT_EVIDENCE"),
        ([("ai_detection", 0.9, "OK", "DECISIVE", None), ("provenance_c2pa", 0.15, "OK", "DECISIVE", None)], "INCONCLUSIVE", "CONFLICTING_RESULTS", 0.9 * 0.7 + 0.15 * 0.3, "INSUFFICIENT_EVIDENCE"),
        ([("ai_detection", None, "ERROR", "DECISIVE", None), ("provenance_c2pa", 0.15, "OK", "DECISIVE", None)], "NO_INDICATORS_DETECTED", "BELOW_THRESHOLD,PROCESSING_FAILURE", 0.15, "AUTHENTIC"),
        ([("ai_detection", 0.9, "OK", "DECISIVE", None), ("provenance_c2pa", 0.7, "OK", "DESCRIPTIVE", None)], "INDICATORS_DETECTED", "ABOVE_THRESHOLD", 0.9, "MANIPULATED"),
    ],
)
def test_decision_table(spark, rows, state, reasons, score, verdict):
    got = assessed(spark, rows)
    assert (got.state, got.reasons, got.verdict) == (state, reasons, verdict)
    assert got.score is None if score is None else abs(got.score - score) < 1e-9


def test_signal_builders(spark):
    rows = spark.createDataFrame([("VERIFIED", True), ("VERIFIED", False), ("INVALID", None), ("UNVERIFIED", True), ("ABSENT", None), (None, None)], "state string, gen boolean")
    s, st, role, run = fusion.provenance(F.col("state"), F.col("gen"))
    got = [tuple(r) for r in rows.select(s, st, role, run).collect()]
    assert got == [(0.85, "OK", "DECISIVE", None), (0.15, "OK", "DECISIVE", None), (0.7, "OK", "DESCRIPTIVE", None), (0.6, "OK", "DESCRIPTIVE", None), (None, "INCONCLUSIVE", "DESCRIPTIVE", "UNAVAILABLE"), (None, "UNAVAILABLE", "DESCRIPTIVE", None)]
    items = spark.createDataFrame([("a", "audio"), ("b", "weird")], "evidence_id string, media_type string")
    built = fusion.build_signals(items, spark.createDataFrame([], SIGNALS))
    assert {(r.evidence_id, r["count"]) for r in built.groupBy("evidence_id").count().collect()} == {("a", 1), ("b", 5)}
    assert built.filter("status <> 'UNAVAILABLE'").count() == 0


def test_chain_tampering_and_repair(spark, monkeypatch):
    monkeypatch.setattr(chain, "RANGE_ROWS", 7)  # several ranges
    raw = spark.createDataFrame([(i, f"event {i}") for i in range(1, 60) if i % 11], "seq long, content string")
    log = chain.relink(raw)
    assert chain.summary(chain.link_check(log), log).first().valid
    changed = log.withColumn("content", F.when(F.col("seq") == 20, "x").otherwise(F.col("content")))
    bad = chain.summary(chain.link_check(changed), changed).first()
    assert (bad.valid, bad.first_invalid, bad.n_invalid) == (False, 20, 1)
    gone = log.filter("seq <> 30")
    assert [r.seq for r in chain.link_check(gone).filter("not link_ok").collect()] == [31]
    assert chain.summary(chain.link_check(chain.relink(changed)), chain.relink(changed)).first().valid


def test_lineage_climb_ends_on_cycles(spark):
    nodes = spark.createDataFrame([(1, 3), (2, 1), (3, 2), (4, None), (5, 4)], "id long, parent_id long")
    got = {(r.id, r.ancestor) for r in lineage.climb(nodes, nodes.select("id")).collect()}
    assert got == {(i, j) for i in (1, 2, 3) for j in (1, 2, 3)} | {(4, 4), (5, 5), (5, 4)}
    assert [lineage.trace_status(*x) for x in ((0, 0), (2, 0), (2, 1))] == ["NO_EVIDENCE", "ISOLATED", "TRACED"]


def test_latest_orders_ties_by_id(spark):
    rows = spark.createDataFrame([("k", DAY, 1, "a"), ("k", DAY, 2, None), ("l", None, 3, "c")], "key string, at timestamp, id long, v string")
    got = {r.key: (r.id, r.v) for r in latest.latest_per_key(rows, ["key"], ["at", "id"]).collect()}
    assert got == {"k": (2, None), "l": (3, "c")}


def test_filters_are_strict():
    for limit, offset in ((0, 0), (501, 0), (10, -1), (10, 100_001)):
        with pytest.raises(ValueError):
            listing.check_page(limit, offset)
    with pytest.raises(ValueError):
        listing.moment("yesterday")
    assert listing.moment("2026-01-02T01:00:00+01:00") == DAY


def test_lifecycle(spark):
    stored = spark.createDataFrame([("c1", "aa", "p1", "1"), ("c1", "bb", "p2", "2")], "case_id string, sha256 string, path string, id string")
    files = spark.createDataFrame([("c1", "aa", "p1"), ("c1", "cc", "p3"), ("c1", "cc", "p4"), ("c2", "aa", "p5")], "case_id string, sha256 string, path string")
    assert sorted(r.path for r in lifecycle.fresh(files, stored, ["case_id"]).collect()) == ["p3", "p5"]
    assert sorted(r.path for r in lifecycle.fresh(files, stored, []).collect()) == ["p3"]
    good, refused = lifecycle.gated(lifecycle.rehashed(files, stored))
    assert ([r.id for r in good.collect()], [r.id for r in refused.collect()]) == (["1"], ["2"])
    new = lifecycle.updated(stored, spark.createDataFrame([("1", "zz", None)], "id string, sha256 string, path string"), "id")
    assert {r.id: (r.sha256, r.path, r.changed) for r in new.collect()} == {"1": ("zz", "p1", ["sha256"]), "2": ("bb", "p2", [])}
    left = lifecycle.deleted({"evidence": stored, "audit_log": stored}, stored.filter("id = '1'"), "id")
    assert (left["evidence"].count(), left["audit_log"].count()) == (1, 2)
    assert "status" in migrated(stored, "id string, status string", {"status": "open"}).columns


def test_windows(spark):
    row = spark.range(1).select(windows.even_frames(F.lit(100)).alias("long"), windows.even_frames(F.lit(3)).alias("short"), windows.fitted(F.array(F.lit(1), F.lit(2)), 5).alias("fit")).first()
    assert row.long[0] == 0 and row.long[-1] == 99 and len(row.long) == 16
    assert row.short == [0, 1] + [2] * 14 and row.fit == [1, 2, 1, 2, 1]


def test_chain_repair_relinks_from_the_first_break_and_refuses_changes(spark):
    from evidara.functions.files import row_hash

    rows = spark.createDataFrame([(c, 10 * c + i, f"row {i}") for c in range(4) for i in range(5)], "case long, seq long, content string")
    log = chain.relink(rows, chain="case")
    broken = log.withColumn("previous_hash", F.when(F.col("seq") == 12, "0").otherwise(F.col("previous_hash")))
    broken = broken.withColumn("row_hash", F.when(F.col("seq") == 12, row_hash(F.lit("0"), F.col("content"))).otherwise(F.col("row_hash")))
    broken = broken.withColumn("content", F.when(F.col("seq") == 23, "changed").otherwise(F.col("content")))
    same, found = chain.repair(broken, "case")
    assert same is broken and {(r.case, r.status, r.first_break, r.n_to_relink) for r in found.collect()} == {(0, "clean", None, 0), (1, "repairable", 12, 3), (2, "refused", None, 0), (3, "clean", None, 0)}
    after, _ = chain.repair(broken, "case", dry_run=False)
    checked = chain.link_check(after, chain="case").collect()
    assert all(r.link_ok and (r.content_ok or r.seq == 23) for r in checked) and len(checked) == 21
    kept = {r.seq: r.row_hash for r in after.collect()}
    assert all(kept[r.seq] == r.row_hash for r in broken.collect() if r.case != 1 or r.seq < 12)
    assert "CHAIN_REPAIRED" in after.filter("seq = 15").first().content


def test_long_chain_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(chain, "RANGE_ROWS", 7)
    log = chain.relink(spark.createDataFrame([(i * i, f"row {i}") for i in range(40)], "seq long, content string"))
    assert all(r.link_ok and r.content_ok for r in chain.link_check(log).collect())


def test_bands_refuse_settings_that_pair_everything(spark):
    from evidara.operators import neighbours

    h = spark.createDataFrame([(1, 5), (2, 5)], "id long, value long")
    with pytest.raises(ValueError):
        neighbours.hamming_within(h, h, 20, 10)


def test_top_k_over_a_grid_equals_brute_force(spark, monkeypatch):
    from evidara.operators import neighbours

    monkeypatch.setattr(neighbours, "TASK_PAIRS", 50)
    rows = [(i, i * 2654435761 % (1 << 40)) for i in range(40)] + [(99, None)]
    h = spark.createDataFrame(rows, "id long, value long")
    got = {(r.query, r.rank): (r.distance, r.candidate) for r in neighbours.hamming_top_k(h, h, 3).collect()}
    for i, v in rows[:-1]:
        want = sorted(((v ^ w).bit_count(), j) for j, w in rows[:-1] if j != i)[:3]
        assert [got[i, k + 1] for k in range(3)] == want
    assert neighbours.hamming_top_k(h.limit(0), h, 3).count() == 0


def test_owned_files_and_url_lists(spark):
    from evidara.operators import reports

    files = spark.createDataFrame([("/root/a",), ("/root/a",), ("/root/../b",), ("/rooted/c",), (None,)], "path string")
    assert [r.path for r in reports.owned_files(files, "path", "/root").collect()] == ["/root/a"]
