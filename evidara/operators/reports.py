"""Reports as rows: bounded tables, readiness, order of contributions, regions, files and the library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a report's table, regions of an image and the least activation of one.
TABLE_ROWS, REGIONS, ACTIVATION = 8, 5, 0.5


def first_rows(rows: DataFrame, case: str, section: str, order: list[Column], most: int = TABLE_ROWS) -> DataFrame:
    """The first rows of each section of each case with their position; the rest are cut before they are shuffled."""
    w = Window.partitionBy(case, section).orderBy(*order)
    return rows.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= most)


def readiness(cases: DataFrame, case: str, evidence: DataFrame, results: DataFrame) -> DataFrame:
    """ready, empty (nothing to report on) or refused: evidence exists but nothing of it was examined."""
    count = lambda rows, name: rows.groupBy(case).agg(F.count(F.lit(1)).alias(name))
    both = cases.join(count(evidence, "n_evidence"), case, "left").join(count(results, "n_examined"), case, "left").fillna(0, ["n_evidence", "n_examined"])
    return both.withColumn("status", F.when(F.col("n_evidence") == 0, "empty").when(F.col("n_examined") == 0, "refused").otherwise("ready"))


def count_reports(reports: DataFrame, case: str, only: object | None = None) -> DataFrame:
    """How many reports there are, of one case if it is given."""
    return (reports if only is None else reports.filter(F.col(case) == F.lit(only))).agg(F.count(F.lit(1)).alias("n_reports"))


def by_contribution(signals: DataFrame, case: str, contribution: str, tie: str) -> DataFrame:
    """Signals of each case, largest contribution first, missing ones last, as position."""
    return signals.withColumn("position", F.row_number().over(Window.partitionBy(case).orderBy(F.col(contribution).desc_nulls_last(), tie)))


def lanes(nodes: DataFrame, case: str, generation: str) -> DataFrame:
    """Distinct generations of each case in order; a case has few."""
    return nodes.groupBy(case).agg(F.sort_array(F.collect_set(generation)).alias("lanes"))


def regions(rows: DataFrame, key: str, activation: str, tie: str, above: float = ACTIVATION, most: int = REGIONS) -> DataFrame:
    """Regions of an image that are over the threshold, the strongest few."""
    return first_rows(rows.filter(F.col(activation) > above).withColumn("_", F.lit(0)), key, "_", [F.col(activation).desc(), F.col(tie)], most).drop("_")


def owned_files(files: DataFrame, path: str, root: str) -> DataFrame:
    """Distinct paths inside the root; a path that climbs out of it is not inside."""
    inside = F.col(path).startswith(root.rstrip("/") + "/") & ~F.col(path).rlike("(^|/)[.][.](/|$)")
    return files.filter(inside).select(path).distinct()


def library(reports: DataFrame, columns: list[str], term: str, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """Reports that contain the term in some column, newest first, with total and truncated."""
    from evidara.operators.listing import any_contains, counted_page

    return counted_page(reports.filter(any_contains(columns, term)), order, limit, offset)


def index_status(index: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """n_indexed, n_pending (evidence that is not there) and n_stale (entries without evidence)."""
    ids = lambda rows: rows.select(key).distinct()
    both = ids(index).withColumn("_i", F.lit(True)).join(ids(evidence).withColumn("_e", F.lit(True)), key, "full_outer")
    return both.agg(F.count_if(F.col("_i") & F.col("_e")).alias("n_indexed"), F.count_if(F.col("_i").isNull()).alias("n_pending"), F.count_if(F.col("_e").isNull()).alias("n_stale"))


def match_impact(matches: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Matches that go with the ids of ``gone``: own ones (its queries) and those that other cases own (its candidates)."""
    g = gone.select(F.col(key).alias("_k")).distinct()
    own = matches.join(g, matches["query"] == F.col("_k"), "left_semi").agg(F.count(F.lit(1)).alias("n_own"))
    foreign = matches.join(g, matches["query"] == F.col("_k"), "left_anti").join(g, F.col("candidate") == F.col("_k"), "left_semi").agg(F.count(F.lit(1)).alias("n_foreign"))
    return own.join(foreign)
