"""Scores as text and the threshold of the equal error rate, as SQL has them."""

from pyspark.sql import functions as F

from evidara.functions import scores
from evidara.operators import evaluation


def test_scores_as_text_equal_sql(spark, duck):
    values = [0.0, 1.0, 0.5, 0.001, 0.000143794, 0.0001, 0.000999999, 0.00009, 0.000012345, 1e-05, 1e-09, 1.2e-07, -0.0005, 0.123456789, -1e-06, 12.25]
    got = [r.t for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", scores.plain_text(F.col("v")).alias("t")).orderBy("i").collect()]
    assert got == [duck.sql(f"SELECT CAST({v!r}::DOUBLE AS VARCHAR)").fetchall()[0][0] for v in values]
    assert spark.range(1).select(scores.plain_text(F.lit(None).cast("double")).alias("t")).first().t is None


def test_of_nearly_equal_gaps_the_lower_threshold_decides(spark):
    """The gap from threshold 101 on is smaller by 6e-8 than that from 1 on; a step counts 1e-9."""
    counts = [(0, 0, 2001), (199, 0, 2000), (0, 1, 1600), (100, 1, 799), (199, 1, 1601)]
    df = spark.createDataFrame(counts, "slot int, label int, k int").select(((F.col("slot") + 0.5) / 199).alias("score"), "label", F.explode(F.sequence(F.lit(1), F.col("k"))))
    far, frr = 2000 / 4001, 1600 / 4000
    assert abs(2399 / 4000 - far) < far - frr
    got = evaluation.eer(df).first()
    assert got.eer == (far + frr) / 2 and got.eer_gap == abs(2399 / 4000 - far)
