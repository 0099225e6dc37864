import numpy as np
from pyspark.sql import functions as F

from lodestar.llm import quality


def test_forest_is_fitted_on_every_labelled_row(spark):
    """Of 7,000 labelled texts more than any earlier sample held decide: no row is left out of the counts or the cut."""
    n = 7000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), 12 + F.col("id") % 20), lambda i: F.concat(F.lit("w"), (i * 7 + F.col("id")).cast("string")))).alias("text"))
    docs = docs.withColumn("text", F.when(F.col("doc_id") % 50 == 0, F.concat("text", F.lit(" ### $$$ ||| %%% ||| ### ||| $$$ %%% |||"))).otherwise(F.col("text")))
    labels = docs.select("doc_id", (F.col("doc_id") % 50 > 0).cast("int").alias("quality"))
    forest = quality.fit_forest(docs, labels)
    rows = quality.score_documents(docs, forest).orderBy("doc_id").toPandas()
    own = rows[~rows["base_failed"]]
    x, good = quality.features({c: own[c].to_numpy() for c in quality.BASE + quality.MORE}), own["doc_id"].to_numpy() % 50 > 0
    whole = quality.calibrate(quality.grow(x[good]), x, good)
    assert np.array_equal(forest.feature, whole.feature) and np.allclose(forest.length, whole.length) and forest.cut == whole.cut
    assert int(quality.reached(quality.plan(6), x[good])[0, 0]) == good.sum() > 6000
    bad = rows["doc_id"] % 50 == 0
    assert not rows["kept"][bad].any() and rows["kept"][~bad].mean() > 0.97
