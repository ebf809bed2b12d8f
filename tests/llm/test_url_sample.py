"""A hot url does not fill the training sample."""

from pyspark.sql import functions as F

from casebook.llm import urls


def test_a_hot_url_counts_once_in_the_sample(spark):
    names = [f"http://h{i}.com/p" for i in range(40)]
    hashed = spark.createDataFrame([(n,) for n in names], "url string").orderBy(F.xxhash64("url"), "url")
    order = [r["url"] for r in hashed.collect()]
    rows = [(order[0], 1.0)] * 200 + [(u, float(i % 2)) for i, u in enumerate(order[1:], 1)]
    labelled = spark.createDataFrame(rows, "url string, label double").select(
        "url", "label", *[(F.col("label") if f == "depth" else F.lit(0.0)).alias(f) for f in urls.FEATURES])
    model = urls.train(labelled, max_training=20)
    assert not isinstance(model, float)  # both labels are in the sample
    found = urls.predict(labelled, model).select("label", "prediction").distinct().collect()
    assert all(r["label"] == r["prediction"] for r in found)
