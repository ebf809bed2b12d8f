"""Nearest pages are the same for any number of sort partitions."""

from casebook.llm import html


def _texts(spark, pages, parts):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return sorted((r["page_id"], r["text"]) for r in html.main_text(pages).collect())
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_texts_do_not_depend_on_partitions(spark):
    rows = [(i, f"http://h{i // 20}.org/{'ab'[i % 20 // 10]}/{i:03d}", f"<div>Site {i // 20}</div><p>Story {i}</p><p>Part {i // 3}</p><div>Copyright</div>") for i in range(60)]
    rows.append((99, "http://one.net/x", "<div>Alone</div>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    want = _texts(spark, pages, 1)
    assert len(want) == 61 and (0, "Story 0") in want and (99, "Alone") in want
    for parts in (7, 100):
        assert _texts(spark, pages, parts) == want
