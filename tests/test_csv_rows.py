"""The CSV round trip of csv_read keeps every row, also those that a line-wise reader would break."""

import os
import tempfile
from collections import Counter

import pytest

from casebook.plans.catalog_more import headlines_through_csv
from casebook.plans.standins import Archive

CELLS = [
    "plain", None, "", "\n", "two\nlines", "a\r\nb", "c\rd", "\n\n", 'said "so",\nthen left', " led by a space", "trailed by one ", ",", '"', "\\", '\\"\n,', "é\n日本",
]


def _path():
    return tempfile.mkdtemp(prefix="spark-") + "/csv"


def test_every_cell_comes_back(spark):
    rows = [(i, i % 3, cell) for i, cell in enumerate(CELLS)]
    lines = spark.createDataFrame(rows, "conv_id bigint, turn bigint, headline string").repartition(3)
    assert sorted(map(tuple, headlines_through_csv(lines, _path()).collect())) == [(i, t, cell or None) for i, t, cell in rows]


def test_every_headline_comes_back(spark):
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("test tables not present")
    lines = Archive(spark, "/root/testdata/sf0.001").headline.select("conv_id", "turn", "headline")
    want = Counter((c, t, h or None) for c, t, h in lines.collect())
    assert any("\n" in (h or "") for _, _, h in want)
    assert Counter(map(tuple, headlines_through_csv(lines, _path()).collect())) == want
