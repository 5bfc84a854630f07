"""XYZ texts in rows: what is read of many small texts goes out together, and plain numbers are written as they were."""

from __future__ import annotations

from pyspark.sql import functions as F

from moltable.sources import xyz


def test_small_texts_share_batches(spark):
    texts = [(f"t{i}", f"1\nn\nC {i} 0 0\n") for i in range(40)] + [("bad", "1\nn\nC 1_0 0 0\n"), ("none", None)]
    df = xyz.parse(spark.createDataFrame(texts, "path string, value string").coalesce(1))
    sizes = df.mapInArrow(lambda batches: (b.select(["site_id"]).slice(0, 1) for b in batches), "site_id long")
    assert sizes.count() == 1
    got = {r.path: (r.x, r.error_kind, r.error_column) for r in df.collect()}
    assert got == {f"t{i}": (float(i), None, None) for i in range(40)} | {"bad": (None, "Coordinate", 3)}


def test_numbers_in_plain_digits(spark):
    want = {0.5: "0.5", 12.0: "12", -0.0: "-0", 0.001: "0.001", -7.25: "-7.25", 1e7: "10000000", 1.5e-5: "0.000015", 123456789.25: "123456789.25", float("inf"): "Infinity", float("-inf"): "-Infinity", float("nan"): "NaN"}
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(want)], "i int, v double").select("i", xyz.number(F.col("v")).alias("t")).collect()
    assert [r.t for r in sorted(rows)] == list(want.values())
