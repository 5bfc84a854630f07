"""Files read in blocks give the rows and errors of files read as a whole."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from moltable.sources import xyz

NAMED = {
    "empty": "",
    "blank": "\n  \n",
    "spaces": "  ",
    "bad count first": "x\n1\nc\nO 1 2 3\n",
    "range": "1\nc\nO 1 2 3\n4294967296\nc\n",
    "past range": "1\nc\nO 1 2 3\n\n18446744073709551616\nc\n",
    "no comment": "1\nc\nO 1 2 3\n0",
    "cut": "1\nc\nO 1 2 3\n3\nd\nH 1 2 3\nH 1 2 3\n",
    "cut behind an error": "3\nd\nH 1 2 3\nH 1 2 oops\n",
    "numbers as comments": "1\n7\nO 1 2 3\n+2\n1\nh 1 2 3\nHE 4. .5 -6e-1\n0\n3\n",
    "blank comments": "\n\n1\n\nO 1 2 3\r\n\n1\n\nO 1 2 3\n\n\n",
    "bad atoms": "1\nc\nO 1 2 3\n1\nc\n Xx 1 2 3\n1\nc\nO 1 2\n",
    "far away": "1\nc\nO 1 2 1e999\n",
    "odd but right": "1\nc\n O 1 2 3\n1\nc\nO +1 2e+2 3.\n",
    "endless": "4000000000\nc\nO 1 2 3\n",
    "one of many lines": "40\nlong\n" + "C 1 2 3\n" * 40 + "1\nlast\nN 1 2 3\n",
}


def texts() -> dict[str, str]:
    rng, out = random.Random(7), dict(NAMED)
    for i in range(4):
        t = ""
        for f in range(rng.randrange(10, 40)):
            n = rng.choice([0, 1, 2, 3, 9, 30])
            t += "\n" * rng.choice([0, 0, 1, 3]) + f"{n}\n" + rng.choice(["", "5", f"frame {f}", "2"]) + "\n"
            t += "".join(f"{rng.choice(['C', 'n', 'CL'])} {rng.random()} {rng.randrange(-9, 9)} {rng.random() * 1e-9}\n" for _ in range(n))
        if i % 2 == 0:
            rows = t.split("\n")
            rows[rng.randrange(len(rows))] = rng.choice(["O 1 2", "zz 1 2 3", "-4", "3"])
            t = "\n".join(rows)
        out[f"random {i}"] = t
    return out


@pytest.mark.parametrize(("segment", "first"), [(5, False), (65_536, True)])
def test_blocks_give_what_whole_files_give(spark, tmp_path, segment, first):
    for name, t in texts().items():
        (tmp_path / f"{name.replace(' ', '_')}.xyz").write_bytes(t.encode())
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1200")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = xyz.read(spark, str(tmp_path), first, segment).collect()
        many = spark.read.option("lineSep", "\n").text(str(tmp_path)).select("_metadata.file_path", "_metadata.file_block_start").distinct().count()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert many > len(texts()) + 4
    want = xyz.parse(spark.read.text(str(tmp_path), wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value"), first).collect()
    key = lambda r: tuple((v is not None, v) for v in r)
    assert sorted(map(key, got)) == sorted(map(key, want))
