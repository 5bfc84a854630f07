"""Records of line-based files whose first line tells their length, found by many tasks a file.

A file is read in blocks as Spark splits it.  Every line that could open a record points to the line behind that record, so
records are the chain of pointers from line 1.  Chains are followed inside segments of lines first; what is left, a pointer
from the entry of one segment to the entry of the next, is followed by pointer doubling over joins.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import stored

SEGMENT = 65_536  # lines


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, text): every line, numbered from 1 in its file.

    The lines are stored once: blocks and positions in them are then fixed, however the files would be split next time.
    """
    text = spark.read.option("lineSep", "\n").text(path)
    raw = stored(text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", r"\r\z", "").alias("text")), "lines")
    block = raw.groupBy("path", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    block = block.select("path", "block", "first", F.coalesce(before, F.lit(0)).alias("before"))
    return raw.join(block, ["path", "block"]).select("path", (F.col("at") - F.col("first") + F.col("before") + 1).alias("line"), "text")


def _links(line: np.ndarray, to: np.ndarray) -> np.ndarray:
    """The place of each pointer's target among the (sorted) lines, its own place where the target is not among them."""
    at = np.minimum(np.searchsorted(line, to), len(line) - 1)
    return np.where(line[at] == to, at, np.arange(len(line)))


def _leave(part: pd.DataFrame) -> pd.DataFrame:
    """Where the chain from each line of a segment leaves it, and how many records it passes."""
    part = part.sort_values("line")
    to, opens = part["to"].to_numpy(), part["opens"].to_numpy().astype(np.int64)
    after = _links(part["line"].to_numpy(), to)
    passed = np.where(after != np.arange(len(after)), opens, 0)
    while (after[after] != after).any():
        passed, after = passed + passed[after], after[after]
    return part.assign(leaves=to[after], passed=passed + opens[after])


def _follow(part: pd.DataFrame) -> pd.DataFrame:
    """The records on the chain from a segment's entry, numbered."""
    part = part.sort_values("line")
    line, opens, to = part["line"].to_numpy(), part["opens"].to_numpy(), part["to"].to_numpy()
    after = _links(line, to)
    at, seen = int(np.searchsorted(line, part["entry"].iloc[0])), []
    while True:
        if opens[at]:
            seen.append(at)
        if after[at] == at:
            break
        at = after[at]
    return pd.DataFrame({"path": part["path"].iloc[0], "record": part["rank"].iloc[0] + np.arange(len(seen)), "line": line[seen], "to": to[seen]})


def records(nodes: DataFrame, segment: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """Records and ends of the chains from line 1 over nodes (path, line, to, opens); to > line, opens is false for lines skipped.

    Records: (path, record, line, to), numbered from 0.  Ends: (path, stop, records), the first line that is no node; files
    whose line 1 is none are missing there.  A task holds the nodes of one segment.
    """
    keyed = nodes.select("path", F.expr(f"line div {segment}").alias("segment"), "line", "to", "opens")
    out = stored(keyed.groupBy("path", "segment").applyInPandas(_leave, "path string, segment long, line long, to long, opens boolean, leaves long, passed long"), "chain")
    entry = out.select("path", F.col("leaves").alias("line")).distinct()
    entry = out.join(entry, ["path", "line"], "semi").select("path", "line", "leaves", "passed").unionByName(out.where("line = 1").select("path", "line", "leaves", "passed"))
    entry = stored(entry, "entries")
    jump = entry.join(entry.select("path", F.col("line").alias("leaves"), F.lit(True).alias("known")), ["path", "leaves"], "left")
    jump = jump.select("path", "line", F.when(F.col("known"), F.col("leaves")).alias("to"), F.col("passed").alias("hops")).where("to is not null")
    reached = entry.where("line = 1").select("path", "line", F.lit(0).cast("long").alias("rank"))
    while True:
        jump = stored(jump, "jumps")
        new = stored(reached.join(jump, ["path", "line"]).select("path", F.col("to").alias("line"), (F.col("rank") + F.col("hops")).alias("rank")), "reached")
        if new.isEmpty():
            break
        reached = reached.unionByName(new)
        far = jump.select("path", F.col("line").alias("to"), F.col("to").alias("end"), F.col("hops").alias("more"))
        jump = jump.join(far, ["path", "to"]).select("path", "line", F.col("end").alias("to"), (F.col("hops") + F.col("more")).alias("hops"))
    reached = stored(reached, "reached")
    ends = reached.join(entry, ["path", "line"]).groupBy("path").agg(F.max(F.struct("line", F.col("leaves").alias("stop"), (F.col("rank") + F.col("passed")).alias("records"))).alias("e")).select("path", "e.stop", "e.records")
    own = out.join(reached.select("path", F.expr(f"line div {segment}").alias("segment"), F.col("line").alias("entry"), "rank"), ["path", "segment"])
    found = own.groupBy("path", "segment").applyInPandas(_follow, "path string, record long, line long, to long")
    return stored(found, "records"), ends
