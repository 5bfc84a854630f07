"""Fixity audit of web archives by Merkle trees over records and their offset ranges.

Records are laid out in archive files of a fixed number of places, each with its
offset and length.  A leaf is the hash of a record with its offset range; a node
hashes its children's range and digests in order.  Two replicas compare the roots of
their files; only where digests differ the next level is looked at, down to the
records.  All of it is joins and grouped hashes of Spark SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

FANOUT = 16
LEVELS = 3  # places of a file: FANOUT ** LEVELS


def record_bytes(url, html):
    """A record: a short header and the payload; a null part is empty."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def leaves(pages: DataFrame) -> DataFrame:
    """(file, place, page_id, offset, length, digest) of each record.

    A file holds FANOUT ** LEVELS ids in a row, so no order over all pages is needed.  Repeated
    rows of an id are records behind each other; rows of a null id have no place and are left out.
    """
    size = FANOUT**LEVELS
    rec = pages.where("page_id is not null").select(F.col("page_id").cast("long").alias("page_id"), record_bytes(F.col("url"), F.col("html")).alias("rec"))
    rec = rec.select("page_id", F.octet_length("rec").cast("long").alias("length"), F.sha2("rec", 256).alias("digest"))
    order = Window.partitionBy("file").orderBy("page_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    rec = rec.select(F.floor(F.col("page_id") / size).cast("long").alias("file"), F.pmod("page_id", F.lit(size)).alias("place"), "page_id", "length", "digest")
    return rec.withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0)))


def tree(leaf: DataFrame, name: str) -> list[DataFrame]:
    """Levels from the root down: (file, node, first, last, digest), first and last the offset range."""
    places = leaf.groupBy("file", F.col("place").alias("node")).agg(
        F.min("offset").alias("first"), F.max(F.col("offset") + F.col("length")).alias("last"), F.sha2(F.concat_ws("|", F.sort_array(F.collect_list(F.concat_ws(":", F.lpad(F.col("offset").cast("string"), 16, "0"), F.col("length").cast("string"), "digest")))), 256).alias("digest")
    )
    out = [stored(places, f"{name}-leaves")]
    for _ in range(LEVELS):
        below = out[0]
        up = below.groupBy("file", F.floor(F.col("node") / FANOUT).cast("long").alias("up")).agg(
            F.min("first").alias("first"), F.max("last").alias("last"), F.sha2(F.concat_ws("|", F.transform(F.array_sort(F.collect_list(F.struct("node", "first", "last", "digest"))), lambda c: F.concat_ws(":", c["node"].cast("string"), c["first"].cast("string"), c["last"].cast("string"), c["digest"]))), 256).alias("digest")
        )
        out.insert(0, stored(up.withColumnRenamed("up", "node"), f"{name}-level"))
    return out


def differing(one: list[DataFrame], two: list[DataFrame], name: str) -> DataFrame:
    """(file, node) of the leaves that differ, found by descending mismatching branches only."""
    open_ = None
    for a, b in zip(one, two, strict=True):
        if open_ is not None:
            parent = F.floor(F.col("node") / FANOUT).cast("long")
            a, b = (x.withColumn("up", parent).join(open_, ["file", "up"], "left_semi").drop("up") for x in (a, b))
        both = a.select("file", "node", F.col("digest").alias("d1")).join(b.select("file", "node", F.col("digest").alias("d2")), ["file", "node"], "full")
        bad = stored(both.where(~F.col("d1").eqNullSafe(F.col("d2"))).select("file", "node"), f"{name}-bad")
        open_ = bad.select("file", F.col("node").alias("up"))
    return bad


def audit(pages: DataFrame, replica: DataFrame) -> DataFrame:
    """(file, page_id, status, offset, length, digest, replica_offset, replica_length, replica_digest).

    One row for each page whose record, or its place in the file, differs between two replicas of
    (page_id, url, html): status is missing, added, moved (same bytes elsewhere) or corrupt.  Repeated
    records of one id are compared as one: sums of lengths, the least offset, and the digest of digests.
    Null urls and payloads are empty; rows of a null id are left out; equal replicas give no rows.
    """
    mine, theirs = stored(leaves(pages), "fixity-a"), stored(leaves(replica), "fixity-b")
    bad = differing(tree(mine, "fixity-a"), tree(theirs, "fixity-b"), "fixity").withColumnRenamed("node", "place")

    def side(leaf: DataFrame, tag: str) -> DataFrame:
        own = leaf.join(bad, ["file", "place"], "left_semi").groupBy("file", "page_id")
        return own.agg(F.min("offset").alias(f"{tag}offset"), F.sum("length").alias(f"{tag}length"), F.array_join(F.sort_array(F.collect_list("digest")), ",").alias(f"{tag}digest"))

    both = side(mine, "").join(side(theirs, "replica_"), ["file", "page_id"], "full")
    status = F.when(F.col("replica_digest").isNull(), "missing").when(F.col("digest").isNull(), "added").when(F.col("digest") == F.col("replica_digest"), "moved").otherwise("corrupt")
    return both.select("file", "page_id", status.alias("status"), "offset", "length", "digest", "replica_offset", "replica_length", "replica_digest")
