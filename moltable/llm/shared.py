"""Helpers that several operators share: shared-folder tables, Arrow slices, byte-level words.

Words are found on the UTF-8 bytes of a whole Arrow slice at once.  A word's hash
is a difference of a running polynomial sum, so hashing costs a few numpy passes
a slice and no Python step per word.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
SLICE_BYTES = 1 << 20
_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C13 | 3
_INV = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: dict[int, np.ndarray] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir.  Where none is set a local folder serves on a local master; on a cluster that would lose data, so it fails."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        got = os.path.join(tempfile.gettempdir(), "moltable-checkpoints")
        spark.conf.set("spark.checkpoint.dir", got)
    return got.rstrip("/")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends, columns prune, and shuffle files go."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def plain(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra or clashing columns of the input do no harm."""
    return df.select(*(F.col(f"`{n}`") for n in names))


def fresh(df: DataFrame, name: str) -> str:
    """name, with as many _ behind it as it takes to be none of df's columns."""
    own = {c.lower() for c in df.columns}
    while name.lower() in own:
        name += "_"
    return name


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x + U64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _pow(base: int, n: int) -> np.ndarray:
    got = _powers.get(base)
    if got is None or len(got) < n:
        size = max(n, SLICE_BYTES + 4096)
        got = np.ones(size, U64)
        have, step = 1, base
        while have < size:  # doubling: powers[have:2*have] = powers[:have] * base**have
            m = min(have, size - have)
            got[have : have + m] = got[:m] * U64(step)
            have, step = have + m, step * step & 0xFFFFFFFFFFFFFFFF
        if n <= SLICE_BYTES + 4096:
            _powers[base] = got
    return got


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the n + 1 offsets; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    buf = column.buffers()
    off = np.frombuffer(buf[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(buf[2], np.uint8) if buf[2] is not None and buf[2].size else np.zeros(0, np.uint8)
    return data, off


def slices(column: pa.Array, limit: int = SLICE_BYTES, rows: int = 4000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of at most limit bytes (or one row) with their bytes and offsets from 0."""
    data, off = utf8(column)
    n, a = len(off) - 1, 0
    while a < n:
        b = int(np.searchsorted(off, off[a] + limit, "right")) - 1
        b = min(n, max(a + 1, b), a + rows)
        yield a, b, data[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


class Words:
    """Words of a slice: start and end bytes, their row, first word of each row, and hashes."""

    def __init__(self, data: np.ndarray, off: np.ndarray, lower: bool = True):
        self.data = _LOWER[data] if lower else data
        n = len(data)
        word = ~SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        before = np.empty(n, bool)
        before[:1] = False
        before[1:] = word[:-1]
        after = np.empty(n, bool)
        after[-1:] = False
        after[:-1] = word[1:]
        self.start = np.flatnonzero(word & (~before | edge[:n]))
        self.end = np.flatnonzero(word & (~after | edge[1:])) + 1
        self.row = (np.searchsorted(off, self.start, "right") - 1).astype(np.int64)
        # a row that is empty shares its offset with the next one; "right" gives the last, which holds the word
        self.first = np.searchsorted(self.start, off)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(_BYTE[self.data] * _pow(_BASE, n)[:n], out=self.sums[1:])

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * _pow(_INV, len(self.data) + 1)[start])

    @property
    def hash(self) -> np.ndarray:
        return self.span_hash(self.start, self.end)


def hash_bytes(text: bytes) -> int:
    """The hash that Words gives to these bytes as one word."""
    a = np.frombuffer(text, np.uint8)
    return int(mix(np.array([(_BYTE[a] * _pow(_BASE, len(a))[: len(a)]).sum(dtype=U64)], U64))[0])


def shingles(words: np.ndarray, row: np.ndarray, rows: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words with their rows; a row of fewer words gives its whole sequence as one."""
    n = len(words)
    out, of = np.zeros(0, U64), np.zeros(0, np.int64)
    count = np.bincount(row, minlength=rows)
    if n >= size:
        whole = row[: n - size + 1] == row[size - 1 :]
        h = np.zeros(n - size + 1, U64)
        for j in range(size):
            h = (h + words[j : n - size + 1 + j]) * U64(0xD6E8FEB86659FD93)
        out, of = mix(h[whole], size), row[: n - size + 1][whole]
    few = np.flatnonzero((count > 0) & (count < size))
    if len(few):
        first = np.searchsorted(row, few)
        h = np.zeros(len(few), U64)
        for j in range(size - 1):
            here = count[few] > j
            h[here] = (h[here] + words[first[here] + j]) * U64(0xD6E8FEB86659FD93)
        out = np.concatenate([out, mix(h + count[few].astype(U64), 77)])
        of = np.concatenate([of, few])
    return out, of


def array_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, (pa.Array, pa.ChunkedArray)) else c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components of (u, v) long edges: (node, component), component the smallest node.

    Alternating large-star and small-star steps; every step is a pre-aggregated minimum
    and an equi-join, so a hub is split by adaptive skew joins.  Rounds end when the
    edge set no longer changes; only its count and hash sum come to the driver.
    """
    e = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    spark = e.sparkSession
    sign = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    last = sign(e)
    while last[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = stored(large, name)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e, old = stored(small, name), e
        discard(large, old)
        now = sign(e)
        if now == last:
            break
        last = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()) if last[0] else spark.createDataFrame([], "node long, component long")
