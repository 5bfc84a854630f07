"""Embedding near-duplicates by randomly rotated binary codes with correction factors.

A unit vector is rotated by random orthogonal matrices; the signs are its code.  The
stored factor <code, vector> of each rotation turns <code, other> into an unbiased
estimate of the inner product, with a confidence bound from the factor.  Bits of the
codes are the keys of candidate buckets.  Codes and factors are stored once; for a candidate
pair one vector meets the other's code (some 130 bytes at 64 dimensions), and a pair whose upper
bound is below the threshold is dropped.  Only for the rest both vectors are fetched and the
cosine is recomputed in double precision.  Vectors that are equal are one class and are compared once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import U64, array_batch, components, mix, signed, stored


@dataclass(frozen=True)
class Codes:
    """At an angle t a pair shares a band's key with probability (1 - t / pi)**bits; 32 bands of 16 bits miss 2e-6 at cosine 0.98.

    A vector of few components gets more rotations than `rotations`, so that no bit of a key stands in two bands.
    """

    rotations: int = 8
    bits: int = 16
    bands: int = 32
    cosine: float = 0.98
    sigmas: float = 6.0
    seed: int = 5

    def matrices(self, dim: int) -> np.ndarray:
        return _matrices(self, dim)


@lru_cache(maxsize=8)
def _matrices(cfg: Codes, dim: int) -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64([cfg.seed, dim]))
    count = max(cfg.rotations, -(-cfg.bands * cfg.bits // dim))
    q = np.linalg.qr(rng.standard_normal((count, dim, dim)))
    return q[0] * np.sign(np.diagonal(q[1], axis1=1, axis2=2))[:, None, :]


def unit(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(places, unit vectors in double precision) of a batch whose vectors all have one length."""
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True), x


def rotated(x: np.ndarray, cfg: Codes) -> np.ndarray:
    return np.einsum("tij,nj->nti", cfg.matrices(x.shape[1]), x, optimize=True)


def encode(x: np.ndarray, cfg: Codes) -> tuple[np.ndarray, np.ndarray]:
    """Bits [n, rotations, dim] and factors [n, rotations] of unit vectors."""
    r = rotated(x, cfg)
    return r > 0, np.abs(r).sum(2) / np.sqrt(x.shape[1])


def bounds(r: np.ndarray, bits: np.ndarray, factor: np.ndarray, cfg: Codes) -> tuple[np.ndarray, np.ndarray]:
    """Estimate and half-width for the inner product of rotated unit vectors r with the coded vectors."""
    dim = r.shape[2]
    est = (np.where(bits, r, -r).sum(2) / np.sqrt(dim)) / factor
    spread = np.sqrt(np.maximum(1 - factor**2, 0)) / factor / np.sqrt(max(dim - 1, 1))
    return est.mean(1), cfg.sigmas * np.sqrt((spread**2).sum(1)) / est.shape[1]


def _by_length(batches: Iterator[pa.RecordBatch], column: int, rows: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most `rows` rows whose vectors in `column` have one length."""
    for batch in batches:
        lengths = np.asarray(batch.column(column).value_lengths())
        for dim in np.unique(lengths):
            part = batch.filter(pa.array(lengths == dim))
            for a in range(0, part.num_rows, rows):
                yield part.slice(a, rows)


def _coded(batches: Iterator[pa.RecordBatch], cfg: Codes) -> Iterator[pa.RecordBatch]:
    """(node, dim, bits, factor) of (node, v): what is stored of a vector, a bit a rotation and dimension and a factor a rotation."""
    for part in _by_length(batches, 1, 2000):
        bits, factor = encode(unit(part.column(1))[0], cfg)
        packed = np.packbits(bits.reshape(len(bits), -1), axis=1)
        dim = pa.array(np.full(len(bits), bits.shape[2], np.int32))
        yield pa.RecordBatch.from_arrays([part.column(0), dim, pa.array([p.tobytes() for p in packed], pa.binary()), pa.array(factor.tolist(), pa.list_(pa.float64()))], ["node", "dim", "bits", "factor"])


def _possible(batches: Iterator[pa.RecordBatch], cfg: Codes) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of (a, b, x, dim, bits, factor) whose bound, from a's vector and b's stored code, does not rule a link out."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for part in _by_length(batches, 2, 4000):
        dim = len(part.column(2)[0])
        part = part.filter(pc.equal(part.column(3), dim))
        if not part.num_rows:
            continue
        a = np.asarray(part.column(0))
        _, first, back = np.unique(a, return_index=True, return_inverse=True)
        turned = rotated(unit(part.column(2).take(pa.array(first)))[0], cfg)
        bits = np.unpackbits(np.stack([np.frombuffer(v, np.uint8) for v in part.column(4).to_pylist()]), axis=1)
        count = turned.shape[1]
        est, width = bounds(turned[back], bits[:, : count * dim].reshape(-1, count, dim).astype(bool), np.array(part.column(5).to_pylist()), cfg)
        on = np.flatnonzero(est + width >= cfg.cosine)
        yield array_batch(schema, a[on], np.asarray(part.column(1))[on])


def _exact(batches: Iterator[pa.RecordBatch], cfg: Codes) -> Iterator[pa.RecordBatch]:
    """Pairs (u, v) of (a, b, x, y) whose cosine in double precision reaches the threshold."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    for part in _by_length(batches, 2, 4000):
        (_, x), (_, y) = unit(part.column(2)), unit(part.column(3))
        cos = (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))
        on = np.flatnonzero(cos >= cfg.cosine)
        yield array_batch(schema, np.asarray(part.column(0))[on], np.asarray(part.column(1))[on])


def near_vectors(vectors: DataFrame, cfg: Codes = Codes()) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding, label).

    Only rows of one label that is not null are compared.  A vector that is null, empty, zero,
    or holds a null or a non-finite number links with nothing.  Vectors of different lengths
    never link.  Repeated rows each count as a vector; a null id is linked with nothing and not kept.
    """
    src = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").alias("l"))
    sound = ~F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists("v", lambda e: e != 0)
    ok = src.where(F.col("vec_id").isNotNull() & F.col("l").isNotNull() & sound)
    member = stored(ok.select("vec_id", "l", F.xxhash64("v").alias("h1"), F.hash("v").alias("h2"), "v"), "vec-rows")
    node = stored(member.groupBy("l", "h1", "h2").agg(F.min("vec_id").alias("node"), F.count("*").alias("m"), F.min_by("v", "vec_id").alias("v")), "vec-classes")
    schema = pa.schema([("node", pa.int64()), ("key", pa.int64())])

    def keys(batches):
        for batch in batches:
            lengths = np.asarray(batch.column(1).value_lengths())
            for dim in np.unique(lengths):
                part = batch.filter(pa.array(lengths == dim))
                for a in range(0, part.num_rows, 2000):
                    sub = part.slice(a, 2000)
                    bits, _ = encode(unit(sub.column(1))[0], cfg)
                    flat = bits.reshape(len(bits), -1)
                    words = (flat[:, : cfg.bands * cfg.bits].reshape(len(bits), cfg.bands, cfg.bits) << np.arange(cfg.bits)).sum(2).astype(U64)
                    h = mix(words + (np.arange(cfg.bands, dtype=U64) << U64(32)) + U64(int(dim) << 48))
                    yield array_batch(schema, np.repeat(np.asarray(sub.column(0)), cfg.bands), signed(h.ravel().copy()))

    band = node.select("node", "v").mapInArrow(keys, "node long, key long").join(node.select("node", "l"), "node")
    full = band.groupBy("l", "key").agg(F.count("*").alias("c")).where("c > 1").select("l", "key")
    band = stored(band.join(full, ["l", "key"]), "vec-buckets")
    pair = band.select("l", "key", F.col("node").alias("a")).join(band.select("l", "key", F.col("node").alias("b")), ["l", "key"]).where("a < b").select("a", "b").distinct()
    codes = stored(node.select("node", "v").mapInArrow(lambda batches: _coded(batches, cfg), "node long, dim int, bits binary, factor array<double>"), "vec-codes")
    x = node.select(F.col("node").alias("a"), F.col("v").alias("x"))
    y = node.select(F.col("node").alias("b"), F.col("v").alias("y"))
    known = codes.select(F.col("node").alias("b"), "dim", "bits", "factor")
    near = stored(pair.join(x, "a").join(known, "b").select("a", "b", "x", "dim", "bits", "factor").mapInArrow(lambda batches: _possible(batches, cfg), "a long, b long"), "vec-possible")
    links = stored(near.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(lambda batches: _exact(batches, cfg), "u long, v long"), "vec-links")
    size = node.select("node", "m")
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    degree = both.join(size.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.sum("m").alias("far")).withColumnRenamed("u", "node")
    group = components(links, "vec-cc")
    info = size.join(degree, "node", "left").join(group, "node", "left")
    info = info.select("node", (F.col("m") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component"))
    own = member.select("vec_id", "l", "h1", "h2").join(stored(node.select("l", "h1", "h2", "node").join(info, "node"), "vec-info"), ["l", "h1", "h2"]).select("vec_id", "n_links", "component")
    rest = src.where(~F.coalesce(F.col("vec_id").isNotNull() & F.col("l").isNotNull() & sound, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component"))
    out = own.unionByName(rest)
    return out.select("vec_id", "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("component"), F.lit(False)).alias("kept"))
