"""Product quantisation of integer vectors: sixteen parts, each coded by the nearest entry of its codebook.

Codebooks are integers and are broadcast: 16 x 64 entries, whatever the data.  An Arrow batch computes
the squared distances of all its parts to all entries as |x|^2 - 2 x.c + |c|^2 with exact long products and
takes the first least one.  A task adds up the parts of each entry before anything is shuffled; the
grouped sums of a round, one row an entry and position, make the next codebooks.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import array_batch, discard, stored
from .whitening import integers, matrix, sound

ROWS = 1024


@dataclass(frozen=True)
class Quantiser:
    step: int = 256
    parts: int = 16
    entries: int = 64
    rounds: int = 2

    def width(self, longest: int) -> int:
        return max(1, -(-longest // self.parts))

    def largest(self, width: int) -> int:
        """Components saturate here, so that a vector's squared distance stays under 2**62: 2**27 for 64 of them."""
        return math.isqrt((1 << 62) // (self.parts * width)) // 2


def assign(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index [parts, n], squared distance [parts, n]) of the first nearest entry of books [parts, entries, width] for x [n, parts * width]."""
    parts, _, width = books.shape
    y = np.ascontiguousarray(x.reshape(len(x), parts, width).transpose(1, 0, 2))
    far = np.matmul(y, books.transpose(0, 2, 1))
    far *= -2
    far += (books * books).sum(2)[:, None, :]
    at = far.argmin(2)
    return at, np.take_along_axis(far, at[:, :, None], 2)[:, :, 0] + (y * y).sum(2)


def first_books(rows: DataFrame, cfg: Quantiser, width: int) -> np.ndarray:
    """Parts of the vectors of the smallest ids, null ids last and equal ids by their vectors; fewer if there are fewer."""
    top = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(cfg.entries).select("x").collect()
    return np.ascontiguousarray(np.array([r["x"] for r in top], np.int64).reshape(len(top), cfg.parts, width).transpose(1, 0, 2))


def improved(rows: DataFrame, books: np.ndarray, cfg: Quantiser) -> np.ndarray:
    """Every entry replaced by the floored mean of the parts that are nearest to it; an unused one stays."""
    parts, entries, width = books.shape
    schema = pa.schema([("at", pa.int32()), ("n", pa.int64()), ("s", pa.int64())])
    sent = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        books = sent.value
        n, s = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                x = matrix(batch.column(0).slice(a, ROWS), parts * width)
                at, _ = assign(x, books)
                slot = (at + np.arange(parts)[:, None] * entries).T.ravel()
                n += np.bincount(slot, minlength=len(n))
                np.add.at(s, slot, x.reshape(-1, width))
        used = np.flatnonzero(n)
        if len(used):
            yield array_batch(schema, (used[:, None] * width + np.arange(width)).ravel(), np.repeat(n[used], width), s[used].ravel())

    got = rows.select("x").mapInArrow(run, "at int, n long, s long").groupBy("at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    out = books.copy().reshape(-1)
    for r in got:
        out[r["at"]] = int(r["s"]) // r["n"]
    return out.reshape(books.shape)


def coded(vectors: DataFrame, cfg: Quantiser = Quantiser()) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every sound row of (vec_id, embedding, label).

    Rows of a null vector, or of one with null or non-finite components, are left out.  Repeated rows and null ids
    each keep their own row; null labels are one label.  A vector shorter than the longest one, or than a
    multiple of the parts, is read as if followed by zeros.  Components saturate (Quantiser.largest).  Fewer
    vectors than entries make smaller codebooks.  A label_error over 2**63 - 1 is null.  An empty table gives an
    empty one; other columns are ignored.
    """
    v = F.col("embedding").cast("array<double>")
    src = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding"), F.col("label").alias("label")).where(sound(v))
    longest = src.agg(F.max(F.size("embedding"))).first()[0]
    if longest is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    width = cfg.width(longest)
    dim = cfg.parts * width
    rows = stored(src.select("vec_id", "label", integers(F.col("embedding"), cfg.step, 0, cfg.largest(width), dim).alias("x")), "pq-rows")
    books = first_books(rows, cfg, width)
    for _ in range(cfg.rounds):
        books = improved(rows, books, cfg)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    sent = rows.sparkSession.sparkContext.broadcast(books)
    schema = pa.schema([("vec_id", pa.int64()), ("code", pa.string()), ("error", pa.int64())])
    hexes = np.frombuffer("".join(f"{k:02x}" for k in range(max(cfg.entries, 1))).encode(), "S2")

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                at, far = assign(matrix(part.column(1), dim), sent.value)
                code = np.ascontiguousarray(hexes[at.T]).view(f"S{2 * cfg.parts}").ravel()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(code.astype(str).tolist(), pa.string()), pa.array(far.sum(0)), part.column(2)], names=[*schema.names, "label"])

    label = rows.schema["label"].dataType.simpleString()
    out = stored(rows.select("vec_id", "x", "label").mapInArrow(run, f"vec_id long, code string, error long, label {label}"), "pq-codes")
    discard(rows)
    total = out.groupBy(F.col("label").alias("l")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("t"))
    total = total.select("l", F.expr("try_cast(t AS bigint)").alias("label_error"))
    both = out.join(total, F.col("label").eqNullSafe(F.col("l")))
    return both.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
