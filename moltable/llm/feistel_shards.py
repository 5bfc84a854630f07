"""Training-order materialisation: a keyed Feistel permutation gives every sequence its slot.

Texts become token ids and sequences of a fixed number of tokens.  Sequences are
numbered 0..N-1 by (doc_id, place); a balanced Feistel network over the least even
number of bits that holds N permutes the numbers, walking on while a value lies
outside (cycle-walking), so the permutation is of exactly 0..N-1, needs no table and
can be inverted.  Slots are range-partitioned into shards of a fixed number of
sequences of a fixed stride: where a slot's tokens start follows from its number, and
read() goes on from any slot.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import U64, array_batch, mix, plain, slices, stored

END_OF_TEXT = 256
PAD = 257
BROADCAST_ROWS = 2_000_000  # of (doc_id, first), 16 bytes each; more are joined by a shuffle


@dataclass(frozen=True)
class Layout:
    tokens: int = 2048
    per_shard: int = 128
    key: int = 0x5EED
    rounds: int = 4

    @property
    def stride(self) -> int:
        return 2 * self.tokens


def _half_bits(n: int) -> int:
    return max(1, -(-max(1, int(n - 1).bit_length()) // 2))


def permute(x: np.ndarray, n: int, key: int, rounds: int = 4, back: bool = False) -> np.ndarray:
    """The slots of numbers x, all below n; with back, the numbers of slots."""
    half = U64(_half_bits(n))
    mask = (U64(1) << half) - U64(1)

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> half, v & mask
        for k in reversed(range(rounds)) if back else range(rounds):
            if back:
                left, right = right ^ (mix(left + U64(key << 8 & 0xFFFFFFFFFFFF), k + 1) & mask), left
            else:
                left, right = right, left ^ (mix(right + U64(key << 8 & 0xFFFFFFFFFFFF), k + 1) & mask)
        return left << half | right

    out = once(x.astype(U64))
    while (far := out >= U64(n)).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


def byte_tokens(data: np.ndarray) -> np.ndarray:
    """Ids of a text: its UTF-8 bytes and END_OF_TEXT."""
    return np.append(data.astype("<u2"), np.array([END_OF_TEXT], "<u2"))


SEQUENCE = pa.schema([("doc_id", pa.int64()), ("seq", pa.int64()), ("n_tokens", pa.int64()), ("body", pa.binary())])


def sequences(docs: DataFrame, cfg: Layout) -> DataFrame:
    """(doc_id, seq, n_tokens, body): bodies are zstd-compressed little-endian 16-bit ids."""

    def run(batches):
        codec = pa.Codec("zstd", 1)
        for batch in batches:
            for a, b, data, off in slices(batch.column(1)):
                rows = []
                for r in range(b - a):
                    ids = byte_tokens(data[off[r] : off[r + 1]])
                    doc = batch.column(0)[a + r].as_py()
                    for k in range(0, len(ids), cfg.tokens):
                        part = ids[k : k + cfg.tokens]
                        rows.append((doc, k // cfg.tokens, len(part), codec.compress(part.tobytes(), asbytes=True)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SEQUENCE, strict=True)], schema=SEQUENCE)

    return plain(docs, "doc_id", "text").mapInArrow(run, "doc_id long, seq long, n_tokens long, body binary")


def numbers(docs: DataFrame, cfg: Layout) -> tuple[DataFrame, int]:
    """(doc_id, first): the number of each document's first sequence, and how many sequences there are.

    A running sum in two levels: over range partitions, whose totals (a number each) are summed
    first, and within each of them.
    """
    size = F.ceil((F.coalesce(F.octet_length("text"), F.lit(0)) + 1) / F.lit(cfg.tokens)).cast("long")
    per = plain(docs, "doc_id", "text").select("doc_id", size.alias("k"))
    per = stored(per.repartitionByRange("doc_id").select("doc_id", "k", F.spark_partition_id().alias("p")), "slot-sizes")
    total = per.groupBy("p").agg(F.sum("k").alias("t"))
    base = total.select("p", F.coalesce(F.sum("t").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b"))
    n = total.agg(F.sum("t")).first()[0] or 0
    within = F.coalesce(F.sum("k").over(Window.partitionBy("p").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return per.select("doc_id", "p", within.alias("w")).join(base, "p").select("doc_id", (F.col("b") + F.col("w")).alias("first")), int(n)


SHARD = pa.schema([("shard", pa.int64()), ("first_slot", pa.int64()), ("n", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("seqs", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("content", pa.binary())])
SHARD_DDL = "shard long, first_slot long, n long, doc_ids array<long>, seqs array<long>, n_tokens array<long>, content binary"


def shards(docs: DataFrame, cfg: Layout = Layout()) -> DataFrame:
    """A row for each shard, written to the shared folder in slot order: `content` holds per_shard sequences
    (the last shard fewer) of cfg.stride bytes each, padded with PAD.

    A null or empty text is one sequence of END_OF_TEXT.  Ids must be unique and not null: rows
    of a null id are left out and of repeated ids one row, that of the least text, is taken.
    An empty table has no shards; other columns are ignored.
    """
    docs = plain(docs, "doc_id", "text").where("doc_id is not null")
    twice = docs.groupBy("doc_id").agg(F.count("*").alias("c"), F.min("text").alias("t")).where("c > 1").select("doc_id", "t") if _repeats(docs) else None
    if twice is not None:
        docs = docs.join(twice.select("doc_id"), "doc_id", "left_anti").unionByName(twice.withColumnRenamed("t", "text"))
    first, n = numbers(docs, cfg)

    def place(batches):
        schema = pa.schema([("shard", pa.int64()), ("slot", pa.int64()), *SEQUENCE])
        for batch in batches:
            at = np.asarray(batch.column(4)) + np.asarray(batch.column(1))
            slot = permute(at, n, cfg.key, cfg.rounds)
            yield pa.RecordBatch.from_arrays([pa.array(slot // cfg.per_shard), pa.array(slot), *batch.columns[:4]], schema=schema)

    def write(batches):
        codec = pa.Codec("zstd", 1)
        held: list[tuple] = []

        def row():
            held.sort(key=lambda r: r[1])
            body = np.full((len(held), cfg.tokens), PAD, "<u2")
            for i, r in enumerate(held):
                body[i, : r[4]] = np.frombuffer(codec.decompress(r[5], 2 * r[4], asbytes=True), "<u2")
            cols = [[held[0][0]], [held[0][1]], [len(held)], [[r[2] for r in held]], [[r[3] for r in held]], [[r[4] for r in held]], [body.tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, SHARD, strict=True)], schema=SHARD)

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][0] != r[0]:
                    yield row()
                    held.clear()
                held.append(r)
        if held:
            yield row()

    first = stored(first, "slot-numbers")
    if first.count() <= BROADCAST_ROWS:
        first = F.broadcast(first)
    placed = sequences(docs, cfg).join(first, "doc_id").select("doc_id", "seq", "n_tokens", "body", "first")
    placed = placed.mapInArrow(place, "shard long, slot long, doc_id long, seq long, n_tokens long, body binary")
    # slots are uniform and their number is known, so ranges of shards need no sample, which would encode all texts a second time
    n_shards = -(-n // cfg.per_shard)
    parts = max(1, min(n_shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    ranged = placed.repartitionById(parts, F.expr(f"cast(shard * {parts} div {max(n_shards, 1)} as int)"))
    return stored(ranged.sortWithinPartitions("slot").mapInArrow(write, SHARD_DDL), "shards", "zstd")


def _repeats(docs: DataFrame) -> bool:
    return bool(docs.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").limit(1).count())


def index(written: DataFrame, cfg: Layout = Layout()) -> DataFrame:
    """(slot, doc_id, seq, n_tokens, shard, byte_offset, sha256) of every sequence, read from the shards' bytes."""
    schema = pa.schema([("slot", pa.int64()), ("doc_id", pa.int64()), ("seq", pa.int64()), ("n_tokens", pa.int64()), ("shard", pa.int64()), ("byte_offset", pa.int64()), ("sha256", pa.string())])

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                shard, first, n, docs, seqs, sizes, content = (c[k].as_py() for c in batch.columns)
                at = np.arange(n)
                sha = [hashlib.sha256(content[i * cfg.stride : i * cfg.stride + 2 * t]).hexdigest() for i, t in enumerate(sizes)]
                yield array_batch(schema, first + at, docs, seqs, sizes, np.full(n, shard), at * cfg.stride, sha)

    return written.mapInArrow(run, "slot long, doc_id long, seq long, n_tokens long, shard long, byte_offset long, sha256 string")


def read(written: DataFrame, cfg: Layout = Layout(), start: int = 0, stop: int | None = None) -> DataFrame:
    """(slot, doc_id, seq, ids) of the slots from start up to before stop (None: to the end), in slot order within each task's rows.

    A reader that stopped goes on by start = its last slot + 1.  Only shards that hold such slots are read: shards lie in
    the files in ascending order, so the condition on `shard` skips files and row groups, and within a shard a slot's
    bytes begin at its place times the stride.  Slots outside 0..N-1 give no rows.
    """
    last = F.lit(True) if stop is None else F.col("shard") <= (stop - 1) // cfg.per_shard
    schema = pa.schema([("slot", pa.int64()), ("doc_id", pa.int64()), ("seq", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                _, first, n, docs, seqs, sizes, content = (c[k].as_py() for c in batch.columns)
                a, b = max(0, start - first), n if stop is None else min(n, stop - first)
                if a < b:
                    ids = [np.frombuffer(content, "<u2", sizes[i], i * cfg.stride).astype(np.int32) for i in range(a, b)]
                    yield array_batch(schema, np.arange(first + a, first + b), docs[a:b], seqs[a:b], ids)

    return written.where((F.col("shard") >= start // cfg.per_shard) & last).mapInArrow(run, "slot long, doc_id long, seq long, ids array<int>")
