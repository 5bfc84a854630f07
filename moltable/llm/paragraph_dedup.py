"""Repeated passages across documents: paragraph MinHash banding, exact Jaccard, removal by components.

A text is cut into paragraphs by its words, not by its lines: a paragraph begins where
the hash of two words is the least within RADIUS words on either side.  So a passage
breaks alike whatever surrounds it, and one of 50 words holds whole paragraphs (some
15 words each).  Sets of word shingles are sketched and banded like a document's, with
bands of few rows, as unrelated paragraphs share next to no five-word runs.  Colliding
paragraphs are verified on full sets; of each component that stands in two documents
or more the first paragraph, by document and place, is kept.

Paragraphs are then put together to passages.  Neighbours belong together if some other
document has the same two components in a row.  The ends of a piece of fewer words than
asked for, and of its neighbours, are extended word by word, as far as another member of
the component goes on alike, over up to SKIPS replaced words; pieces go together across a
few edited words.  Reported are the paragraphs of passages that hold at least `min_words`
words, so that a repeated heading or notice alone is none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import neardup
from .shared import U64, Words, array_batch, discard, fresh, mix, plain, signed, slices, stored

RADIUS = 7
MIN_WORDS = 50
GAP = 7 * RADIUS  # words between two pieces of one passage
EDITED = 4  # of them may differ
PERIOD = 2 * (RADIUS + 1)
SKIPS = 2
AGAIN = 4  # words that must be alike behind a replaced one
BANDING = neardup.Banding(rows=2, bands=3, shingle=5, margin=1.0)  # misses 5e-2 of pairs at 0.8, 7e-3 at 0.9, none of equal sets; a passage has several paragraphs
PLACE = pa.schema([("doc_id", pa.int64()), ("version", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("n_words", pa.int32()), ("word", pa.int32())])


def breaks(words: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Whether a paragraph begins at each word.

    That is at a row's first, where the two words' hash is least around (the leftmost of equals), and, where
    words go round in a circle of at most RADIUS, at every PERIOD-th word of such a run and behind it.
    """
    n = len(words)
    out = np.ones(n, bool)
    out[1:] = row[1:] != row[:-1]
    if n < 2:
        return out
    v = np.append(mix(words[:-1] + words[1:] * U64(0xD6E8FEB86659FD93), 91), U64(2**64 - 1))
    least, again = np.ones(n, bool), np.zeros(n, bool)
    for d in range(1, RADIUS + 1):
        if d >= n:
            break
        same = row[d:] == row[:-d]
        least[d:] &= ~same | (v[d:] < v[:-d])
        least[:-d] &= ~same | (v[:-d] <= v[d:])
        again[d:] |= same & (v[d:] == v[:-d])
    begin = np.flatnonzero(again & np.append(True, ~again[:-1] | (row[1:] != row[:-1])))
    end = np.flatnonzero(again & np.append(~again[1:] | (row[1:] != row[:-1]), True)) + 1
    for a, b in zip(begin, end, strict=True):
        if b - a >= PERIOD:
            out[a:b:PERIOD] = True
            out[b : b + 1] = True
    return out | least


class Paragraphs:
    """Paragraphs of a slice: row, first word, words, start and end bytes and id of each; w has the words."""

    def __init__(self, doc: np.ndarray, data: np.ndarray, off: np.ndarray):
        self.w = w = Words(data, off)
        self.hash = w.hash
        head = np.flatnonzero(breaks(self.hash, w.row)) if len(w.row) else np.zeros(0, np.int64)
        size = np.diff(np.append(head, len(w.row)))
        keep = size > RADIUS
        self.head, self.size = head[keep], size[keep]
        self.row = w.row[self.head]
        self.start, self.end = w.start[self.head], w.end[self.head + self.size - 1]
        whole = w.span_hash(off[:-1], off[1:])
        self.version = mix(whole ^ mix(doc.view(U64), 1), 2)[self.row]
        self.pid = signed(mix(self.version + (self.start - off[self.row]).astype(U64), 3))

    def sets(self, shingle: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Up to 4000 paragraphs at a time: which, their values, and the paragraph of each value."""
        for k in range(0, len(self.row), 4000):
            own = slice(k, min(k + 4000, len(self.row)))
            head, size = self.head[own], self.size[own]
            at = np.repeat(head - np.cumsum(size) + size, size) + np.arange(size.sum())
            yield own, *neardup.value_sets(self.hash[at], np.repeat(np.arange(len(head)), size), len(head), shingle)


def _cut(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, Paragraphs]]:
    ids = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64)
    for a, b, data, off in slices(batch.column(1)):
        yield a, data, off, Paragraphs(ids[a:b].copy(), data, off)


def band_keys(value: np.ndarray, para: np.ndarray, paragraphs: int, cfg: neardup.Banding) -> list[np.ndarray]:
    """A key for each band: a hash of the least values under `rows` hash functions, in full width, as the sets are small and many."""
    rng = np.random.Generator(np.random.PCG64(31))
    times = rng.integers(0, 2**63, (cfg.bands, cfg.rows), dtype=np.uint64) * U64(2) + U64(1)
    lead = np.searchsorted(para, np.arange(paragraphs))
    keys = []
    for b in range(cfg.bands):
        key = np.full(paragraphs, b, U64)
        for t in times[b]:
            key = mix(key + np.minimum.reduceat(mix(value * t, b), lead), 1)
        keys.append(signed(key))
    return keys


def _points(data: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])


def sketch_paragraphs(docs: DataFrame, cfg: neardup.Banding) -> DataFrame:
    """A row for each paragraph; start and end are code points of the text, word is the number of its first word."""

    keys = [f"k{i}" for i in range(cfg.bands)]
    schema = pa.schema([(c, pa.int64()) for c in ("pid", "n", "s", *keys)] + list(PLACE))

    def run(batches):
        for batch in batches:
            for a, data, off, p in _cut(batch):
                point = _points(data)
                base = point[off[p.row]]
                for own, value, para in p.sets(cfg.shingle):
                    many = own.stop - own.start
                    n, s1, s2 = neardup.set_sums(value, para, many)
                    sketch = n, signed(mix(s1 ^ mix(s2, 29), 37)), *band_keys(value, para, many, cfg)
                    row = p.row[own]
                    first = p.head[own] - p.w.first[row]
                    yield array_batch(schema, p.pid[own], *sketch, batch.column(0).take(pa.array(a + row)), signed(p.version[own].copy()), point[p.start[own]] - base[own], point[p.end[own]] - base[own], p.size[own], first)

    return plain(docs, "doc_id", "text").mapInArrow(run, ", ".join(f"{c} long" for c in ("pid", "n", "s", *keys, "doc_id", "version")) + ", start int, end int, n_words int, word int")


def paragraph_set_rows(docs: DataFrame, cfg: neardup.Banding):
    def make(bits: np.ndarray) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast(bits)

        def run(batches):
            for batch in batches:
                for _, _, _, p in _cut(batch):
                    for own, value, para in p.sets(cfg.shingle):
                        wanted = neardup.in_bloom(sent.value, p.pid[own])
                        if wanted.any():
                            yield neardup.set_batch(p.pid[own], value, para, wanted)

        return plain(docs, "doc_id", "text").mapInArrow(run, "pid long, set array<long>")

    return make


def around(docs: DataFrame, wanted: DataFrame, reach: int) -> DataFrame:
    """(key, h): for the wanted keys, and some more, hashes of the `reach` words before a paragraph (key = pid) or behind it (key = ~pid), the nearest first."""
    sent = docs.sparkSession.sparkContext.broadcast(neardup.bloom(wanted))
    schema = pa.schema([("key", pa.int64()), ("h", pa.list_(pa.int32()))])
    step = np.arange(1, reach + 1)

    def run(batches):
        for batch in batches:
            for *_, p in _cut(batch):
                for key, edge, sign in ((p.pid, p.head, -1), (~p.pid, p.head + p.size - 1, 1)):
                    hit = np.flatnonzero(neardup.in_bloom(sent.value, key))
                    for k in range(0, len(hit), 4000):
                        own = hit[k : k + 4000]
                        word = edge[own][:, None] + sign * step[None, :]
                        row = p.row[own]
                        inside = (word >= p.w.first[row][:, None]) & (word < p.w.first[row + 1][:, None])
                        word = np.where(inside, word, 0)
                        h = (p.hash[word].astype(np.uint32) | np.uint32(1)).view(np.int32)[inside]
                        edges = pa.array(np.concatenate([[0], np.cumsum(inside.sum(1))]), pa.int32())
                        yield pa.RecordBatch.from_arrays([pa.array(key[own]), pa.ListArray.from_arrays(edges, pa.array(h))], schema=schema)

    return plain(docs, "doc_id", "text").mapInArrow(run, "key long, h array<int>")


def alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """By how many words the rows of x and y begin alike, over SKIPS replaced words that AGAIN words alike follow; 0 is no word."""
    same = (x == y) & (x != 0)
    run = np.zeros((len(x), x.shape[1] + 2), np.int64)
    for j in range(x.shape[1] - 1, -1, -1):
        run[:, j] = np.where(same[:, j], run[:, j + 1] + 1, 0)
    at = np.arange(len(x))
    k = run[:, 0].copy()
    for _ in range(SKIPS):
        more = run[at, np.minimum(k + 1, x.shape[1])]
        k = np.where(more >= AGAIN, k + 1 + more, k)
    return k


def _best(of: np.ndarray, doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """For rows sorted by (of, h): how far each is alike with the nearest row of its group and another document, before or behind."""
    n = len(of)
    new = np.append(True, (of[1:] != of[:-1]) | (doc[1:] != doc[:-1]))
    start = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    out = np.zeros(n, np.int64)
    for near in (start[run] - 1, np.append(start[1:], n)[run]):
        ok = np.flatnonzero((near >= 0) & (near < n))
        ok = ok[of[near[ok]] == of[ok]]
        out[ok] = np.maximum(out[ok], alike(h[ok], h[near[ok]]))
    return out


def extended(ends: DataFrame, reach: int) -> DataFrame:
    """(key, more): by how many words an end goes on like some other document's.

    ends: (key, doc_id, of, asks, h); only those that ask get a row.  Ends are sorted by group and by their words in range
    partitions, so that the one that agrees longest stands next to each; no pairs are made and a hot group is split.  The first
    and last rows of every partition are compared once more with those of the next, two rows a partition.
    """
    schema = pa.schema([("key", pa.int64()), ("more", pa.int64()), ("part", pa.int64()), ("of", pa.int64()), ("doc_id", pa.int64()), ("h", pa.list_(pa.int32()))])

    def run(batches):
        held = list(batches)  # one range partition
        if not held:
            return
        t = pa.Table.from_batches(held)
        key, doc, of, part = (np.asarray(t.column(c)) for c in ("key", "doc_id", "of", "part"))
        asks, lists = np.asarray(t.column("asks")), t.column("h").combine_chunks()
        size = np.asarray(lists.value_lengths())
        h = np.zeros((len(key), reach), np.int32)
        h[np.repeat(np.arange(len(key)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = lists.flatten().to_numpy()
        more = _best(of, doc, h)
        edge = np.zeros(len(key), bool)
        edge[[0, -1]] = True
        for kind, take in ((-1, np.flatnonzero(asks & (more > 0))), (0, np.flatnonzero(edge))):
            for k in range(0, len(take), 4000):
                own = take[k : k + 4000]
                blank = pa.array([None] * len(own), pa.list_(pa.int32())) if kind else lists.take(pa.array(own))
                yield array_batch(schema, key[own], more[own], np.full(len(own), -1) if kind else part[own], of[own], doc[own], blank)

    laid = ends.repartitionByRange("of", "h").sortWithinPartitions("of", "h").select("key", "doc_id", "of", F.spark_partition_id().cast("long").alias("part"), "asks", "h")
    out = stored(laid.mapInArrow(run, "key long, more long, part long, of long, doc_id long, h array<int>"), "para-far")
    edges = sorted(out.where("part >= 0").collect(), key=lambda r: (r.part, r.of, r.h))
    more = []
    for a, b in zip(edges, edges[1:], strict=False):
        if a.part != b.part and a.of == b.of and a.doc_id != b.doc_id:
            x, y = (np.array([r.h + [0] * (reach - len(r.h))]) for r in (a, b))
            more += [(r.key, int(alike(x, y)[0])) for r in (a, b)]
    found = out.where("part < 0").select("key", "more")
    if more:
        found = found.unionByName(out.sparkSession.createDataFrame(more, "key long, more long"))
    return found.groupBy("key").agg(F.max("more").alias("more"))


def _apart(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that rows of two documents or more have."""
    return df.groupBy(*keys).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").drop("lo", "hi")


def passages(docs: DataFrame, hits: DataFrame, min_words: int) -> DataFrame:
    """hits with passage_word and passage_words; hits: matched paragraphs (pid, doc_id, version, start, end, n_words, word, component)."""
    place = Window.partitionBy("doc_id", "version").orderBy("word")
    last = F.lag(F.struct("component", (F.col("word") + F.col("n_words")).alias("to"))).over(place)
    row = hits.withColumn("last", last).withColumn("gap", F.col("word") - F.col("last.to")).withColumn("before", F.col("last.component")).drop("last")
    row = stored(row, "para-order")
    discard(hits)
    both = _apart(row.where(F.col("gap") <= GAP), "before", "component").withColumn("shared", F.lit(True))
    row = row.join(both, ["before", "component"], "left").withColumn("shared", F.coalesce(F.col("shared") & (F.col("gap") <= GAP), F.lit(False)))
    fresh = F.when(F.col("shared") & (F.col("gap") == 0), 0).otherwise(1)
    row = row.withColumn("piece", F.sum(fresh).over(place))
    row = row.withColumn("words", F.sum("n_words").over(Window.partitionBy("doc_id", "version", "piece")))
    small = lambda near, on: (F.col("words") < min_words) | on & (near < min_words)
    row = row.withColumn("next", F.lead(F.struct("piece", "words", "shared")).over(place)).withColumn("prior", F.lag("words").over(place))
    opens = (fresh == 1) & small(F.col("prior"), F.col("shared"))
    closes = F.coalesce(F.col("next.piece") != F.col("piece"), F.lit(True)) & small(F.col("next.words"), F.col("next.shared"))
    row = row.withColumn("opens", F.coalesce(opens, F.lit(False))).withColumn("closes", F.coalesce(closes, F.lit(False))).drop("next", "prior", "words")
    row = stored(row, "para-pieces")

    side = lambda on, out: row.where(on).select(F.col("component").alias("of"), F.lit(out).alias("side")).distinct()
    ends = side("opens", -1).unionByName(side("closes", 1))
    wanted = row.select("pid", "doc_id", F.col("component").alias("of"), "opens", "closes").join(ends, "of")
    left = F.col("side") < 0
    key, asks = F.when(left, F.col("pid")).otherwise(F.bitwise_not("pid")), F.when(left, F.col("opens")).otherwise(F.col("closes"))
    wanted = stored(wanted.select(key.alias("key"), "doc_id", F.xxhash64("of", "side").alias("of"), asks.alias("asks")), "para-ends")
    words = around(docs, wanted.select(F.col("key").alias("pid")), min_words)
    ends = stored(wanted.join(words, "key"), "para-around")
    far = extended(ends, min_words)
    discard(wanted, ends)

    ahead, behind = (far.select(F.col("key").alias("pid" if s < 0 else "other"), F.col("more").alias(f"more{s}")) for s in (-1, 1))
    behind = behind.withColumn("pid", F.bitwise_not("other")).drop("other")
    row = row.join(ahead, "pid", "left").join(behind, "pid", "left")
    piece = row.groupBy("doc_id", "version", "piece").agg(
        (F.min("word") - F.coalesce(F.min_by("more-1", "word"), F.lit(0))).alias("lo"), (F.max(F.col("word") + F.col("n_words")) + F.coalesce(F.max_by("more1", "word"), F.lit(0))).alias("hi"), F.min_by("shared", "word").alias("shared")
    )
    order = Window.partitionBy("doc_id", "version").orderBy("piece")
    joins = F.coalesce(F.col("shared") & (F.col("lo") - F.lag("hi").over(order) <= EDITED), F.lit(False))
    piece = piece.withColumn("joins", joins).withColumn("passage", F.sum(F.when(F.col("joins"), 0).otherwise(1)).over(order))
    whole = Window.partitionBy("doc_id", "version", "passage")
    piece = piece.withColumn("passage_word", F.min("lo").over(whole)).withColumn("passage_words", F.max("hi").over(whole) - F.col("passage_word"))
    piece = piece.where(F.col("passage_words") >= min_words).select("doc_id", "version", "piece", "passage_word", "passage_words")
    return row.drop("more-1", "more1").join(piece, ["doc_id", "version", "piece"])


def repeated(docs: DataFrame, min_words: int = MIN_WORDS, cfg: neardup.Banding = BANDING) -> DataFrame:
    """(doc_id, start, end, n_words, word, component_id, kept, passage_word, passage_words, version): the matched paragraphs of passages of min_words words or more that stand in several documents.

    component_id is the smallest doc_id of the paragraph's component; kept is true for its first
    paragraph by (doc_id, start).  start and end are code points, word and passage_word numbers of words.  A passage repeated within one document
    only is none.  Null, empty or blank texts and documents of a null id give no rows; rows that
    share id and text count once, rows that share the id alone are told apart by `version`.  An
    empty table gives an empty one; other columns are ignored.
    """
    docs = plain(docs, "doc_id", "text").where("doc_id is not null and text is not null")
    if not docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        docs = stored(docs.dropDuplicates(), "para-texts")
    rows = stored(sketch_paragraphs(docs, cfg), "para-rows")
    got = neardup.linked(rows, paragraph_set_rows(docs, cfg), cfg, "para")
    got = stored(got.select("pid", "doc_id", "version", "start", "end", "n_words", "word", "component"), "para-members")
    many = got.groupBy("component").agg(F.max("doc_id").alias("hi"), F.min(F.struct("doc_id", "start", "version")).alias("f")).where("hi > f.doc_id")
    discard(rows)
    many = stored(many.select("component", "f"), "para-components")
    hits = stored(got.join(many, "component"), "para-hits")
    discard(got, many)
    out = passages(docs, hits, min_words)
    first = F.struct("doc_id", "start", "version") == F.col("f")
    return out.select("doc_id", "start", "end", "n_words", "word", F.col("f.doc_id").alias("component_id"), first.alias("kept"), "passage_word", "passage_words", "version")


def versions(docs: DataFrame, name: str) -> DataFrame:
    """docs with a column `name`: the row's key as `repeated` has it."""
    names = docs.columns
    at, of = names.index("text"), names.index("doc_id")

    def run(batches):
        for batch in batches:
            ids = np.asarray(batch.column(of).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False), np.int64)
            out = np.zeros(batch.num_rows, np.int64)
            for a, b, data, off in slices(batch.column(at)):
                w = Words(data, off)
                out[a:b] = signed(mix(w.span_hash(off[:-1], off[1:]) ^ mix(ids[a:b].copy().view(U64), 1), 2))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def cleaned(docs: DataFrame, min_words: int = MIN_WORDS, cfg: neardup.Banding = BANDING) -> DataFrame:
    """docs with every matched paragraph of a repeated passage but a component's first removed from the text.

    Rows of a null id, and null texts, stay as they are, and so do all other columns.
    """
    version, gone = fresh(docs, "__version"), fresh(docs, "__cuts")
    cuts = repeated(docs, min_words, cfg).where("not kept").groupBy(F.col("doc_id"), F.col("version").alias(version)).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias(gone))
    names = docs.columns
    at = names.index("text")

    def run(batches):
        for batch in batches:
            texts = []
            for text, cut in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                for c in reversed(cut or []):
                    text = text[: c["start"]] + text[c["end"] :].removeprefix("\n")
                texts.append(text)
            columns = list(batch.columns[: len(names)])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    keyed = versions(docs, version).join(cuts, ["doc_id", version], "left")
    return keyed.select(*(F.col(f"`{c}`") for c in names), gone).mapInArrow(run, T.StructType(list(docs.schema.fields)))
