"""Near-duplicate classes of word-shingle sets: HyperMinHash sketches, banding, exact verification.

A sketch has `bins` registers.  A shingle's hash picks a bin, the least hash of a bin
gives its register: the leading-zero count and 10 mantissa bits in 16 bits.  An empty
bin takes the register of another one, drawn in an order fixed for that bin, so that
small sets keep the collision probability of their Jaccard similarity (optimal
densification).  Bands of `rows` registers are hashed to keys.

Exact copies of a set are put together first, one of each class goes on.  Candidate
pairs come in rounds, so that a group of g near copies costs about g pairs and not
g * g: first each member of a bucket with the one bucket leader it meets most often;
then, where a bucket still holds several components, its members with another member
drawn for it.  Such pairs are verified on full sets if the collision-corrected estimate
doesn't rule them out (`margin` is over five standard errors).  What is left are
members of one bucket that belong to different components, mostly just under the
threshold; these are compared on full sets block against block, in blocks of bounded
size, and only links leave a block.  So the components are those of all candidate links.

Sets are only made for documents in such pairs and blocks: a Bloom filter of fixed size,
at most 8 MB, says which.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import U64, Words, array_batch, components, discard, mix, plain, shingles, signed, slices, stored

VALUE_BITS = 52
MANTISSA = 10
BLOOM_WORDS = 1 << 20
DRAWS = 1  # rounds with a drawn member before the block comparison
SMALL = 8  # members of a bucket whose pairs are compared one by one; larger buckets are compared block against block
BLOCK_SETS = 512
BLOCK_VALUES = 400_000


@dataclass(frozen=True)
class Banding:
    """At similarity s a pair is missed with probability (1 - s**rows)**bands."""

    bins: int = 256
    rows: int = 6
    bands: int = 42
    shingle: int = 5
    percent: int = 80
    margin: float = 0.14


def _orders(bins: int) -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(bins))
    return np.argsort(rng.random((bins, bins)), axis=0)  # [attempt, bin] -> bin to borrow from


_order_of: dict[int, np.ndarray] = {}


def value_sets(words: np.ndarray, row: np.ndarray, rows: int, shingle: int, per: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 52-bit shingle values, sorted by (row, value), and their rows (at most 4095 rows)."""
    h, of = shingles(words, row, rows, shingle)
    key = np.sort((of.astype(U64) << U64(VALUE_BITS)) | (h >> U64(64 - VALUE_BITS)))
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return key & U64((1 << VALUE_BITS) - 1), (key >> U64(VALUE_BITS)).astype(np.int64)


def registers(value: np.ndarray, row: np.ndarray, rows: int, bins: int) -> np.ndarray:
    """rows x bins uint16 registers; a row without values has zeros."""
    x = value * U64(bins)
    at = row * bins + (x >> U64(VALUE_BITS)).astype(np.int64)
    lead = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
    rest = np.maximum(x[lead] & U64((1 << VALUE_BITS) - 1), U64(1)).astype(np.float64).view(U64)
    out = np.zeros(rows * bins, np.uint16)
    has = np.zeros(rows * bins, bool)
    out[at[lead]] = ((rest >> U64(52 - MANTISSA)) - U64(1023 << MANTISSA)).astype(np.uint16)
    has[at[lead]] = True
    had = has.copy()
    some = had.reshape(rows, bins).any(1)
    empty = np.flatnonzero(~has & np.repeat(some, bins))
    order = _order_of.setdefault(bins, _orders(bins))
    for step in range(bins):
        if not len(empty):
            break
        source = empty - empty % bins + order[step][empty % bins]
        ok = had[source]
        out[empty[ok]] = out[source[ok]]
        empty = empty[~ok]
    return out.reshape(rows, bins)


def set_sums(value: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size and two order-free 64-bit sums of each row's set."""
    n = np.bincount(row, minlength=rows)
    edge = np.concatenate([[0], np.cumsum(n)])

    def total(seed: int) -> np.ndarray:
        c = np.concatenate([np.zeros(1, U64), np.cumsum(mix(value, seed))])
        return c[edge[1:]] - c[edge[:-1]]

    return n, total(11), total(23)


def document_sets(batch_text, shingle: int):
    """(first row, rows, values, row of each value) of each slice of a text column."""
    for a, b, data, off in slices(batch_text):
        w = Words(data, off)
        yield a, b - a, *value_sets(w.hash, w.row, b - a, shingle)


SKETCH = pa.schema([("pid", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("sig", pa.binary())])
SKETCH_DDL = "pid long, n long, s1 long, s2 long, sig binary"


def sketch_columns(value, row, rows, bins):
    n, s1, s2 = set_sums(value, row, rows)
    sig = registers(value, row, rows, bins)
    return n, signed(s1), signed(s2), pa.array([x.tobytes() for x in sig], pa.binary())


def sketch_documents(docs: DataFrame, id_col: str, text_col: str, cfg: Banding) -> DataFrame:
    def run(batches):
        for batch in batches:
            for a, rows, value, row in document_sets(batch.column(1), cfg.shingle):
                yield array_batch(SKETCH, batch.column(0).slice(a, rows), *sketch_columns(value, row, rows, cfg.bins))

    return plain(docs, id_col, text_col).mapInArrow(run, SKETCH_DDL)


def _bits(pid: np.ndarray) -> list[np.ndarray]:
    x = pid.view(U64)
    return [mix(x, s) % U64(BLOOM_WORDS * 64) for s in (3, 5)]


def bloom(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of the long column pid: 2**26 bits, whatever the number of ids."""
    schema = pa.schema([("w", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            pos = np.unique(np.concatenate(_bits(batch.column(0).to_numpy(zero_copy_only=False))))
            word = (pos >> U64(6)).astype(np.int64)
            at = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else []
            if len(at):
                yield array_batch(schema, word[at], signed(np.bitwise_or.reduceat(U64(1) << (pos & U64(63)), at)))

    got = ids.select("pid").mapInArrow(run, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(BLOOM_WORDS, U64)
    if got.num_rows:
        out[got.column(0).to_numpy()] = got.column(1).to_numpy().view(U64)
    return out


def in_bloom(bits: np.ndarray, pid: np.ndarray) -> np.ndarray:
    ok = np.ones(len(pid), bool)
    for pos in _bits(pid):
        ok &= (bits[(pos >> U64(6)).astype(np.int64)] >> (pos & U64(63)) & U64(1)).astype(bool)
    return ok


def sets_schema() -> pa.Schema:
    return pa.schema([("pid", pa.int64()), ("set", pa.list_(pa.int64()))])


def set_batch(pid: np.ndarray, value: np.ndarray, row: np.ndarray, wanted: np.ndarray) -> pa.RecordBatch:
    """Sets of the wanted rows as a list column."""
    n = np.bincount(row, minlength=len(pid))[wanted]
    take = np.isin(row, np.flatnonzero(wanted)) if not wanted.all() else slice(None)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(signed(value[take].copy()), pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(pid[wanted], pa.int64()), lists], schema=sets_schema())


def document_set_rows(docs: DataFrame, id_col: str, text_col: str, cfg: Banding) -> Callable[[np.ndarray], DataFrame]:
    def make(bits: np.ndarray) -> DataFrame:
        sent = docs.sparkSession.sparkContext.broadcast(bits)

        def run(batches):
            for batch in batches:
                pid = np.asarray(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False), np.int64)
                ok = in_bloom(sent.value, pid) & ~np.asarray(batch.column(0).is_null())
                if ok.any():
                    pid, text = pid[ok], batch.column(1).filter(pa.array(ok))
                    for a, rows, value, row in document_sets(text, cfg.shingle):
                        yield set_batch(pid[a : a + rows], value, row, np.ones(rows, bool))

        return plain(docs, id_col, text_col).mapInArrow(run, "pid long, set array<long>")

    return make


def band_rows(reps: DataFrame, cfg: Banding) -> DataFrame:
    """(key, pid, n): a row for each band of each sketch."""
    schema = pa.schema([("key", pa.int64()), ("pid", pa.int64()), ("n", pa.int64())])
    used = cfg.rows * cfg.bands

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                sig = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint16).reshape(part.num_rows, -1)[:, :used].astype(U64)
                h = np.repeat(np.arange(1, cfg.bands + 1, dtype=U64)[None, :], len(sig), 0)
                for j in range(cfg.rows):
                    h = mix(h + sig[:, j :: cfg.rows], j + 1)
                pid, n = (np.repeat(np.asarray(part.column(i)), cfg.bands) for i in (0, 1))
                yield array_batch(schema, signed(h.ravel().copy()), pid, n)

    return reps.select("pid", "n", "sig").mapInArrow(run, "key long, pid long, n long")


def likely(pairs: DataFrame, reps: DataFrame, cfg: Banding) -> DataFrame:
    """Of pairs (a, b) those that the estimate doesn't rule out; all of them where the sketch is too coarse for one (margin 1)."""
    if cfg.margin >= 1:
        return pairs
    left = reps.select(F.col("pid").alias("a"), F.col("n").alias("na"), F.col("sig").alias("siga"))
    right = reps.select(F.col("pid").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sigb"))
    both = pairs.join(left, "a").join(right, "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * cfg.percent)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                part = batch.slice(at, 4000)
                x, y = (np.frombuffer(b"".join(part.column(i).to_pylist()), np.uint16).reshape(part.num_rows, -1) for i in (4, 5))
                est = estimate((x == y).mean(1), np.asarray(part.column(2)), np.asarray(part.column(3)))
                ok = est >= cfg.percent / 100 - cfg.margin
                yield array_batch(schema, np.asarray(part.column(0))[ok], np.asarray(part.column(1))[ok])

    return both.select("a", "b", "na", "nb", "siga", "sigb").mapInArrow(run, "a long, b long")


def estimate(equal: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard from the share of equal registers, less the expected chance collisions of cut-off registers."""
    ratio = na / np.maximum(nb, 1)
    chance = 0.169919487159739 * 2.0**-MANTISSA * 4 * ratio / (1 + ratio) ** 2
    return (equal - chance) / (1 - chance)


def verified(pairs: DataFrame, sets_of: Callable[[np.ndarray], DataFrame], cfg: Banding, name: str) -> DataFrame:
    """Pairs (a, b) whose full sets have 100 * intersection >= percent * union, as edges (u, v)."""
    pairs = stored(pairs.distinct(), name)
    ids = pairs.select(F.col("a").alias("pid")).unionByName(pairs.select(F.col("b").alias("pid"))).distinct()
    sets = sets_of(bloom(ids))
    x = pairs.join(sets.select(F.col("pid").alias("a"), F.col("set").alias("x")), "a")
    y = x.join(sets.select(F.col("pid").alias("b"), F.col("set").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    out = stored(y.where(both * 100 >= (F.size("x") + F.size("y") - both) * cfg.percent).select(F.col("a").alias("u"), F.col("b").alias("v")), name)
    discard(pairs)
    return out


def _hooked(label: DataFrame | None, links: DataFrame, name: str) -> DataFrame:
    """(pid, c): labels after more links (u, v): every label hooks on to the smallest one it is linked with, and
    once more on to that one's.  Equal labels are one component; one component may still have several."""
    if label is None:
        edge = links.select(F.greatest("u", "v").alias("x"), F.least("u", "v").alias("y"))
    else:
        cu, cv = label.select(F.col("pid").alias("u"), F.col("c").alias("cu")), label.select(F.col("pid").alias("v"), F.col("c").alias("cv"))
        both = links.join(cu, "u", "left").join(cv, "v", "left").select(F.coalesce("cu", "u").alias("p"), F.coalesce("cv", "v").alias("q"))
        edge = both.where("p <> q").select(F.greatest("p", "q").alias("x"), F.least("p", "q").alias("y"))
    up = stored(edge.groupBy("x").agg(F.min("y").alias("y")), name)
    up = up.join(up.select(F.col("x").alias("y"), F.col("y").alias("z")), "y", "left").select(F.col("x").alias("c"), F.coalesce("z", "y").alias("top"))
    if label is None:
        return stored(up.select(F.col("c").alias("pid"), F.col("top").alias("c")), name)
    old = label.join(up, "c", "left").select("pid", F.coalesce("top", "c").alias("c"))
    fresh = up.select(F.col("c").alias("pid"), F.col("top").alias("c")).join(label.select("pid"), "pid", "left_anti")
    return stored(old.unionByName(fresh), name)


def _block_links(rows: DataFrame, sets_of: Callable[[np.ndarray], DataFrame], cfg: Banding, name: str) -> DataFrame:
    """Links (u, v) between members of one bucket that are of different components; rows: (key, pid, n, c).

    For each bucket its most frequent component is m; the members of m, and those of other components that
    meet m in a bucket, are dealt to blocks.  Blocks of the others are compared with each other and with those of m.
    """
    mode = rows.groupBy("key", "c").agg(F.count("*").alias("k")).groupBy("key").agg(F.max_by("c", F.struct("k", "c")).alias("m"))
    part = rows.join(mode, "key").select("m", "pid", "n", "c", (F.col("c") != F.col("m")).alias("other")).distinct()
    part = stored(part, f"{name}-parts")
    blocks = lambda own: F.greatest(F.lit(1), F.ceil(F.sum(F.when(own, 1).otherwise(0)) / BLOCK_SETS), F.ceil(F.sum(F.when(own, F.col("n")).otherwise(0)) / BLOCK_VALUES)).cast("int")
    size = part.groupBy("m").agg(blocks(~F.col("other")).alias("nm"), blocks(F.col("other")).alias("ns"))
    dealt = part.join(size, "m").withColumn("r", F.when(F.col("other"), F.col("nm") + F.pmod(F.xxhash64("pid"), "ns")).otherwise(F.pmod(F.xxhash64("pid"), "nm")).cast("int"))
    dealt = dealt.withColumn("t", F.explode(F.sequence(F.when(F.col("other"), 0).otherwise(F.col("nm")), F.col("nm") + F.col("ns") - 1)))
    sets = sets_of(bloom(part.select("pid").distinct()))
    both = dealt.join(sets, "pid").select("m", F.least("r", "t").alias("p"), F.greatest("r", "t").alias("q"), "r", "pid", "c", "set")
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def side(t: pa.Table):
        lists = t.column("set").combine_chunks()
        value = lists.flatten().to_numpy(zero_copy_only=False)
        n = np.asarray(lists.value_lengths())
        return np.asarray(t.column("pid")), np.asarray(t.column("c")), n, value, np.repeat(np.arange(len(n)), n)

    def compare(t: pa.Table) -> pa.Table:
        r, p, q = (np.asarray(t.column(c)) for c in "rpq")
        a = side(t.filter(pa.array(r == p[0])))
        b = a if p[0] == q[0] else side(t.filter(pa.array(r == q[0])))
        code = np.intersect1d(a[3], b[3])
        inter = np.zeros((len(a[0]), len(b[0])), np.float32)
        at = [np.searchsorted(code, x[3]) for x in (a, b)]
        ok = [(i < len(code)) & (code[np.minimum(i, len(code) - 1)] == x[3]) if len(code) else np.zeros(len(i), bool) for i, x in zip(at, (a, b), strict=True)]
        for lo in range(0, len(code), 4096):
            dense = []
            for x, i, good in zip((a, b), at, ok, strict=True):
                here = good & (i >= lo) & (i < lo + 4096)
                d = np.zeros((len(x[0]), min(4096, len(code) - lo)), np.float32)
                d[x[4][here], i[here] - lo] = 1
                dense.append(d)
            inter += dense[0] @ dense[1].T
        inter = inter.astype(np.int64)
        hit = (100 * inter >= cfg.percent * (a[2][:, None] + b[2][None, :] - inter)) & (a[1][:, None] != b[1][None, :])
        x, y = np.nonzero(hit)
        return pa.Table.from_batches([array_batch(schema, a[0][x], b[0][y])])

    out = stored(both.groupBy("m", "p", "q").applyInArrow(compare, "u long, v long").distinct(), f"{name}-blocklinks")
    discard(part)
    return out


def _candidate_links(bands: DataFrame, reps: DataFrame, sets_of: Callable[[np.ndarray], DataFrame], cfg: Banding, name: str) -> DataFrame:
    """Links (u, v) between members of buckets; bands: (key, pid, n), reps: stored sketches of the pids, for estimates."""
    buckets = bands.groupBy("key").agg(F.min("pid").alias("lead"), F.max("pid").alias("last")).where("lead < last").select("key", "lead")
    inside = stored(bands.join(buckets, "key"), f"{name}-buckets")

    met = inside.where("pid <> lead").groupBy("pid", "lead").agg(F.count("*").alias("c"))
    pairs = met.groupBy("pid").agg(F.max_by("lead", "c").alias("a")).select("a", F.col("pid").alias("b"))
    tried, links, label, old = None, None, None, []
    for step in range(DRAWS + 2):
        if step:
            label = _hooked(label, more, f"{name}-label{step}")
            known = inside.select("key", "pid", "n").join(label, "pid", "left").withColumn("c", F.coalesce("c", "pid"))
            mixed = known.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min_by(F.struct("pid", "c"), F.xxhash64("pid", "key", F.lit(step))).alias("drawn")).where("lo < hi").select("key", "drawn")
            wider = inside
            inside = stored(known.join(mixed, "key").select("key", "pid", "n", "c", F.col("drawn.pid").alias("d"), F.col("drawn.c").alias("cd")), f"{name}-open{step}")
            discard(wider)
            if inside.isEmpty():
                break
            if step > DRAWS:
                small = inside.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") <= SMALL).select("key")
                one, two = (inside.join(small, "key").select("key", F.col("pid").alias(i), F.col("c").alias(c)) for i, c in (("a", "ca"), ("b", "cb")))
                pairs = stored(one.join(two, "key").where("a < b and ca <> cb").select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), f"{name}-small")
                links = links.unionByName(verified(likely(pairs, reps, cfg), sets_of, cfg, f"{name}-smalllinks"))
                old.append(pairs)
                inside = stored(inside.join(small, "key", "left_anti"), f"{name}-large")
                links = links.unionByName(_block_links(inside, sets_of, cfg, name))
                break
            pairs = inside.where("c <> cd").select(F.least("pid", "d").alias("a"), F.greatest("pid", "d").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
        pairs = stored(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), f"{name}-pairs{step}")
        tried = pairs if tried is None else tried.unionByName(pairs)
        more = verified(likely(pairs, reps, cfg), sets_of, cfg, f"{name}-links{step}")
        links = more if links is None else links.unionByName(more)
        old.append(pairs)

    discard(inside, *old)
    return links


def near_classes(rows: DataFrame, sets_of: Callable[[np.ndarray], DataFrame], cfg: Banding, name: str) -> DataFrame:
    """rows: sketches (SKETCH).  Gives (pid, n, component) of every row."""
    rows = stored(rows, f"{name}-sketch")
    light = rows.select("pid", "n", "s1", "s2")
    classes = light.where("n > 0 and pid is not null").groupBy("n", "s1", "s2").agg(F.min("pid").alias("node"), F.max("pid").alias("last")).where("node < last")
    classes = stored(classes, f"{name}-classes")
    copies = stored(light.join(classes, ["n", "s1", "s2"]).where("pid <> node").select("pid", "node"), f"{name}-copies")
    reps = stored(rows.where("n > 0 and pid is not null").join(copies, "pid", "left_anti").select("pid", "n", "sig"), f"{name}-reps")
    links = _candidate_links(band_rows(reps, cfg), reps, sets_of, cfg, name)
    discard(reps)
    groups = components(links, f"{name}-cc")
    out = light.drop("s1", "s2").join(copies.distinct(), "pid", "left").withColumn("node", F.coalesce("node", "pid"))
    return out.join(groups, "node", "left").select("pid", "n", F.coalesce("component", "node").alias("component"))


def linked(rows: DataFrame, sets_of: Callable[[np.ndarray], DataFrame], cfg: Banding, name: str) -> DataFrame:
    """rows: a stored table of pid, n, a set's hash s, its band keys k0, k1, ... and more columns.  Gives those of rows that are linked with another one, and their component."""
    keys = [f"k{i}" for i in range(cfg.bands)]
    reps = rows.groupBy("s").agg(F.min("pid").alias("pid"), F.min("n").alias("n"), F.count("*").alias("copies"), *(F.min(k).alias(k) for k in keys))
    reps = stored(reps, f"{name}-reps")
    twice = stored(reps.where("copies > 1").select("s", F.col("pid").alias("node")), f"{name}-copies")
    bands = reps.select(F.explode(F.array(*keys)).alias("key"), "pid", "n").repartition("key")  # grouped and joined by key in one exchange
    links = _candidate_links(bands, reps, sets_of, cfg, name)
    groups = stored(components(links, f"{name}-cc"), f"{name}-groups")
    own = twice.unionByName(reps.select("s", F.col("pid").alias("node")).join(groups.select("node"), "node", "left_semi").select("s", "node")).distinct()
    own = own.join(groups, "node", "left").select("s", F.coalesce("component", "node").alias("component"))
    own = stored(own, f"{name}-own")
    discard(reps, twice, groups)
    return rows.drop("n", *keys).join(own, "s").drop("s")


def near_documents(docs: DataFrame, cfg: Banding, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs.

    Null, empty or blank texts have no shingles and link with nothing; a text of fewer
    words than a shingle is one shingle.  Ties: the smallest id of a component is kept.
    Repeated rows of one id give a row each and count as one node; a null id links with
    nothing and is not kept.  An empty table gives an empty one.  Other columns are ignored.
    """
    rows = sketch_documents(docs, id_col, text_col, cfg)
    got = near_classes(rows, document_set_rows(docs, id_col, text_col, cfg), cfg, "neardup")
    return got.select(
        F.col("pid").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("pid") == F.col("component"), F.lit(False)).alias("kept")
    )
