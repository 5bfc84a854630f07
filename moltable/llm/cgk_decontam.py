"""Benchmark passages in documents: CGK embedding, bit sampling, exact edit distance.

The CGK walk copies the character under a pointer to the output at every step and moves
the pointer on if a random bit of (step, character) says so.  Two texts of small edit
distance walk together most of the time, so their outputs have small Hamming distance.
A key samples some output positions; `repeats` walks with a key each are drawn.

Windows of items start at each of their words, windows of documents at every second
word, so that an item in a document has several aligned pairs of windows, each with
`repeats` chances.  A pair with a common key goes on if the outputs agree in at least
`least` steps and in a share of `agree` of those within the item, and if the 60 bytes
at the window align with at most `near` of them edited.  Then the document around the
place of the whole item is aligned with the item by edit distance, bit-parallel.  At
most `edits` of an item's length may differ.

Texts are compared as lower-case A-Z bytes with runs of white space as one space.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import SPACE, U64, _LOWER, mix, plain, slices

BLOCK_BYTES = 4 << 20
FILTER = 1 << 20
NEAR = 60


@dataclass(frozen=True)
class Walk:
    steps: int = 110
    sampled: int = 36
    samples: int = 10
    repeats: int = 3
    stride: int = 2
    tail: int = 24
    agree: float = 0.35
    least: int = 30
    near: float = 0.4
    edits: float = 0.2
    seed: int = 7

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.Generator(np.random.PCG64(self.seed))
        bits = rng.integers(0, 2, (self.repeats, self.steps, 256), dtype=np.uint8)
        picks = np.stack([np.sort(rng.choice(self.sampled, self.samples, replace=False)) for _ in range(self.repeats)])
        return bits, picks


def normal(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised bytes, their offsets, and the source byte of each."""
    space = SPACE[data]
    keep = ~space
    keep[1:] |= ~space[:-1]
    keep[off[:-1][off[:-1] < len(data)]] = True
    source = np.flatnonzero(keep)
    out = _LOWER[data[source]]
    out[space[source]] = 32
    return out, np.searchsorted(source, off), source


def word_starts(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places where words start, their rows, and their numbers in the row."""
    word = data != 32
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    start = np.flatnonzero(word & (edge[:-1] | np.concatenate([[True], ~word[:-1]]))) if len(data) else np.zeros(0, np.int64)
    row = np.searchsorted(off, start, "right") - 1
    return start, row, np.arange(len(start)) - np.searchsorted(row, row)


def walk(padded: np.ndarray, start: np.ndarray, bits: np.ndarray, picks: np.ndarray, rep: int, whole: bool = False):
    """Key of each window in walk `rep`; with whole, the output of all steps."""
    at = start.astype(np.intp)
    key = np.zeros(len(at), np.uint64)
    out = np.zeros((len(at), bits.shape[1]), np.uint8) if whole else None
    take = set(picks[rep].tolist())
    for j in range(bits.shape[1] if whole else int(picks[rep][-1]) + 1):
        c = padded[at]
        if j in take:
            key *= U64(0x9E3779B97F4A7C15)
            key += c
        if whole:
            out[:, j] = c
        at += bits[rep, j][c]
    return mix(key, rep + 1), out


def align(item: bytes, text: bytes, most: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the best place of item in text, or None if over `most`; the first of equals."""

    def ends(p: bytes, t: bytes, anchored: bool) -> tuple[int, int]:
        n = len(p)
        mask, high = (1 << n) - 1, 1 << (n - 1)
        eq: dict[int, int] = {}
        for i, c in enumerate(p):
            eq[c] = eq.get(c, 0) | 1 << i
        vp, vn, score = mask, 0, n
        best = (n, 0) if anchored else (n + 1, 0)
        for j, c in enumerate(t, 1):
            x = eq.get(c, 0) | vn
            d0 = ((vp + (x & vp)) ^ vp) | x
            hn, hp = vp & d0, vn | (mask & ~(vp | d0))
            score += bool(hp & high) - bool(hn & high)
            hp = (hp << 1 | anchored) & mask
            hn = hn << 1 & mask
            vp, vn = (hn | (mask & ~(d0 | hp))) & mask, d0 & hp
            if score < best[0]:
                best = (score, j)
        return best

    if item in text:
        at = text.index(item)
        return 0, at, at + len(item)
    score, end = ends(item, text, False)
    if score > most:
        return None
    _, back = ends(item[::-1], text[:end][::-1], True)
    return score, end - back, end


class Index:
    """Keys of all windows of a block of items."""

    def __init__(self, items: list[tuple[int, str]], cfg: Walk):
        self.cfg = cfg
        self.bits, self.picks = cfg.tables()
        self.ids, self.texts = [], []
        self.exact: list[int] = []
        windows = []
        for i, text in items:
            raw = np.frombuffer(text.encode("utf-8"), np.uint8)
            t = normal(raw, np.array([0, len(raw)]))[0].tobytes().strip()
            if not t:
                continue
            k = len(self.ids)
            self.ids.append(i)
            self.texts.append(t)
            a = np.frombuffer(t, np.uint8)
            start = word_starts(a, np.array([0, len(a)]))[0]
            start = start[start <= len(a) - cfg.tail]
            if len(start) < cfg.stride:  # too short for the stride: only exact places are looked for
                self.exact.append(k)
            windows += [(k, int(s)) for s in start]
        joined, at = [], []
        place = 0
        for t in self.texts:
            at.append(place)
            joined.append(t + b"\0" * (cfg.steps + 1))
            place += len(t) + cfg.steps + 1
        self.data = np.frombuffer(b"".join(joined) or b"\0", np.uint8)
        self.of = np.array([k for k, _ in windows], np.int64)
        self.shift = np.array([s for _, s in windows], np.int64)
        self.start = np.array([at[k] + s for k, s in windows], np.int64)
        self.keys, self.order, self.filter, self.out = [], [], [], []
        for rep in range(cfg.repeats):
            key, out = walk(self.data, self.start, self.bits, self.picks, rep, True)
            order = np.argsort(key, kind="stable")
            maybe = np.zeros(FILTER, bool)
            maybe[key % U64(FILTER)] = True
            self.keys.append(key[order])
            self.order.append(order)
            self.filter.append(maybe)
            self.out.append(out)

    def candidates(self, padded: np.ndarray, start: np.ndarray):
        """(window of start, window of items) pairs whose keys and outputs agree in one walk."""
        for rep in range(self.cfg.repeats):
            key, _ = walk(padded, start, self.bits, self.picks, rep)
            hit = np.flatnonzero(self.filter[rep][key % U64(FILTER)])
            lo, hi = (np.searchsorted(self.keys[rep], key[hit], side) for side in ("left", "right"))
            n = hi - lo
            a = np.repeat(hit, n)
            if not len(a):
                continue
            b = self.order[rep][np.repeat(lo, n) + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)]
            _, mine = walk(padded, start[a], self.bits, self.picks, rep, True)
            theirs = self.out[rep][b]
            equal = ((mine == theirs) & (theirs > 0)).sum(1)  # steps within the item only
            ok = (equal >= self.cfg.least) & (equal >= self.cfg.agree * (theirs > 0).sum(1))
            yield a[ok], b[ok]

    def search(self, data: np.ndarray, off: np.ndarray):
        """(row, item, source start byte, source end byte, distance): the best place of each item found in each row."""
        text, toff, source = normal(data, off)
        start, row, number = word_starts(text, toff)
        take = number % self.cfg.stride == 0
        start, row = start[take], row[take]
        padded = np.concatenate([text, np.zeros(self.cfg.steps + 1, np.uint8)])
        wanted: dict[tuple[int, int, int], bool] = {}
        if len(self.of) and len(start):
            for a, b in self.candidates(padded, start):
                place = (start[a] - self.shift[b] - toff[row[a]]) // 16
                for r, k, p, s, shift in zip(row[a].tolist(), self.of[b].tolist(), place.tolist(), start[a].tolist(), self.shift[b].tolist(), strict=True):
                    if not wanted.get((r, k, p)):
                        part = self.texts[k][shift : shift + NEAR]
                        most = int(len(part) * self.cfg.near)
                        wanted[(r, k, p)] = align(part, text[s : min(toff[r + 1], s + len(part) + most)].tobytes(), most) is not None
        best: dict[tuple[int, int], tuple[int, int, int]] = {}

        def offer(r: int, k: int, lo: int, piece: bytes, most: int) -> None:
            got = align(self.texts[k], piece, most)
            if got:
                d, s, e = got
                best[(r, k)] = min(best.get((r, k), (1 << 30, 0, 0)), (d, int(lo + s), int(lo + e)))

        for r, k, place in sorted(w for w, ok in wanted.items() if ok):
            item = self.texts[k]
            most = int(len(item) * self.cfg.edits)
            if best.get((r, k), (1,))[0] == 0:
                continue
            lo = max(toff[r], toff[r] + place * 16 - most)
            offer(r, k, lo, text[lo : min(toff[r + 1], toff[r] + place * 16 + 16 + len(item) + most)].tobytes(), most)
        if self.exact:
            for r in range(len(off) - 1):
                whole = text[toff[r] : toff[r + 1]].tobytes()
                for k in self.exact:
                    if self.texts[k] in whole:
                        offer(r, k, toff[r], whole, 0)
        for (r, k), (d, s, e) in sorted(best.items()):
            yield r, k, int(source[s] - off[r]), int(source[e - 1] + 1 - off[r]), d


def contaminated(docs: DataFrame, items: DataFrame, cfg: Walk = Walk()) -> DataFrame:
    """(doc_id, item_id, start, end, distance, item_length): a row for each item found in a document.

    start and end are code points of the text.  Of several places of an item in a document the
    nearest one, then the first, is given.  Items go to the executors in blocks of bounded size,
    each of which passes over the documents.  Null, empty and blank texts and items match
    nothing; repeated rows of either table give repeated rows; a null id stays null.  Items of
    fewer than `stride` words 24 bytes before their end are looked for exactly only.
    """
    spark = docs.sparkSession
    items = plain(items, "item_id", "text").where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("distance", pa.int64()), ("item_length", pa.int64())])
    out = None
    for k in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        sent = spark.sparkContext.broadcast(Index([(r[0], r[1]) for r in own.collect()], cfg))

        def run(batches, sent=sent):
            for batch in batches:
                index: Index = sent.value
                rows = []
                for a, _, data, off in slices(batch.column(1)):
                    for r, k, s, e, d in index.search(data, off):
                        raw = data[off[r] : off[r] + e].tobytes()
                        first = len(raw[:s].decode("utf-8"))
                        rows.append((batch.column(0)[a + r].as_py(), index.ids[k], first, first + len(raw[s:].decode("utf-8", "ignore")), d, len(index.texts[k])))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        found = plain(docs, "doc_id", "text").mapInArrow(run, "doc_id long, item_id long, start long, end long, distance long, item_length long")
        out = found if out is None else out.unionByName(found)
    return out
