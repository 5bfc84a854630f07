"""Token counts by a two-tier lookup on the map side.

The lengths in tokens of frequent pre-tokens go to every worker as one open-addressed hash
table; what it does not hold is encoded, once a worker while its bounded cache lasts.  Pre-tokens
are never shuffled: a slice of texts is split by array passes, all its pre-tokens are looked
up at once, and sums by text are the answer.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from .pretokens import Spec, Splitter, sent
from .shared import U64, array_batch, plain, signed

#: Longer pre-tokens are encoded where they stand, not looked up by their hash.
LONG = 48
EMPTY = U64(0)
GAP = re.compile(r"[ \t\n\r]")


@dataclass(frozen=True)
class Lookup:
    """How the two tiers are sized; none of these numbers changes a count.

    frequent: entries of the broadcast table (10 bytes and a load of one half: 1.3 MB).
    sample: about so many whole texts, drawn from all rows, say which pre-tokens are frequent.
    cached: entries of a worker's cache, which is emptied when full.
    segment: characters split at once; longer texts are cut behind white space.
    """

    frequent: int = 1 << 16
    sample: int = 2000
    cached: int = 400_000
    segment: int = 1 << 19
    limit: int = 2048


class Table:
    """Open addressing with linear probing over two arrays: hashes, and lengths in tokens."""

    def __init__(self, keys: np.ndarray, lengths: np.ndarray):
        size = 1 << max(4, int(2 * len(keys)).bit_length())
        self.mask = U64(size - 1)
        self.keys, self.lengths = np.zeros(size, U64), np.zeros(size, np.uint16)
        left, at = np.arange(len(keys)), keys & self.mask
        while len(left):
            free = self.keys[at] == EMPTY
            self.keys[at[free]] = keys[left[free]]  # of several that want one slot the last stays
            own = self.keys[at] == keys[left]
            self.lengths[at[own]] = lengths[left[own]]
            left, at = left[~own], (at[~own] + U64(1)) & self.mask

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Lengths, -1 where the table does not hold the key."""
        at = keys & self.mask
        found = self.keys[at]
        out = np.where(found == keys, self.lengths[at].astype(np.int64), -1)
        left = np.flatnonzero((found != keys) & (found != EMPTY))
        at = at[left]
        while len(left):
            at = (at + U64(1)) & self.mask
            found = self.keys[at]
            hit = found == keys[left]
            out[left[hit]] = self.lengths[at[hit]]
            on = ~hit & (found != EMPTY)
            left, at = left[on], at[on]
        return out


class Counter:
    """Splits and encodes in one worker."""

    def __init__(self, spec: Spec):
        self.splitter = Splitter(spec)
        self.tok = Tokenizer.from_str(spec.text)
        self.model, self.bytes = self.tok.model, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.cache: dict[int, int] = {}

    def length(self, word: str) -> int:
        """Tokens of one pre-token: its bytes as the model spells them, then the merges."""
        return sum(len(self.model.tokenize(p)) for p, _ in self.bytes.pre_tokenize_str(word))

    def pieces(self, texts: list[str], cfg: Lookup) -> Iterator[tuple[int, str]]:
        """(place of the text, segment) with special tokens taken out: each stands as a line break.

        Pre-tokens never reach over white space, so a cut behind it changes nothing.
        """
        for k, t in enumerate(texts):
            at = 0
            while len(t) - at > cfg.segment:
                gap = GAP.search(t, at + cfg.segment)
                if not gap:
                    break
                yield k, t[at : gap.end()]
                at = gap.end()
            yield k, t[at:]

    def groups(self, texts: list[str], cfg: Lookup) -> Iterator[tuple[list[int], list[str]]]:
        """Segments gathered until some `segment` characters are together."""
        where, parts, size = [], [], 0
        for k, s in self.pieces(texts, cfg):
            if parts and size + len(s) > cfg.segment:
                yield where, parts
                where, parts, size = [], [], 0
            where.append(k)
            parts.append(s)
            size += len(s)
        if parts:
            yield where, parts

    def spread(self, where: list[int], parts: list[str], special: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(points, start, end, hash, text's place) of all pre-tokens; special tokens are counted on the way."""
        arrays, ends, total = [], [], 0
        for k, s in zip(where, parts, strict=True):
            if "<" in s or not s.isascii():
                for mark in self.splitter.special:
                    if n := s.count(mark):
                        special[k] += n
                        s = s.replace(mark, "\n")
            arrays.append(self.splitter.points(s + "\n"))
            total += len(arrays[-1])
            ends.append(total)
        points = np.concatenate(arrays)
        start, end = self.splitter.split(points)
        return points, start, end, self.splitter.hashes(points, start, end), np.asarray(where)[np.searchsorted(ends, start, "right")]

    def count(self, texts: list[str], table: Table, cfg: Lookup) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        for where, parts in self.groups(texts, cfg):
            points, start, end, h, row = self.spread(where, parts, out)
            got = table.get(h)
            far = np.flatnonzero((end - start > LONG) & (got >= 0))
            got[far] = -1
            miss = np.flatnonzero(got < 0)
            long = miss[end[miss] - start[miss] > LONG]
            short = miss[end[miss] - start[miss] <= LONG]
            for i in long:
                got[i] = self.length(points[start[i] : end[i]].tobytes().decode("utf-32-le"))
            keys, first, back = np.unique(h[short], return_index=True, return_inverse=True)
            got[short] = np.fromiter((self._cached(key, points, start[i], end[i], cfg) for key, i in zip(keys.tolist(), short[first].tolist(), strict=True)), np.int64, len(keys))[back]
            out += np.bincount(row, got, len(texts)).astype(np.int64)
        return out

    def _cached(self, key: int, points: np.ndarray, start: int, end: int, cfg: Lookup) -> int:
        n = self.cache.get(key)
        if n is None:
            if len(self.cache) >= cfg.cached:
                self.cache.clear()
            n = self.cache[key] = self.length(points[start:end].tobytes().decode("utf-32-le"))
        return n


@lru_cache(maxsize=1)
def counter(spec: Spec) -> Counter:
    return Counter(spec)


def frequent(docs: DataFrame, vocabulary: str, cfg: Lookup = Lookup(), text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Hashes and token lengths of the most frequent pre-tokens of a sample of whole texts.

    The sample is dealt to eight tasks, each of which gives its most frequent pre-tokens with their
    counts, at most cfg.frequent; their union, cut to that many, is all that reaches the driver.
    """
    texts = plain(docs, text_col).where(F.col(f"`{text_col}`").isNotNull())
    rows = texts.count()
    if not rows:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    spec = sent(docs.sparkSession, vocabulary)
    schema = pa.schema([("h", pa.int64()), ("n", pa.int64()), ("tokens", pa.int64())])

    def run(batches):
        c = counter(spec.value)
        seen: dict[int, list] = {}
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                texts = batch.column(0).slice(a, 64).to_pylist()
                for where, parts in c.groups(texts, cfg):
                    points, start, end, h, _ = c.spread(where, parts, np.zeros(len(texts), np.int64))
                    short = np.flatnonzero(end - start <= LONG)
                    keys, first, n = np.unique(h[short], return_index=True, return_counts=True)
                    for key, i, k in zip(keys.tolist(), short[first].tolist(), n.tolist(), strict=True):
                        if key in seen:
                            seen[key][0] += k
                        else:
                            seen[key] = [k, points[start[i] : end[i]].tobytes().decode("utf-32-le")]
                if len(seen) > 8 * cfg.frequent:
                    seen = dict(sorted(seen.items(), key=lambda x: -x[1][0])[: 4 * cfg.frequent])
        best = sorted(seen.items(), key=lambda x: (-x[1][0], x[0]))[: cfg.frequent]
        if best:
            yield array_batch(schema, signed(np.array([k for k, _ in best], U64)), [v[0] for _, v in best], [c.length(v[1]) for _, v in best])

    drawn = texts.sample(min(1.0, cfg.sample / rows), seed=11).repartition(8)
    got = drawn.mapInArrow(run, "h long, n long, tokens long").toArrow()
    keys, back = np.unique(got.column("h").to_numpy().view(U64), return_inverse=True)
    n, tokens = np.bincount(back, got.column("n").to_numpy(), len(keys)), np.zeros(len(keys), np.int64)
    tokens[back] = got.column("tokens").to_numpy()
    best = np.argsort(-n, kind="stable")[: cfg.frequent]
    best = best[(keys[best] != EMPTY) & (tokens[best] < 1 << 16)]
    return keys[best], tokens[best]


def counts(docs: DataFrame, vocabulary: str, cfg: Lookup = Lookup(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every whole text, as the file's library counts it without added tokens.

    A null text is empty: 0 bytes and tokens.  Repeated rows each give a row and a null id stays null;
    an empty table gives an empty one; other columns are left behind, whatever their names.  Of a
    text of any length only a segment is split at a time.  Pre-tokens of up to 48 code points are told
    apart by 64-bit hashes.
    """
    spec = sent(docs.sparkSession, vocabulary)
    table = docs.sparkSession.sparkContext.broadcast(frequent(docs, vocabulary, cfg, text_col))
    schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches):
        c, known = counter(spec.value), Table(*table.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                n = c.count([t or "" for t in part.column(1).to_pylist()], known, cfg)
                yield array_batch(schema, part.column(0), part.column(2), n, n > cfg.limit)

    size = F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)).cast("long")
    src = docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`"), size)
    return src.toDF("id", "text", "size").mapInArrow(run, "id long, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
