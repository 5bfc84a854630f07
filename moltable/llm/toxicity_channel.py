"""Toxicity behind disguises: a noisy channel decoded under a character language model.

The language model is a character trigram counted over every document of the corpus.
A word that looks disguised (digits or signs inside letters, a letter three times, or
letters spaced out) is a lattice: a sign may stand for letters, a repeated letter or a
separator for nothing.  Viterbi decoding under the model finds the likeliest word.
Where a disguise has separators, a second lattice may also end a word at each of them.
Restored and plain words are then scored alike, by a table of words and word beginnings
that labelled documents show to be toxic.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .neardup import Banding, near_documents
from .shared import U64, Words, array_batch, fresh, mix, plain, signed, slices, stored

#: Letters of the model beside a-z, and what signs stand for.
ACCENTED = "àáâãäåæçèéêëìíîïñòóôõöøùúûüýßœ"
SIGNS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "*": "aeiou"}
SEPARATORS = " .-_*~'"
WORD_END = "\n"  # a wider gap in a spaced-out run
PIECE, OVERLAP = 240, 80
CLASSES = 64
PREFIXES = (4, 5, 6, 8)
LEVELS = 4
LEVEL_BITS = U64(7)
FIT_DOCUMENTS = 8000
TABLE = 20_000
EVIDENCE = 20.0
_CLASS = np.zeros(0x180, np.int64)
for _i, _c in enumerate("abcdefghijklmnopqrstuvwxyz" + ACCENTED, 1):
    _CLASS[ord(_c)] = _i
    if len(_c.upper()) == 1 and ord(_c.upper()) < len(_CLASS):
        _CLASS[ord(_c.upper())] = _i
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in "0123456789@$!|+(*.-_~'"]] = True
_MEANS = _LETTER.copy()
_MEANS[[ord(c) for c in SIGNS]] = True
_REPEATED = re.compile(r"(.)\1{3,}", re.DOTALL)
_PARTS = re.compile(f"[{re.escape(SEPARATORS + WORD_END)}]+")
_FRONT = np.zeros(256, bool)
_FRONT[[ord(c) for c in "\"'([{<.,;:"]] = True
_BACK = np.zeros(256, bool)
_BACK[[ord(c) for c in ".,;:!?\"')]}>*&%$#|"]] = True


@dataclass
class CharModel:
    logp: np.ndarray  # [a, b, c]: log P(c | a b)
    memo: dict[str, str] = field(default_factory=dict)

    @staticmethod
    def of(counts: np.ndarray) -> CharModel:
        tri = counts.reshape(CLASSES, CLASSES, CLASSES).astype(np.float64)
        bi, uni = tri.sum(0), tri.sum((0, 1))
        p1 = (uni + 1) / (uni.sum() + CLASSES)
        p2 = (bi + 5 * p1) / (bi.sum(1, keepdims=True) + 5)
        p3 = (tri + 5 * p2[None]) / (tri.sum(2, keepdims=True) + 5)
        return CharModel(np.log(p3).astype(np.float32))

    def restore(self, seen: str, breaks: bool = False) -> str:
        """The likeliest letters behind a lower-case disguise; with breaks, words of them."""
        key = f"\0{seen}" if breaks else seen
        got = self.memo.get(key)
        if got is None:
            if len(self.memo) > 100_000:
                self.memo.clear()
            got = self.memo[key] = self._viterbi(seen, breaks)
        return got

    def readings(self, seen: str) -> list[str]:
        """As one word and, if there are separators, as likely words and as its parts; what is longer than PIECE in overlapping pieces."""
        out = [self.restore(seen.replace(WORD_END, " "))] if len(seen) <= PIECE else []
        if len(seen) > PIECE:
            seen = _REPEATED.sub(r"\1\1\1", seen)
        for at in range(0, max(1, len(seen) - OVERLAP), PIECE - OVERLAP):
            piece = seen[at : at + PIECE]
            split = any(c in piece for c in SEPARATORS + WORD_END)
            if split or piece != seen or not out:
                out.append(self.restore(piece, split))
        parts = _PARTS.split(seen)
        if len(parts) > 1:
            out.append(" ".join(self.restore(x) for x in parts if 2 <= len(x) <= PIECE))
        return list(dict.fromkeys(x for x in out if x))

    def _viterbi(self, seen: str, breaks: bool) -> str:
        """States are the last two letters; of the ways into a state the best is kept, with a link back."""
        logp = self.logp
        best = {(0, 0): (0.0, None)}
        before = ""
        for c in seen:
            arcs = [(x, 0.0 if x == c else 0.7 if c != "*" else 2.0) for x in ([c] if c < "\x7f" and c.isalpha() or c in ACCENTED else []) + list(SIGNS.get(c, ""))]
            silent = 0.4 if c in SEPARATORS else 1.0 if c == before else None
            ends = 0.4 if breaks and c in SEPARATORS else 0.0 if c == WORD_END else None
            if not arcs and silent is None and ends is None:
                silent = 3.0
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (score, link) in best.items():
                if silent is not None:
                    s = score - silent
                    if (a, b) not in new or s > new[(a, b)][0]:
                        new[(a, b)] = (s, link)
                if ends is not None:
                    s = score + float(logp[a, b, 0]) - ends
                    if (b, 0) not in new or s > new[(b, 0)][0]:
                        new[(b, 0)] = (s, (" ", link))
                for x, cost in arcs:
                    k = int(_CLASS[ord(x)])
                    s = score + float(logp[a, b, k]) - cost + LETTER_GAIN
                    if (b, k) not in new or s > new[(b, k)][0]:
                        new[(b, k)] = (s, (x, link))
            best, before = new, c
        _, (_, link) = max(((s + float(logp[a, b, 0]), (s, link)) for (a, b), (s, link) in best.items()), key=lambda v: v[0])
        out = []
        while link is not None:
            out.append(link[0])
            link = link[1]
        return "".join(reversed(out))


#: A letter's gain over silence, so that the model does not favour short words.
LETTER_GAIN = 2.5


def count_characters(docs: DataFrame) -> np.ndarray:
    """Trigram counts over all texts; as many numbers as the alphabet cubed, whatever the corpus."""
    schema = pa.schema([("g", pa.int64()), ("n", pa.int64())])

    def run(batches):
        total = np.zeros(CLASSES**3, np.int64)
        for batch in batches:
            for _, _, data, off in slices(batch.column(0)):
                point = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
                c = _CLASS[np.where(point < len(_CLASS), point, 0)]
                row = np.repeat(np.arange(len(off) - 1), np.diff(np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[off]))
                if len(c) > 2:
                    own = row[:-2] == row[2:]  # no trigram goes over a row's end
                    total += np.bincount(((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:])[own], minlength=CLASSES**3)
        at = np.flatnonzero(total)
        if len(at):
            yield array_batch(schema, at, total[at])

    got = plain(docs, "text").mapInArrow(run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(CLASSES**3, np.int64)
    out[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return out


def disguised(w: Words) -> tuple[list[str], np.ndarray]:
    """Lower-case disguises of a slice and their rows."""
    data, start, end = w.data, w.start.copy(), w.end.copy()
    if not len(start):
        return [], np.zeros(0, np.int64)
    for _ in range(4):
        start += (end > start) & _FRONT[data[np.minimum(start, len(data) - 1)]]
        end -= (end > start) & _BACK[data[end - 1]]
    count = lambda flag: (lambda c: c[end] - c[start])(np.concatenate([[0], np.cumsum(flag)]))
    thrice = np.zeros(len(data), bool)
    thrice[2:] = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & _LETTER[data[2:]]
    inner = np.minimum(start + 2, end)
    runs = np.concatenate([[0], np.cumsum(thrice)])
    odd = (count(_SIGN[data]) > 0) & (count(_MEANS[data]) >= 2) | (runs[end] - runs[inner] > 0)
    texts = [data[a:b].tobytes().decode("utf-8") for a, b in zip(start[odd], end[odd], strict=True)]
    rows = w.row[odd]
    # words of one letter or sign in a row are one disguise, where a gap wider than its least one ends a word
    head = data[np.minimum(start, len(data) - 1)]
    one = (end - start == 1) & (_LETTER | _SIGN)[head] | (end - start == 2) & ((head == 0xC3) | (head == 0xC5))
    edge = np.flatnonzero(np.diff(np.concatenate([[0], one.astype(np.int8), [0]])))
    more, of = [], []
    for a, b in zip(edge[::2], edge[1::2], strict=True):
        cut = [a, *(np.flatnonzero(np.diff(w.row[a:b])) + a + 1), b]
        for i, j in zip(cut, cut[1:], strict=False):
            if j - i >= 2:
                gap = w.start[i + 1 : j] - w.end[i : j - 1]
                wide = [WORD_END if g else " " for g in gap > gap.min()] + [""]
                more.append("".join(data[p:q].tobytes().decode("utf-8").lower() + g for p, q, g in zip(start[i:j], end[i:j], wide, strict=True)))
                of.append(w.row[i])
    return texts + more, np.concatenate([rows, np.array(of, np.int64)])


def features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """4 x words hashes (the word, and its beginnings where it is longer; else 0) and the rows."""
    start, end = w.start.copy(), w.end.copy()
    for _ in range(4):
        if len(start):
            start += (end > start) & _FRONT[w.data[np.minimum(start, len(w.data) - 1)]]
            end -= (end > start) & _BACK[w.data[end - 1]]
    ok = end > start
    start, end = start[ok], end[ok]
    out = np.zeros((1 + len(PREFIXES), len(start)), U64)
    out[0] = w.span_hash(start, end)
    for i, k in enumerate(PREFIXES, 1):
        has = end - start > k
        out[i, has] = mix(w.span_hash(start[has], start[has] + k), k)
    return out, w.row[ok]


def slice_words(data: np.ndarray, off: np.ndarray, model: CharModel) -> tuple[np.ndarray, np.ndarray]:
    """features() of plain and restored words."""
    w = Words(data, off)
    h, row = features(w)
    seen, of = disguised(w)
    if seen:
        ways = [model.readings(s) for s in seen]
        of = np.repeat(of, [len(x) for x in ways])
        back = [x.encode("utf-8") for way in ways for x in way]
        edge = np.concatenate([[0], np.cumsum([len(b) for b in back])])
        more = Words(np.frombuffer(b"".join(back), np.uint8), edge)
        if len(more.start):
            h2, r2 = features(more)
            h, row = np.concatenate([h, h2], 1), np.concatenate([row, of[r2]])
    return h, row


def word_evidence(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Evidence of the distinct words of each row, as kinds x words, and the rows.

    A kind is the word itself, or one of its beginnings shared by at least 1..LEVELS distinct
    words of the row; 0 where it doesn't hold.  The last three bits of a hash are the level.
    """
    order = np.lexsort((h[0], row))
    h, row = h[:, order] & ~LEVEL_BITS, row[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[0, 1:] != h[0, :-1])
    h, row = h[:, new], row[new]
    out = [h[0]]
    for own in h[1:]:
        _, back, n = np.unique(own + row.astype(U64) * U64(0xD6E8FEB86659FD93), return_inverse=True, return_counts=True)
        out += [np.where((own > 0) & (n[back] >= k), own | U64(k), U64(0)) for k in range(1, LEVELS + 1)]
    return np.stack(out), row


@dataclass(frozen=True)
class Lexicon:
    keys: np.ndarray
    p: np.ndarray
    weight: np.ndarray  # of hits(), for the logit of a document's score

    def hits(self, h: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """rows x 5: one; 1, 2, and 3 or more distinct words with a hit; and the sum over them of -log(1 - p), at most 8.

        p of a word is the greatest probability of its kinds of evidence.
        """
        out = np.zeros((rows, 5))
        out[:, 0] = 1
        if not len(self.keys) or not h.size:
            return out
        plain, base = np.unique(self.keys & ~LEVEL_BITS), h & ~LEVEL_BITS
        at = np.minimum(np.searchsorted(plain, base), len(plain) - 1)
        maybe = (plain[at] == base).any(0)
        e, row = word_evidence(h[:, maybe], row[maybe])
        at = np.minimum(np.searchsorted(self.keys, e), len(self.keys) - 1)
        p = np.where(self.keys[at] == e, self.p[at], 0.0).max(0) if e.size else np.zeros(0)
        n = np.bincount(row[p > 0], minlength=rows)
        out[:, 1], out[:, 2], out[:, 3] = n == 1, n == 2, n > 2
        out[:, 4] = np.minimum(np.bincount(row, -np.log1p(-p), rows), 8)
        return out

    def score(self, h: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        return 1 / (1 + np.exp(-self.hits(h, row, rows) @ self.weight))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 25) -> np.ndarray:
    """Newton's method; the first weight, of the constant, is not shrunk."""
    w = np.zeros(x.shape[1])
    shrink = np.full(len(w), ridge)
    shrink[0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink)
        w += np.linalg.solve(hess, x.T @ (y - p) - shrink * w)
    return w


def copies(docs: DataFrame) -> DataFrame:
    """(doc_id, copy): copy is the same for near copies, of 80 % of word pairs alike, and null for texts without words."""
    got = near_documents(docs, Banding(shingle=2))
    return got.groupBy("doc_id").agg(F.min(F.when(F.col("n_shingles") > 0, F.col("component_id"))).alias("copy"))


def fit(docs: DataFrame, labels: DataFrame, model: CharModel, documents: int = FIT_DOCUMENTS, table: int = TABLE) -> Lexicon:
    """labels: (doc_id, label 0 or 1).  Learns from at most `documents` labelled rows, those of the least hash of doc_id.

    The lexicon holds at most `table` pieces of evidence, those of most toxic rows.  Near copies among them count once: of documents of one component of near copies and one label that of the least id stays.
    """
    spark = docs.sparkSession
    chosen = labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").cast("long").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(documents)
    few = stored(plain(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text"), "tox-fit")
    sent = spark.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("label", pa.int64()), ("h", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            for a, b, data, off in slices(batch.column(2)):
                h, row = slice_words(data, off, sent.value)
                e, of = word_evidence(h, row)
                n = np.cumsum(np.bincount(of, minlength=b - a))[:-1]
                lists = []
                for x in np.split(e, n, axis=1):
                    own = np.unique(x)
                    lists.append(signed(own[own > 0].copy()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(lists, pa.list_(pa.int64()))], schema=schema)

    rows = few.mapInArrow(run, "doc_id long, label long, h array<long>").join(copies(few), "doc_id")
    rows = stored(rows.groupBy("label", "copy").agg(F.min(F.struct("doc_id", "h")).alias("first")).select("label", "first.h"), "tox-features")
    toxic, total = rows.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count("*")).first()
    if not toxic or toxic == total:
        return Lexicon(np.zeros(0, U64), np.zeros(0), np.array([0 if not total else 3 if toxic else -3, 0, 0, 0, 0], np.float64))
    rate = toxic / total
    freq = rows.select("label", F.explode("h").alias("f")).groupBy("f").agg(F.sum("label").alias("t"), F.count("*").alias("n"))
    p = (F.col("t") + rate) / (F.col("n") + 1)
    t, n, share = F.col("t"), F.col("n"), F.col("t") / F.col("n")
    other = F.when(t < n, (n - t) * F.log((1 - share) / (1 - rate))).otherwise(0.0)
    gain = 2 * (F.when(t > 0, t * F.log(share / rate)).otherwise(0.0) + other)  # likelihood ratio against the overall rate
    good = freq.where((t >= max(3, toxic // 100)) & (p >= max(0.5, rate)) & (gain >= EVIDENCE)).select("f", p.alias("p"), "t").orderBy(F.desc("t"), "f").limit(table).toPandas()
    keys = good.f.to_numpy().astype(np.int64).view(U64)
    order = np.argsort(keys)
    keys, p = keys[order], np.minimum(good.p.to_numpy(np.float64)[order], 0.999)
    found = Lexicon(keys, p, np.zeros(5))

    def count(batches):
        for batch in batches:
            for a, b, data, off in slices(batch.column(2)):
                x = found.hits(*slice_words(data, off, sent.value), b - a)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), *(pa.array(c) for c in x.T)], names=["label", *"abcde"])

    seen = few.mapInArrow(count, "label long, a double, b double, c double, d double, e double").toPandas()
    return Lexicon(keys, p, logistic(seen[list("abcde")].to_numpy(), seen.label.to_numpy()))


def scored(docs: DataFrame, model: CharModel, lexicon: Lexicon, keep: list[str] | None = None, name: str | None = None) -> DataFrame:
    """The columns `keep` of docs (all by default) with a score column, 0 to 1, `name`: toxicity, or where docs has
    that column toxicity_ and so on.

    A null, empty or blank text has the score of a document without toxic words.  Null ids and
    repeated rows pass through; an empty table gives an empty one.
    """
    keep = docs.columns if keep is None else keep
    name = name or fresh(docs.select(*(F.col(f"`{c}`") for c in keep)), "toxicity")
    sent = docs.sparkSession.sparkContext.broadcast((model, lexicon))

    def run(batches):
        m, lex = sent.value
        for batch in batches:
            score = np.zeros(batch.num_rows)
            for a, b, data, off in slices(batch.column(0)):
                score[a:b] = lex.score(*slice_words(data, off, m), b - a)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(np.clip(score, 0, 1))], names=[*keep, name])

    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(name, T.DoubleType())])
    return docs.select(F.col("text"), *(F.col(f"`{c}`") for c in keep)).mapInArrow(run, schema)
