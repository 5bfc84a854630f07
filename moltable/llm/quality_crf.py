"""Document quality from a linear-chain conditional random field over lines.

Every non-blank line is good or bad.  Features of a line are shares and densities of
its bytes and words, and those of the line before and after it; the chain's
transition weights tie neighbours.  Only documents are labelled, so each line of a
labelled document has the document's label when fitting.  A document's score is the
mean of its lines' forward-backward marginals for "good", weighted by their length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Words, array_batch, fresh, plain, slices

FIT_DOCUMENTS = 2500
FIT_LINES = 2000
FIT_BLOCK = 50
OWN = 11
FEATURES = 3 * OWN + 1
_CLASS = np.zeros(256, np.uint8)  # 0 other, 1 upper, 2 lower, 3 digit, 4 symbol, 5 !, 6 |, 7 sentence mark
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = 1, 2, 3
_CLASS[[ord(c) for c in "#$%&*@^~_=<>{}[]\\+/"]] = 4
_CLASS[ord("!")], _CLASS[ord("|")] = 5, 6
_CLASS[[ord(c) for c in ".,;:?"]] = 7


@dataclass(frozen=True)
class Model:
    weight: np.ndarray  # of FEATURES, for "good" against "bad"
    move: np.ndarray  # 2 x 2, from and to bad, good
    prior: float


def line_features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, length in bytes, row) of the non-blank lines of a slice."""
    rows = len(off) - 1
    newline = data == 10
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    start = np.flatnonzero(np.concatenate([[True], newline[:-1]]) | edge[:-1]) if len(data) else np.zeros(0, np.int64)
    line_of = np.zeros(len(data), np.int64)
    line_of[start[1:]] = 1
    np.cumsum(line_of, out=line_of)
    m = len(start)
    count = np.bincount(line_of * 8 + _CLASS[data], minlength=8 * m).reshape(m, 8).astype(np.float64)
    length = np.diff(np.append(start, len(data))).astype(np.float64)
    w = Words(data, off, lower=False)
    words = np.zeros(m)
    same = np.zeros(m)
    stops = np.zeros(m)
    if len(w.start):
        at = line_of[w.start]
        words += np.bincount(at, minlength=m)
        h = w.hash
        again = np.concatenate([[False], (h[1:] == h[:-1]) & (at[1:] == at[:-1])])
        same += np.bincount(at[again], minlength=m)
        stops += np.bincount(at[_CLASS[data[w.end - 1]] == 7], minlength=m)
    per = np.maximum(words, 1)
    letters = np.maximum(count[:, 1] + count[:, 2], 1)
    own = np.stack(
        [
            np.log1p(words) / 5,
            count[:, 1] / letters,
            np.tanh(count[:, 4] / per),
            np.tanh(2 * count[:, 5] / per),
            np.tanh(4 * count[:, 6] / per),
            same / per,
            np.tanh(10 * count[:, 3] / np.maximum(length, 1)),
            np.minimum(length / per / 20, 2),
            stops / per,
            (words <= 2).astype(np.float64),
            (same > 2).astype(np.float64),
        ],
        1,
    )
    row = np.searchsorted(off, start, "right") - 1
    keep = words > 0
    own, length, row = own[keep], length[keep], row[keep]
    x = np.zeros((len(own), FEATURES))
    x[:] = np.concatenate([own, own, own, np.ones((len(own), 1))], 1)  # a document's ends are their own neighbours
    linked = row[1:] == row[:-1]
    x[1:, OWN : 2 * OWN][linked] = own[:-1][linked]
    x[:-1, 2 * OWN : 3 * OWN][linked] = own[1:][linked]
    assert rows == 0 or not len(row) or row[-1] < rows
    return x, length, row


def marginals(unary: np.ndarray, move: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) of each line and the expected number of each transition; lines are in runs of `count`."""
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    order = np.argsort(-count, kind="stable")
    first, count = first[order], count[order]
    e = np.stack([np.ones_like(unary), np.exp(np.clip(unary, -30, 30))], 1)
    t = np.exp(np.clip(move, -20, 20))
    a, b = np.ones_like(e), np.ones_like(e)
    longest = int(count[0]) if len(count) else 0
    live = [int(np.searchsorted(-count, -s, "left")) for s in range(longest)]  # runs with more than s lines
    for s in range(longest):
        at = first[: live[s]] + s
        f = e[at] if s == 0 else (a[at - 1] @ t) * e[at]
        a[at] = f / f.sum(1, keepdims=True)
    for s in range(longest - 2, -1, -1):
        at = first[: live[s + 1]] + s
        f = (e[at + 1] * b[at + 1]) @ t.T
        b[at] = f / f.sum(1, keepdims=True)
    p = a * b
    p /= p.sum(1, keepdims=True)
    pairs = np.zeros((2, 2))
    head = np.ones(len(unary), bool)
    head[first] = False
    at = np.flatnonzero(head)
    if len(at):
        joint = a[at - 1][:, :, None] * t[None] * (e[at] * b[at])[:, None, :]
        pairs = (joint / joint.sum((1, 2), keepdims=True)).sum(0)
    return p[:, 1], pairs


def fit_arrays(x: np.ndarray, y: np.ndarray, count: np.ndarray, rounds: int = 200, rate: float = 0.3, ridge: float = 1e-5) -> Model:
    """Maximum likelihood by Adam; y: each line's label, count: lines of each document."""
    w, move = np.zeros(x.shape[1]), np.zeros((2, 2))
    first = np.zeros(len(y), bool)
    first[np.concatenate([[0], np.cumsum(count)[:-1]])] = True
    at = np.flatnonzero(~first)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[at - 1], y[at]), 1)
    n, m, v = len(y), np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    for k in range(1, rounds + 1):
        p, pairs = marginals(x @ w, move, count)
        g = np.concatenate([x.T @ (y - p) / n - ridge * w, ((seen - pairs) / n - 10 * ridge * move).ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        w, move = w + step[:-4], move + step[-4:].reshape(2, 2)
    ends = np.cumsum(count) - 1
    return Model(w, move, float(y[ends].mean()))


def fit(docs: DataFrame, labels: DataFrame, documents: int = FIT_DOCUMENTS, lines: int = FIT_LINES) -> Model | None:
    """labels: (doc_id, label 0 or 1).  Learns from at most `documents` labelled rows, those of the
    least hash of doc_id.  Of a document of more than `lines` lines as many are taken, in runs of FIT_BLOCK
    lines that are spread evenly over the whole text.  None without rows, or with labels of one kind."""
    chosen = labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").cast("long").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(documents)
    schema = pa.schema([("label", pa.int64()), ("lines", pa.int64()), ("x", pa.binary())])

    def run(batches):
        for batch in batches:
            for a, b, data, off in slices(batch.column(1)):
                x, _, row = line_features(data, off)
                n = np.bincount(row, minlength=b - a)
                label, at = np.asarray(batch.column(0).slice(a, b - a)), np.cumsum(n) - n
                for i in np.flatnonzero(n):
                    own = x[at[i] : at[i] + n[i]].astype(np.float32)
                    runs = [own] if n[i] <= lines else [own[k : k + FIT_BLOCK] for k in np.linspace(0, n[i] - FIT_BLOCK, lines // FIT_BLOCK).astype(int)]
                    yield array_batch(schema, np.full(len(runs), label[i]), [len(r) for r in runs], pa.array([r.tobytes() for r in runs], pa.binary()))

    few = plain(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").select("label", "text")
    got = few.mapInArrow(run, "label long, lines long, x binary").toPandas()
    if got.empty or got.label.nunique() < 2:
        return None
    got = got.sort_values(["lines", "x"])
    x = np.frombuffer(b"".join(got.x), np.float32).reshape(-1, FEATURES).astype(np.float64)
    count = got.lines.to_numpy()
    return fit_arrays(x, np.repeat(got.label.to_numpy(), count), count)


def document_scores(model: Model | None, column: pa.Array) -> np.ndarray:
    out = np.full(len(column), 0.5 if model is None else model.prior)
    if model is None:
        return out
    for a, b, data, off in slices(column):
        x, length, row = line_features(data, off)
        if len(row):
            n = np.bincount(row, minlength=b - a)
            good, _ = marginals(x @ model.weight, model.move, n[n > 0])
            has = np.flatnonzero(n)
            out[a + has] = (np.bincount(row, good * length, b - a) / np.maximum(np.bincount(row, length, b - a), 1))[has]
    return np.clip(out, 0.0, 1.0)


def scored(docs: DataFrame, model: Model | None, keep: list[str] | None = None, name: str | None = None) -> DataFrame:
    """The columns `keep` of docs (all by default) with a score column, `name`: quality_score, or where docs has
    that column quality_score_ and so on.

    Every whole text is scored; a null, empty or blank one has the share of good documents in
    the fit as its score (0.5 without a fit).  Null ids and repeated rows pass through.
    """
    keep = docs.columns if keep is None else keep
    name = name or fresh(docs.select(*(F.col(f"`{c}`") for c in keep)), "quality_score")
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(name, T.DoubleType())])

    def run(batches):
        for batch in batches:
            score = pa.array(document_scores(model, batch.column(0)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], score], names=[*keep, name])

    return docs.select(F.col("text"), *(F.col(f"`{c}`") for c in keep)).mapInArrow(run, schema)
