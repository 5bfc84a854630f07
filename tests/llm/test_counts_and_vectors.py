"""Token counts, whitening and vector codes: the library, numpy and plain Python as brute force, and edge cases."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from moltable.llm import bpe_automaton, pretokens, rotation_codes, token_counts, vector_codes, whitening
from moltable.llm.queries import VOCABULARY

DOCS = "doc_id long, text string, lang string, n_tokens long, id int, size string"
VECS = "vec_id long, embedding array<float>, label int, x int, component string"
ODD = ["'s", "'ll", "'", "''", "a", "B", "1", "<|endoftext|>", "<|startoftext|>", "<|", " ", "\n", "́", "é", "İ", "Σ", "\x1c", " ", "don't", "x'RE", "'ſ", "1'd", "!", "ẞ", "ᄀ", "ᅡ", "՘", "౜", "Ᲊ"]


def doc_frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", 7, 1, "x") for i, t in rows], DOCS)


def vec_frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], l, 1, "c") for i, v, l in rows], VECS)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


@pytest.fixture(scope="module")
def spec():
    with open(VOCABULARY, encoding="utf-8") as f:
        return pretokens._described(f.read())


def test_counts_against_the_library(spark, library):
    rng = random.Random(4)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 14))) for _ in range(400)]
    texts += ["", "  \n ", "word " * 30_000, "x" * 60_000, "é " * 3000, "one two", "one two"]
    rows = [(i // 2, t) for i, t in enumerate(texts)] + [(None, "a b c"), (7, None), (None, None)]
    want = sorted((str(i), len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t in rows)
    for cfg in (token_counts.Lookup(), token_counts.Lookup(frequent=8, sample=5, cached=16, segment=50), token_counts.Lookup(frequent=0)):
        got = token_counts.counts(doc_frame(spark, rows), VOCABULARY, cfg)
        assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
        assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == want
    assert token_counts.counts(doc_frame(spark, []), VOCABULARY).collect() == []
    assert token_counts.counts(doc_frame(spark, [(1, None)]), VOCABULARY).collect() == [(1, 0, 0, False)]


def test_table_finds_all_and_only_its_keys():
    rng = np.random.default_rng(1)
    keys = np.unique(np.concatenate([rng.integers(1, 2**63, 5000, dtype=np.uint64), (np.arange(1, 3000, dtype=np.uint64) << np.uint64(40)) | np.uint64(7)]))
    n = rng.integers(0, 60_000, len(keys))
    table = token_counts.Table(keys, n)
    assert (table.get(keys) == n).all()
    assert (table.get(np.setdiff1d(rng.integers(1, 2**63, 5000, dtype=np.uint64), keys)) == -1).all()


def test_classes_of_code_points_between_letters_alone_and_at_ends(spec, library):
    """Those of every block, and all on which versions of Unicode differ: by counts, and by ids and labels of the automaton."""
    points = [*range(0, 0x3400, 3), *range(0xA000, 0xD800, 31), *range(0xE000, 0x110000, 997), 0x558, 0x58B, 0xC5C, 0xCDC, 0x1C89, *range(0x323B0, 0x33479, 50), 0x3D000]
    c, empty, codec = token_counts.counter(spec), token_counts.Table(np.zeros(0, np.uint64), np.zeros(0)), bpe_automaton.codec(spec)
    for form in ("a%sB", "%s", "%sa", "a%s", "'%s1"):
        texts = [form.replace("%s", chr(p)) for p in points]
        ids = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        assert c.count(texts, empty, token_counts.Lookup()).tolist() == [len(i) for i in ids]
        assert [codec.encode(t) for t in texts] == ids


def test_digests_with_unknown_letters(spark, library):
    texts = ["a՘b", "xᲉY z", "౜", "Σας İ", None, ""]
    got = {r.doc_id: r for r in bpe_automaton.digests(doc_frame(spark, list(enumerate(texts))), VOCABULARY).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe_automaton.digests(doc_frame(spark, []), VOCABULARY).count() == 0


def vectors(rng, n, dim):
    base = rng.standard_normal((n, dim)) @ np.diag(np.geomspace(1, 0.01, dim)) @ np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    return [v.tolist() for v in base.astype(np.float32)]


BROKEN = [(900, None, 1), (901, [1.0, None], 1), (902, [float("nan"), 1.0], 1), (903, [float("inf"), 0.0], None)]


@pytest.mark.parametrize(("n", "dim"), [(400, 24), (90, 5)])
def test_whitening_against_numpy(spark, n, dim):
    rng = np.random.default_rng(dim)
    v = vectors(rng, n, dim)
    rows = [(i, x, i % 3) for i, x in enumerate(v + v[:50])] + [(3, v[0], 1), (None, v[1], 2)] + BROKEN
    out = whitening.whitened(vec_frame(spark, rows).repartition(40)).collect()
    x = np.floor(64 * np.array(v, np.float32).astype(float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    m, s = len(fit), fit.sum(0)
    e, u = np.linalg.eigh(np.cov(fit.T, bias=True))
    e, u = e[::-1], u[:, ::-1]
    k = min(16, dim)
    assert len(out) == (len(rows) - len(BROKEN)) * k
    want = ((x - s / m) @ u[:, :k]) / np.sqrt(e[:k])
    got = {(r.vec_id, r.component): r for r in out if r.vec_id is not None and r.vec_id != 3}
    sign = [1 if got[5, j + 1].whitened * want[5, j] > 0 else -1 for j in range(k)]
    for (i, c), r in got.items():
        row = x[i if i < n else i - n]
        assert r.n == m and r.deviation == int(((m * row - s) ** 2).sum())
        assert abs(r.whitened - sign[c - 1] * want[i if i < n else i - n, c - 1]) < 1e-8
        assert abs(r.explained / (e[c - 1] / e.sum()) - 1) < 1e-9 and r.identity_error < 1e-8
    assert sum(r.vec_id == 3 for r in out) == 2 * k and sum(r.vec_id is None for r in out) == k


def test_whitening_small_singular_values_are_accurate():
    """Columns scaled over twelve orders of magnitude: the least value keeps its digits, which the covariance would lose."""
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.standard_normal((8, 8)))[0]
    length, v = whitening.jacobi(q * np.geomspace(1, 1e-12, 8))
    assert np.allclose(length / np.geomspace(1, 1e-12, 8), 1, rtol=1e-12)
    assert np.allclose(np.abs(v), np.eye(8), atol=1e-10)
    assert sorted(map(tuple, np.concatenate(whitening.rounds(7)).tolist())) == [(a, b) for a in range(7) for b in range(a + 1, 7)]


def test_whitening_edge_cases(spark):
    assert whitening.whitened(vec_frame(spark, [])).count() == 0 == whitening.whitened(vec_frame(spark, BROKEN)).count()
    one = whitening.whitened(vec_frame(spark, [(1, [1, 2], 0), (2, [1, 2], 0)])).collect()
    assert [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained) for r in sorted(one)] == [(i, c, 1, 0, None, None) for i in (1, 2) for c in (1, 2)]
    flat = {(r.vec_id, r.component): r for r in whitening.whitened(vec_frame(spark, [(1, [0, 0], 0), (2, [1, 1], 0), (3, [], 0), (4, [2, 2], 0), (5, [0.0], 0)])).collect()}
    assert len(flat) == 10 and flat[3, 1].whitened == flat[1, 1].whitened == flat[5, 1].whitened
    assert abs(flat[1, 1].explained - 1) < 1e-12 and flat[1, 2].explained == 0 and flat[1, 2].whitened is None and flat[1, 1].identity_error < 1e-12
    huge = whitening.whitened(vec_frame(spark, [(1, [3e38, -3e38], 0), (2, [0, 1], 0)])).collect()
    assert len(huge) == 4 and all(r.deviation is None for r in huge)


def plain_codes(rows, rounds=2):
    rows = sorted(((i, np.floor(256 * np.array(v, np.float32).astype(float)).astype(int), l) for i, v, l in rows), key=lambda r: (r[0] is None, r[0], r[1].tolist()))
    w = len(rows[0][1]) // 16
    parts = [[tuple(v[p * w : p * w + w].tolist()) for _, v, _ in rows] for p in range(16)]
    books = [q[:64] for q in parts]
    near = lambda y, book: min((sum((a - b) ** 2 for a, b in zip(y, c, strict=True)), k) for k, c in enumerate(book))
    for _ in range(rounds):
        for p in range(16):
            at = [near(y, books[p])[1] for y in parts[p]]
            own = [[y for y, k in zip(parts[p], at, strict=True) if k == j] for j in range(len(books[p]))]
            books[p] = [tuple(sum(c) // len(o) for c in zip(*o, strict=True)) if o else books[p][j] for j, o in enumerate(own)]
    final = [[near(y, books[p]) for y in parts[p]] for p in range(16)]
    error = [sum(final[p][i][0] for p in range(16)) for i in range(len(rows))]
    total = {}
    for (_, _, l), e in zip(rows, error, strict=True):
        total[l] = total.get(l, 0) + e
    digest = hashlib.sha256(",".join(str(c) for b in books for entry in b for c in entry).encode()).hexdigest()
    return sorted((str(i), "".join(f"{final[p][k][1]:02x}" for p in range(16)), error[k], total[l], digest) for k, (i, _, l) in enumerate(rows))


@pytest.mark.parametrize(("n", "dim"), [(150, 32), (20, 16)])
def test_codes_against_plain_python(spark, n, dim):
    rng = np.random.default_rng(n)
    v = vectors(rng, n, dim)
    rows = [(i + 5, x, i % 4 or None) for i, x in enumerate(v)] + [(7, v[3], 1), (8, v[4], None), (None, v[5], 2)]
    got = vector_codes.coded(vec_frame(spark, rows + BROKEN).repartition(7))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == plain_codes(rows)


def test_codes_edge_cases(spark):
    assert vector_codes.coded(vec_frame(spark, [])).count() == 0 == vector_codes.coded(vec_frame(spark, BROKEN)).count()
    short = vector_codes.coded(vec_frame(spark, [(1, [0.5] * 20, 1), (2, [], 1), (3, [3e38, -3e38], 1)])).collect()
    assert {r.vec_id: r.error for r in short} == {1: 0, 2: 0, 3: 0} and all(len(r.code) == 32 for r in short)


def test_assign_takes_the_first_nearest_and_holds_large_values():
    cfg = vector_codes.Quantiser()
    top = cfg.largest(4)
    books = np.full((16, 2, 4), top)
    at, far = vector_codes.assign(np.full((1, 64), -top), books)
    assert at.max() == 0 and int(far.sum()) == 64 * (2 * top) ** 2


@pytest.mark.parametrize("dim", [3, 16, 64, 200])
def test_bounds_of_stored_codes_lose_no_link(dim):
    """Estimates are unbiased, and no pair at the threshold or above is ruled out by the other's packed code."""
    rng = np.random.default_rng(dim)
    cfg = rotation_codes.Codes()
    x = rng.standard_normal((3000, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    off = rng.standard_normal((3000, dim))
    off -= (off * x).sum(1, keepdims=True) * x
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    cos = rng.uniform(0.9, 1.0, (3000, 1))
    y = cos * x + np.sqrt(1 - cos**2) * off
    bits, factor = rotation_codes.encode(y, cfg)
    est, width = rotation_codes.bounds(rotation_codes.rotated(x, cfg), bits, factor, cfg)
    true = (x * y).sum(1)
    assert (est + width >= cfg.cosine)[true >= cfg.cosine].all()
    assert abs((est - true).mean()) < 0.01
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(y.tolist())], ["node", "v"])
    (code, *_) = [pa.Table.from_batches(list(rotation_codes._coded([batch], cfg))).combine_chunks().to_batches()[0]]
    pairs = pa.RecordBatch.from_arrays([pa.array(range(5000, 8000)), code.column(0), pa.array(x.tolist()), *code.columns[1:]], ["a", "b", "x", "dim", "bits", "factor"])
    got = {b for part in rotation_codes._possible([pairs], cfg) for b in part.column(1).to_pylist()}
    assert got == set(np.flatnonzero(est + width >= cfg.cosine).tolist())
