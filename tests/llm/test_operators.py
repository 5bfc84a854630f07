"""Operators against brute force, exact round trips and edge cases: nulls, empty and blank texts, ties, repeated rows,
empty tables, clashing columns."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from moltable.llm import bpe_automaton, cgk_decontam, feistel_shards, merkle_audit, neardup, paragraph_dedup, pii_sanitise, quality_crf, queries, rotation_codes, toxicity_channel
from moltable.llm.shared import Words, components, hash_bytes, slices

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, n_chars long, key int, pid string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", 0, 1, "x") for i, t in rows], DOCS)


def prose(rng, n):
    return " ".join("".join(rng.choice(["th", "er", "on", "an", "re", "he"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


ODD = [(None, "a b c"), (9001, None), (9002, ""), (9003, "  \n "), (9004, "one"), (9005, "one"), (9005, "one"), (9006, "é " * 3000), (9007, "x" * 60_000)]


def closure(ids, links):
    up = {i: i for i in ids}
    def top(i):
        while up[i] != i:
            i = up[i]
        return i
    for a, b in links:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {i: top(i) for i in ids}


def test_words_hash_like_single_words():
    data, off = np.frombuffer("Ab cD  é\nab".encode(), np.uint8), np.array([0, 3, 3, 12])
    w = Words(data, off)
    assert w.row.tolist() == [0, 2, 2, 2]
    assert [int(h) for h in w.hash] == [hash_bytes(x.encode()) for x in ("ab", "cd", "é", "ab")]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = closure({x for e in edges for x in e}, edges)
    assert got == {k: v for k, v in want.items() if any(k in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("shingle", [2, 5])
def test_near_documents_against_brute_force(spark, shingle):
    rng = random.Random(shingle)
    base = [prose(rng, rng.randint(1, 120)) for _ in range(40)]
    rows = []
    for t in base:
        for _ in range(rng.randint(1, 6)):
            w = t.split(" ")
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                w[rng.randrange(len(w))] = "zz" + str(rng.randrange(50))
            rows.append((len(rows) + 10, " ".join(w)))
    rows += ODD
    got = {}
    for r in neardup.near_documents(frame(spark, rows), neardup.Banding(shingle=shingle)).collect():
        got.setdefault(r.doc_id, []).append(r)
    sets = {}
    for i, t in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + shingle]) for k in range(len(w) - shingle + 1)} if len(w) >= shingle else {tuple(w)} if w else set()
    ids = [i for i in sets if i is not None]
    links = [(a, b) for a, b in itertools.combinations(ids, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = closure(ids, links)
    for i in ids:
        assert all((r.n_shingles, r.component_id, r.kept) == (len(sets[i]), want[i], want[i] == i) for r in got[i]), i
    assert len(got[9005]) == 2 and len(got[None]) == 1 and not got[None][0].kept
    assert neardup.near_documents(frame(spark, []), neardup.Banding()).count() == 0


def test_near_documents_hot_group_of_chained_copies(spark):
    """Many copies of one text, some just under the threshold of each other: the block comparison decides."""
    rng = random.Random(9)
    base = prose(rng, 100).split(" ")
    rows = []
    for i in range(160):
        w = list(base)
        for k in rng.sample(range(100), rng.choice([2, 4, 6, 8])):
            w[k] = f"q{rng.randrange(10_000)}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r.component_id for r in neardup.near_documents(frame(spark, rows), neardup.Banding(shingle=2)).collect()}
    sets = [{p for p in itertools.pairwise(t.split())} for _, t in rows]
    links = [(a, b) for a, b in itertools.combinations(range(160), 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert got == closure(range(160), links)


def test_estimate_is_close_to_the_jaccard_similarity():
    rng = np.random.default_rng(3)
    for n, share in ((400, 0.9), (3000, 0.5), (30, 0.8)):
        common = rng.integers(0, 2**52, int(n * share), dtype=np.uint64)
        own = [np.unique(np.concatenate([common, rng.integers(0, 2**52, n - len(common), dtype=np.uint64)])) for _ in range(2)]
        sig = [neardup.registers(s, np.zeros(len(s), np.int64), 1, 256)[0] for s in own]
        true = len(common) / (2 * n - len(common))
        assert abs(float(neardup.estimate(np.array([(sig[0] == sig[1]).mean()]), np.array([n]), np.array([n]))[0]) - true) < 0.15


def test_quality_learns_and_keeps_edge_cases(spark):
    rng = random.Random(2)
    good = [(i, "\n".join(prose(rng, 20).capitalize() + "." for _ in range(rng.randint(1, 5)))) for i in range(60)]
    bad = [(i, "\n".join(prose(rng, 20).upper().replace(" ", "!! ") for _ in range(rng.randint(1, 5)))) for i in range(60, 120)]
    docs = frame(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120) if i % 2] + [(None, 1), (7, None)], "doc_id long, label int")
    model = quality_crf.fit(docs, labels)
    got = {r.doc_id: r.quality_score for r in quality_crf.scored(docs, model).collect()}
    assert all((got[i] >= 0.5) == (i < 60) for i in range(120))
    odd = quality_crf.scored(frame(spark, ODD), model)
    assert odd.columns == [*frame(spark, []).columns, "quality_score"] and odd.count() == len(ODD)
    assert odd.where("quality_score between 0 and 1").count() == len(ODD)
    assert quality_crf.fit(docs, labels.limit(0)) is None
    assert quality_crf.scored(docs, None).where("quality_score = 0.5").count() == 120


def test_crf_marginals_against_enumeration():
    rng = np.random.default_rng(0)
    count = np.array([1, 4, 3])
    u, move = rng.normal(size=8), rng.normal(size=(2, 2))
    p, pairs = quality_crf.marginals(u, move, count)
    want, at, expected = [], 0, np.zeros((2, 2))
    for n in count:
        weights = {y: np.exp(sum(u[at + i] * y[i] for i in range(n)) + sum(move[a, b] for a, b in itertools.pairwise(y))) for y in itertools.product((0, 1), repeat=int(n))}
        z = sum(weights.values())
        want += [sum(w for y, w in weights.items() if y[i]) / z for i in range(n)]
        for y, w in weights.items():
            for a, b in itertools.pairwise(y):
                expected[a, b] += w / z
        at += n
    assert np.allclose(p, want) and np.allclose(pairs, expected)


def test_near_vectors_against_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 64)).astype(np.float32)
    rows = []
    for i in range(300):
        v = x[rng.integers(0, 120)] + rng.normal(size=64).astype(np.float32) * rng.choice([0, 0.05, 0.14, 0.2])
        rows.append((i, v.astype(np.float32).tolist(), int(rng.integers(0, 3))))
    rows += [(400, None, 1), (401, [0.0] * 64, 1), (402, [1.0] * 64, None), (403, [float("nan")] * 64, 1), (404, [], 1), (405, [1.0, None], 1), (None, [1.0] * 64, 1), (406, [1.0, 2.0], 1)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, node int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in rotation_codes.near_vectors(df).collect()}
    ok = [(i, np.array(v, np.float64), lb) for i, v, lb in rows if i is not None and i < 300]
    unit = np.stack([v / np.linalg.norm(v) for _, v, _ in ok])
    cos = unit @ unit.T
    links = [(a, b) for a, b in itertools.combinations(range(300), 2) if ok[a][2] == ok[b][2] and cos[a, b] >= 0.98]
    want = closure(range(300), links)
    degree = np.bincount(np.array(links).ravel(), minlength=300)
    assert all(got[i] == (degree[i], want[i], want[i] == i) for i in range(300))
    assert all(got[i] == (0, i, True) for i in (400, 401, 402, 403, 404, 405, 406)) and got[None][2] is False
    assert rotation_codes.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("dim", [2, 4, 8, 16])
def test_near_vectors_of_few_components(spark, dim):
    """Pairs just over the threshold are found in low dimensions too."""
    rng = np.random.default_rng(dim)
    rows, pairs = [], 150
    for i in range(pairs):
        a = rng.normal(size=dim)
        a /= np.linalg.norm(a)
        b = rng.normal(size=dim)
        b -= (b @ a) * a
        b = 0.9805 * a + np.sqrt(1 - 0.9805**2) * b / np.linalg.norm(b)
        rows += [(2 * i, a.tolist(), i), (2 * i + 1, b.tolist(), i)]
    got = {r.vec_id: r.n_links for r in rotation_codes.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert sum(got[2 * i] for i in range(pairs)) >= 0.98 * pairs


def test_pii_patterns_against_plain_regular_expressions():
    rng = random.Random(5)
    pattern = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    digits = lambda s: re.sub("[^0-9]", "", s)
    ok = [lambda s: True, lambda s: all(int(p) <= 255 for p in s.split(".")), lambda s: 13 <= len(digits(s)) <= 19 and pii_sanitise.luhn(digits(s)), lambda s: 9 <= len(digits(s)) <= 15]
    pieces = ["a", "b_", "@", ".", "1", "25", "4", "0", " ", "-", "+", "(", ")", "é", "\n", "@a.b", "1.2.3.4", "4111 1111 1111 1111", "+1 555 123 4567"]
    for _ in range(4000):
        t = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 25)))
        assert pii_sanitise.base_spans(t) == [[m.span() for m in re.finditer(p, t) if f(m[0])] for p, f in zip(pattern, ok, strict=True)], t


def test_pii_terms_that_disclose_are_generalised(spark):
    rng = random.Random(6)
    rows = [(i, f"{prose(rng, 9)} zorblatt wrote to x.y@mail.example.com about {prose(rng, 9)}") for i in range(6)]
    rows += [(i, prose(rng, 40)) for i in range(10, 60)] + ODD
    docs = frame(spark, rows)
    found = {r.doc_id: r for r in pii_sanitise.found(docs).collect() if r.doc_id is not None and r.doc_id < 6}
    clean = {r.doc_id: r.text for r in pii_sanitise.sanitised(docs).collect()}
    for i, text in rows[:6]:
        a = text.index("x.y@")
        base = f"email:{a}:{a + 20}"
        assert found[i].n_email == 1 and found[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert base in found[i].spans and f"term:{text.index('zorblatt')}:" in found[i].spans
        assert "[EMAIL]" in clean[i] and "[TERM]" in clean[i] and "zorblatt" not in clean[i]
    assert all(clean[i] == t for i, t in rows[6:])
    assert pii_sanitise.found(docs).count() == len(rows) and pii_sanitise.sanitised(docs).columns == docs.columns
    assert pii_sanitise.found(docs.limit(0)).count() == 0


def test_pii_terms_go_wherever_they_stand_in_texts_of_their_entity(spark):
    rng = random.Random(8)
    far = lambda i: f"zorblatt {prose(rng, 30)} zorblatt wrote to x.y@mail.example.com. {prose(rng, 30)} Zorblatt (zorblatt) {i}"
    rows = [(i, far(i)) for i in range(6)] + [(9, f"x.y@mail.example.com {prose(rng, 20)} zorblatt")]
    rows += [(10, "zorblatt alone, or beside a.b@mail.example.com")] + [(i, prose(rng, 40)) for i in range(11, 60)]
    clean = {r.doc_id: r.text for r in pii_sanitise.sanitised(frame(spark, rows)).collect()}
    assert all("zorblatt" not in clean[i] for i in (*range(6), 9))
    assert clean[0].count("[TERM]") >= 3 and "zorblatt alone" in clean[10]
    assert all(clean[i] == t for i, t in rows if i > 10)
    hits = pii_sanitise.disclosing(frame(spark, rows)).groupBy("key").count().collect()
    assert all(r["count"] >= 1 for r in hits) and len(hits) == 7


def test_feistel_is_a_permutation_that_can_be_inverted():
    for n in (1, 2, 3, 17, 1000, 4097):
        slot = feistel_shards.permute(np.arange(n), n, 99)
        assert sorted(slot.tolist()) == list(range(n))
        assert feistel_shards.permute(slot, n, 99, back=True).tolist() == list(range(n))
    assert feistel_shards.permute(np.arange(100), 100, 1).tolist() != feistel_shards.permute(np.arange(100), 100, 2).tolist()


def test_shards_hold_every_sequence_at_its_slot(spark):
    rng = random.Random(7)
    rows = [(i * 3, prose(rng, rng.randint(0, 60))) for i in range(50)] + [(1, None), (2, ""), (4, "b"), (4, "a"), (None, "gone")]
    cfg = feistel_shards.Layout(tokens=32, per_shard=8)
    written = feistel_shards.shards(frame(spark, rows), cfg)
    texts = {i: t or "" for i, t in rows if i is not None}
    texts[4] = "a"
    seqs = []
    for i in sorted(texts):
        ids = [*texts[i].encode(), feistel_shards.END_OF_TEXT]
        seqs += [(i, k, ids[k * 32 : k * 32 + 32]) for k in range(-(-len(ids) // 32))]
    slot = feistel_shards.permute(np.arange(len(seqs)), len(seqs), cfg.key)
    want = {int(s): q for s, q in zip(slot, seqs, strict=True)}
    got = {r.slot: r for r in feistel_shards.index(written, cfg).collect()}
    assert sorted(got) == sorted(want)
    for s, (doc, k, ids) in want.items():
        r = got[s]
        assert (r.doc_id, r.seq, r.n_tokens, r.shard, r.byte_offset) == (doc, k, len(ids), s // 8, s % 8 * 64)
        assert r.sha256 == hashlib.sha256(np.array(ids, "<u2").tobytes()).hexdigest()
    for r in written.collect():
        assert len(r.content) == r.n * cfg.stride and r.first_slot == r.shard * 8
    assert feistel_shards.shards(frame(spark, []), cfg).count() == 0


def test_shards_are_read_on_from_any_slot(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randint(0, 60))) for i in range(40)] + [(40, "long " * 3000)]
    cfg = feistel_shards.Layout(tokens=32, per_shard=8)
    written = feistel_shards.shards(frame(spark, rows), cfg)
    whole = [tuple(r) for r in feistel_shards.read(written, cfg).orderBy("slot").collect()]
    assert [r[0] for r in whole] == list(range(len(whole)))
    texts: dict[int, list] = {}
    for _, doc, seq, ids in sorted(whole, key=lambda r: (r[1], r[2])):
        texts.setdefault(doc, []).extend(ids)
    assert {d: bytes(ids[:-1]).decode() for d, ids in texts.items()} == dict(rows)
    assert all(ids[-1] == feistel_shards.END_OF_TEXT for ids in texts.values())
    for at in (0, 1, 7, 8, 21, len(whole) - 1, len(whole), len(whole) + 50):
        first = [tuple(r) for r in feistel_shards.read(written, cfg, 0, at).orderBy("slot").collect()]
        rest = [tuple(r) for r in feistel_shards.read(written, cfg, at).orderBy("slot").collect()]
        assert first + rest == whole and len(rest) == max(0, len(whole) - at)
    plan = feistel_shards.read(written, cfg, 16, 24)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(shard,2)" in plan and "LessThanOrEqual(shard,2)" in plan


def test_toxicity_sees_through_disguises(spark):
    rng = random.Random(8)
    bad = ["moron", "idiot", "loser"]
    rows = [(i, f"{prose(rng, 30)} {rng.choice(bad)} {prose(rng, 5)} {rng.choice(bad)}") for i in range(60)] + [(i, prose(rng, 40)) for i in range(60, 260)]
    docs = frame(spark, rows)
    model = toxicity_channel.CharModel.of(toxicity_channel.count_characters(docs))
    assert model.restore("m0r0n") == "moron" and model.restore("iiidiot") == "idiot" and model.restore("l.o.s.e.r") == "loser"
    labels = spark.createDataFrame([(i, int(i < 60)) for i, _ in rows], "doc_id long, label int")
    lexicon = toxicity_channel.fit(docs, labels, model)
    test = [(1, "the m0r0n on he"), (2, "an 1d1ot re an id!ot"), (3, prose(rng, 30)), *ODD]
    got = {}
    for r in toxicity_channel.scored(frame(spark, test), model, lexicon).collect():
        got.setdefault(r.doc_id, []).append(r.toxicity)
    assert min(got[1][0], got[2][0]) >= 0.3 > max(got[3] + got[9004] + got[9006])
    assert toxicity_channel.scored(docs.limit(0), model, lexicon).count() == 0


def test_toxicity_decodes_disguises_of_any_length(spark):
    rng = random.Random(10)
    bad = ["moron", "idiot", "loser"]
    rows = [(i, f"{prose(rng, 30)} {rng.choice(bad)} {prose(rng, 5)} {rng.choice(bad)}") for i in range(60)] + [(i, prose(rng, 40)) for i in range(60, 260)]
    model = toxicity_channel.CharModel.of(toxicity_channel.count_characters(frame(spark, rows)))
    text = ["t h e  h e r e  i d i o t", "  ".join(" ".join(x) for x in ["there", "hereon", "there", "anther", "onthere", "reheth", "moron", "there"]), "there.hereon.anther.there.hereon.moron.there.on", "m" * 60 + "oron", "1d107"]
    for seen, want in zip(text, ["idiot", "moron", "moron", "moron", "idiot"], strict=True):
        raw = np.frombuffer(seen.encode(), np.uint8)
        h, _ = toxicity_channel.slice_words(raw, np.array([0, len(raw)]), model)
        assert hash_bytes(want.encode()) in {int(x) for x in h[0]}, seen


def test_toxicity_learns_from_all_but_near_copies(spark):
    rng = random.Random(9)
    own = [prose(rng, 30) for _ in range(40)]
    lead = min((f"w{k}" for k in range(5000)), key=lambda w: hash_bytes(w.encode()))  # the least-hashed word of each document
    rows = [(i, f"{t} {lead}") for i, t in enumerate(own)] + [(100 + i, f"{own[0]} {lead}") for i in range(5)] + [(200, ""), (201, None)]
    got = {r.doc_id: r.copy for r in toxicity_channel.copies(frame(spark, rows)).collect()}
    assert len({got[i] for i in range(40)}) == 40 and {got[100 + i] for i in range(5)} == {got[0]} and got[200] is got[201] is None
    bad = ["moron", "idiot", "loser"]
    train = [(i, f"{t} {lead} {bad[i % 3]} {bad[(i + 1) % 3]}") for i, t in enumerate(own)] + [(100 + i, f"{prose(rng, 30)} {lead}") for i in range(60)]
    docs = frame(spark, train)
    model = toxicity_channel.CharModel.of(toxicity_channel.count_characters(docs))
    lexicon = toxicity_channel.fit(docs, spark.createDataFrame([(i, int(i < 40)) for i, _ in train], "doc_id long, label int"), model)
    assert {hash_bytes(w.encode()) & ~7 for w in bad} <= {int(k) for k in lexicon.keys}


def test_alignment_against_dynamic_programming():
    rng = random.Random(3)
    for _ in range(300):
        p, t = (bytes(rng.choice(b"abc") for _ in range(rng.randint(lo, hi))) for lo, hi in ((1, 12), (0, 30)))
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p, 1):
            new = [i]
            for j, d in enumerate(t, 1):
                new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d)))
            row = new
        got = cgk_decontam.align(p, t, len(p) - 1)
        assert (got is None and min(row) >= len(p)) or got[0] == min(row)


def test_contaminated_finds_exact_and_edited_items(spark):
    rng = random.Random(4)
    items = [(i, prose(rng, 30)) for i in range(20)] + [(90, None), (91, ""), (92, "tiny item")]
    rows = []
    for i in range(20):
        words = items[i][1].split(" ")
        if i >= 10:
            words[5] = "edited"
        rows.append((i, f"{prose(rng, 40)}\n{' '.join(words).upper() if i % 2 else '  '.join(words)} {prose(rng, 40)}"))
    rows += [(i, prose(rng, 90)) for i in range(100, 140)] + [(200, "has a tiny item in it"), *ODD[1:]]
    bench = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    got = cgk_decontam.contaminated(frame(spark, rows), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(i, i) for i in range(20)} | {(200, 92)}
    assert all((r.distance == 0) == (r.doc_id < 10 or r.doc_id == 200) for r in got)
    text = dict(rows)
    for r in got:
        assert r.doc_id >= 10 or " ".join(text[r.doc_id][r.start : r.end].lower().split()) == items[r.item_id][1]
    assert cgk_decontam.contaminated(frame(spark, rows), bench.limit(0)).count() == 0


def test_repeated_passages_against_brute_force(spark):
    """Passages of 51 words and more within longer lines, exact and edited; passages of 40 words, and repeats within a document, are none."""
    rng = random.Random(3)
    rows, planted, edited, passages = [], set(), set(), {}
    for i in range(40):
        passage = prose(rng, rng.randint(60, 80) if i % 2 else rng.randint(51, 80)).split()
        for j in range(2):
            words = passage[:]
            if j and i % 2:
                for at in rng.sample(range(len(words)), 3):
                    words[at] = "edit" + str(rng.randrange(10**6))
            text = f"{prose(rng, 70)} {' '.join(words)} {prose(rng, 70)}"
            rows.append((1000 + 2 * i + j, text))
            passages[1000 + 2 * i + j] = words
            (edited if i % 2 else planted).add(1000 + 2 * i + j)
    short = prose(rng, 40)
    rows += [(2000 + k, f"{prose(rng, 90)} {short} {prose(rng, 90)}") for k in range(6)]
    twice = prose(rng, 60)
    rows += [(2100, f"{twice} {prose(rng, 50)} {twice}"), (2101, prose(rng, 200))]
    rows += [(2200, prose(rng, 30) + " shti" * 90), (2201, "shti " * 70 + prose(rng, 30))]
    planted |= {2200, 2201}
    rows += ODD + [(1000, prose(rng, 100))]  # another text of a known id
    got = paragraph_dedup.repeated(frame(spark, rows)).collect()
    found = {r.doc_id for r in got}
    assert len(planted - found) <= 2
    assert len(edited & found) >= 0.7 * len(edited), len(edited & found)
    assert found <= planted | edited
    text = dict(reversed(rows))
    for r in got:
        if r.doc_id in planted:
            assert r.passage_words >= 50 and r.passage_word <= r.word and r.word + r.n_words <= r.passage_word + r.passage_words
            if r.doc_id < 2000:  # an end may go on alike by chance
                assert 50 <= r.passage_words <= len(passages[r.doc_id]) + 3
        assert r.n_words == len(text[r.doc_id][r.start : r.end].split())
    assert all(r.kept == (r.component_id == r.doc_id) for r in got if r.doc_id < 2000)
    clean = [(r.doc_id, r.text) for r in paragraph_dedup.cleaned(frame(spark, rows)).collect()]
    assert len(clean) == len(rows)
    gone = {(r.doc_id, text[r.doc_id][r.start : r.end]) for r in got if not r.kept}
    after = dict(c for c in clean if c[0] is not None and c[0] >= 1001 and c[0] < 3000)
    assert all(piece not in after[i] for i, piece in gone if i not in (2200, 2201))
    assert after[2101] == text[2101] and after[2000] == text[2000]
    assert dict(clean)[9003] == "  \n " and dict(clean)[9001] is None
    assert paragraph_dedup.repeated(frame(spark, [])).count() == 0
    assert paragraph_dedup.cleaned(frame(spark, [])).count() == 0


def test_paragraphs_break_alike_in_any_surroundings():
    rng, found = random.Random(5), 0
    for _ in range(200):
        passage = prose(rng, 51)
        cuts = []
        for text in (f"{prose(rng, 40)} {passage} {prose(rng, 40)}", passage):
            data = np.frombuffer(text.encode(), np.uint8)
            p = paragraph_dedup.Paragraphs(np.array([1]), data, np.array([0, len(data)]))
            cuts.append({text[a:b] for a, b in zip(p.start, p.end, strict=True)})
        found += bool(cuts[0] & cuts[1])
    assert found >= 190


def test_audit_locates_corruption(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"<p>{i}</p>" * (i % 7), 1) for i in range(0, 9000, 3)] + [(None, "u", "h", 1), (3, None, None, 1)], "page_id long, url string, html string, file int")
    assert merkle_audit.audit(pages, pages).count() == 0
    broken = pages.withColumn("html", F.when(F.col("page_id") == 4500, F.regexp_replace("html", "4", "5")).otherwise(F.col("html"))).where("page_id is null or page_id not in (4095)")
    got = {r.page_id: r.status for r in merkle_audit.audit(pages, broken).collect()}
    assert got == {4500: "corrupt", 4095: "missing"}
    assert merkle_audit.audit(pages.limit(0), pages.limit(0)).count() == 0


def test_encoding_is_the_library_s(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(queries.VOCABULARY)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    texts += ["aaaa aaa aaaaa hhhhhhhh", "a<|endoftext|>b <|startoftext|>", "ΑΣ Σ İstanbul ǅ ﬁ é Å 中文 123 '''s don't I'LL x", "", "z" * 300, "\x1c\x00a\x85b　c", "    "]
    rows = {r.doc_id: r for r in bpe_automaton.encode_decode(frame(spark, [*enumerate(texts), (10**6, None)]), queries.VOCABULARY).collect()}
    for i, t in enumerate(texts):
        ids = lib.encode(t, add_special_tokens=False).ids
        assert (rows[i].n_tokens, rows[i].ids, rows[i].decoded) == (len(ids), " ".join(map(str, ids)), lib.decode(ids, skip_special_tokens=False)), t[:50]
    assert (rows[10**6].n_tokens, rows[10**6].ids, rows[10**6].decoded) == (0, "", "")


def test_automaton_against_plain_merging():
    """A small vocabulary with ties and unreachable merges, on all short words."""
    merges = [("a", "a"), ("a", "b"), ("b", "a"), ("aa", "a"), ("b", "aa"), ("ab", "ab"), ("b", "b</w>"), ("a", "b</w>"), ("aa", "b</w>"), ("ba", "ab")]
    symbols = ["a", "b", "a</w>", "b</w>"]
    vocab = {s: i for i, s in enumerate([*symbols, *(x + y for x, y in merges)])}
    auto = bpe_automaton.Automaton(vocab, merges)
    rank = {m: i for i, m in enumerate(merges)}
    for n in range(1, 9):
        for word in map("".join, itertools.product("ab", repeat=n)):
            parts = [*word[:-1], word[-1] + "</w>"]
            while True:
                best = min(((rank.get(p, 99), i) for i, p in enumerate(itertools.pairwise(parts))), default=(99, 0))
                if best[0] == 99:
                    break
                pair = merges[best[0]]
                out, i = [], 0
                while i < len(parts):
                    if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                        out.append(parts[i] + parts[i + 1])
                        i += 2
                    else:
                        out.append(parts[i])
                        i += 1
                parts = out
            assert auto.encode(word) == tuple(vocab[p] for p in parts), word


def test_slices_cover_all_rows():
    column = pa.array(["a" * 10, None, "", "b" * 40, "c"])
    assert [(a, b) for a, b, _, _ in slices(column, limit=12)] == [(0, 3), (3, 4), (4, 5)]


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_queries_run_on_the_smallest_tables(spark, name):
    """Every numbered query gives rows; those of a row a document (or vector) give each of them once."""
    got = [r[0] for r in queries.QUERIES[name](spark, SF).collect()]
    assert got
    if name[:4] in ("op1_", "op2_", "op4_", "op6_", "op10"):
        assert sorted(got) == sorted(r[0] for r in queries.table(spark, SF, "documents").select("doc_id").collect())
    if name[:4] == "op3_":
        assert sorted(got) == sorted(r[0] for r in queries.table(spark, SF, "embeddings").select("vec_id").collect())


def test_toxicity_counts_do_not_depend_on_rows(spark):
    texts = ["abc", "Déjà vu", "", None, "x", "ab", "ZYX"]
    one = toxicity_channel.count_characters(frame(spark, list(enumerate(texts))))
    split = sum(toxicity_channel.count_characters(frame(spark, [(0, t)])) for t in texts)
    assert (one == split).all() and one.sum() == 1 + 5 + 1


def test_quality_learns_from_long_documents(spark):
    rows = [(i, "\n".join(f"{'good words here.' if i % 2 else '%%% ### $$$'} {k}" for k in range(300))) for i in range(12)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, label int")
    model = quality_crf.fit(frame(spark, rows), labels, lines=100)
    got = {r.doc_id: r.quality_score for r in quality_crf.scored(frame(spark, rows), model).collect()}
    assert all((got[i] > 0.5) == bool(i % 2) for i in got)
    assert quality_crf.scored(frame(spark, []), model).count() == 0


def test_pipeline_stages_keep_columns(spark):
    import corpus_pipeline

    docs = frame(spark, [(i, prose(random.Random(i), 40)) for i in range(30)] + ODD)
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
    left = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()]
    assert left.count(9005) <= 1 and None in left
    leak = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()
    copy = prose(random.Random(77), 60)
    docs = frame(spark, [(None, copy), (None, copy), (5, copy), (6, None), (None, None), (None, f"so {leak.text} so"), (7, "one text"), (7, "another text here")])
    kept = corpus_pipeline.decontaminate(spark, corpus_pipeline.near_duplicates(spark, docs, SF), SF).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in kept) == [(False, 5, copy), (False, 6, ""), (False, 7, "another text here"), (False, 7, "one text"), (True, 0, "")]
