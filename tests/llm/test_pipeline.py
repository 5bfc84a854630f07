"""The pipeline as a whole against a plain Python version on documents whose fate is known."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

from tokenizers import Tokenizer

import corpus_pipeline
from moltable.llm import paragraph_dedup, pii_sanitise, quality_crf
from moltable.llm.queries import VOCABULARY


def prose(rng, n):
    return " ".join("".join(rng.choice(["th", "er", "on", "an", "re", "he"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_run_against_a_plain_version(spark, tmp_path):
    rng = random.Random(12)
    good = {i: "\n".join(prose(rng, 25).capitalize() + "." for _ in range(rng.randint(2, 4))) for i in range(0, 60)}
    for i in range(60, 75):  # near and exact copies
        w = good[i - 60].split(" ")
        if i % 3:
            w[rng.randrange(len(w))] = "changed"
        good[i] = " ".join(w)
    for i in range(75, 80):  # one edit in every five words: not a near copy
        w = good[i - 60].split(" ")
        good[i] = " ".join("zz" if k % 5 == 0 else x for k, x in enumerate(w))
    items = {i: prose(rng, 25) for i in range(8)}
    for i in range(80, 88):
        good[i] = f"{prose(rng, 40)}.\n{items[i - 80]}\n{prose(rng, 30)}."
    for i in range(88, 94):
        good[i] = f"{prose(rng, 40)} a{i}@mail.example.com {prose(rng, 9)} 10.0.{i}.1 {prose(rng, 9)}."
    bad = {i: "\n".join(prose(rng, 20).upper().replace(" ", "!! ") for _ in range(3)) for i in range(100, 140)}
    docs = good | bad | {200: None, 201: ""}
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 100), 0) for i in docs if i < 200], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    left = good | {200: "", 201: ""}  # an empty text has the share of good documents as its score, which is over the threshold
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.lower().split()) for i, t in left.items())}
    up = {i: i for i in left}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(sorted(left), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            up[max(top(a), top(b))] = min(top(a), top(b))
    left = {i: t for i, t in left.items() if top(i) == i}
    left = {i: t for i, t in left.items() if not any(x in t for x in items.values())}
    clean = {i: re.sub(r"\b10\.0\.\d+\.1\b", "[IP]", re.sub(r"\S+@mail\.example\.com", "[EMAIL]", t)) for i, t in left.items()}
    lib = Tokenizer.from_file(VOCABULARY)

    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert sorted(got) == sorted(clean)
    assert len(clean) < len(good) - 20 and set(range(75, 80)) <= set(clean)
    for i, t in clean.items():
        ids = lib.encode(t, add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids) == (len(ids), ids), i
        assert got[i].decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_stages_and_operators_leave_clashing_columns_alone(spark):
    """Columns named as the code's own helpers keep their values in every stage; ids are shared and null."""
    rng = random.Random(3)
    names = ["__key", "__text", "__terms", "__shared", "__id", "quality_score", "toxicity", "__cuts", "__version", "key", "base", "terms"]
    texts = ["\n".join(prose(rng, 25).capitalize() + "." for _ in range(3)) for _ in range(12)]
    rows = [(i // 2 if i < 8 else i, t, len(t), *range(100 * i, 100 * i + len(names))) for i, t in enumerate(texts)] + [(None, texts[0], 5, *range(7000, 7000 + len(names))), (50, None, None, *range(8000, 8000 + len(names)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, " + ", ".join(f"`{n}` long" for n in names)).repartition(3)
    want = {r[3]: r[3:] for r in rows}
    sf = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name == "token_ids":
            assert out.count() == len(rows) and out.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]
            continue
        got = out.collect()
        assert out.columns == docs.columns and got, name
        assert all(tuple(r[3:]) == want[r[3]] for r in got), name
        assert name in ("quality", "near_duplicates") or len(got) == len(rows), name
    for out in (paragraph_dedup.cleaned(docs), pii_sanitise.sanitised(docs)):
        assert out.columns == docs.columns and {r[3]: tuple(r[3:]) for r in out.collect()} == want
    model = quality_crf.fit(docs, spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, label int"))
    assert quality_crf.scored(docs, model).columns == [*docs.columns, "quality_score_"]
