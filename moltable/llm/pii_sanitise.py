"""Personal data: patterns for four kinds, and information-theoretic sanitisation around them.

The entity behind a pattern match (an address, a number) is protected.  A term near it
discloses it as far as seeing the term makes the entity likelier: pointwise mutual
information over the entity's own information, PMI(t; e) / I(e), with probabilities
from document frequencies in the whole corpus.  Terms over the threshold, seen often
enough with the entity in different contexts (a copied context counts once), are
generalised to [TERM] in every text that holds the entity, wherever they stand in it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import U64, Words, array_batch, fresh, mix, plain, signed, slices, stored

KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
_DIGITS = str.maketrans("", "", " -().+")
TERM_BITS = 1 << 22
PAIR_BITS = 1 << 22
_TRIM = np.zeros(256, bool)
_TRIM[[ord(c) for c in ".,;:!?\"'()[]{}<>*&%$#|-_"]] = True


@dataclass(frozen=True)
class Disclosure:
    window: int = 6
    threshold: float = 0.5
    support: int = 3


def emails(text: str) -> Iterator[tuple[int, int]]:
    """One pass over the @ signs: what stands left of one back to the last match, a domain right of it."""
    done, at = 0, text.find("@")
    while at >= 0:
        left = text[done:at]
        size = len(left) - len(left.rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if size else None
        if m:
            yield at - size, m.end()
            done = m.end()
        else:
            done = at + 1  # nothing left of this sign can belong to a later match
        at = text.find("@", done)


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Matches of each kind in KINDS, by start; start and end are code points."""
    out: list[list[tuple[int, int]]] = [[], [], [], []]
    if "@" in text:
        out[0] = list(emails(text))
    if DIGIT.search(text):
        if "." in text:
            for m in IP.finditer(text):
                if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 and (len(p) <= 3 or not p[:-3].strip("0")) for p in m[0].split(".")):
                    out[1].append(m.span())
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13:
                digits = m[0].translate(_DIGITS)
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out[2].append(m.span())
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(m[0].translate(_DIGITS)) <= 15:
                    out[3].append(m.span())
    return out


def joined(spans: list[list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, found in zip(KINDS, spans, strict=True) for a, b in found)


def entity(kind: str, text: str) -> int:
    value = text.lower() if kind in ("email", "ip") else text.translate(_DIGITS)
    return int.from_bytes(hashlib.blake2b(f"{kind}:{value}".encode(), digest_size=8).digest(), "little", signed=True)


def terms(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row, hash) of words without marks at their ends, of 3 bytes at least."""
    w = Words(data, off)
    start, end = w.start.copy(), w.end.copy()
    for _ in range(8):
        cut = (end > start) & _TRIM[data[np.minimum(start, len(data) - 1)]]
        start += cut
        back = (end > start) & _TRIM[data[end - 1]]
        end -= back
        if not cut.any() and not back.any():
            break
    ok = end - start >= 3
    start, end = start[ok], end[ok]
    return start, end, w.row[ok], w.span_hash(start, end)


def free_terms(text: str, spans: list[list[tuple[int, int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of the terms of a text that lie in no match; start and end are code points."""
    raw = text.encode("utf-8")
    data = np.frombuffer(raw, np.uint8)
    start, end, _, h = terms(data, np.array([0, len(raw)]))
    if len(raw) != len(text) and len(start):
        point = np.cumsum((data & 0xC0) != 0x80)
        start, end = point[start] - 1, point[end - 1]
    free = np.ones(len(start), bool)
    for a, b in sorted(s for found in spans for s in found):
        free[int(np.searchsorted(end, a, "right")) : int(np.searchsorted(start, b, "left"))] = False
    return start[free], end[free], signed(h[free].copy())


def near(text: str, spans: list[list[tuple[int, int]]], window: int) -> Iterator[tuple[int, int, int]]:
    """(entity, term, context) of each term within `window` terms of a match and in none."""
    start, end, h = free_terms(text, spans)
    for kind, found in zip(KINDS, spans, strict=True):
        for a, b in found:
            i, j = int(np.searchsorted(end, a, "right")), int(np.searchsorted(start, b, "left"))
            lo, hi = max(0, i - window), min(len(start), j + window)
            if lo < hi:
                e = entity(kind, text[a:b])
                context = int(mix(np.array([h[lo:hi].view(U64).sum(dtype=U64)], U64), hi - lo).view(np.int64)[0])
                for k in range(lo, hi):
                    yield e, int(h[k]), context


def pair_slot(e: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The place of (entity, term) in a table of PAIR_BITS bits."""
    return (mix(e.view(U64), 1) ^ mix(t.view(U64), 2)) & U64(PAIR_BITS - 1)


BASE = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base", pa.string())])
NEAR = pa.schema([(c, pa.int64()) for c in "etc"])
HITS = pa.schema([(c, pa.int64()) for c in ("key", "e", "t", "a", "b")])


def _keyed(docs: DataFrame, name: str = "__key") -> DataFrame:
    """A row's own key: repeated rows share it, rows that share only their id don't."""
    return docs.withColumn(name, F.xxhash64(F.col("doc_id"), F.col("text")))


def disclosing(docs: DataFrame, cfg: Disclosure = Disclosure()) -> DataFrame:
    """(key, a, b): spans of disclosing terms of each row of docs; key is xxhash64(doc_id, text).

    How much a term discloses is estimated where it stands near an entity; it then goes wherever it stands in texts that
    hold the entity.
    """

    def contexts(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = []
                for text in part.column(0).to_pylist():
                    spans = base_spans(text or "")
                    if any(spans):
                        rows += near(text, spans, cfg.window)
                if rows:
                    yield array_batch(NEAR, *(np.array(c, np.int64) for c in zip(*rows, strict=True)))

    seen = stored(plain(docs, "text").mapInArrow(contexts, "e long, t long, c long").distinct(), "pii-contexts")
    pair = seen.groupBy("e", "t").agg(F.count("*").alias("n_et")).where(F.col("n_et") >= cfg.support)
    pair = stored(pair, "pii-pairs")
    single = seen.select("e", "c").distinct().groupBy("e").agg(F.count("*").alias("n_e"))

    # document frequencies of the terms that are in question, over all documents: a bit table of fixed size says which
    bits = np.zeros(TERM_BITS, bool)
    slot = pair.select(F.pmod("t", F.lit(TERM_BITS)).cast("int").alias("s")).distinct().toArrow()
    bits[slot.column(0).to_numpy()] = True
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def frequency(batches):
        schema = pa.schema([("t", pa.int64()), ("n", pa.int64())])
        table = np.unpackbits(sent.value).astype(bool)
        for batch in batches:
            for _, _, data, off in slices(batch.column(0)):
                _, _, row, h = terms(data, off)
                ok = table[h & U64(TERM_BITS - 1)]
                pairs = np.unique(np.stack([h[ok], row[ok].astype(U64)], 1), axis=0) if ok.any() else np.zeros((0, 2), U64)
                t, n = np.unique(pairs[:, 0], return_counts=True)
                if len(t):
                    yield array_batch(schema, signed(t.copy()), n)

    total = docs.count()
    df = plain(docs, "text").mapInArrow(frequency, "t long, n long").groupBy("t").agg(F.sum("n").alias("n_t"))
    rule = pair.join(single, "e").join(df, "t")
    n = F.greatest(F.lit(float(total)), F.col("n_e").cast("double") + 1)
    pmi = F.log2(F.col("n_et") * n / (F.col("n_e") * F.greatest("n_t", "n_et")))
    rule = stored(rule.where(pmi / F.log2(n / F.col("n_e")) >= cfg.threshold).select("e", "t"), "pii-rules")

    # a bit table of fixed size says which pairs may be rules; when it is full all pass, and the join decides alone
    def marks(batches):
        for batch in batches:
            slots_of = pair_slot(*(np.array(batch.column(i).to_numpy(), np.int64) for i in (0, 1)))
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(slots_of).astype(np.int32))], names=["s"])

    held = np.zeros(PAIR_BITS, bool)
    held[rule.mapInArrow(marks, "s int").distinct().toArrow().column(0).to_numpy()] = True
    rules = docs.sparkSession.sparkContext.broadcast(np.packbits(held))

    def occurrences(batches):
        table = np.unpackbits(rules.value).astype(bool)
        for batch in batches:
            rows, held_rows = [], 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                spans = base_spans(text or "")
                who = {entity(kind, text[a:b]) for kind, got in zip(KINDS, spans, strict=True) for a, b in got}
                if not who:
                    continue
                start, end, h = free_terms(text, spans)
                for e in who:
                    ok = np.flatnonzero(table[pair_slot(np.full(len(h), e, np.int64), h)])
                    if len(ok):
                        rows.append(np.stack([np.full(len(ok), key), np.full(len(ok), e), h[ok], start[ok], end[ok]]))
                        held_rows += len(ok)
                    if held_rows > 20_000:
                        yield array_batch(HITS, *np.concatenate(rows, axis=1))
                        rows, held_rows = [], 0
            if rows:
                yield array_batch(HITS, *np.concatenate(rows, axis=1))

    hits = _keyed(plain(docs, "doc_id", "text")).select("__key", "text").mapInArrow(occurrences, "key long, e long, t long, a long, b long")
    return stored(hits.join(rule, ["e", "t"], "semi").select("key", "a", "b").distinct(), "pii-terms")


def found(docs: DataFrame, cfg: Disclosure = Disclosure()) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row.

    A null text is empty and has no spans.  Repeated rows each give a row, a null id stays
    null, an empty table gives an empty one; other columns are ignored.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                spans = [base_spans(t or "") for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(i).cast(pa.int64()) for i in (0, 1)), *(pa.array([len(s[i]) for s in spans], pa.int64()) for i in range(4)), pa.array([joined(s) for s in spans], pa.string())], schema=BASE)

    extra = disclosing(docs, cfg).groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("a", "b"))), lambda s: F.concat_ws(":", F.lit("term"), s["a"].cast("string"), s["b"].cast("string"))), ",").alias("terms"))
    base = _keyed(plain(docs, "doc_id", "text")).select("__key", "doc_id", "text").mapInArrow(run, "key long, doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string")
    out = base.join(extra, "key", "left")
    spans = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.col("terms"))
    return out.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), spans.alias("spans"))


def sanitised(docs: DataFrame, cfg: Disclosure = Disclosure()) -> DataFrame:
    """docs with matches replaced by [EMAIL], [IP], [CARD], [PHONE] and disclosing terms by [TERM].

    Overlapping spans are replaced once, by the earliest and longest; a null text stays null.  All other columns
    stay as they are, whatever their names; repeated rows each stay, and an empty table gives an empty one.
    """
    key, terms = fresh(docs, "__key"), fresh(docs, "__terms")
    extra = disclosing(docs, cfg).groupBy(F.col("key").alias(key)).agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias(terms))
    names = docs.columns
    at = names.index("text")

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                texts = [None if t is None else replaced(t, [(x["a"], x["b"]) for x in more or []]) for t, more in zip(part.column(at).to_pylist(), part.column(len(names)).to_pylist(), strict=True)]
                columns = list(part.columns[: len(names)])
                columns[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=names)

    both = _keyed(docs, key).join(extra, key, "left")
    return both.select(*(F.col(f"`{c}`") for c in names), terms).mapInArrow(run, T.StructType(list(docs.schema.fields)))


def replaced(text: str, more: list[tuple[int, int]]) -> str:
    spans = [(a, -b, k.upper()) for k, got in zip(KINDS, base_spans(text), strict=True) for a, b in got] + [(a, -b, "TERM") for a, b in more]
    out, done = [], 0
    for a, b, kind in sorted(spans):
        if a >= done:
            out += [text[done:a], f"[{kind}]"]
            done = -b
    return "".join([*out, text[done:]])
