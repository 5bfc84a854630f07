"""Splitting texts into pre-tokens as a tokenizer file does, on arrays of code points.

The file's normaliser and pre-tokeniser know another version of Unicode than Python, so
the class and the lower case of every code point are asked of the library once, on the
driver, and sent to the workers with the file's text.  A slice of texts is then split by
a few passes over one array, and a pre-token's hash is a difference of running sums.
"""

from __future__ import annotations

import json
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark import Broadcast
from pyspark.sql import SparkSession
from tokenizers import Tokenizer

from .shared import U64, mix

SPACE, LETTER, NUMBER, OTHER = range(4)
POINTS = 0x110000
#: Bases of the running sums: an odd number and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 7
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


@dataclass(frozen=True, eq=False)
class Spec:
    """A tokenizer file's text, and what its library makes of each code point."""

    text: str
    kind: bytes  # class of each code point
    lower: tuple[np.ndarray, np.ndarray]  # code points with another lower case, and that
    spelt: dict[str, str]  # those whose lower case is more than one code point

    def __hash__(self) -> int:
        return hash(self.text)

    def __eq__(self, other: object) -> bool:
        """Of one file's text: what workers build from it is built once, however often it is sent."""
        return isinstance(other, Spec) and self.text == other.text


def describe(text: str, block: int = 256) -> Spec:
    tok = Tokenizer.from_str(text)
    points = [c for c in range(POINTS) if not 0xD800 <= c < 0xE000]
    normal = tok.normalizer.normalize_str("\n".join(f"\x00{chr(c)}" for c in points if c)).split("\x00")[1:]
    low = {0: "\x00"} | {c: n[:-1] if n.endswith(" ") and len(n) > 1 else n for c, n in zip(points[1:], normal, strict=True)}
    kind = np.zeros(POINTS, np.uint8)
    for a in range(0, len(points), block):
        part = points[a : a + block]
        # a block of letters is one pre-token with the a, one of other signs a second one beside it
        whole = [at for _, at in tok.pre_tokenizer.pre_tokenize_str("a" + "".join(map(chr, part)))]
        if part[0] > 255 and whole in ([(0, len(part) + 1)], [(0, 1), (1, len(part) + 1)]):
            kind[part] = LETTER if len(whole) == 1 else OTHER
            continue
        # each as a, c, c and a space: a letter makes one pre-token, a number three, another sign two; white space ends after a
        ends = dict(at for _, at in tok.pre_tokenizer.pre_tokenize_str("".join(f"a{chr(c)}{chr(c)} " for c in part)))
        for k, c in enumerate(part):
            if low[c].strip(" "):
                stop = ends[4 * k]
                kind[c] = LETTER if stop == 4 * k + 3 else SPACE if 4 * k + 1 not in ends else NUMBER if 4 * k + 2 in ends else OTHER
    one = [(c, ord(n)) for c, n in low.items() if len(n) == 1 and ord(n) != c and n != " " and unicodedata.is_normalized("NFC", chr(c))]
    spelt = {chr(c): n for c, n in low.items() if len(n) > 1 and unicodedata.is_normalized("NFC", chr(c))}
    return Spec(text, kind.tobytes(), (np.array([c for c, _ in one], np.uint32), np.array([n for _, n in one], np.uint32)), spelt)


@lru_cache(maxsize=4)
def _described(text: str) -> Spec:
    return describe(text)


def sent(spark: SparkSession, path: str) -> Broadcast:
    """The Spec of the file at `path`, read on the driver only and broadcast: some 8 MB, whatever the data."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(_described(f.read()))


def _pow(base: int, n: int) -> np.ndarray:
    got = _powers.get(base)
    if got is None or len(got) < n:
        size = 1 << max(20, int(n).bit_length())
        got = np.ones(size, U64)
        have, step = 1, base
        while have < size:
            m = min(have, size - have)
            got[have : have + m] = got[:m] * U64(step)
            have, step = have + m, step * step & 0xFFFFFFFFFFFFFFFF
        _powers[base] = got
    return got


class Splitter:
    def __init__(self, spec: Spec):
        self.kind = np.frombuffer(spec.kind, np.uint8)
        self.low = np.arange(POINTS, dtype=np.uint32)
        self.low[spec.lower[0]] = spec.lower[1]
        self.spelt = spec.spelt
        added = json.loads(spec.text)["added_tokens"]
        self.special = sorted((t["content"] for t in added), key=len, reverse=True)

    def points(self, text: str) -> np.ndarray:
        """Code points of the text, composed and in lower case."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            for c, n in self.spelt.items():
                if c in text:
                    text = text.replace(c, n)
        return self.low[np.frombuffer(text.encode("utf-32-le"), np.uint32)]

    def split(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pre-tokens: runs of letters, single numbers, runs of other signs, and
        an apostrophe with s, t, m, d, re, ve or ll where it begins one."""
        kind = self.kind[points]
        n = len(kind)
        cut = np.ones(n + 1, bool)
        np.not_equal(kind[1:], kind[:-1], out=cut[1:n])
        cut[:n] |= kind == NUMBER
        at = np.flatnonzero(points == 39)
        at = at[(at == 0) | (kind[at - 1] != OTHER)]
        if len(at):
            ahead = np.concatenate([points, np.zeros(3, np.uint32)])
            c1, c2 = ahead[at + 1], ahead[at + 2]
            short = np.isin(c1, np.frombuffer("stmd".encode("utf-32-le"), np.uint32))
            long = (c2 == 101) & ((c1 == 114) | (c1 == 118)) | (c1 == 108) & (c2 == 108)
            cut[at[short | long] + 1] = False
            cut[at[short] + 2] = True
            cut[at[long] + 3] = True
        start = np.flatnonzero(cut[:n] & (kind != SPACE))
        stop = np.flatnonzero(cut)
        return start, stop[np.searchsorted(stop, start, "right")]

    @staticmethod
    def hashes(points: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(points) + 1, U64)
        np.cumsum(mix(points.astype(U64), 3) * _pow(BASE, len(points))[: len(points)], out=sums[1:])
        return mix((sums[end] - sums[start]) * _pow(INVERSE, len(points) + 1)[start], 5)
