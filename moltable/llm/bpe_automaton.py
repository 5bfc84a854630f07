"""BPE by a deterministic tokenisation automaton.

Each merge (u, v) -> w of the vocabulary is one *gadget* put into an automaton whose
states are "after token x" and whose arcs are labelled by tokens: the gadget adds a
w arc beside every path u v and cuts the v arc out of the state behind u.  The state
behind w is a copy of the state behind v as it was then.  Written out, these arcs are
of the order of the vocabulary squared, so they are kept as what the gadgets did: a
table of cuts with the time of each, and for each token its time and two parts.

Texts are read by bytes, so the automaton is made deterministic over bytes: a state
holds, for every token label that the last bytes may begin, the token that stands
before it, and the token that ends here.  Every prefix of a text has one path through
the gadgets' automaton, so there is one such token.  Entries of the transition table
(state, byte) are compiled from the gadgets when they are first met.
Encoding is a table lookup a byte, and the ids are read off backwards, from the token
that ends the word.  Decoding emits the labels of the ids.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import Spec, Splitter, sent
from .shared import plain

END = "</w>"
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
MAX_ARCS = 400_000
MAX_STATES = 150_000  # of some 600 bytes with their transitions; a full table is begun again, with the same results
LONG_WORD = 48
NEVER = 1 << 60


def byte_symbols() -> list[str]:
    """One printable character for each byte: printable Latin-1 bytes stand for themselves, the rest follow 256."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    out, extra = {b: chr(b) for b in own}, 256
    for b in range(256):
        if b not in out:
            out[b], extra = chr(extra), extra + 1
    return [out[b] for b in range(256)]


class Automaton:
    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.vocab = vocab
        self.labels = {i: s for s, i in vocab.items()}
        self.time, self.left, self.right, self.cut = dict.fromkeys(vocab.values(), -1), {}, {}, {}
        self._arcs: dict[tuple[int, int], bool] = {}
        for k, (a, b) in enumerate(merges):
            self._gadget(k, vocab[a], vocab[b], vocab[a + b])
        self._compile_labels()

    def _compile_labels(self) -> None:
        """The trie of labels over bytes: at each node the token that it spells within a word, and at a word's end."""
        byte = {s: b for b, s in enumerate(byte_symbols())}
        self.child: dict[int, int] = {}
        self.inner, self.final, self.grows = [-1], [-1], [False]
        self.length = {}
        for s, i in self.vocab.items():
            ends = s.endswith(END) and len(s) > len(END)
            label = s[: -len(END)] if ends else s
            if self.time[i] == NEVER or self.time[i] < 0 and len(label) > 1:
                continue
            node = 0
            for c in label:
                at = node << 8 | byte[c]
                self.grows[node] = True
                node = self.child.setdefault(at, len(self.inner))
                if node == len(self.inner):
                    self.inner.append(-1)
                    self.final.append(-1)
                    self.grows.append(False)
            (self.final if ends else self.inner)[node] = i
            self.length[i] = len(label)
        self.nodes = len(self.inner)
        self._clear()

    def _clear(self) -> None:
        self.table: dict[int, int] = {}  # state << 8 | byte -> state
        self.spans: list[tuple[int, ...]] = []  # of each state: (token before + 1) * nodes + node of the label begun since
        self.token: list[int] = []
        self.ending: list[int | None] = []
        self.state: dict[tuple[int, ...], int] = {}
        self._enter((0,), -1)

    def _enter(self, spans: tuple[int, ...], token: int) -> int:
        got = self.state.get(spans)
        if got is None:
            got = self.state[spans] = len(self.spans)
            self.spans.append(spans)
            self.token.append(token)
            self.ending.append(None)
        return got

    def _transition(self, state: int, b: int) -> int:
        """Compile one entry of the table: each begun label goes on by byte b, and the one that is whole here ends."""
        spans, token, nodes = [], -1, self.nodes
        for code in self.spans[state]:
            before, node = divmod(code, nodes)
            node = self.child.get(node << 8 | b)
            if node is None:
                continue
            t = self.inner[node]
            if t >= 0 and (not before or self.arc(before - 1, t)):
                token = t
            if self.grows[node] or self.final[node] >= 0:
                spans.append(before * nodes + node)
        if token >= 0:
            spans.append((token + 1) * nodes)
        if len(self.spans) >= MAX_STATES:
            self._clear()
            return self._enter(tuple(spans), token)
        to = self.table[state << 8 | b] = self._enter(tuple(spans), token)
        return to

    def _word_end(self, state: int) -> int:
        """The token that ends a word in this state, -1 for none."""
        got = self.ending[state]
        if got is None:
            got = -1
            for code in self.spans[state]:
                before, node = divmod(code, self.nodes)
                t = self.final[node]
                if t >= 0 and (not before or self.arc(before - 1, t)):
                    got = t
            self.ending[state] = got
        return got

    def _gadget(self, k: int, u: int, v: int, w: int) -> None:
        """Merge number k: w beside u v, and v no longer behind u.  A pair that earlier gadgets cut everywhere makes nothing."""
        if self.time[u] != NEVER and self.time[v] != NEVER and self._arc(u, v, k):
            self.cut[(u, v)] = k
            if w not in self.left:
                self.time[w], self.left[w], self.right[w] = k, u, v
        elif w not in self.left:
            self.time[w] = NEVER

    def arc(self, x: int, t: int) -> bool:
        """Whether the state behind x has a t arc when all gadgets are in."""
        got = self._arcs.get((x, t))
        if got is None:
            if len(self._arcs) > MAX_ARCS:
                self._arcs.clear()
            got = self._arcs[(x, t)] = self._arc(x, t, NEVER)
        return got

    def _arc(self, x: int, t: int, until: int) -> bool:
        also = False
        while True:
            c = self.cut.get((x, t))
            if c is not None and (c < until or also and c == until):
                return False
            a, b = self.time[x], self.time[t]
            if a < 0 and b < 0:
                return True
            if b >= a:  # t came later: its left part must follow x when t is made; a tie goes to the pair further left
                until, also, t = b, True, self.left[t]
            else:
                until, also, x = a, False, self.right[x]

    def encode(self, word: str) -> tuple[int, ...]:
        """Ids of one pre-split word."""
        if not word:
            return ()
        state, tokens = 0, []
        data = word.encode("utf-8")
        for b in data:
            to = self.table.get(state << 8 | b)
            state = self._transition(state, b) if to is None else to
            tokens.append(self.token[state])
        path, at, t = [], len(data), self._word_end(state)
        while t >= 0:
            path.append(t)
            at -= self.length[t]
            if at == 0:
                return tuple(reversed(path))
            t = tokens[at - 1]
        raise ValueError(f"no path spells {word!r}")


class Codec:
    """Normalising, pre-splitting and the automaton for one vocabulary file.

    Classes and lower case of letters beyond ASCII are those of the file's library.
    """

    def __init__(self, described: Spec):
        spec = json.loads(described.text)
        self.splitter = Splitter(described)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.automaton.labels |= {i: s for s, i in self.special.items()}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.marks = tuple(self.special)
        self.words = _Words(self)

    def pieces(self, text: str) -> Iterator[tuple[int | None, list[str]]]:
        """Special ids, or lists of pre-split words."""
        parts = self.split.split(text) if self.split and any(m in text for m in self.marks) else [text]
        for p in parts:
            if p in self.special:
                yield self.special[p], []
            elif p:
                if p.isascii():
                    yield None, PRETOKEN.findall(p.lower())
                    continue
                points = self.splitter.points(p)
                low = points.tobytes().decode("utf-32-le")
                start, end = self.splitter.split(points)
                yield None, [low[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]

    def word_ids(self, word: str) -> tuple[int, ...]:
        return self.automaton.encode(word)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for special, words in self.pieces(text):
            if special is not None:
                out.append(special)
            for w in words:
                out += self.word_ids(w)
        return out

    def decode(self, ids: list[int]) -> str:
        """Arc labels, joined as a vocabulary without a decoder has them."""
        return " ".join(self.automaton.labels[i] for i in ids)

    def texts(self, text: str) -> tuple[int, str, str]:
        """Number of ids, the ids in decimal, and their labels, each joined by spaces."""
        ids, labels = [], []
        for special, words in self.pieces(text):
            if special is not None:
                ids.append(str(special))
                labels.append(self.automaton.labels[special])
            elif words:
                got = [self.words[w] for w in words]
                ids += [x for x, _ in got]
                labels += [x for _, x in got]
        joined = " ".join(ids)
        return joined.count(" ") + 1 if joined else 0, joined, " ".join(labels)


class _Words(dict):
    """Memo from a word to its ids and labels, both as text; bounded, and emptied when full."""

    LIMIT = 250_000

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, word: str) -> tuple[str, str]:
        ids = self.codec.word_ids(word)
        labels = self.codec.automaton.labels
        got = " ".join(map(str, ids)), " ".join(labels[i] for i in ids)
        if len(word) <= LONG_WORD:
            if len(self) >= self.LIMIT:
                self.clear()
            self[word] = got
        return got


@lru_cache(maxsize=1)
def codec(described: Spec) -> Codec:
    return Codec(described)


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids, decoded) of every whole text.

    ids is the ids in decimal joined by one space, decoded the labels of these ids.  A null
    or empty text has no ids: 0 and two empty strings.  Repeated rows each give a row; a
    null id stays null; an empty table gives an empty one; other columns are left behind.
    The vocabulary is read on the driver and sent to the workers.
    """
    spec = sent(docs.sparkSession, vocabulary)
    schema = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.string()), ("decoded", pa.string())])

    def run(batches):
        c = codec(spec.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                part = batch.slice(a, 64)
                rows = [c.texts(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), *(pa.array([r[i] for r in rows], schema.field(i + 1).type) for i in range(3))], schema=schema)

    return plain(docs, id_col, text_col).mapInArrow(run, "id long, n_tokens long, ids string, decoded string").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encode_decode's rows."""
    out = encode_decode(docs, vocabulary)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
