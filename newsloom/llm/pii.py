"""Personal data: exact patterns, and a skip-chain conditional random field that adds what the patterns miss.

Patterns find e-mails, IPv4 addresses, cards (Luhn) and phones; they stay whatever the model says. The model labels
the words that hold a digit or an @ (others can't be of these kinds). Its graph is one per document: neighbouring
words are linked, and so are equal or similar words anywhere in it (same letters and digits), each occurrence with the
next, so that a word's links grow with its count and not with its square. Words under a pattern's span have its label
for certain; sum-product messages run over the loops a fixed number of rounds; so an occurrence that a pattern knows
lends its label to the ones that it misses (1-555-555-0199 after +1-555-555-0199, 10-0-0-7 after 10.0.0.7).

Weights are learned by pseudo-likelihood from what the patterns find, on one text each of at most `MAX_TEXTS` ids
(smallest hash) with texts of at most `MAX_CHARS` characters. Were the patterns' own features always seen, they would
carry all the weight and the model would only repeat the patterns: so they are hidden from a share `HIDDEN` of the words
under spans, which must then be told by neighbours, cue words and similar words elsewhere. Runs of words with one label,
likelier than `SURE`, that touch no pattern's span are added under that kind.

Time is linear in a text's length. Defined cases: null text counts as empty; texts without digits or @ have no spans;
places are code points, end exclusive; rows with null id are scanned but not learned from; repeated rows come back each;
an empty table learns nothing and returns nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
MAX_TEXTS, MAX_CHARS, ROUNDS, SURE = 2000, 100_000, 6, 0.7
HIDDEN = 0.5

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match that can't start where a run of digits starts can't start within it either
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"[^ \t-\r]+")
_SIGN = re.compile(r"[0-9@]")
_PLAIN = re.compile(r"[^0-9a-z@]+")
_EDGE = "\"'.,;:!?()[]{}<>|*#$%&"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ back over its local part and on over its domain: linear, however long the runs."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's place, start, end) by kind and start."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if _SIGN.search(text):
        if "." in text:
            out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                out.append((2, *m.span()))
        if "+" in text:
            out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


# ---- the field ---------------------------------------------------------------------------------

_CUES = ({"email", "e-mail", "mail", "correo", "courriel"}, {"ip", "host", "server", "address"}, {"card", "visa", "karte", "carte", "tarjeta"}, {"phone", "tel", "call", "telefon", "tél", "fax", "mobile"})
N_FEATURES = 21
#: The features that decide a pattern (@, domain, dotted quad, its parts, Luhn, plus sign), and the shape of mixed words,
#: which would stand for an address by itself where a corpus has few others.
DECIDING = (1, 2, 3, 4, 6, 10, 13, 14)
#: What is believed of a similar word's gain before data speak, and how strongly: names recur, so it is high.
SKIP_GAIN, BELIEF = 4.0, 0.02
#: The unary gain of a label that a pattern gives.
CERTAIN = 20.0


def _features(word: str, before: str, next_is: bool, previous_is: bool) -> list[float]:
    core = word.strip(_EDGE)
    digits = sum(c in "0123456789" for c in core)
    only = all(c in "0123456789.-() +" for c in core)
    parts = core.split(".")
    quad = len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts)
    at = core.find("@")
    return [
        1, "@" in core, at > 0 and "." in core[at:], quad, quad and all(len(p) < 4 and int(p) < 256 for p in parts), only and digits >= 16, only and digits == len(core) and 16 <= digits <= 19 and luhn(core),
        only and 7 <= digits <= 12, only and 3 <= digits < 7, only and digits < 3, core[:1] == "+", "(" in word and ")" in word, "-" in core and only, digits > 0 and not only, len(core) > 24,
        *(before in c for c in _CUES), next_is or previous_is, only and "." in core,
    ]


class Graph:
    """A document's candidate words: places, features, links."""

    def __init__(self, text: str):
        self.at, rows, keys, words = [], [], [], []
        before, place = "", 0
        for m in _WORD.finditer(text):
            w = m[0]
            if _SIGN.search(w):
                self.at.append((place, m.start(), m.end()))
                words.append((w, before))
                keys.append(_PLAIN.sub("", w.lower()))
            before = w.strip(_EDGE + "=").lower()
            place += 1
        n = len(self.at)
        chain = [(i, i + 1) for i in range(n - 1) if self.at[i][0] + 1 == self.at[i + 1][0]]
        linked, follows = {a for a, _ in chain}, {b for _, b in chain}
        for i, (w, b) in enumerate(words):
            rows.append(_features(w, b, i in linked, i in follows))
        seen: dict[str, int] = {}
        skip = []
        for i, k in enumerate(keys):
            if len(k) >= 4:
                if k in seen:
                    skip.append((seen[k], i))
                seen[k] = i
        self.x = np.array(rows, np.float32).reshape(n, N_FEATURES)
        self.chain, self.skip = np.array(chain, np.int64).reshape(-1, 2), np.array(skip, np.int64).reshape(-1, 2)

    def labels(self, spans: list[tuple[int, int, int]]) -> np.ndarray:
        """What the patterns say of each word: 0, or 1 + the kind's place, the first kind where two meet."""
        out = np.zeros(len(self.at), np.int64)
        first, end = (np.array([w[i] for w in self.at], np.int64) for i in (1, 2))
        for kind in range(len(KINDS) - 1, -1, -1):
            own = np.array([(s, e) for k, s, e in spans if k == kind], np.int64).reshape(-1, 2)  # in order, apart
            if len(own):
                at = np.searchsorted(own[:, 1], first, side="right")
                met = at < len(own)
                met[met] = own[at[met], 0] < end[met]
                out[met] = kind + 1
        return out


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Field:
    """Weights: unary (features by labels), chain (labels by labels), skip (a label's gain where two similar words share it)."""

    def __init__(self, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.unary, self.chain, self.skip = unary, chain, skip

    @classmethod
    def fit(cls, x, y, chain, skip, steps: int = 300, rate: float = 0.5, decay: float = 1e-3) -> Field:
        k = len(KINDS) + 1
        one = np.eye(k)[y]
        # what a word's neighbours have, at their known labels
        before, after, alike = (np.zeros((len(y), k)) for _ in range(3))
        np.add.at(before, chain[:, 1], one[chain[:, 0]])
        np.add.at(after, chain[:, 0], one[chain[:, 1]])
        np.add.at(alike, skip[:, 0], one[skip[:, 1]])
        np.add.at(alike, skip[:, 1], one[skip[:, 0]])
        w, a, b = np.zeros((x.shape[1], k)), np.zeros((k, k)), np.full(k, SKIP_GAIN)
        for _ in range(steps):
            p = _softmax(x @ w + before @ a + after @ a.T + alike * b)
            g = (one - p) / max(1, len(y))
            w += rate * (20 * (x.T @ g) - decay * w)
            a += rate * (20 * (before.T @ g + (after.T @ g).T) - decay * a)
            b = np.maximum(0, b + rate * (20 * (alike * g).sum(axis=0) - BELIEF * (b - SKIP_GAIN)))  # similar words never repel
        return cls(w, a, b)

    def marginals(self, x: np.ndarray, chain: np.ndarray, skip: np.ndarray, rounds: int = ROUNDS, known: np.ndarray | None = None) -> np.ndarray:
        """Loopy sum-product, all links at once in each round. known: labels given by patterns, 0 where none is."""
        own = x @ self.unary
        if known is not None:
            own = own + CERTAIN * np.eye(own.shape[1])[known] * (known > 0)[:, None]
        if not len(chain) + len(skip):
            return _softmax(own)
        k = own.shape[1]
        a = np.concatenate([chain[:, 0], chain[:, 1], skip[:, 0], skip[:, 1]])
        b = np.concatenate([chain[:, 1], chain[:, 0], skip[:, 1], skip[:, 0]])
        nc, ns = len(chain), len(skip)
        back = np.concatenate([np.arange(nc) + nc, np.arange(nc), np.arange(ns) + 2 * nc + ns, np.arange(ns) + 2 * nc])
        alike = np.diag(self.skip)
        pot = np.exp(np.concatenate([np.broadcast_to(m, (n, k, k)) for m, n in ((self.chain, nc), (self.chain.T, nc), (alike, 2 * ns))]))
        msg = np.zeros((len(a), k))
        for _ in range(rounds):
            total = own.copy()
            np.add.at(total, b, msg)
            out = total[a] - msg[back]
            out = np.exp(out - out.max(axis=1, keepdims=True))
            new = np.log(np.einsum("ek,ekl->el", out, pot) + 1e-30)
            msg = 0.5 * msg + 0.5 * (new - new.mean(axis=1, keepdims=True))  # damped, so that loops settle
        total = own.copy()
        np.add.at(total, b, msg)
        return _softmax(total)

    def added(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        g = Graph(text)
        if not len(g.at):
            return []
        known = g.labels(base)
        if known.all():
            return []
        p = self.marginals(g.x, g.chain, g.skip, known=known)
        label, sure = p.argmax(axis=1), p.max(axis=1)
        out: list[tuple[int, int, int]] = []
        last = None
        for i, (place, a, b) in enumerate(g.at):
            if known[i] or not label[i] or sure[i] < SURE:
                continue
            if last is not None and last == (place - 1, label[i]):
                k, s, _ = out.pop()
            else:
                k, s = int(label[i]) - 1, a + len(text[a:b]) - len(text[a:b].lstrip(_EDGE))
            last = (place, label[i])
            out.append((k, s, b - len(text[a:b]) + len(text[a:b].rstrip(_EDGE))))
        return [x for x in out if x[2] > x[1]]


def hidden(x: np.ndarray, y: np.ndarray, share: float = HIDDEN, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(x without the deciding features of a share of the labelled words, which words those are)."""
    some = (y > 0) & (np.random.default_rng(seed).random(len(y)) < share)
    x = x.copy()
    x[np.ix_(some, DECIDING)] = 0
    return x, some


def fit(docs: DataFrame, max_texts: int = MAX_TEXTS, max_chars: int = MAX_CHARS, share: float = HIDDEN) -> Field | None:
    """Learns from a bounded sample of (doc_id, text); what comes to the driver are its words' features."""
    import pyarrow as pa

    with_signs = docs.filter(F.col("doc_id").isNotNull() & (F.length("text") <= max_chars) & F.col("text").rlike("[0-9@]"))
    ids = F.broadcast(with_signs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_texts))
    one = with_signs.join(ids, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(0).to_pylist():
                g = Graph(t)
                rows.append((g.x.astype(np.float32).tobytes(), g.labels(base_spans(t)).astype(np.int8).tobytes(), g.chain.tobytes(), g.skip.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.binary()) for i in range(4)], ["x", "y", "chain", "skip"])

    rows = one.select("text").mapInArrow(run, "x binary, y binary, chain binary, skip binary").collect()
    x, y, chain, skip, n = [], [], [], [], 0
    for r in sorted(rows, key=lambda r: (bytes(r["x"]), bytes(r["y"]))):
        y.append(np.frombuffer(r["y"], np.int8))
        x.append(np.frombuffer(r["x"], np.float32).reshape(-1, N_FEATURES))
        chain.append(np.frombuffer(r["chain"], np.int64).reshape(-1, 2) + n)
        skip.append(np.frombuffer(r["skip"], np.int64).reshape(-1, 2) + n)
        n += len(y[-1])
    if not n or not any(len(v) and v.any() for v in y):
        return None
    y = np.concatenate(y).astype(np.int64)
    return Field.fit(hidden(np.concatenate(x).astype(float), y, share)[0], y, np.concatenate(chain), np.concatenate(skip))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find(docs: DataFrame, model: Field | None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base, spans, n_added) of (doc_id, text): counts of the patterns' spans, those and
    all spans as joined kind:start:end, and how many the model added."""
    import pyarrow as pa

    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows = []
                for t in part.column(1).to_pylist():
                    base = base_spans(t) if t and _SIGN.search(t) else []
                    more = model.added(t, base) if model is not None and t and _SIGN.search(t) else []
                    rows.append(([sum(k == i for k, _, _ in base) for i in range(4)], joined(base), joined(base + more), len(more)))
                counts = [pa.array([r[0][i] for r in rows], pa.int64()) for i in range(4)]
                yield pa.RecordBatch.from_arrays([part.column(0), *counts, pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.int64())], ["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans", "n_added"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base string, spans string, n_added long")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, fit(docs))
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), "spans", "n_added", (sum((F.col(f"n_{k}") for k in KINDS), F.lit(0)) + F.col("n_added")).alias("n_spans"))
