"""BPE encoding and decoding by dynamic programming over prefixes.

Every prefix of a pretoken has one last token in its BPE encoding. It is found among the vocabulary entries that end
where the prefix ends (an automaton over the vocabulary gives all of them while it reads the bytes once): the one
whose rest is empty or ends in a token that is compatible with it. Two adjacent tokens are compatible if undoing
their merges at the boundary, latest first, never shows a pair that the merges would have joined before. Following
the last tokens back from the end gives the ids. Time is linear in the pretoken's length; nothing is searched twice.

The tokenizer file's path is a parameter; the driver reads it once and its merges (a fixed few MB) are broadcast.

Defined cases: null text counts as empty: no ids, empty text; the special token's string in a text is that token, as
the tokenizers library has it; repeated rows come back repeated; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TOKENIZER = "byte_bpe_50k.json"
#: Pretokens whose ids, and pairs whose compatibility, are remembered in a worker; beyond it the memory starts anew.
REMEMBERED, PAIRS = 100_000, 100_000

# Fixed values of the byte-level scheme: white space, and the split of a text into pretokens.
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
_ASCII_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    odd = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(odd)}


class Codec:
    """Ids of pretokens, and bytes of ids."""

    def __init__(self, spec: str):
        import ahocorasick
        import regex

        spec_ = json.loads(spec)
        vocab, merges = spec_["model"]["vocab"], spec_["model"]["merges"]
        letters = byte_letters()
        back = {c: b for b, c in letters.items()}
        self.as_letters = {b: ord(c) for b, c in letters.items()}
        self.rank: dict[tuple[int, int], int] = {}
        size = max([*vocab.values(), *(t["id"] for t in spec_["added_tokens"])]) + 1
        self.made, self.left, self.right = [-1] * size, [0] * size, [0] * size
        for r, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            a, b, t = vocab[a], vocab[b], vocab[a + b]
            self.rank[a, b] = r
            if self.made[t] < 0:
                self.made[t], self.left[t], self.right[t] = r, a, b
        self.bytes: list[bytes] = [b""] * size
        self.ends = ahocorasick.Automaton()
        for text, i in vocab.items():
            self.bytes[i] = bytes(back[c] for c in text)
            if len(text) == 1 or self.made[i] >= 0 and self.own(i):
                self.ends.add_word(text, (len(text), i))
        self.ends.make_automaton()
        self.length = [len(b) for b in self.bytes]
        self.packed = [i.to_bytes(4, "little") for i in range(size)]
        self.special = {t["content"]: t["id"] for t in spec_["added_tokens"]}
        for text, i in self.special.items():
            self.bytes[i] = text.encode()
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.find, self.find_ascii = regex.compile(_SPLIT).findall, re.compile(_ASCII_SPLIT).findall
        self.pairs: dict[tuple[int, int], bool] = {}
        self.known = _Known(self)

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE leaves a and b apart where they meet."""
        rank, made, limit = self.rank, self.made, 1 << 40
        while True:
            if rank.get((a, b), limit) < limit:
                return False
            if made[a] < 0 and made[b] < 0:
                return True
            if made[a] > made[b]:  # the later merge is undone first
                limit, a = made[a], self.right[a]
            else:  # the leftmost of equal merges goes first, so an equal one across the boundary wins
                limit, b = made[b] + 1, self.left[b]

    def pretoken(self, text: str) -> list[int]:
        """The ids of one pretoken."""
        word = text.encode().decode("latin-1").translate(self.as_letters)
        last = [-1] * len(word)  # of the prefix that ends with each letter
        pairs, done = self.pairs, -1
        for end, (length, token) in self.ends.iter(word):  # longest first at each end
            if end == done:
                continue
            if end >= length:
                pair = last[end - length] << 20 | token
                ok = pairs.get(pair)
                if ok is None:
                    if len(pairs) > PAIRS:
                        pairs.clear()
                    ok = pairs[pair] = self.compatible(pair >> 20, token)
                if not ok:
                    continue
            last[end], done = token, end
        ids, end = [], len(word) - 1
        while end >= 0:
            ids.append(last[end])
            end -= self.length[last[end]]
        return ids[::-1]

    def own(self, token: int) -> bool:
        """Whether BPE makes this token of its own bytes: its halves, themselves so made, stay apart until its merge."""
        a, b, made, limit = self.left[token], self.right[token], self.made, self.made[token]
        while made[a] >= 0 or made[b] >= 0:
            if made[a] > made[b]:
                limit, a = made[a], self.right[a]
            else:
                limit, b = made[b] + 1, self.left[b]
            if self.rank.get((a, b), limit) < limit:
                return False
        return True

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.at_special is None or not any(s in text for s in self.special):
            return self._plain(text)
        return b"".join(self.special[p].to_bytes(4, "little") if p in self.special else self._plain(p) for p in self.at_special.split(text))

    def _plain(self, text: str) -> bytes:
        known = self.known
        return b"".join([known[w] for w in (self.find_ascii if text.isascii() else self.find)(text)])

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


class _Known(dict):
    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        packed = self.codec.packed
        out = b"".join([packed[i] for i in self.codec.pretoken(word)])
        if len(word) < 100:
            self[word] = out
        return out


_codecs: dict[str, Codec] = {}


def codec(spec: str) -> Codec:
    """Built once in a worker."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _codecs:
        _codecs[key] = Codec(spec)
    return _codecs[key]


def _spec(path: str | None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, *, path: str | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id_col, ids: array<int>) of every row."""
    import pyarrow as pa

    spec, kind = docs.sparkSession.sparkContext.broadcast(_spec(path)), docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        c = codec(spec.value)
        for batch in batches:
            for part in _small(batch):
                ids = [np.frombuffer(c.encode(t or ""), "<i4") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], [id_col, "ids"])

    return docs.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode(encoded: DataFrame, *, path: str | None = None, id_col: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(id_col, text) of rows with ids."""
    import pyarrow as pa

    spec, kind = encoded.sparkSession.sparkContext.broadcast(_spec(path)), encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(spec.value)
        for batch in batches:
            for part in _small(batch, 100):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([c.decode(x or []) for x in part.column(1).to_pylist()], pa.string())], [id_col, "text"])

    return encoded.select(id_col, ids).mapInArrow(run, f"`{id_col}` {kind}, text string")


def _small(batch, rows: int = 500):
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def round_trip(docs: DataFrame, *, path: str | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256): encode and decode in one pass, so that ids needn't travel."""
    import pyarrow as pa

    spec, kind = docs.sparkSession.sparkContext.broadcast(_spec(path)), docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        c = codec(spec.value)
        for batch in batches:
            for part in _small(batch):
                sizes, hashes, texts = [], [], []
                for t in part.column(1).to_pylist():
                    ids = c.encode(t or "")
                    sizes.append(len(ids) // 4)
                    hashes.append(hashlib.sha256(ids).hexdigest())
                    texts.append(hashlib.sha256(c.decode(np.frombuffer(ids, "<u4").tolist()).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(hashes, pa.string()), pa.array(texts, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
