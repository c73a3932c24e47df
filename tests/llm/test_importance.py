"""Importance resampling against a plain version."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UP = {i: i + 32 for i in range(65, 91)}


def _features(text, order):
    w = WORD.findall((text or "").translate(UP))
    return w, [" ".join(w[i : i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1)]


def _plain(docs, target, order=2, buckets=10_000, least=20, percent=25, seed=7):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(map(bucket, _features(x, order)[1]))
    for x in target:
        t.update(map(bucket, _features(x, order)[1]))
    ns, nt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (ns + buckets) / ((s[b] + 1) * (nt + buckets))))
    out = []
    for i, x in docs:
        w, f = _features(x, order)
        weight = sum(gain(bucket(a)) for a in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2], r[3]))
    drawn = able[: percent * len(able) // 100]
    ranks = {}
    for k, r in enumerate(drawn, 1):
        ranks.setdefault(r, []).append(k)
    return sorted((*r[:1], *r[2:], ranks.get(r).pop(0) if ranks.get(r) else None) for r in out) if None not in [r[0] for r in out] else [(*r[:1], *r[2:], ranks[r].pop(0) if ranks.get(r) else None) for r in out]


def _texts():
    rng = random.Random(5)
    words = ["alpha", "Beta", "x1", "É", "日本語", "naïve", "z" * 60, "q" * 47, "w" * 48, "v" * 49, "A-b", "tau,", "0"]
    some = lambda n: " ".join(rng.choice(words) + str(rng.randrange(30)) for _ in range(n))
    base = some(50)
    return [None, "", " -- \t", "one", "two words", base, base, base.upper(), "same " * 60, "\x85 \xa0 é", *(some(rng.randrange(5, 60)) for _ in range(60))]


@pytest.fixture(scope="module")
def rows():
    return list(enumerate(_texts())) + [(7, "other text of an id " * 8), (None, "a text without an id " * 8)]


@pytest.fixture(scope="module")
def target():
    return ["alpha1 alpha2 beta3", None, "", "x10 x11 日本語5 naïve7 " * 10]


def _frames(spark, rows, target):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("n_words", "weight", "score", "rank", "_i", "id")})
    return docs, spark.createDataFrame([(t,) for t in target], "text string")


@pytest.mark.parametrize(("order", "buckets", "piece"), [(1, 50, 1 << 20), (2, 10_000, 1 << 20), (2, 97, 64), (3, 1000, 100)])
def test_equals_plain(spark, rows, target, order, buckets, piece, monkeypatch):
    monkeypatch.setattr(importance, "PIECE", piece)
    docs, wanted = _frames(spark, rows, target)
    if piece < 1 << 20:  # within this process, where the piece is that small
        trie, got = importance.Trie(order), Counter()
        for _, text in rows:
            data = np.frombuffer((text or "").encode(), np.uint8)
            for _, part, at, lead in importance._pieces(data, np.array([0, len(data)]), order - 1):
                for level in trie.grow(part, at, lead):
                    for c, n in zip((level.crc % buckets).tolist(), level.count.tolist(), strict=True):
                        got[c] += n
        want = Counter(zlib.crc32(f.encode()) % buckets for _, t in rows for f in _features(t, order)[1])
        assert +got == +want
        return
    got = importance.resampled(docs.repartition(5), wanted, order=order, buckets=buckets).select("doc_id", "n_features", "weight", "score", "rank")
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(_plain(rows, target, order, buckets), key=key)


def test_long_text_in_pieces(spark):
    rng = random.Random(2)
    text = " ".join(rng.choice(["ab", "Cd", "é", "longerword"]) + str(rng.randrange(500)) for _ in range(600_000)) + " " * 3_000_000 + "u" * 2_500_000 + " end"
    docs = spark.createDataFrame([(1, text), (2, "ab1 cd2")], "doc_id long, text string")
    got = importance.totals(docs)
    want = Counter(zlib.crc32(f.encode()) % 10_000 for t in (text, "ab1 cd2") for f in _features(t, 2)[1])
    assert {i: n for i, n in enumerate(got.tolist()) if n} == dict(want)


def test_all_rows_equal_and_none(spark):
    docs, wanted = _frames(spark, [(1, "word " * 30)] * 8, [])
    got = importance.resampled(docs, wanted).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2] and len({r["score"] for r in got}) == 1
    assert importance.resampled(docs.filter("doc_id < 0"), wanted).count() == 0
