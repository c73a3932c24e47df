"""The trained operators on the test tables: what a constant or a copy of the patterns would not pass."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm import common, neighbours, pii, toxicity

DIR = "/root/testdata/sf0.01"


# ---- personal data -----------------------------------------------------------------------------

@pytest.fixture(scope="module")
def field(spark):
    return pii.fit(common.table(spark, DIR, "documents").select("doc_id", "text"))


def test_a_similar_word_lends_its_label(field):
    alone, after = "later 1-555-555-0199 again", "call +1-555-555-0199 now, later 1-555-555-0199 again"
    assert field.added(alone, pii.base_spans(alone)) == []
    at = after.index("1-555-555-0199 again")
    assert field.added(after, pii.base_spans(after)) == [(3, at, at + 14)]


def test_hidden_spans_are_found(spark, field):
    """Half of the patterns' words, their deciding features and labels hidden: found again by context and links."""
    rows = common.table(spark, DIR, "documents").filter("text rlike '[0-9@]'").select("text").collect()
    rng, hit, wrong, all_ = np.random.default_rng(5), 0, 0, 0
    for (text,) in rows:
        g = pii.Graph(text)
        y = g.labels(pii.base_spans(text))
        hid = (y > 0) & (rng.random(len(y)) < 0.5)
        x = g.x.copy()
        x[np.ix_(hid, pii.DECIDING)] = 0
        known = np.where(hid, 0, y)
        p = field.marginals(x, g.chain, g.skip, known=known)
        got = np.where((p.max(axis=1) >= pii.SURE) & (known == 0), p.argmax(axis=1), 0)
        hit += int((hid & (got == y)).sum())
        wrong += int(((got > 0) & (got != y)).sum())
        all_ += int(hid.sum())
    assert all_ > 40 and hit >= 0.7 * all_ and wrong <= 0.1 * hit


def test_labels_by_merge_are_labels_by_scan():
    text = "a1 +1 (555) 555-0199 b2 x@y.de 10.0.0.1 on 4111 1111 1111 1111, +4915112345678 z9 4111111111111111@q.de " * 3
    g, spans = pii.Graph(text), pii.base_spans(text)
    want = [next((k + 1 for k, s, e in sorted(spans) if s < b and a < e), 0) for _, a, b in g.at]
    assert g.labels(spans).tolist() == want and len(set(want)) == 5


def test_learning_is_bounded(spark):
    docs = spark.createDataFrame([(i % 3, f"mail a{i}@b.de x") for i in range(60)] + [(7, "a1@b.de " * 40_000), (None, "q1@b.de")], "doc_id long, text string")
    assert pii.fit(docs, max_texts=2) is not None
    assert pii.fit(docs.filter("doc_id = 7")) is None


# ---- toxicity ----------------------------------------------------------------------------------

def _plain_features(text, fixed, learned, stems):
    words = re.findall(r"[^\W_]+", text.lower())
    per = 100 / max(1, len(words))
    f = [w in fixed for w in words]
    le = [w in learned or w[:5] in stems or w[:7] in stems for w in words]
    hits = [i for i in range(len(words)) if f[i] or le[i]]
    densest = max((sum(i <= j < i + toxicity.STRETCH for j in hits) for i in hits), default=0)
    near = sum(any(w in toxicity.SECOND_PERSON for w in words[max(0, i - 4) : i + 5]) for i in hits)
    odd = [w for w in re.findall(r"[^\W\d_]+(?:[0-9@$!|*._-]+[^\W\d_]+)+", text.lower())]
    hidden = sum(w.translate(toxicity.LEET) in fixed | learned for w in odd)
    raw = text.encode()
    letters, upper = sum(chr(b).isalpha() and b < 128 for b in raw), sum(65 <= b <= 90 for b in raw)
    marks = sum(b < 128 and not chr(b).isalnum() and b > 32 and b != 127 for b in raw)
    return [sum(f) * per, sum(le) * per, np.log1p(sum(f)), np.log1p(sum(le)), densest, near / max(1, len(hits)), upper / max(1, letters), marks / max(1, len(text)), raw.count(b"!") / max(1, len(text)), len(odd) * per, np.log1p(hidden), np.log1p(len(words))]


def test_features_against_a_plain_form():
    fixed, learned, stems = frozenset(toxicity.INSULTS), frozenset({"gloop", "x"}), frozenset({"abcde"})
    for t in ["", "You IDIOT!! you id1ot, gloop", "abcdefgh m0ron é tú " * 40, "fine words here.", "s.h.i.t u st*pid x " * 9, "日本 YOU 7 _x_"]:
        assert np.allclose(toxicity.features_of(t, fixed, learned, stems), _plain_features(t, fixed, learned, stems)), t


def test_toxic_documents_are_found(spark):
    docs, labels = (common.table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    docs = docs.select("doc_id", "text")
    model = toxicity.fit(docs, labels)
    rows = model.score(docs.join(labels.select("doc_id"), "doc_id"), ["doc_id"]).join(labels, "doc_id").filter(common.crc_fold(F.col("doc_id")) == 0).select("_score", "toxic").collect()
    bad = [r for r in rows if r.toxic]
    said = [r for r in rows if r._score >= 0.5]
    assert len(bad) > 30 and sum(r._score >= 0.5 for r in bad) >= 0.8 * len(bad)
    assert sum(r.toxic for r in said) >= 0.9 * len(said)
    # ranks: a random toxic document stands above a random clean one
    wins = np.mean([(b._score > c._score) + 0.5 * (b._score == c._score) for b in bad for c in rows if not c.toxic])
    assert wins >= 0.9
    # calibration: monotone in the trees' probability, within the unit interval
    bounds, values = np.array(model.calibration.boundaries), np.array(model.calibration.predictions)
    assert (np.diff(bounds) >= 0).all() and (np.diff(values) >= 0).all() and values.min() >= 0 and values.max() <= 1
    assert {r["_score"] for r in model.score(docs.limit(0), ["doc_id"]).collect()} == set()


def test_toxicity_of_odd_labels(spark):
    docs = spark.createDataFrame([(i, f"you idiot number {i}" if i % 2 else f"a fine text {i}") for i in range(40)] + [(None, "you idiot"), (3, "other text of the same id")], "doc_id long, text string").withColumn("_score", F.lit("mine"))
    one = docs.selectExpr("doc_id", "1 AS toxic")
    assert {r.s for r in toxicity.fit(docs, one).score(docs, docs.columns, "s").collect()} == {1.0}
    both = docs.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS toxic")
    model = toxicity.fit(docs.filter(common.crc_fold(F.col("doc_id")) != 4), both)  # no calibration fold
    scored = model.score(docs, docs.columns, "s").collect()
    assert len(scored) == 42 and {r["_score"] for r in scored} == {"mine"} and all(0 <= r.s <= 1 for r in scored)


# ---- neighbours --------------------------------------------------------------------------------

def test_recall_on_many_vectors(spark, capsys):
    rng = np.random.default_rng(8)
    n, dim = 20_000, 32
    centres = rng.normal(size=(150, dim)) * 2
    x = centres[rng.integers(0, 150, n)] + rng.normal(size=(n, dim))
    x[5000:5300] = x[0]  # a hot vector
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    rows = neighbours.valid(df)
    got = {}
    for r in neighbours.search(rows, rows.filter("vec_id % 100 = 0")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert len(got) == 200 and all(len(v) == 10 for v in got.values())
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        want = np.lexsort((np.arange(n), d))[:10]
        hits += len({i for _, i in found} & set(want.tolist()))
    index, _ = neighbours.build(rows)
    lists = [len(index.probes(v)) for v in x[::100]]
    with capsys.disabled():
        print(f"\nrecall@10 {hits / 2000:.3f} on {n} vectors; {len(index.c)} lists, {np.mean(lists):.1f} read a query")
    assert hits >= 0.95 * 2000 and np.mean(lists) < 0.5 * len(index.c)


def test_short_queries_are_asked_of_all_lists(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAST_PROBES", 1)
    monkeypatch.setattr(neighbours, "PROBES", 1)
    monkeypatch.setattr(neighbours, "LIST", 4)
    monkeypatch.setattr(neighbours, "ASKED", 3)
    monkeypatch.setattr(neighbours, "PART", 5)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4))
    x[:20] = x[0]  # a hot list, of many queries too
    rows = neighbours.valid(spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>"))
    got = {}
    for r in neighbours.search(rows, rows.filter("vec_id < 40")).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    assert len(got) == 40 and all(sorted(v) == list(range(1, 11)) for v in got.values())
    assert [got[3][i] for i in range(1, 11)] == [0, 1, 2, 4, 5, 6, 7, 8, 9, 10]
