"""Each operator against brute force, on rows chosen to be awkward: null, empty and long texts, ties, copies, clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm import bpe, common, decontaminate, elias_fano, jaccard_join, language_model, line_dedup, neighbours, pii, substring_dedup, toxicity, url_reputation

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UP = {i: i + 32 for i in range(65, 91)}
EXTRA = ("block", "token", "n", "h1", "lines", "score", "features", "host", "shard", "rank", "component_id", "raw")


def _texts():
    rng = random.Random(7)
    words = ["alpha", "Beta", "gamma", "É", "delta!", "42", "x1", "omega", "sigma", "zz", "naïve", "日本", "tau,", "rho"]
    base = [rng.choice(words) + str(rng.randrange(40)) for _ in range(160)]
    near = base[:]
    near[80] = "changed"
    far = base[:80] + [f"w{i}" for i in range(80)]
    return [
        None, "", " \t\n", "one", "two words", " ".join(base), " ".join(base), "  ".join(near), "\n".join(far), " ".join(base).upper(), "a b c d", "a b c d",
        " ".join(rng.choice(words) for _ in range(30_000)), "mail a.b@c.de +1 (555) 555-0199 from 10.0.0.1 or 999.1.1.1 card 4111 1111 1111 1111.", "<|endoftext|> it's <|endoftext|>", " ".join(["same"] * 60), "mail a.b@c.de\x85\xa0 x\x1cy",
    ]


@pytest.fixture(scope="module")
def rows():
    return list(enumerate(_texts()))


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame([(i, t, None if i == 3 else f"src{i % 2}") for i, t in rows], "doc_id long, text string, source string")
    return df.withColumns({c: F.lit(i) for i, c in enumerate(EXTRA)})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("doc_id < 0")


def _hex(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def test_bpe(docs, rows, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(bpe.TOKENIZER))
    got = {r.doc_id: r for r in bpe.round_trip(docs).collect()}
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == _hex(t.decode(ids, skip_special_tokens=False))
    assert {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs)).collect()} == {i: t or "" for i, t in rows}
    assert bpe.round_trip(empty).count() == 0


def _patterns(t: str):
    kinds = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    for k, p in enumerate(kinds):
        for m in re.finditer(p, t):
            digits = re.sub("[^0-9]", "", m[0])
            if k == 1 and any(int(x) > 255 for x in m[0].split(".")) or k == 2 and not (16 <= len(digits) <= 19 and pii.luhn(digits)) or k == 3 and not 8 <= len(digits) <= 15:
                continue
            yield k, *m.span()


def test_pii(docs, rows, empty):
    got = {r.doc_id: r for r in pii.find(docs, pii.fit(docs.select("doc_id", "text"))).collect()}
    for i, t in rows:
        want = list(_patterns(t or ""))
        assert got[i].base == pii.joined(want)
        assert set(filter(None, got[i].base.split(","))) <= set(got[i].spans.split(","))
    assert pii.find(empty, pii.fit(empty.select("doc_id", "text"))).count() == 0


def test_pii_patterns_at_random():
    rng = random.Random(2)
    for _ in range(20_000):
        t = "".join(rng.choice("1234.@+-ab (0)5") for _ in range(rng.randint(0, 40)))
        assert sorted(pii.base_spans(t)) == sorted(_patterns(t))
    assert pii.base_spans("a" * 300_000 + "@" + "1" * 300_000) == []


def test_skip_links_carry_a_label():
    unary = np.zeros((pii.N_FEATURES, 5))
    unary[10, 4] = 6.0  # a plus sign speaks for a phone
    field = pii.Field(unary, np.zeros((5, 5)), np.full(5, 3.0))
    x = np.zeros((3, pii.N_FEATURES))
    x[0, 10] = 1
    p = field.marginals(x, np.zeros((0, 2), int), np.array([[0, 1]]))
    assert p[1, 4] > 0.8 and abs(p[2, 4] - 0.2) < 1e-6


def _sets(rows, k):
    out = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(UP))
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    return out


@pytest.mark.parametrize(("words", "threshold"), [(4, 85), (5, 80), (2, 30)])
def test_jaccard_join(docs, rows, words, threshold):
    sets = _sets(rows, words)
    top = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                    top[i] = top[j] = min(top[i], top[j])
    got = jaccard_join.classes(docs, words=words, threshold=threshold).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(s), top[i]) for i, s in sets.items()}


def test_jaccard_join_many_near_copies(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = base[:]
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = f"c{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    sets = _sets(rows, 4)
    top = {i: i for i in sets}
    links = [(i, j) for i in sets for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    for _ in range(20):
        for i, j in links:
            top[i] = top[j] = min(top[i], top[j])
    got = jaccard_join.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == top


def test_jaccard_join_empty(empty):
    assert jaccard_join.classes(empty).count() == 0


def test_substring_dedup(docs, rows, empty):
    width, seen, got = 20, set(), {r.doc_id: r for r in substring_dedup.remove_repeats(docs).collect()}
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for j in range(len(w) - width + 1):
            if (k := tuple(w[j : j + width])) in seen:
                gone.update(range(j, j + width))
            seen.add(k)
        assert (got[i].n_words, got[i].n_removed) == (len(w), len(gone))
        assert got[i].text == " ".join(x for j, x in enumerate(w) if j not in gone)
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_language_model(docs, rows, empty):
    tokens = {i: [*WORD.findall((t or "").translate(UP)), ""] for i, t in rows}
    c = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    n, v = sum(c.values()), len(c)
    for r in language_model.scores(docs).collect():
        ws = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1, len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel_tol=1e-9)
        assert r.score < 0
    assert language_model.scores(empty).count() == 0


def test_trie_sums_to_one():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 30, (400, 2)), axis=0)
    count = rng.integers(1, 5, len(keys))
    trie = elias_fano.Trie(keys[:, 0].astype(np.uint64), keys[:, 1], count, 2.5)
    at, backoff = trie.contexts_of(np.arange(35, dtype=np.uint64))
    assert (at[30:] == -1).all() and (backoff[30:] == 0).all()
    for k in np.unique(keys[:, 0]):
        total = elias_fano.restore(trie.lookup(np.full(40, at[k]), np.arange(40))).sum() + elias_fano.restore(backoff[k : k + 1])[0]
        assert abs(total - 1) < 1e-2
        assert set(np.flatnonzero(trie.lookup(np.full(40, at[k]), np.arange(40)))) == set(keys[keys[:, 0] == k, 1])


def test_elias_fano():
    rng = np.random.default_rng(2)
    for n, u in ((0, 5), (1, 1), (100, 90), (1000, 10**12)):
        v = np.sort(rng.integers(0, u, n))
        q = rng.integers(0, u, 500)
        at, found = elias_fano.EliasFano(v, u).successor(q)
        assert (at == np.searchsorted(v, q)).all() and (found == np.isin(q, v)).all()
        assert (elias_fano.EliasFano(v, u)[np.arange(n)] == v).all()


def test_line_dedup(spark, empty):
    rows = [(i, "s", "common line\n\nown %d\n common line " % i if i % 2 else "own %d" % i) for i in range(40)] + [(100, "t", "common line"), (101, None, None), (102, None, "")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns({c: F.lit(1) for c in EXTRA})
    out = line_dedup.remove_boilerplate(df)
    got = {r.doc_id: r.text for r in out.collect()}
    assert out.columns == df.columns
    assert got == {i: ("\nown %d" % i if i % 2 else "own %d" % i) for i in range(40)} | {100: "common line", 101: None, 102: ""}
    assert line_dedup.remove_boilerplate(empty).count() == 0


def test_line_dedup_counts_copies_once(spark):
    import corpus_pipeline

    rng = random.Random(11)
    line = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(10))
    first = [line() for _ in range(12)]
    rows, own = [], {}
    for i in range(90):
        lines = first[:] if i < 45 else [line() for _ in range(6)]
        if 15 <= i < 45:  # 0 to 14: exact copies; these: near copies
            at = rng.randrange(12)
            lines[at] = lines[at].replace("w", "v", 1)
        own[i] = "\n".join(lines)
        rows.append((i, "s", "\n".join(["site header", *lines, "site footer"] if i % 2 else lines)))
    df = spark.createDataFrame([*rows, (None, "s", rows[0][2]), (None, "s", rows[0][2])], "doc_id long, source string, text string")
    out = common.settle(corpus_pipeline.drop_boilerplate(spark, df, ""))
    assert out.count() == 92 and {r.doc_id: r.text for r in out.filter("doc_id is not null").collect()} == own
    left = {r.doc_id: r.text for r in corpus_pipeline.keep_one_of_each_class(spark, out.filter("doc_id is not null"), "").collect()}
    assert left == {i: own[i] for i in [0, *range(45, 90)]}


def test_decontamination(docs, rows, empty, spark):
    strip = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: strip.findall((t or "").translate(UP))
    long = words(rows[5][1])
    items = [(1, " ".join(long[20:35])), (10, "One"), (2, None), (3, "!!"), (4, " ".join(long[20:35]).upper()), (5, "never seen words at all")]
    df = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(docs, df).collect()}
    for i, t in rows:
        w, hit, ids = words(t), set(), set()
        for k, x in items:
            b = words(x)
            size = min(len(b), 10)
            for j in range(len(b) - size + 1 if b else 0):
                for p in range(len(w) - size + 1):
                    if w[p : p + size] == b[j : j + size]:
                        hit.update(range(p, p + size))
                        ids.add(str(k))
        assert (got[i].n_words, got[i].n_hit, list(got[i]["items"])) == (len(w), len(hit), sorted(ids)), i
    assert decontaminate.contamination(empty, df).count() == 0
    assert {r.n_hit for r in decontaminate.contamination(docs, df.filter("item_id < 0")).collect()} == {0}


def test_urls(spark):
    urls = [None, "", "nothing", "HTTP://A.Example.COM/de/1?x", "http://net", "http://x.net/", "https://b.example.net/en/2#f", "http://fakenet/1", "ftp://a.org/fr/", "x://a.org/FR/", "http://org/fr/x://y"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    bad = spark.createDataFrame([("spam.com", 1)] * 40 + [("a.org", 0)] * 40, "host string, bad int")
    got = {r.page_id: (r["host"], r.path, r.rule, r.verdict) for r in url_reputation.judge(pages, bad).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("a.example.com", "/de/1", "example.com/de/", "block")
    assert got[4] == ("net", "", None, "allow") and got[5][2:] == ("net/", "block") and got[6][2:] == ("example.net/en/", "allow")
    assert got[7][2] is None and got[8][2:] == ("org/fr/", "allow") and got[9][2] is None and got[10] == ("org", "/fr/x://y", "org/fr/", "allow")
    spam = url_reputation.judge(spark.createDataFrame([(1, "http://spam.com/x"), (2, "http://sub.spam.com/x")], "page_id long, url string"), bad).collect()
    assert {r.page_id: r.verdict for r in spam}[1] == "block"
    assert url_reputation.judge(pages, bad.filter("bad > 1")).filter("verdict = 'block' and rule is null").count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 8)).astype(float)
    x[50:80] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] * 8), (1003, [1.0] * 3), (1004, [None] + [1.0] * 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    v = neighbours.valid(df)
    got = {}
    for r in neighbours.search(v, v.filter("vec_id % 100 = 0")).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert sorted(got) == [0, 100, 200, 300, 400, 500]
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        want = np.lexsort((np.arange(600), d))[:10]
        assert sorted(found) == list(range(1, 11))
        hits += len({i for i, _ in found.values()} & set(want.tolist()))
        assert all(s == d[i] for i, s in found.values())
    assert hits >= 54 and [i for i, _ in (got[0][k] for k in range(1, 11))] == list(range(50, 60))
    few = neighbours.valid(df.filter("vec_id < 4"))
    assert neighbours.search(few, few.filter("vec_id = 0")).count() == 3
    assert neighbours.search(v.filter("vec_id < 0"), v.filter("vec_id < 0")).count() == 0


def test_toxicity(spark, docs):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.fit(common.table(spark, d, "documents").select("doc_id", "text"), labels)
    odd = model.score(docs, docs.columns)
    assert odd.count() == docs.count() and odd.filter("_score is null or _score < 0 or _score > 1").count() == 0
    scored = model.score(common.table(spark, d, "documents"), ["doc_id", "text"]).join(labels, "doc_id").filter(common.crc_fold(F.col("doc_id")) == 0).collect()
    right = sum((r._score >= 0.5) == bool(r.toxic) for r in scored)
    assert right >= 0.85 * len(scored)
    none = toxicity.fit(docs.select("doc_id", "text"), labels.filter("doc_id < 0"))
    assert {r._score for r in none.score(docs, ["doc_id"]).collect()} == {0.0}


def test_pipeline_stages(spark, docs):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    rows = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, d)
        assert out.columns == docs.columns, name
        rows = common.settle(out)
    ids = {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, rows, d).collect()}
    assert {0, 1, 2, 3, 4, 5, 8, 10} <= ids and not ids & {6, 7, 11}
