"""Queries against their SQL, and the cases that the operators define: odd ids, repeated rows, degenerate labels, two-level exchange."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newsloom.llm import blocks, common, decontaminate, jaccard_join, language_model, line_dedup, registry, substring_dedup, url_reputation

DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
UP = {i: i + 32 for i in range(65, 91)}


def _rows(rows, names):
    at = [names.index(c) for c in sorted(names)]
    return sorted((tuple(r[i] for i in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = registry.QUERIES[name](spark, DIR)
    want = con.execute(registry.SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(names)
    assert _rows([tuple(r) for r in df.collect()], df.columns) == _rows(want.fetchall(), names)


# ---- urls --------------------------------------------------------------------------------------

HOSTS = ["a.com", "b.com", "x.b.com", "c.org", "d.co.uk", "e.gov.uk", "10.0.0.1", "u@f.com.au:80", ""]
LABELS = {
    "all good": lambda h, i: 0,
    "all bad": lambda h, i: 1,
    "mixed": lambda h, i: (h * 7 + i) % 3 == 0,
    "none": lambda h, i: None,
}


@pytest.mark.parametrize(("hosts", "label", "each"), [(HOSTS, "all good", 2), (HOSTS, "all bad", 2), (HOSTS, "mixed", 1), (HOSTS, "mixed", 6), (HOSTS[:1], "mixed", 6), (HOSTS[:1], "all bad", 1), (HOSTS[:3], "mixed", 6), (HOSTS, "none", 2), ([], "none", 1)])
def test_reputation_of_degenerate_labels(spark, tmp_path, hosts, label, each):
    pages = [(i, f"http://{h}/p{i}?q") for i, h in enumerate(h for h in hosts for _ in range(each))] + ([(900, None), (901, "http://new.b.com/")] if hosts else [])
    labels = [(i, None if (x := LABELS[label](i // each, i)) is None else 1 - int(x)) for i, _ in pages if i < 900]
    spark.createDataFrame(pages, "page_id long, url string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int").coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(url_reputation.OP8_SQL)
    df = url_reputation.op8_url_reputation(spark, str(tmp_path))
    assert _rows([tuple(r) for r in df.collect()], df.columns) == _rows(want.fetchall(), [c[0] for c in want.description])


def test_levels_and_clashing_names(spark, monkeypatch):
    df = spark.createDataFrame([(h,) for h in HOSTS], "h string")
    got = [tuple(r) for r in df.select(*url_reputation.levels_of(F.col("h"))).collect()]
    assert got == [("a.com", "com"), ("b.com", "com"), ("b.com", "com"), ("c.org", "org"), ("d.co.uk", "co.uk"), ("e.gov.uk", "gov.uk"), ("10.0.0.1", "ip"), ("f.com.au", "com.au"), ("", "")]
    pages = spark.createDataFrame([(i, f"http://{h}/x") for i, h in enumerate(["a.com"] * 30 + ["b.com"] * 3)], "page_id long, url string")
    pages = pages.withColumns({c: F.lit("x") for c in ("host", "bad_bound", "rule", "verdict", "_host", "_h", "_bound", "domain", "pages", "a", "k_h")})
    bad = spark.createDataFrame([("a.com", 1)] * 30 + [("b.com", 0)] * 30, "host string, bad int")
    plain = url_reputation.judge(pages, bad)
    assert set(plain.columns) == {*pages.columns, "path"} and {r["_host"] for r in plain.collect()} == {"x"}
    monkeypatch.setattr(url_reputation, "BROADCAST_HOSTS", 0)
    monkeypatch.setattr(url_reputation, "HEAVY", 2)  # a.com is hot, b.com isn't
    assert sorted(map(repr, url_reputation.judge(pages, bad).collect())) == sorted(map(repr, plain.collect()))


# ---- decontamination ---------------------------------------------------------------------------

def _contamination(rows, items, width=10):
    cut = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: cut.findall((t or "").translate(UP))
    out = []
    for i, t in rows:
        w, hit, ids = words(t), set(), set()
        for k, x in items:
            b = words(x)
            size = min(len(b), width)
            for j in range(len(b) - size + 1 if b else 0):
                for p in range(len(w) - size + 1):
                    if w[p : p + size] == b[j : j + size]:
                        hit.update(range(p, p + size))
                        ids.add(str(k))
        out.append((i, len(w), len(hit), tuple(sorted(ids))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_decontamination_of_repeated_ids(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", broadcast)
    rng = random.Random(5)
    base = " ".join(rng.choice(["the", "a", "of", "cat", "dog"]) for _ in range(60))
    rows = [(1, "a b c d e f"), (1, "x Y z"), (1, "x Y z"), (None, "q x, y"), (None, "q x, y"), (None, None), (2, base), (3, base + " " + base), (-4, " !x! y"), (5, ""), (6, "x"), (7, "y x")]
    items = [(1, "x y"), (2, base[: len(base) // 2]), (2, base), (3, "the the"), (4, None), (5, "X y"), (6, "zz")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in decontaminate.contamination(docs, bench).collect()), key=repr)
    assert got == _contamination(rows, items)
    monkeypatch.setattr(common, "NARROW", broadcast)
    left = common.without(docs, decontaminate.contaminated(docs, bench)).collect()
    assert sorted(map(repr, ((r.doc_id, r.text) for r in left))) == sorted(map(repr, [(1, "a b c d e f"), (None, None), (5, ""), (6, "x"), (7, "y x")]))


# ---- exchange, substring dedup, language model, Jaccard join ---------------------------------------

def _odd_rows():
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(30)]
    passage = " ".join(rng.choice(vocab) for _ in range(40))
    rows = []
    for i in [-5, 7, 0, 2**63 - 1, -(2**63), 12, 13, 2**40, -1]:
        rows.append((i, " ".join([*(rng.choice(vocab) for _ in range(rng.randrange(30))), passage, *(rng.choice(vocab) for _ in range(rng.randrange(30)))])))
    return [*rows, (None, "z " + passage), (3, "one"), (4, None), (5, " \n")], passage


def _deduped(rows, width=20):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        w, gone = WORD.findall(t or ""), set()
        for j in range(len(w) - width + 1):
            if (k := tuple(w[j : j + width])) in seen:
                gone.update(range(j, j + width))
            seen.add(k)
        out[i] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


@pytest.mark.parametrize("fan", [None, 5])
def test_substring_dedup_of_odd_ids(spark, fan):
    rows, _ = _odd_rows()
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), fan=fan).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.text) for r in got} == _deduped(rows)


def test_substring_dedup_of_repeated_ids(spark):
    passage = " ".join(f"p{i}" for i in range(25))
    rows = [(i, passage) for i in (None, None, 4, 4, 4, 9)]
    got = sorted((repr(r.doc_id), r.n_removed) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("4", 0), ("4", 25), ("4", 25), ("9", 25), ("None", 25), ("None", 25)]


def _model(rows, priors):
    """The trigram model as dictionaries: {id: (n_tokens, base, score)} of rows with distinct ids."""
    train = lambda i: i is None or zlib.crc32(str(i).encode()) % 5 != 1
    tokens = {i: [*WORD.findall((t or "").translate(UP)), "\n"] for i, t in rows}
    one, two, three = Counter(), Counter(), Counter()
    for i, ws in tokens.items():
        if train(i):
            one.update(ws)
            for x, y, z in zip(["^", "^", *ws], ["^", *ws], ws, strict=False):
                two[y, z] += 1
                three[x, y, z] += 1
    n, v = sum(one.values()), len(one)
    one["^"] = one["\n"]  # a start a text
    pairs = Counter()
    for (x, y, _), c in three.items():
        pairs[x, y] += c
    for i, ws in tokens.items():  # a text's last pair is a context too: of what comes after the end
        if train(i):
            pairs[["^", *ws][-2], "\n"] += 1
    k2, k3 = priors
    out = {}
    for i, ws in tokens.items():
        base = score = 0.0
        for x, y, z in zip(["^", "^", *ws], ["^", *ws], ws, strict=False):
            p1 = (one[z] + 0.5) / (n + 0.5 * (v + 1))
            p2 = (two[y, z] + k2 * p1) / (one[y] + k2)
            base += math.log10(p1)
            score += math.log10((three[x, y, z] + k3 * p2) / (pairs[x, y] + k3))
        out[i] = (len(ws), base, score)
    return out


@pytest.mark.parametrize(("fan", "dealt"), [(None, None), (5, None), (None, 40)])
def test_language_model_is_the_dictionary_model(spark, monkeypatch, fan, dealt):
    if dealt:
        monkeypatch.setattr(language_model, "DEALT", dealt)
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(12)]
    rows = [(i, " ".join(rng.choice(vocab[: 2 + i % 11]) if rng.random() < 0.98 else f"new{rng.randrange(99)}" for _ in range(rng.randrange(90)))) for i in range(60)] + [(None, "w1 w2 w3"), (100, None), (101, "W1 w1")]
    want = _model(rows, language_model.PRIORS)
    got = language_model.scores(spark.createDataFrame(rows, "doc_id long, text string"), fan=fan).collect()
    assert len(got) == len(rows)
    for r in got:
        n, base, score = want[r.doc_id]
        assert r.n_tokens == n and math.isclose(r.base_score, base, rel_tol=1e-9)
        assert abs(r.score - score) < 4e-4 * n, (r.doc_id, r.score, score)  # 16 bits over 14 decades: 1e-4 a code


def test_language_model_beats_its_base(spark):
    got = language_model.scores(common.table(spark, "/root/testdata/sf0.01", "documents")).filter("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert got[0] / got[2] > got[1] / got[2] + 0.3


def test_language_model_without_training_rows(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 1][:5]
    got = language_model.scores(spark.createDataFrame([(i, "a b") for i in held], "doc_id long, text string")).collect()
    assert [(r.train_tokens, r.n_known, r.base_score, r.score) for r in got] == [(0, 0, 0.0, 0.0)] * 5


@pytest.mark.parametrize("fan", [None, 5])
def test_jaccard_join_of_odd_rows(spark, fan):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for g in range(12):
        own = [f"g{g}x{i}" for i in range(60)] if g % 2 else base[:]
        for _ in range(6):
            w = own[:]
            for _ in range(rng.randrange(12)):
                w[rng.randrange(len(w))] = f"c{rng.randrange(10**6)}"
            rows.append((rng.choice([None, -3, 5, 5, g, 100 + len(rows)]), " ".join(w)))
    rows += [(7, ""), (7, None), (None, " "), (5, "one two"), (6, "ONE  two"), (6, "ONE  two")]
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(UP))
        sets.append({tuple(w[j : j + 4]) for j in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set()))
    top = list(range(len(rows)))
    for _ in rows:
        for i, j in itertools.combinations(range(len(rows)), 2):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                top[i] = top[j] = min(top[i], top[j])
    ids = defaultdict(list)
    for i, t in enumerate(top):
        ids[t].append(rows[i][0])
    want = sorted(((rows[i][0], len(sets[i]), min((x for x in ids[t] if x is not None), default=None) if sets[i] else rows[i][0]) for i, t in enumerate(top)), key=repr)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_join.classes(docs, fan=fan).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == want
    if fan is None:
        left = jaccard_join.leaders(docs.withColumn("_row", F.lit(1)), words=4, threshold=85).collect()
        assert len(left) == len({t for i, t in enumerate(top) if sets[i]}) + sum(not s for s in sets)
        assert Counter(r.text for r in left if not (r.text or "").strip()) == Counter(t for _, t in rows if not (t or "").strip())


def test_exchange_rows_grow_with_the_input(spark):
    """Rows of every hop at two sizes beyond FAN: in proportion to blocks and shards, not to their product."""
    def rows(scale: int) -> tuple[int, int]:
        p = blocks.Plan(200 * scale, 200 * scale, 16)
        x = blocks.Exchange(p, 1 << 64, 1, (np.uint64,), lambda keys, sums: [sums[0]])
        rng = np.random.default_rng(0)
        asked = merged = 0
        for b in range(0, p.blocks, p.blocks // 10):
            keys = np.unique(rng.integers(0, 2**64, 3000, dtype=np.uint64))
            asked += x.ask(b, [keys], [np.ones(len(keys), np.uint8)]).num_rows * (p.blocks // 10) / (p.blocks // 10)
        groups = -(-p.blocks // p.per_group)
        merged = groups * p.shards  # a row a group and shard at most
        return asked / 10 * p.blocks, merged
    (a1, m1), (a2, m2) = rows(1), rows(4)
    assert 3.9 < a2 / a1 < 4.1 and 3.9 < m2 / m1 < 4.1


def test_exchange_in_two_levels(spark):
    rng = np.random.default_rng(1)
    p = blocks.Plan(37, 53, 6)
    x = blocks.Exchange(p, 1 << 64, 1, (np.uint64,), lambda keys, sums: [sums[0]], tally=lambda keys, sums: np.array([sums[0].sum()], np.uint64).tobytes())
    pool = rng.integers(0, 2**64, 500, dtype=np.uint64)
    sent = {b: np.unique(rng.choice(pool, 80)) for b in range(37)}
    table = pa.concat_tables([x.ask(b, [k], [np.full(len(k), b + 1, np.uint16)], own=b"own" if b == 3 else None, note=lambda which: f"{which[0]}".encode()) for b, k in sent.items()])
    want = Counter()
    for b, k in sent.items():
        want.update({int(i): b + 1 for i in k})
    told = x.run(spark.createDataFrame(table)).toArrow()
    assert not p.direct
    import pyarrow.compute as pc

    for b, k in sent.items():
        mine = told.filter(pc.equal(told.column("block"), b))
        assert x.read(mine, [k])[0].tolist() == [want[int(i)] for i in k]
        assert x.notes(mine)[1] == ([b"own"] if b == 3 else []) and x.notes(mine)[0][0][2] == b"0"
    tallies = told.filter(pc.equal(told.column("block"), blocks.TALLY)).column("note").to_pylist()
    assert sum(int(np.frombuffer(t, np.uint64)[0]) for t in tallies) == sum(want.values())


def test_words_of_long_texts(monkeypatch):
    rng = random.Random(3)
    text = "".join(rng.choice("abC d\n\té") for _ in range(30_000)) + " " + "x" * 40_000 + " " + "Y" * 20_000 + " end"
    column = pa.array(["a b", text, None, "Z"])
    data, offsets = common.buffers(column)
    whole = common.Words(data, offsets, lower=True, seeds=2)
    windows = whole.windows(5, 1)
    monkeypatch.setattr(common, "PIECE", 2_000)
    pieces = common.Words(data, offsets, lower=True, seeds=2)
    assert (whole.starts == pieces.starts).all() and (whole.ends == pieces.ends).all() and (whole.row == pieces.row).all()
    assert all((x == y).all() for x, y in zip(whole.hashes, pieces.hashes, strict=True))
    assert all((x == y).all() for x, y in zip(windows, pieces.windows(5, 1), strict=True))
    words = [w.lower() for t in column.to_pylist() for w in WORD.findall(t or "")]
    assert len(words) == len(whole.starts) and len(set(zip(words, whole.hashes[0].tolist(), strict=True))) == len(set(words)) == len(set(whole.hashes[0].tolist()))


# ---- line dedup --------------------------------------------------------------------------------

def test_line_dedup_of_hot_hosts_and_clashing_names(spark, monkeypatch):
    rows = [(i, "hot" if i % 3 else f"h{i % 2}", f"head\nown {i}\nhead") for i in range(180)] + [(500, None, "head"), (501, "new", None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns({c: F.lit("x") for c in ("_host", "_drop", "_lines", "_left", "_row", "_at", "_text", "n_lines")})
    plain = line_dedup.remove_boilerplate(docs, counts=True)
    assert plain.columns == [*(c for c in docs.columns if c != "n_lines"), "n_lines", "n_dropped"]
    want = sorted(map(repr, plain.collect()))
    assert {r.text for r in plain.filter("doc_id < 180").collect()} == {f"own {i}" for i in range(180)}
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", 0)
    monkeypatch.setattr(line_dedup, "HEAVY", 2)
    assert sorted(map(repr, line_dedup.remove_boilerplate(docs, counts=True).collect())) == want


# ---- words that collide as polynomials -------------------------------------------------------------

def _thue_morse(n, flip):
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))


@pytest.mark.parametrize("n", [64, 1024, 2048, 16384, 65536])
def test_patterned_words_stay_apart(spark, n):
    one, two = _thue_morse(n, 0), _thue_morse(n, 1)
    for lower in (False, True):
        raw = np.frombuffer(f"{one} {two} {one}".encode(), np.uint8)
        w = common.Words(raw, np.array([0, len(raw)]), lower, 2)
        for h in w.hashes:
            assert h[0] == h[2] != h[1]
        assert w.hashes[0][0] != w.hashes[1][0]


@pytest.mark.parametrize("n", [1024, 16384])
def test_operators_tell_patterned_words_apart(spark, n):
    one, two, same = _thue_morse(n, 0), _thue_morse(n, 1), [f"s{i}" for i in range(30)]
    docs = spark.createDataFrame([(1, " ".join([*same[:15], one, *same[15:]])), (2, " ".join([*same[:15], two, *same[15:]]))], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(docs).collect()} == {1: 0, 2: 0}
    assert {r.doc_id: r.component_id for r in jaccard_join.classes(docs, words=4, threshold=85).collect()} == {1: 1, 2: 2}
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    told = language_model.scores(spark.createDataFrame([(held, f"{two} s1"), (held + 1, f"{one} s1")], "doc_id long, text string"))
    assert {r.doc_id: r.n_known for r in told.collect()}[held] == 2  # s1 and the end
