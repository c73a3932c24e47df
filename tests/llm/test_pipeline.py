"""The whole pipeline against a plain Python version of its stages, on the smallest tables and on empty ones."""

import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from newsloom.llm import bpe, common, line_dedup, toxicity

DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UP = {i: i + 32 for i in range(65, 91)}


def _classes(texts: dict[int, str]) -> dict[int, int]:
    """Class of each text that has words: five-word shingles, 0.8, linked directly or through others."""
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(t.translate(UP))
        if w:
            sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}
    top = {i: i for i in sets}
    links = [(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    while True:
        before = dict(top)
        for i, j in links:
            top[i] = top[j] = min(top[i], top[j])
        if top == before:
            return top


def _without_boilerplate(rows: dict[int, tuple[str, str]], classes: dict[int, int]) -> dict[int, str]:
    pages, lines = {}, {}
    for i, (host, t) in rows.items():
        page = (True, classes[i]) if i in classes else (False, t)
        pages.setdefault(host, set()).add(page)
        for x in {x.strip(" ") for x in t.split("\n")} - {""}:
            lines.setdefault((host, x), set()).add(page)
    gone = {k for k, v in lines.items() if len(pages[k[0]]) >= line_dedup.MIN_PAGES and len(v) > line_dedup.MAX_RATIO * len(pages[k[0]])}
    return {i: "\n".join(x for x in t.split("\n") if (host, x.strip(" ")) not in gone) for i, (host, t) in rows.items()}


def test_run_is_the_plain_version(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = common.table(spark, DIR, "documents")
    model = toxicity.fit(docs.select("doc_id", "text"), common.table(spark, DIR, "labels"))
    toxic = {r.doc_id for r in model.score(docs, ["doc_id"]).filter("_score >= 0.5").collect()}
    rows = {r.doc_id: (r.source, r.text or "") for r in docs.collect() if r.doc_id not in toxic}
    texts = _without_boilerplate(rows, _classes({i: t for i, (_, t) in rows.items()}))
    top = _classes(texts)
    texts = {i: t for i, t in texts.items() if top.get(i, i) == i}
    windows = set()
    for (t,) in common.table(spark, DIR, "benchmark").select("text").collect():
        w = ITEM.findall((t or "").translate(UP))
        windows |= {tuple(w[j : j + 10]) for j in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(x) for x in windows}
    words = {i: ITEM.findall(t.translate(UP)) for i, t in texts.items()}
    texts = {i: t for i, t in texts.items() if not any(tuple(words[i][j : j + n]) in windows for n in sizes for j in range(len(words[i]) - n + 1))}
    codec = Tokenizer.from_file(public_tokenizers.path(bpe.TOKENIZER))
    want = {}
    for i, t in texts.items():
        ids = codec.encode(t, add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, DIR).collect()}
    assert got == want and 0 < len(want) < docs.count()


def test_empty_tables(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        common.table(spark, DIR, name).limit(0).withColumn("_row", F.lit("x")).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_repeated_and_null_ids(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(None, long), (None, long), (7, long + " more"), (7, "another text of its own"), (3, "bench one two three four five six seven eight nine"), (None, "bench one two three four five six seven eight nine"), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"source": F.lit("s"), "same": F.lit("x"), "_row": F.lit("y"), "class": F.lit("z"), "_score": F.lit(1), "named": F.lit(2)})
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    common.table(spark, DIR, "labels").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "bench one two three four five six seven eight nine ten")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = common.settle(stage(spark, kept, str(tmp_path)))
        assert kept.columns == docs.columns
    left = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    # of the near copies the one with an id stays; both contaminated rows go; rows without words stay all
    assert left == sorted([(7, long + " more"), (7, "another text of its own"), (None, None), (None, "")], key=repr)
