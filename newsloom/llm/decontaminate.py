"""Benchmark decontamination by a prefix-filtered set join. DataFrame operations only.

Every benchmark item becomes windows of `width` consecutive words (an item of fewer words is one window). A window
that occurs in a document has all its words there, so one word suffices as the window's prefix; ordering the words by
their count in the whole corpus makes it the rarest one. Documents' words join the windows on that word alone; the
position it has in the window and the document's length then bound where the window can lie, and the words there are
compared with the window's: an exact containment check. A text is split once to be counted and once to be searched.

Rows are told apart by id and text: rows that share an id are judged each by its own text. A row is its (doc_id,
xxhash64 of the text) wherever it travels without its text.

Defined cases: null and empty texts have no words, contain nothing and come back with zeros; a null id is an id like
others; items without words have no windows; repeated items count each by its own id; rows that repeat both id and
text come back each, with equal results; without windows or rows nothing is hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WIDTH = 10
#: The windows' table is broadcast up to so many rows; beyond it the join shuffles, its hot words dealt in `SALTS`.
BROADCAST_WINDOWS, SALTS = 500_000, 16
_APART = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_KEY = ("doc_id", "same")


def _split(text: Column) -> Column:
    """The words, not lower-cased yet, with an empty string at either end where the text starts or ends between words."""
    return F.split(text, _APART)


def _lower(word: Column) -> Column:
    """A-Z only. Pure ASCII, the usual case, takes the fast way."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, common.UPPER, common.LOWER))


def _count(words: Column) -> Column:
    """The number of words in what _split gives."""
    ends = (F.get(words, F.lit(0)) == "").cast("int") + ((F.size(words) > 1) & (F.get(words, F.size(words) - 1) == "")).cast("int")
    return (F.size(words) - ends).cast("long")


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, same, text); null texts are empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(t).alias("same"), t.alias("text"))


def windows(items: DataFrame, *, item_id: str = "item_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(item_id, phrase: the lower-cased words joined by one space, length: their number) of every item's windows."""
    words = F.filter(F.transform(_split(F.col(text)), _lower), lambda w: w != "")
    listed = items.select(F.col(item_id).alias("item_id"), words.alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - width, F.lit(0)))
    each = listed.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, width))).alias("window"))
    return each.select("item_id", F.concat_ws(" ", "window").alias("phrase"), F.size("window").alias("length"))


def _narrow(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_WINDOWS else df


def prefixes(rows: DataFrame, phrases: DataFrame, total: int, width: int = WIDTH) -> DataFrame:
    """(token, at, length, phrase): each window's rarest word by its count over all rows, and its place in the window.

    A window with a word that no row has can't occur and drops out. phrases: (phrase, length), distinct.
    """
    parts = phrases.select("phrase", "length", F.posexplode(F.split("phrase", " ")).alias("at", "word"))
    vocabulary = _narrow(parts.select("word").distinct(), total * width)
    words = rows.select(F.explode(_split(F.col("text"))).alias("raw")).select(_lower(F.col("raw")).alias("word"))
    counted = words.join(vocabulary, "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    ranked = parts.join(counted, "word", "left").groupBy("phrase", "length").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "at", "word")).alias("p"))
    return ranked.filter("p.n > 0").select(F.col("p.word").alias("token"), F.col("p.at").alias("at"), "length", "phrase")


def occurrences(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """(doc_id, same, start, length, phrase, n_words, n_rows) of every occurrence of a window, start being the word's place
    from 0 or 1; and (phrase, item_id). Each row gives a row with null start besides; n_rows is how often it stands there.
    """
    rows = _rows(docs, doc_id, text)
    members = common.settle(windows(items, text="text", width=width).distinct())
    phrases = members.select("phrase", "length").distinct()
    total = phrases.count()
    prefix = common.settle(prefixes(rows, phrases, total, width))
    listed = rows.select(*_KEY, _split(F.col("text")).alias("ws"))
    if total <= BROADCAST_WINDOWS:
        # a further "word" of every text, which no text has, finds an entry of its own: the row that carries the count
        mark = "\n"
        sentinel = prefix.sparkSession.createDataFrame([(mark, 0, 0, None)], "token string, at int, length int, phrase string")
        each = listed.select(*_KEY, "ws", F.posexplode(F.concat("ws", F.array(F.lit(mark)))).alias("pos", "raw")).withColumn("word", _lower(F.col("raw")))
        begin = F.col("pos") - F.col("at")
        fits = (F.col("word") == F.col("token")) & (F.col("phrase").isNull() | _there("ws", begin, F.col("length"), F.col("phrase")))
        found = each.join(F.broadcast(prefix.unionByName(sentinel)), fits)
        lone = F.col("phrase").isNull()
        found = found.select(*_KEY, F.when(~lone, begin).alias("start"), "length", "phrase", F.when(lone, _count(F.col("ws"))).alias("n_words"))
    else:
        # words travel without their texts, dealt by place; texts are met again only by rows with candidates
        each = listed.select(*_KEY, F.posexplode("ws").alias("pos", "raw")).select(*_KEY, "pos", _lower(F.col("raw")).alias("token")).withColumn("salt", F.col("pos") % SALTS)
        dealt = prefix.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        may = each.join(dealt, ["token", "salt"]).select(*_KEY, (F.col("pos") - F.col("at")).alias("start"), "length", "phrase").distinct()
        may = may.groupBy(F.col("doc_id").alias("_id"), F.col("same").alias("_same")).agg(F.collect_list(F.struct("start", "length", "phrase")).alias("may"))
        held = listed.join(may, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("same") == F.col("_same")))
        held = held.select(*_KEY, F.explode(F.filter("may", lambda m: _there("ws", m["start"], m["length"], m["phrase"]))).alias("m"))
        found = held.select(*_KEY, "m.start", "m.length", "m.phrase", F.lit(None).cast("long").alias("n_words"))
        none = F.lit(None)
        found = found.unionByName(listed.select(*_KEY, none.cast("int").alias("start"), none.cast("int").alias("length"), none.cast("string").alias("phrase"), _count(F.col("ws")).alias("n_words")))
    found = found.groupBy(*_KEY, "start", "length", "phrase").agg(F.max("n_words").alias("n_words"), F.count(F.lit(1)).alias("n_rows"))
    return found, members.select("phrase", "item_id")


def _there(words: str, begin: Column, length: Column, phrase: Column) -> Column:
    """Whether the phrase's words stand at `begin`."""
    text = F.translate(F.concat_ws(" ", F.slice(words, F.greatest(begin + 1, F.lit(1)), length)), common.UPPER, common.LOWER)
    return (begin >= 0) & (begin + length <= F.size(words)) & (text == phrase)


def contaminated(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, same), distinct, of the rows in which a window occurs; `same` is xxhash64 of the text."""
    found, _ = occurrences(docs, items, doc_id=doc_id, text=text, width=width)
    return found.filter("phrase is not null").select(*_KEY).distinct()


def contamination(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, items (sorted ids as strings)."""
    found, members = occurrences(docs, items, doc_id=doc_id, text=text, width=width)
    found = common.settle(found)
    # covered words: spans in order of their starts, each counted beyond the furthest end so far
    spans = F.array_sort(F.collect_set(F.when(F.col("start").isNotNull(), F.struct("start", "length"))))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    end = lambda x: x["start"] + x["length"]
    step = lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), end(x) - F.greatest(acc["end"], x["start"]))).alias("n"), F.greatest(acc["end"], end(x)).alias("end"))
    counted = found.groupBy(*_KEY).agg(F.max("n_words").alias("n_words"), F.max(F.when(F.col("phrase").isNull(), F.col("n_rows"))).alias("n_rows"), F.aggregate(spans, zero, step)["n"].cast("long").alias("n_hit"))
    told = found.filter("phrase is not null").select(*_KEY, "phrase").distinct().join(members, "phrase").select(*_KEY, F.col("item_id").cast("string").alias("item")).distinct()
    none = F.lit(None).cast("long")
    both = counted.withColumn("item", F.lit(None).cast("string")).unionByName(told.withColumns({"n_words": none, "n_rows": none, "n_hit": none}))
    out = both.groupBy(*_KEY).agg(F.max("n_words").alias("n_words"), F.max("n_hit").alias("n_hit"), F.array_sort(F.collect_set("item")).alias("items"), F.max("n_rows").alias("n_rows"))
    return out.select("doc_id", "n_words", "n_hit", "items", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_rows")))).drop("col")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(common.table(spark, sf_dir, "documents").select("doc_id", "text"), common.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), '%s', '%s'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')" % (common.UPPER, common.LOWER)
OP9_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT item_id, array_to_string(w[i:i + 9], ' ') AS win, least(len(w), {WIDTH}) AS n
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WIDTH - 1}, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT DISTINCT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.n = bw.n),
pos AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hit),
np AS (SELECT doc_id, count(*) AS n_hit FROM pos GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hit) GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN np USING (doc_id) LEFT JOIN it USING (doc_id)
"""
