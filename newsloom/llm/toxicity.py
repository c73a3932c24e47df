"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities and counts of a fixed and of a learned lexicon, the densest stretch, hits close to
second-person words, capitals, punctuation, exclamation, obfuscated words and lexicon words behind obfuscation, length.
The learned lexicon, the trees and the calibration come from labelled rows outside the held-out fold; of those at most
`MAX_ROWS` are used (the ones with the smallest hash of the id, of rows that share an id the one with the smallest hash
of its text): a classifier gains nothing from more. The calibration uses a fold that the trees haven't seen; where that
fold has no rows of both classes, it uses the rows that the trees have. Labels, language, source and id are no features.

Defined cases: null text counts as empty; empty texts get features of zeros and so a score; rows whose label or id is
null aren't learned from; without rows of both classes every score is the labelled rate (0 without labels); repeated
rows are scored each; a row with null id isn't held out; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FOLDS, HELD_OUT, CALIBRATION = 5, 0, 4
MAX_ROWS = 20_000
LEXICON_SIZE = 200
#: The lexicon also learns word beginnings of these lengths (written with a star), which inflected words share.
STEMS = (5, 7)
#: A learned word stands in so many toxic texts at least, of so many different lengths (copies of one text are one
#: observation), and of the texts with it at least this share is toxic.
LEAST_TEXTS, LEAST_LENGTHS, LEAST_SHARE = 4, 4, 0.7
STRETCH, NEAR = 50, 4

# Plain insults and second-person words.
INSULTS = (
    "idiot idiots idiotic moron morons moronic stupid dumb dumbass imbecile cretin fool loser losers scum trash garbage "
    "worthless pathetic disgusting clown clowns vermin filth filthy jerk bastard bitch asshole crap shit fuck fucking "
    "retard retarded freak pig swine hate kill idiota estúpido imbécil basura connard abruti crétin ordure dummkopf trottel abschaum"
).split()
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine tu te toi ton ta tes vous votre vos usted tú ti tus".split()
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "*": None, ".": None, "-": None, "_": None})

FEATURES = [f"_{x}" for x in "fixed_rate learned_rate fixed_count learned_count densest near_you capitals punctuation exclaimed obfuscated hidden length".split()]
_WORD = re.compile(r"[^\W_]+")
_ODD = re.compile(r"[^\W\d_]+(?:[0-9@$!|*._-]+[^\W\d_]+)+")
_MIXED = re.compile(r"[^\W\d_][0-9@$!|*._-][^\W\d_]")
_UPPER, _PUNCT = np.zeros(256), np.zeros(256)
_UPPER[65:91] = 1
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 1


def features_of(text: str, fixed: frozenset, learned: frozenset, stems: frozenset) -> list[float]:
    low = text.lower()
    words = _WORD.findall(low)
    n = len(words)
    at_fixed = [i for i, w in enumerate(words) if w in fixed]
    at_learned = [i for i, w in enumerate(words) if w in learned or w[:5] in stems or w[:7] in stems]
    hits = sorted({*at_fixed, *at_learned})
    densest = near = 0
    if hits:
        a = np.array(hits)
        densest = int((np.searchsorted(a, a + STRETCH) - np.arange(len(a))).max())
        near = sum(any(w in _YOU for w in words[max(0, i - NEAR) : i + NEAR + 1]) for i in hits)
    odd = hidden = 0
    if _MIXED.search(low):
        for w in _ODD.findall(low):
            odd += 1
            plain = w.translate(LEET)
            hidden += plain in fixed or plain in learned
    by_byte = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256) if text else np.zeros(256)
    chars, letters = max(1, len(text)), max(1.0, by_byte[65:91].sum() + by_byte[97:123].sum())
    per = 100 / max(1, n)
    return [len(at_fixed) * per, len(at_learned) * per, np.log1p(len(at_fixed)), np.log1p(len(at_learned)), densest, near / max(1, len(hits)), by_byte @ _UPPER / letters, by_byte @ _PUNCT / chars, by_byte[33] / chars, odd * per, np.log1p(hidden), np.log1p(n)]


_YOU = frozenset(SECOND_PERSON)


def features(docs: DataFrame, learned: list[str], keep: list[str]) -> DataFrame:
    """The columns `keep` of (…, text) and the features."""
    import pyarrow as pa

    fixed, more = frozenset(INSULTS), frozenset(w for w in learned if w[-1] != "*")
    stems = frozenset(w[:-1] for w in learned if w[-1] == "*")
    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows = np.array([features_of(t or "", fixed, more, stems) for t in part.column(len(keep)).to_pylist()], float).reshape(-1, len(FEATURES))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *(pa.array(rows[:, i].copy()) for i in range(len(FEATURES)))], [*keep, *FEATURES])

    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, ", ".join([*kinds, *(f"{f} double" for f in FEATURES)]))


def lexicon(rows: DataFrame, size: int = LEXICON_SIZE) -> list[str]:
    """The words of (text, toxic) that speak most for toxic: at most `size` come to the driver."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)[^\W_]{3,}"), F.lit(0))
    stems = [F.transform(F.filter(words, lambda w, k=k: F.length(w) >= k), lambda w, k=k: F.concat(F.substring(w, 1, k), F.lit("*"))) for k in STEMS]
    words = F.array_distinct(F.concat(words, *stems))
    listed = rows.filter("text is not null").dropDuplicates(["text"]).select("toxic", words.alias("ws"), F.length("text").alias("len"))
    each = listed.select("toxic", "len", F.explode("ws").alias("w"))
    counts = each.groupBy("w").agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.when(F.col("toxic") == 1, (F.col("len") / 32).cast("int"))).alias("lengths"))
    good = counts.filter((F.col("bad") >= LEAST_TEXTS) & (F.col("lengths") >= LEAST_LENGTHS) & (F.col("bad") >= LEAST_SHARE * F.col("n")))
    return [r["w"] for r in good.orderBy((F.col("bad") * F.col("bad") / (F.col("n") + 2)).desc(), "w").limit(size).collect()]


class Model:
    """Trees and calibration; without both classes a constant."""

    def __init__(self, learned=(), trees=None, calibration=None, rate: float = 0.0):
        self.learned, self.trees, self.calibration, self.rate = list(learned), trees, calibration, rate

    def score(self, docs: DataFrame, keep: list[str], name: str = "_score") -> DataFrame:
        """The columns `keep` of docs, and the score as `name`; a column of docs with that name is replaced."""
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.functions import vector_to_array

        keep = [c for c in keep if c != name]
        if self.trees is None:
            return docs.select(*(F.col(f"`{c}`") for c in keep), F.lit(float(self.rate)).alias(name))
        rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("_row"), "text")  # no name of docs meets one of the model's
        rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(features(rows, self.learned, ["_row"])).select("_row", "features")
        raw = self.trees.transform(rows).select("_row", vector_to_array("probability")[1].alias("raw"))
        return self.calibration.transform(raw).select("_row.*", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score"))).alias(name))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """docs: (doc_id, text); labels: (doc_id, toxic)."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    fold = common.crc_fold(F.col("doc_id"), FOLDS)
    chosen = labels.filter("toxic is not null and doc_id is not null").filter(fold != HELD_OUT).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # labels beyond the bound stay out before texts are read; the sample is small, so its join broadcasts
    ids = F.broadcast(chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    named = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(ids, "doc_id")
    # of an id's rows one; its text travels only within the sample
    one = named.groupBy("doc_id").agg(F.min_by(F.struct("text", "toxic"), F.xxhash64("text")).alias("r"))
    rows = common.settle(one.select("doc_id", "r.text", "r.toxic").withColumn("fold", fold))
    seen = {r["toxic"]: r["count"] for r in rows.filter(F.col("fold") != CALIBRATION).groupBy("toxic").count().collect()}
    if not seen.get(0) or not seen.get(1):
        return Model(rate=seen.get(1, 0) / max(1, sum(seen.values())))
    learned = lexicon(rows.filter(F.col("fold") != CALIBRATION))
    table = features(rows, learned, ["toxic", "fold"]).withColumn("toxic", F.col("toxic").cast("double"))
    table = common.settle(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(table).select("toxic", "fold", "features")).coalesce(4)
    trees = GBTClassifier(labelCol="toxic", featuresCol="features", maxIter=15, maxDepth=3, stepSize=0.3, seed=7, minInstancesPerNode=5).fit(table.filter(F.col("fold") != CALIBRATION))
    rest = table.filter(F.col("fold") == CALIBRATION)
    both = rest.agg(F.countDistinct("toxic")).first()[0] == 2
    held = trees.transform(rest if both else table).select("toxic", vector_to_array("probability")[1].alias("raw"))
    calibration = IsotonicRegression(labelCol="toxic", featuresCol="raw", predictionCol="score").fit(held)
    return Model(learned, trees, calibration)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, common.table(spark, sf_dir, "labels"))
    scored = model.score(docs, ["doc_id"])
    return scored.select("doc_id", F.coalesce(common.crc_fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))
