"""A corpus from raw documents to token ids: toxicity, line dedup, near duplicates, decontamination, encoding.

Defined cases, in all stages: null text counts as empty, null and repeated ids are ids like others (rows are told apart
by id and text), other columns pass through whatever their names, an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from newsloom.llm import bpe, common, decontaminate, jaccard_join, line_dedup, toxicity

#: Near duplicates: five words a shingle, similarity of 0.8 or more.
NEAR_WORDS, NEAR_THRESHOLD = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labels of documents outside its held-out fold."""
    model = toxicity.fit(docs.select("doc_id", "text"), common.table(spark, sf_dir, "labels"))
    scored = model.score(docs.select(*common.pair(docs), "text"), ["doc_id", "same"])
    return common.without(docs, common.settle(scored.filter("_score >= 0.5").select("doc_id", "same").distinct()))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines common to a source's documents go; every document stays.

    Documents of one class of near copies, by the next stage's measure, are one page here: else a large group's whole
    text would count as boilerplate, and the next stage would find nothing left to link.
    """
    found = jaccard_join.classified(docs, words=NEAR_WORDS, threshold=NEAR_THRESHOLD)
    return line_dedup.remove_boilerplate(docs, copies=common.settle(found.filter("class is not null").select("doc_id", "same", "class").distinct()))


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similarity, directly or through others, the one with the smallest id stays; of rows that
    repeat id and text one; a null id is the largest. Documents without words stay."""
    return jaccard_join.leaders(docs, words=NEAR_WORDS, threshold=NEAR_THRESHOLD)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go, each row by its own text."""
    gone = decontaminate.contaminated(docs.select("doc_id", "text"), common.table(spark, sf_dir, "benchmark"))
    return common.without(docs, common.settle(gone))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of what they decode to."""
    return bpe.round_trip(docs.select("doc_id", "text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("jaccard_join", keep_one_of_each_class),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: A classifier is trained, and ids are hashed: SQL can't express it. tests/llm hold it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.settle(docs)
    return docs
