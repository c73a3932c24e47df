"""The news tables as views over the test tables: editions, entries, sources, tasks, drafts.

Every column is one expression that Spark and other engines read alike, so a query and its SQL start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .tables import table

_CLASS = "CASE {0} % 4 WHEN 0 THEN 'official_model_company' WHEN 1 THEN 'news_media' WHEN 2 THEN 'project_tool' ELSE 'community_social' END"
_GROUP = "CASE {0} % 6 WHEN 0 THEN 'official_blog' WHEN 1 THEN 'tech_media' WHEN 2 THEN 'github_release' WHEN 3 THEN 'reddit_fixed' WHEN 4 THEN 'X_Official' ELSE NULL END"
_AT = "TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 HOUR * CAST({0} AS INT)"

VIEWS: dict[str, tuple[str, dict[str, str], str]] = {
    "sources": ("supplier", {
        "id": "'s' || CAST(s_suppkey AS STRING)", "name": "s_name", "transport": "CASE s_suppkey % 3 WHEN 0 THEN 'feed' WHEN 1 THEN 'rsshub' ELSE 'github' END", "source_group": _GROUP.format("s_suppkey"), "content_class": _CLASS.format("s_suppkey"),
        "url": "CASE WHEN s_suppkey % 5 = 0 THEN 'ftp://s.org/x' ELSE 'https://s' || CAST(s_suppkey AS STRING) || '.org/' END", "account_url": "CASE WHEN s_suppkey % 2 = 0 THEN 'https://x.com/s' || CAST(s_suppkey AS STRING) END", "priority": "s_nationkey",
        "health_status": "CASE WHEN s_suppkey % 9 = 0 THEN 'failed' ELSE 'healthy' END", "consecutive_failures": "CASE WHEN s_suppkey % 9 = 0 THEN 3 END",
    }, "true"),
    "editions": ("orders", {
        "edition_id": "o_orderkey", "edition_date": "CAST(" + _AT.format("24 * o_orderkey") + " AS DATE)", "status": "CASE WHEN o_orderkey % 7 = 3 THEN 'building' ELSE 'published' END",
        "published_at": "CASE WHEN o_orderkey % 11 <> 5 THEN " + _AT.format("24 * o_orderkey + 12") + " END", "candidate_count": "CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey % 50 AS INT) END",
    }, "true"),
    "entries": ("documents", {
        "entry_id": "doc_id", "edition_id": "doc_id % 30", "event_key": "'k' || CAST(doc_id AS STRING)", "display_order": "CAST((doc_id - doc_id % 30) / 30 + 1 AS INT)", "title": "substr(coalesce(text, ''), 1, 20)", "original_title": "CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE upper(lang) END",
        "summary": "substr(coalesce(text, ''), 1, 60)", "url": "CASE WHEN doc_id % 4 = 0 THEN 'nothing' ELSE 'https://e.org/' || CAST(doc_id AS STRING) END", "display_score": "CAST(doc_id * 29 % 101 AS DOUBLE) + CAST(0.5 AS DOUBLE)", "topic": "CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE lang END",
        "content_class": _CLASS.format("doc_id"), "source_group": _GROUP.format("doc_id"), "published_at": _AT.format("doc_id"), "reason": "CASE WHEN doc_id % 2 = 0 THEN 'good ' || lang END",
    }, "true"),
    "items": ("documents", {
        "item_id": "doc_id", "external_id": "CASE doc_id % 6 WHEN 0 THEN 'github_release:' || CAST(doc_id % 90 AS STRING) WHEN 1 THEN ' EXT ' || CAST(doc_id % 70 AS STRING) WHEN 2 THEN 'github_repo:o/r' || CAST(doc_id % 40 AS STRING) ELSE NULL END",
        "canonical_url": "CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'https://GitHub.com/Own/Repo' || CAST(doc_id % 20 AS STRING) || '/' ELSE 'https://ex.org/p' || CAST(doc_id % 80 AS STRING) || '?b=1&utm_source=z' END", "source_url": "CASE WHEN doc_id % 7 = 0 THEN 'https://src.org/' || CAST(doc_id AS STRING) END",
        "title": "substr(coalesce(text, ''), 1, 20)", "published_at": "CASE WHEN doc_id % 8 <> 0 THEN " + _AT.format("doc_id % 500") + " END", "captured_at": _AT.format("600 + doc_id % 100"), "content_class": _CLASS.format("doc_id"), "source_id": "source", "source_group": _GROUP.format("doc_id"), "b1_priority": "CAST(doc_id * 29 % 101 AS INT)",
    }, "true"),
    "tasks": ("events", {
        "run": "user_id % 20", "stage": "CASE event_id % 4 WHEN 0 THEN 'screen' WHEN 1 THEN 'analyze' WHEN 2 THEN 'cluster' ELSE 'export' END", "task_id": "event_id", "subject_type": "CASE WHEN event_id % 13 = 0 THEN 'run' ELSE 'item' END",
        "status": "CASE event_id % 11 WHEN 0 THEN 'failed' WHEN 1 THEN 'skipped' WHEN 2 THEN 'running' WHEN 3 THEN 'retry_waiting' WHEN 4 THEN 'pending' WHEN 5 THEN 'blocked' ELSE 'succeeded' END", "fingerprint": "event_id % 5", "lease_expires_at": "CASE WHEN event_id % 3 <> 0 THEN ts END",
        "error_code": "CASE WHEN event_id % 17 = 0 THEN 'e' || CAST(event_id AS STRING) END", "attempt_count": "CAST(event_id % 4 AS INT)", "reason": "CASE event_id % 3 WHEN 0 THEN 'Item too OLD' WHEN 1 THEN 'missing publish time' ELSE 'from the future' END",
        "decision": "CASE event_type WHEN 'view' THEN 'Pass' WHEN 'click' THEN 'uncertain' ELSE 'reject' END", "filtered": "event_type = 'error'", "ts": "ts",
    }, "true"),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns, where = VIEWS[name]
    return table(spark, sf_dir, source).filter(where).selectExpr(*(f"{v} AS {k}" for k, v in columns.items()))


def sql(*names: str) -> str:
    """The views as common table expressions."""
    return ", ".join(f"{n} AS (SELECT {', '.join(f'{v} AS {k}' for k, v in VIEWS[n][1].items())} FROM {VIEWS[n][0]} WHERE {VIEWS[n][2]})" for n in names)
