"""Requests to a model about a set of events: their text, and what is logged of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text

MAX_SELECTED = 15


def selection_requests(events: DataFrame, fields: list[str], *, run: str = "run_id", order: str = "display_order", max_selected: int = MAX_SELECTED) -> DataFrame:
    """(run, n_events, body, body_sha256, body_bytes): a run's candidate events in order as one JSON request, with the hash and size that
    go to the audit log. An event's fields stand in the order given, null ones left out. A request holds a run's
    candidates, of which the policy admits a bounded number."""
    one = F.to_json(F.struct(*fields))
    gathered = events.groupBy(run).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, one.alias("json")))), lambda x: x["json"]).alias("events"))
    body = F.concat(F.lit(f'{{"max_selected":{max_selected},"candidate_events":['), F.array_join("events", ","), F.lit("]}"))
    out = gathered.select(run, F.size("events").cast("long").alias("n_events"), body.alias("body"))
    return out.withColumns({"body_sha256": F.sha2("body", 256), "body_bytes": F.octet_length("body").cast("long")})


def repair_requests(requests: DataFrame, answers: DataFrame, *, run: str = "run_id", cap: int = 4000) -> DataFrame:
    """Requests to put a refused answer right: answers (run, answer, error). The first answer and what is wrong with it, cut,
    stand after the request's own text; runs whose answer was fine (a null or blank error) get none."""
    rows = requests.join(answers, run).filter(text.trimmed_or_null(F.col("error")).isNotNull())
    again = F.to_json(F.struct(F.substring("error", 1, cap).alias("validation_error"), F.substring(F.coalesce("answer", F.lit("")), 1, cap).alias("previous_answer")))
    body = F.concat_ws("\n", "body", again)
    return rows.select(run, "n_events", body.alias("body")).withColumns({"body_sha256": F.sha2("body", 256), "body_bytes": F.octet_length("body").cast("long")})
