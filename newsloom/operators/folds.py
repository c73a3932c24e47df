"""Ordered folds: what depends on each key's rows in turn, where no grouping or window says it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def folded(df: DataFrame, key: list[str], order: list[str], first: Callable[[], object], move: Callable[[object, dict], tuple[object, list[dict]]], end: Callable[[object, dict], list[dict]], schema: str) -> DataFrame:
    """A fold of each key's rows in `order`, as they stream by: memory holds one key's state, never its rows.

    first() gives a state; move(state, row) the next one and rows to tell; end(state, last row) what is left to tell. Keys
    are dealt by their hash, and each is one task's: for keys whose logs are short beside the table, or whose steps are few.
    """
    made = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, last = None, None, None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if (k := tuple(r[c] for c in key)) != now or last is None:
                    if last is not None:
                        out += end(state, last)
                    now, state = k, first()
                state, rows = move(state, r)
                out += rows
                last = r
            yield pa.RecordBatch.from_pylist(out, schema=made)
        if last is not None:
            yield pa.RecordBatch.from_pylist(end(state, last), schema=made)

    return df.repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(run, schema)
