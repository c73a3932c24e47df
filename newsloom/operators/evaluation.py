"""Row functions that may fail or cost much, such as a model's judgement, applied row by row in isolation.

Every distinct input is asked once: rows get a fingerprint of the function's inputs, and only fingerprints without a
successful answer in the folder's `answers` are dealt to tasks. A row that fails gives an error in its own outcome and
nothing else. A task writes each answer to its journal in the folder before it goes on, and reads the journal of its own
partition first: so a task that is killed and repeated asks only for what hadn't been answered. When the job is done its
answers become a part of the table `answers`, and the journal goes; what a driver left behind is taken in at the next start.

The function gets a dict of the inputs and returns a dict with fields of the result's schema, which JSON must be able to
hold. Defined cases: null inputs are inputs; fields that the schema doesn't have, and values that don't fit it, are the
error InvalidResult; errors are kept, and asked again in later runs; repeated inputs share an outcome; an empty table asks nothing.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..plans.drafts import _fs, exists
from ..tables import settle, with_hot

ERROR = "struct<code:string,message:string>"
MESSAGE = 4000


def fingerprint(inputs: list[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*inputs)), 256)


def isolated(function: Callable[[dict], dict], row: dict, kind: pa.DataType) -> dict:
    """(result, error) of one row; whatever the function raises stays with it."""
    try:
        value = function(row)
        try:
            if set(value) - {f.name for f in kind}:
                raise ValueError(f"fields {sorted(set(value) - {f.name for f in kind})} aren't known")
            value = pa.scalar(value, kind).as_py()
        except Exception as e:
            return {"result": None, "error": {"code": "InvalidResult", "message": str(e)[:MESSAGE]}}
        return {"result": value, "error": None}
    except Exception as e:
        return {"result": None, "error": {"code": type(e).__name__, "message": (str(e).strip() or type(e).__name__)[:MESSAGE]}}


class Journal:
    """The answers of one partition so far, as files of JSON lines; a file is there whole or not at all."""

    def __init__(self, folder: str):
        self.fs, self.path = pafs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder.removeprefix("file:"))
        self.fs.create_dir(self.path, recursive=True)

    def read(self) -> dict[str, dict]:
        found = {}
        for info in self.fs.get_file_info(pafs.FileSelector(self.path)):
            if info.base_name.endswith(".json"):
                with self.fs.open_input_stream(info.path) as f:
                    found |= {r["fingerprint"]: r["outcome"] for r in map(json.loads, f.read().decode().splitlines())}
        return found

    def write(self, rows: list[dict]) -> None:
        name = f"{self.path}/{uuid.uuid4().hex}"
        with self.fs.open_output_stream(name) as f:
            f.write("".join(json.dumps(r) + "\n" for r in rows).encode())
        self.fs.move(name, f"{name}.json")


def _schema(result: str) -> StructType:
    return StructType.fromDDL(f"fingerprint string, outcome struct<result:struct<{result}>,error:{ERROR}>")


def answers(spark: SparkSession, folder: str, result: str) -> DataFrame:
    """(fingerprint, outcome, run) of all runs so far."""
    schema = _schema(result).add("run", "string")
    return spark.read.schema(schema).parquet(f"{folder}/answers") if exists(spark, f"{folder}/answers") else spark.createDataFrame([], schema)


def recovered(spark: SparkSession, folder: str, result: str) -> None:
    """Takes in the journals of runs that didn't end."""
    if exists(spark, f"{folder}/journal"):
        left = spark.read.schema(_schema(result)).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(f"{folder}/journal")
        left.withColumn("run", F.lit(f"{time.time_ns():020d}")).write.mode("append").partitionBy("run").parquet(f"{folder}/answers")
        fs, p = _fs(spark, f"{folder}/journal")
        fs.delete(p, True)


def evaluated(rows: DataFrame, inputs: list[str], function: Callable[[dict], dict], result: str, *, folder: str, every: int = 1, parts: int | None = None) -> DataFrame:
    """rows with `fingerprint` and `outcome`, a struct of result (fields of the DDL `result`) and error (code, message).

    folder: where answers and journals stand; driver and tasks reach it. every: answers a file of the journal; at most so
    many are asked again after a kill. parts: how many tasks ask at a time, those of a shuffle if not given."""
    spark = rows.sparkSession
    recovered(spark, folder, result)
    kind = to_arrow_type(_schema(result)["outcome"].dataType)
    marked = rows.withColumn("fingerprint", fingerprint(inputs))
    known = answers(spark, folder, result).filter("outcome.error is null").select("fingerprint").distinct()
    asked = marked.groupBy("fingerprint").agg(F.any_value(F.struct(*inputs)).alias("input")).join(known, "fingerprint", "left_anti")
    # what is asked, and in which partition, stays the same if a task is repeated
    asked = settle(asked.repartition(parts, "fingerprint") if parts else asked.repartition("fingerprint"))
    run, journals = f"{time.time_ns():020d}", f"{folder}/journal"

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        journal = Journal(f"{journals}/{run}/{TaskContext.get().partitionId()}")
        done = journal.read()
        for batch in batches:
            out, unwritten = [], []
            for r in batch.to_pylist():
                outcome = done.get(r["fingerprint"])
                if outcome is None:
                    outcome = isolated(function, r["input"], kind.field("result").type)
                    unwritten.append({"fingerprint": r["fingerprint"], "outcome": outcome})
                    if len(unwritten) >= every:
                        journal.write(unwritten)
                        unwritten = []
                out.append({"fingerprint": r["fingerprint"], "outcome": outcome})
            if unwritten:
                journal.write(unwritten)
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("fingerprint", pa.string()), ("outcome", kind)]))

    told = asked.mapInArrow(ask, _schema(result)).withColumn("run", F.lit(run))
    told.write.mode("append").partitionBy("run").parquet(f"{folder}/answers")
    fs, p = _fs(spark, journals)
    fs.delete(p, True)
    # of several answers to one input the first success counts, else the last error
    fine = F.col("outcome.error").isNull()
    best = answers(spark, folder, result).groupBy("fingerprint").agg(F.coalesce(F.min_by(F.when(fine, F.col("outcome")), F.when(fine, F.col("run"))), F.max_by("outcome", "run")).alias("outcome"))
    return with_hot(marked, best, "fingerprint", "left")
