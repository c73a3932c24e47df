"""Tables that steps settle."""

import time

from newsloom import tables
from pyspark.sql import functions as F


def _shuffles(spark) -> set[str]:
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size())} if files.size() else set()


def test_shuffles_of_a_settled_table_go_at_once(spark):
    own = lambda: {x for x in _shuffles(spark) if x.startswith("shuffle_")} - before
    before, kept = _shuffles(spark), spark.conf.get(tables.CLEANUP, None)
    rows = spark.range(1000).select((F.col("id") % 7).alias("k"), F.col("id").alias("v"))
    grouped = rows.repartition(5, "v").groupBy("k").agg(F.sum("v").alias("s"))
    out = tables.settle(grouped)
    for _ in range(100):
        if not own():
            break
        time.sleep(0.1)
    assert not own()
    assert spark.conf.get(tables.CLEANUP, None) == kept
    # the table stands, and the frame it was made from can still be read, and settled once more
    same = {k: sum(range(k, 1000, 7)) for k in range(7)}
    assert {r.k: r.s for r in out.collect()} == {r.k: r.s for r in grouped.collect()} == {r.k: r.s for r in tables.settle(grouped).collect()} == same
