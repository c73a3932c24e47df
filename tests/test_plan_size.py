"""Expressions that use a part several times hold it once in their plan: what stands there twice is computed twice a row."""

import pytest
from pyspark.sql import functions as F

from newsloom.functions import addresses, urls
from newsloom.operators import entities, events


@pytest.mark.parametrize(("made", "most"), [
    (addresses.public_url, 20), (urls.event_url, 60), (lambda u: entities.identity_keys(F.lit("e"), u), 70), (lambda u: events.related_hints(F.lit("e"), u), 70),
])
def test_parts_stand_once(spark, made, most):
    plan = spark.createDataFrame([("http://e.org/",)], "u string").select(made(F.col("u")).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_") <= most
