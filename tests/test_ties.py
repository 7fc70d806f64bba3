"""Repeated lines leave ties in the order of spans; results must be those of the distinct spans."""

import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import spans


@pytest.mark.parametrize("copies", [1, 6])
def test_copies_of_spans_change_no_island(spark, copies):
    r = random.Random(2)
    rows = sorted({(k, s := r.randrange(40), s + r.randrange(1, 12), r.choice("ab")) for k in range(20) for _ in range(10)})
    df = spark.createDataFrame(rows, "k int, start int, end int, label string")
    many = df.crossJoin(spark.range(copies)).drop("id").repartition(5, F.rand(1))
    order = lambda out: sorted(map(tuple, out.select("k", "start", "end", "label").collect()))
    for step in (lambda x: spans.heal_adjacent(x, ["k"], 2), lambda x: spans.merge_overlapping(x, ["k"], "label")):
        assert order(step(many)) == order(step(df))
