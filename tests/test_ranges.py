"""Joins on a key and a range."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tracewright import catalogue
from tracewright.operators import ranges


@pytest.mark.parametrize("side, width", [(2048, 1), (3, 1), (3, 4)])
def test_within(spark, monkeypatch, side, width):
    monkeypatch.setattr(ranges, "SIDE", side)
    draw = random.Random(7)
    a = [(draw.choice(["p", "q", None]), draw.choice([None, *range(-9, 9)]), draw.randint(-9, 9), i) for i in range(120)] + [("p", 0, 5, 500 + i) for i in range(9)]
    b = [(draw.choice(["p", "q", None]), draw.choice([None, *range(-9, 9)]), i) for i in range(120)]
    got = ranges.within(spark.createDataFrame(a, "k string, lo int, hi int, x int"), spark.createDataFrame(b, "k string, v int, y int"), "k", width)
    want = [(x, y) for k, lo, hi, x in a for c, v, y in b if k is not None and k == c and lo is not None and v is not None and lo < v <= hi]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) != []


def test_range_join_tries_only_near_pairs(spark, tmp_path):
    """One brand with 60,000 parts of 60,000 sizes: 60,000 near pairs out of 3,600,000,000."""
    spark.range(60_000).select(F.col("id").alias("p_partkey"), F.lit("b").alias("p_brand"), F.col("id").cast("int").alias("p_size")).write.parquet(str(tmp_path / "part.parquet"))
    began = time.time()
    got = catalogue.queries()["exec_range_join"](spark, str(tmp_path)).agg(F.count("*"), F.min(F.col("y") - F.col("x")), F.max(F.col("y") - F.col("x"))).first()
    assert tuple(got) == (59_999, 1, 1) and time.time() - began < 30
