"""Joins on order, against brute force, with nulls, ties and empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from quern.operators.joins import as_of_join, interval_join


def cases(seed, n):
    r = random.Random(seed)
    return [(r.choice([1, 2, 3, None]), r.choice([None, *range(20)]), i) for i in range(n)]


@pytest.mark.parametrize("sizes", [(30, 40), (0, 5), (5, 0)])
def test_as_of(spark, sizes):
    left, right = cases(1, sizes[0]), cases(2, sizes[1])
    a, b = (spark.createDataFrame(x, f"k long, t long, {c} long") for x, c in ((left, "a"), (right, "b")))
    got = sorted(map(str, map(tuple, as_of_join(a, b, "k", "t", "b").collect())))
    want = []
    for k, t, i in left:
        near = [(u, j) for m, u, j in right if None not in (k, t, u) and m == k and u <= t]
        want.append((k, t, i, max(near)[1] if near else None))
    assert got == sorted(map(str, want))


@pytest.mark.parametrize("sizes", [(40, 30), (0, 5), (5, 0)])
def test_interval(spark, sizes):
    r = random.Random(3)
    points = cases(4, sizes[0])
    spans = [(r.choice([1, 2, None]), *sorted(r.sample(range(-5, 25), 2)), i) for i in range(sizes[1])] + [(1, 9, 3, 99), (1, None, 3, 98)]
    p, s = spark.createDataFrame(points, "k long, t long, p long"), spark.createDataFrame(spans, "k long, lo long, hi long, s long")
    for width in (1, 7, 100):
        found = interval_join(p, s, "k", F.col("t"), F.col("lo"), F.col("hi"), width).collect()
        want = [(i, j) for k, t, i in points for m, lo, hi, j in spans if None not in (k, t, lo) and m == k and lo <= t <= hi]
        assert sorted((x["p"], x["s"]) for x in found) == sorted(want)
