"""Interval joins against plain search."""

import random

import pytest

from tidemark.operators import intervals

SPANS, POINTS = "file string, span_id long, start long, end long", "file string, point_id long, at long"


def data(seed):
    rng = random.Random(seed)
    spans = [(rng.choice("abc"), i, s, s + rng.choice([0, 1, 3, 10, 64, 500])) for i in range(150) for s in [rng.randint(-40, 300)]]
    spans += [("a", 200, 5, 9), ("a", 201, 5, 9), ("a", 202, 5, 9), (None, 203, 0, 99), ("b", 204, None, 5), ("b", 205, 9, 4)]
    points = [(rng.choice("abcd"), i, rng.randint(-60, 900)) for i in range(200)] + [(None, 300, 5), ("a", 301, None), ("a", 302, 5), ("a", 303, 9)]
    return spans, points


def usable(spans):
    return [x for x in spans if None not in x and x[2] < x[3]]


@pytest.mark.parametrize("seed", [1, 2])
def test_innermost_and_last(spark, seed):
    spans, points = data(seed)
    s, p = spark.createDataFrame(spans, SPANS), spark.createDataFrame(points, POINTS)
    inside, before = {}, {}
    for f, i, at in points:
        around = [(-a, b, k) for g, k, a, b in usable(spans) if g == f and at is not None and a <= at < b]
        ended = [(b, a, k) for g, k, a, b in usable(spans) if g == f and at is not None and b <= at]
        inside[i], before[i] = (min(around)[2] if around else None), (max(ended)[2] if ended else None)
    assert {r["point_id"]: r["span_id"] for r in intervals.innermost(p, s, ["file"]).collect()} == inside
    for rows in (10, 1000):
        found = intervals.last_before(p, s, ["file"], rows).collect()
        assert len(found) == len(points) and {r["point_id"]: r["span_id"] for r in found} == before
    plan = intervals.innermost(p, s, ["file"])._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_parents(spark):
    spans, _ = data(3)
    want = {}
    for f, i, a, b in spans:
        around = [(-x, y, -k) for g, k, x, y in usable(spans) if (f, i, a, b) in usable(spans) and g == f and x <= a and y >= b and (x < a or y > b or k < i)]
        want[i] = -min(around)[2] if around else None
    found = {r["span_id"]: r["parent"] for r in intervals.parents(spark.createDataFrame(spans, SPANS), ["file"]).collect()}
    assert found == want


def test_no_rows(spark):
    spans, points = spark.createDataFrame([], SPANS), spark.createDataFrame([("a", 1, 2)], POINTS)
    assert [tuple(r) for r in intervals.innermost(points, spans, ["file"]).select("point_id", "span_id").collect()] == [(1, None)]
    assert [tuple(r) for r in intervals.last_before(points, spans, ["file"]).select("point_id", "span_id").collect()] == [(1, None)]
    assert intervals.parents(spans, ["file"]).count() == 0
