"""Enclosure against pairs of all spans, with levels from single places to long ranges."""

import random

import pytest

from tessera.operators import catalog, spans

pytestmark = pytest.mark.usefixtures("small")


def _rows(seed, n=120):
    r = random.Random(seed)
    out = [("a", 0, 0, 0), ("a", 0, 0, 1), ("a", 5, 3, 2), (None, 1, 9, 3), ("b", 0, 2**40, 4), ("b", 2**39, 2**39 + 1, 5)]
    for k in range(n):
        s = r.randrange(300)
        out.append((r.choice("aaab"), s, s + r.choice([0, 1, 2, 3, 7, 8, 63, 64, 200]), k + 6))
    return out


def test_depth(spark):
    rows = sorted({x[:3] for x in _rows(1)}, key=repr)
    got = spans.depth(spark.createDataFrame(rows, "path string, s long, e long"), "path").collect()
    inside = lambda a, b: a[0] is not None and b[0] == a[0] and b[1] <= a[1] and b[2] >= a[2] and b != a and b[2] >= b[1]
    valid = {(p, s, e, sum(inside((p, s, e), b) for b in rows)) for p, s, e in rows if e >= s}
    assert {tuple(r) for r in got if r.e >= r.s} == valid and len(got) == len(rows)


def test_innermost(spark):
    rows, r = _rows(2), random.Random(3)
    probes = [(k, r.choice(["a", "b", "c", None]), s, s + r.choice([0, 5, 40])) for k, s in enumerate(r.randrange(320) for _ in range(80))]
    got = catalog.innermost(spark.createDataFrame(rows, "path string, s long, e long, key long"), spark.createDataFrame(probes, "probe long, path string, start long, end long"))
    want = {}
    for k, p, s, e in probes:
        held = [(b[2] - b[1], b[3]) for b in rows if p is not None and b[0] == p and b[1] <= s and b[2] >= e]
        if held:
            want[k] = min(held)
    assert {x.probe: (x.width, x.key) for x in got.collect()} == want


def test_no_spans(spark):
    none = spark.createDataFrame([], "path string, s long, e long, key long")
    assert spans.depth(none, "path").count() == 0
    assert catalog.innermost(none, spark.createDataFrame([(1, "a", 0, 1)], "probe long, path string, start long, end long")).count() == 0


def test_no_pairs(spark):
    """Equal spans and equal probes are looked at once, and no join has a row for each pair of a probe and a span that holds it."""
    rows = [("a", x % 40, x % 40 + 30 + x % 7, x) for x in range(400)]
    probes = [(x, "a", x % 30 + 30, x % 30 + 33) for x in range(300)]
    df = catalog.innermost(spark.createDataFrame(rows, "path string, s long, e long, key long"), spark.createDataFrame(probes, "probe long, path string, start long, end long"))
    want = {k: min(((e - s, key) for _, s, e, key in rows if s <= a and e >= b)) for k, _, a, b in probes}
    assert {x.probe: (x.width, x.key) for x in df.collect()} == want
    assert "start#" not in "".join(x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x and "<=" in x)
