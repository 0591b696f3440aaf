import math
import random

import pytest

from plumbline.operators.percentile import exact_percentile, nearest_ranks


def brute(values, q, nearest):
    values = sorted(v for v in values if v is not None)
    if not values:
        return None
    if nearest:
        return next(v for i, v in enumerate(values, 1) if i / len(values) >= q)
    at = q * (len(values) - 1)
    a, b = values[math.floor(at)], values[math.ceil(at)]
    return a + (b - a) * (at - math.floor(at))


@pytest.mark.parametrize("nearest", [False, True])
@pytest.mark.parametrize("accuracy", [10_000, 20])
def test_any_group(spark, nearest, accuracy):
    dice = random.Random(2)
    rows = [(g, float(dice.choice([dice.randrange(20), dice.random() * 1000]))) for g in ("a", "b", None) for _ in range(dice.randrange(1, 400))]
    rows += [("one", 5.0), ("none", None), ("a", None)] + [("same", 7.0)] * 50
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    for q in (0.0, 0.01, 0.5, 0.9, 1.0):
        got = {r.g: r.p for r in exact_percentile(df, ["g"], "v", q, "p", nearest, accuracy).collect()}
        wanted = {g: brute([v for x, v in rows if x == g], q, nearest) for g, _ in rows}
        if nearest:
            wanted.pop("none")
        assert got.keys() == wanted.keys()
        assert all(got[g] == (w if w is None else pytest.approx(w, rel=1e-12)) for g, w in wanted.items()), q
        alone = exact_percentile(df, [], "v", q, "p", nearest, accuracy).collect()
        assert alone[0].p == pytest.approx(brute([v for _, v in rows], q, nearest), rel=1e-12) and len(alone) == 1


@pytest.mark.parametrize("accuracy", [10, 50, 10_000])
def test_several_nearest_ranks(spark, accuracy):
    dice = random.Random(accuracy)
    for n in (0, 1, 2, 3, 700):
        values = [dice.choice([dice.random(), 1.0, 5.0]) for _ in range(n)] + [None, None]
        df = spark.createDataFrame([(v,) for v in values], "x double").repartition(3)
        got = nearest_ranks(df, "x", {"a": 0.0, "b": 0.5, "c": 0.52, "d": 0.95, "e": 1.0}, accuracy).first()
        known = sorted(v for v in values if v is not None)
        for name, q in zip("abcde", (0.0, 0.5, 0.52, 0.95, 1.0)):
            wanted = known[max(0, math.ceil(q * n - 1e-9) - 1)] if n else None
            assert got[name] == wanted, (n, q)
