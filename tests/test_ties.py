"""Queries whose thresholds are met exactly: a mean is summed in order, whatever order the rows lie in."""

import datetime
import random

import pytest

from spanloom.plans import registry


def means(values):
    ahead = back = 0.0
    for a, b in zip(values, values[::-1]):
        ahead, back = ahead + a, back + b
    return ahead / len(values), back / len(values)


@pytest.fixture
def stored(spark, tmp_path):
    def store(values):
        """One user's events of a day, the last first in the file."""
        began = datetime.datetime(2024, 1, 1, 1)
        rows = [(i, began + datetime.timedelta(hours=i), 1, "view", v, "{}") for i, v in enumerate(values)]
        spark.createDataFrame(rows[::-1], "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
        return str(tmp_path)

    return store


def test_mean_at_the_limit_of_a_verdict(spark, stored):
    draw = random.Random(1)
    for _ in range(100_000):
        a, b, c = (draw.randrange(100, 8000) for _ in range(3))
        values = [a / 100, b / 100, c / 100, (18000 - a - b - c) / 100]
        ahead, back = means(values)
        if (ahead < 45) != (back < 45):
            break
    assert registry.QUERIES["window_verdicts"](spark, stored(values)).first().doubled == (ahead < 45)


def test_rate_at_the_edge_of_its_anchor(spark, stored):
    def folds(v, m):
        return any(10 <= x <= 200 and abs(x - m) <= 0.2 * m for x in (v / 2, v * 2))

    draw = random.Random(2)
    for _ in range(100_000):
        a, b, c = (2 * draw.randrange(1000, 4000) for _ in range(3))
        values = [a / 100, b / 100, c / 100, (a + b + c) * 3 // 2 / 100]
        ahead, back = means(values)
        if folds(values[3], ahead) != folds(values[3], back):
            break
    got = {r.event_id: r.folded for r in registry.QUERIES["harmonic_fold"](spark, stored(values)).collect()}
    assert got[3] == folds(values[3], ahead)
