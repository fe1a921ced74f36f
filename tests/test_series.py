"""Recurrences and resampling over long series, against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quarrylens.operators import anomaly, quantiles, stats, trend
from quarrylens.operators.series import with_previous


def holt(values, alpha=0.3, beta=0.1):
    level, slope, ss = values[0], (values[-1] - values[0]) / len(values), 0.0
    for y in values[1:]:
        was = level
        level = alpha * y + (1 - alpha) * (level + slope)
        slope = beta * (level - was) + (1 - beta) * slope
        ss += (y - level - slope) ** 2
    return level, slope, ss


@pytest.mark.parametrize("whole", [True, False])
def test_smoothing_in_stretches_is_smoothing_in_one_place(spark, whole):
    draw = random.Random(5)
    series = {"a": [1e6 + k + draw.gauss(0, 1) for k in range(157)], "flat": [1e5] * 40, "one": [3.0], "two": [1.0, 4.0], None: [draw.uniform(-5, 5) for _ in range(30)]}
    rows = [(k, n, y) for k, ys in series.items() for n, y in enumerate(ys)]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, _us long, _y double").repartition(5)
    got = {r.k: (r.level, r.trend, r.ss) for r in trend.smoothed(df, ["k"], 0.3, 0.1, stretch=7, fan=2, whole=whole).collect()}
    assert set(got) == set(series)
    for k, ys in series.items():
        assert all(math.isclose(x, y, rel_tol=1e-7, abs_tol=1e-7) for x, y in zip(got[k], holt(ys), strict=True)), k


def test_forecast_of_a_series_without_keys_and_of_null_keys(spark):
    rows = [(None, 60 * k, 2.0 * k) for k in range(12)]
    df = spark.createDataFrame(rows, "k string, s long, value double").withColumn("ts", F.timestamp_seconds("s"))
    level, slope, _ = holt([2.0 * k for k in range(12)])
    for keys in (["k"], []):
        got = trend.holt_forecast(df, keys, periods=2).orderBy("step").collect()
        assert [round(r.predicted_value, 9) for r in got] == [round(level + slope, 9), round(level + 2 * slope, 9)]
    assert trend.holt_forecast(df.limit(0), ["k"]).count() == 0


def resampled(spark, rows, parts, **more):
    df = spark.createDataFrame(rows, "k string, id long, value double, late boolean").repartition(parts)
    got = anomaly.bootstrap(df, ["k"], "value", F.col("late"), iterations=400, **more).collect()
    return {r.k: [round(x, 9) for x in r[1:]] for r in got}


@pytest.mark.parametrize("more", [{"identity": ["id"]}, {}])
def test_bootstrap_does_not_depend_on_partitions(spark, more):
    draw = random.Random(3)
    rows = [(k, n, float(draw.choice((1, 2, 5, 9))) + late, bool(late)) for k in ("a", None) for n in range(60) for late in (n % 2,)] + [("only", 1, 1.0, True), ("a", 99, None, True), ("a", 98, float("nan"), True), ("a", 97, 1.0, None)]
    one, four = resampled(spark, rows, 1, **more), resampled(spark, rows[::-1], 4, **more)
    assert one == four and set(one) == {"a", None}
    assert resampled(spark, rows, 2, seed=8, **more) != one


def test_bootstrap_agrees_with_plain_resampling(spark):
    """Mean and interval of the normal limit: the difference of means and its standard error."""
    draw = random.Random(11)
    rows = [("m", n, draw.gauss(10 + 2 * (n % 2), 3), bool(n % 2)) for n in range(2000)]
    before, after = [r[2] for r in rows if not r[3]], [r[2] for r in rows if r[3]]
    mean = lambda x: sum(x) / len(x)
    error = math.sqrt(sum(sum((v - mean(x)) ** 2 for v in x) / len(x) ** 2 for x in (before, after)))
    step = mean(after) - mean(before)
    for more in ({"identity": ["id"]}, {}):
        middle, low, high, *_, p = resampled(spark, rows, 3, **more)["m"]
        assert abs(middle - step) < 0.25 * error and abs(low - (step - 1.96 * error)) < 0.4 * error and abs(high - (step + 1.96 * error)) < 0.4 * error and p == 1.0


def test_bootstrap_counts_equal_rows_as_often_as_they_stand(spark):
    """A value that stands many times varies as that many rows do, not as one row of that weight."""
    rows = [("m", n, float(n % 2), bool(n // 2 % 2)) for n in range(4000)]
    _, low, high, *_ = resampled(spark, rows, 2)["m"]
    assert 0.8 < (high - low) / (2 * 1.96 * math.sqrt(2 * 0.25 / 2000)) < 1.2


def anchored(times, size):
    made, start = {}, None
    for t in sorted(times):
        if start is None or t >= start + size:
            start = t
        made[start] = made.get(start, 0) + 1
    return made


@pytest.mark.parametrize("whole", [True, False])
def test_anchored_windows_against_a_loop(spark, whole):
    """Windows much shorter and much longer than a stretch, grids, bursts, ties, gaps, times before 1970, null keys."""
    draw = random.Random(9)
    series = {
        "grid": list(range(0, 400, 2)), "dense": [draw.randrange(100) for _ in range(300)], "bursts": [s * 977 + draw.randrange(40) for s in range(12) for _ in range(20)],
        "sparse": [k * 1000 for k in range(20)], "ties": [5] * 50, "one": [-7], "old": [draw.randrange(-900, 100) for _ in range(150)], None: [draw.randrange(3000) for _ in range(200)],
    }
    rows = [(k, s, 1.0) for k, ts in series.items() for s in ts] + [("one", None, 1.0), ("one", 3, None)]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, s long, value double").withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz")).repartition(3)
    for size in (30, 1) if not whole else (30, 7, 1):
        got = {}
        for r in stats.anchored_windows(df, ["k"], seconds=size, stretch=11, whole=whole).select("k", F.unix_micros(F.col("window_start").cast("timestamp")).alias("at"), "sample_count", "sum_value").collect():
            assert r.sum_value == r.sample_count
            got.setdefault(r.k, {})[r.at // 1_000_000] = r.sample_count
        assert got == {k: anchored(ts, size) for k, ts in series.items()}, size
    assert stats.anchored_windows(df.where("k = 'none'"), ["k"], whole=whole).count() == 0
    assert stats.anchored_windows(df, [], seconds=30, stretch=50, whole=whole).count() == len(anchored([s for ts in series.values() for s in ts], 30))


@pytest.mark.parametrize("whole", [True, False])
def test_previous_rows_across_stretches(spark, whole):
    draw = random.Random(2)
    rows = [(k, n, None if n % 7 == 3 else draw.random()) for k in ("a", None) for n in range(50)] + [("b", 0, 1.0)]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, n long, v double").repartition(4)
    got = {(r.k, r.n): r.w for r in with_previous(df, ["k"], "n", "v", "w", stretch=6, whole=whole).collect()}
    values = {(k, n): v for k, n, v in rows}
    assert got == {(k, n): values.get((k, n - 1)) for k, n in values}


@pytest.mark.parametrize("buffer_rows", [0, 10**9])
def test_percentiles_at_levels(spark, buffer_rows):
    """In one buffer and by brackets: the same as one query for each level; null keys are apart from left-out ones."""
    draw = random.Random(4)
    rows = [(draw.choice(("x", "y", None)), draw.randrange(3), draw.choice((None, draw.uniform(0, 9)))) for _ in range(400)]
    df = spark.createDataFrame(rows, "a string, b int, v double")
    got = {(r._level, r.a, r.b): (r.n, [round(p, 9) for p in r._p]) for r in quantiles.at_levels(df, [["a", "b"], ["a"], []], F.col("v"), [0.5, 0.9], [F.count("*").alias("n")], buffer_rows).collect()}
    want = {}
    for level, keys in enumerate((["a", "b"], ["a"], [])):
        for r in df.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile("v", F.array(F.lit(0.5), F.lit(0.9))).alias("p")).collect():
            want[level, r.a if "a" in keys else None, r.b if "b" in keys else None] = (r.n, [round(p, 9) for p in r.p])
    assert got == want
    none = quantiles.grouped(df.where("v is null"), [], F.col("v"), [0.5], [], buffer_rows).collect()
    assert len(none) == 1 and none[0]._p is None
