"""Indicators of the newest row only, and the length of the frames that slide over series."""

import datetime
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from equityspark.functions import indicators as ind
from equityspark.plans import snapshot

KINDS = "ticker string, date date, open double, high double, low double, close double, volume double"


def plan_of(df):
    return df._jdf.queryExecution().analyzed().toString()


@pytest.fixture(scope="module")
def bars(spark):
    rng = np.random.default_rng(3)
    day = datetime.date(2020, 1, 1)
    rows = []
    for ticker, n in (("A", 900), ("B", 213), ("C", 30), ("D", 14), ("E", 1), (None, 25)):
        close = 100 + np.cumsum(rng.normal(size=n))
        rows += [(ticker, day + datetime.timedelta(days=i), float(c) - 1, float(c) + 2, float(c) - 2, float(c), float(rng.integers(1, 99))) for i, c in enumerate(close)]
    rows += [("F", day + datetime.timedelta(days=i), 1.0, 2.0, 0.5, None if i in (3, 55) else 1.0 + i % 7, None if i == 58 else 5.0) for i in range(60)]
    gaps = {"H": range(512, 515), "I": range(512, 520)}  # blocks of the exponential means that begin, or are, without a price
    rows += [(t, day + datetime.timedelta(days=i), 1.0, 2.0, 0.5, None if i in gaps[t] else 50.0 + i * i % 17, 5.0) for t in gaps for i in range(520)]
    rows += [("F", None, 1.0, 1.0, 1.0, 9.0, 1.0), ("G", None, 1.0, 1.0, 1.0, 1.0, 1.0)]
    return spark.createDataFrame(rows, KINDS)


def test_newest_row_equals_the_table(bars):
    levels = {"support": F.min("close").over(ind.trailing(20)), "resistance": F.max("close").over(ind.trailing(20))}
    cols = ["date", *snapshot.OHLCV, *ind.INDICATOR_COLUMNS, "support", "resistance"]
    want = {r["ticker"]: r for r in snapshot.latest(ind.indicator_table(bars.withColumns(levels)), cols).collect()}
    got = {r["ticker"]: r for r in ind.latest_indicators(bars, ["date", *snapshot.OHLCV]).collect()}
    assert set(got) == set(want) and len(got) == 10
    for ticker, row in want.items():
        for c in cols:
            a, b = got[ticker][c], row[c]
            assert a == b if a is None or b is None or c == "date" else math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9), (ticker, c)


def test_newest_row_needs_no_sliding_frame(bars):
    plan = plan_of(snapshot.flat_snapshot(bars))
    assert not re.search(r"specifiedwindowframe\(RowFrame, -[2-9]", plan)


def test_long_means_slide_over_short_frames(bars):
    frames = [int(n) for n in re.findall(r"specifiedwindowframe\(RowFrame, -(\d+), currentrow", plan_of(ind.indicator_table(bars)))]
    assert frames and max(frames) == ind.SUM_ROWS - 1


@pytest.mark.parametrize("n", [1, 20, 50, 63])
def test_sma_equals_the_plain_mean(bars, n):
    w = ind.trailing(n)
    out = bars.withColumns({"a": ind.sma(F.col("close"), n), "b": F.when(F.count("close").over(w) == n, F.avg("close").over(w))})
    assert out.where("NOT (a <=> b) AND (a IS NULL OR b IS NULL OR abs(a - b) > 1e-9)").count() == 0
