"""Column helpers shared by all operators.

Series windows partition by ``ticker``. That is a bounded group by construction:
every series operator takes bars that are unique on (ticker, date), so one ticker
holds at most one row per trading date however many raw trades it had. Raw trades
are always reduced to bars first by a partial (map-side) aggregation on
(ticker, date), which is where a hot ticker is absorbed.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

_KEYS: ContextVar[tuple[str, ...]] = ContextVar("series_keys", default=("ticker",))


def series_keys() -> tuple[str, ...]:
    """Columns that make up one series: the ticker, or inside ``keyed_by`` what it names."""
    return _KEYS.get()


@contextmanager
def keyed_by(*keys: str) -> Iterator[None]:
    """Series expressions built inside are partitioned by ``keys`` (see ``plans.long_series``)."""
    token = _KEYS.set(keys)
    try:
        yield
    finally:
        _KEYS.reset(token)


def series() -> WindowSpec:
    """The one window all series operators share."""
    return Window.partitionBy(*series_keys()).orderBy("date")


def trailing(n: int, w: WindowSpec | None = None) -> WindowSpec:
    """Frame of the last ``n`` rows including the current one."""
    return (w or series()).rowsBetween(-(n - 1), 0)


def full(n: int, x: Column, value: Column, w: WindowSpec | None = None) -> Column:
    """``value`` only when the last ``n`` rows all hold a non-null ``x``, else null."""
    return F.when(F.count(x).over(trailing(n, w)) == n, value)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null when b is zero or null (never an ANSI error, never inf)."""
    return F.try_divide(a, b)


def half_up_mean(total: Column, n: Column, digits: int) -> Column:
    """total / n for whole ``total`` in units of 10^-digits, rounded half away from zero in
    whole numbers: the double mean of two-decimal values may fall on either side of a half."""
    whole = F.floor(F.try_divide((2 * F.abs(total) + n).cast("double"), 2 * n)).cast("double")
    return F.signum(total.cast("double")) * whole / 10.0**digits


def pct(a: Column, b: Column) -> Column:
    """Relative change of a against b in percent."""
    return ratio(a - b, b) * 100.0


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def any_of(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, cols, F.lit(False))


def all_of(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, cols, F.lit(True))


def contains_any(text: Column, words: list[str]) -> Column:
    """True when ``text`` contains one of ``words``; one JVM expression, no UDF."""
    return F.coalesce(any_of([text.contains(w) for w in words]), F.lit(False))


def points(*rules: tuple[Column, float]) -> Column:
    """First rule that holds gives its points; nothing holds (or null) gives 0."""
    expr = None
    for cond, value in rules:
        lit = F.lit(float(value))
        expr = F.when(cond, lit) if expr is None else expr.when(cond, lit)
    return expr.otherwise(F.lit(0.0))


def truthy(x: Column) -> Column:
    """Number that is present and not zero; zero counts as missing in the score rules."""
    return F.when(x != 0, x)


def latest_per(df: DataFrame, keys: list[str], order: str | Column, cols: list[str]) -> DataFrame:
    """Latest row per key by ``max_by``: combined on the map side, so a hot key ships one row
    per task. The plan is a sort aggregate, because the buffered row is not of fixed width."""
    row = F.struct(*[F.col(c) for c in cols])
    return (
        df.groupBy(*keys)
        .agg(F.max_by(row, order).alias("_r"))
        .select(*keys, *[F.col(f"_r.{c}").alias(c) for c in cols])
    )


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rn") -> DataFrame:
    """First ``n`` rows per key.

    ``row_number() <= n`` right above the window lets Spark cut every input partition
    to ``n`` rows per key before the shuffle (WindowGroupLimit), so a key holding a
    third of all rows sends only ``n`` rows per map task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def sanitize(df: DataFrame) -> DataFrame:
    """NaN and +-inf become null in every double/float column and in arrays of them."""

    def clean(x: Column) -> Column:
        return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)

    out = []
    for name, kind in df.dtypes:
        col = F.col(f"`{name}`")
        if kind in ("double", "float"):
            out.append(clean(col).alias(name))
        elif kind in ("array<double>", "array<float>"):
            out.append(F.transform(col, clean).alias(name))
        else:
            out.append(col)
    return df.select(*out)


def attach_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Put the columns of a one-row aggregate next to every row.

    ``one_row`` must come from an aggregation without keys, so the broadcast side is
    exactly one row whatever the data size.
    """
    return df.join(F.broadcast(one_row))
