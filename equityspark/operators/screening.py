"""Weighted rule screens compiled to Columns (ids B5-B20, B22, F2, L1, L2)."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equityspark.functions.core import all_of, any_of

OPERATORS = (">", "<", "=", ">=", "<=", "between", "in")


@dataclass(frozen=True)
class Criterion:
    field: str
    op: str
    value: Any
    weight: float = 1.0


@dataclass(frozen=True)
class Screen:
    name: str
    criteria: tuple[Criterion, ...]
    require_all: bool
    min_score: float


def predicate(c: Criterion, columns: list[str]) -> Column:
    """True only when the field exists, is not null, and the comparison holds."""
    if c.op not in OPERATORS:
        raise ValueError(f"unknown operator {c.op!r}")
    if c.field not in columns:
        return F.lit(False)
    x = F.col(c.field)
    if c.op == "between":
        test = x.between(*c.value)
    elif c.op == "in":
        test = x.isin(list(c.value))
    else:
        test = {">": x > c.value, "<": x < c.value, "=": x == c.value, ">=": x >= c.value, "<=": x <= c.value}[c.op]
    return F.coalesce(test, F.lit(False))


def _shown(c: Criterion) -> str:
    return f"{c.field} {c.op} {c.value}"


def score(criteria: tuple[Criterion, ...], columns: list[str]) -> Column:
    """Share of passed weight in percent; no criteria 100, no weight 0."""
    if not criteria:
        return F.lit(100.0)
    total = float(sum(c.weight for c in criteria))
    if total <= 0:
        return F.lit(0.0)
    got = F.lit(0.0)
    for c in criteria:
        got = got + F.when(predicate(c, columns), F.lit(float(c.weight))).otherwise(F.lit(0.0))
    return got / total * 100.0


def evaluate(metrics: DataFrame, criteria: list[Criterion] | tuple[Criterion, ...], require_all: bool = True) -> DataFrame:
    """Adds passed, score and reasons to every row; one projection, no shuffle."""
    criteria = tuple(criteria)
    cols = metrics.columns
    tests = [predicate(c, cols) for c in criteria]
    passed = all_of(tests) if require_all else any_of(tests)
    reasons = F.array(
        *[F.when(t, F.lit("✓ " + _shown(c))).otherwise(F.lit("✗ " + _shown(c))) for t, c in zip(tests, criteria)]
    ) if criteria else F.array().cast("array<string>")
    return metrics.withColumns({"passed": passed, "score": score(criteria, cols), "reasons": reasons})


def run(metrics: DataFrame, screen: Screen, limit: int | None = None) -> DataFrame:
    """Passed rows at or above the minimum score, best first; ties by ticker.

    With a limit this plans as TakeOrderedAndProject: each task keeps ``limit`` rows.
    """
    out = evaluate(metrics, screen.criteria, screen.require_all)
    out = out.where(F.col("passed") & (F.col("score") >= screen.min_score)).orderBy(F.desc("score"), "ticker")
    return out.limit(limit) if limit is not None else out


def quick_filter(df: DataFrame, condition: Column | str) -> DataFrame:
    """Rows for which a user predicate (Column or SQL text) is true."""
    return df.where(condition)


def _screen(name: str, require_all: bool, min_score: float, *rules: tuple) -> Screen:
    return Screen(name, tuple(Criterion(*rule) for rule in rules), require_all, min_score)


# The ten named screens (field, operator, value, weight).
SCREENS: dict[str, Screen] = {
    s.name: s
    for s in (
        _screen("oversold", True, 50, ("rsi", "<", 30, 1.0), ("volume_ratio", ">", 1.2, 0.5)),
        _screen("overbought", True, 50, ("rsi", ">", 70, 1.0), ("volume_ratio", ">", 1.2, 0.5)),
        _screen("breakout", True, 60, ("price_vs_sma20", ">", 0, 1.0), ("volume_ratio", ">", 1.5, 0.8), ("returns_5d", ">", 2, 0.6)),
        _screen("momentum", True, 60, ("returns_5d", ">", 3, 1.0), ("rsi", "between", (50, 70), 0.8), ("volume_ratio", ">", 1.2, 0.6)),
        _screen("value", False, 40, ("pe_ratio", "<", 20, 1.0), ("price_to_book", "<", 3, 0.8), ("dividend_yield", ">", 2, 0.6)),
        _screen("growth", False, 40, ("revenue_growth", ">", 15, 1.0), ("earnings_growth", ">", 10, 0.9), ("profit_margin", ">", 10, 0.7)),
        _screen("quality", False, 50, ("roe", ">", 15, 1.0), ("debt_to_equity", "<", 1.0, 0.9), ("profit_margin", ">", 15, 0.8)),
        _screen("dividend", True, 60, ("dividend_yield", ">", 3, 1.0), ("pe_ratio", "<", 25, 0.7), ("debt_to_equity", "<", 1.5, 0.6)),
        _screen("reversal", True, 60, ("rsi", "between", (25, 40), 1.0), ("returns_1d", ">", 0, 0.8), ("volume_ratio", ">", 1.3, 0.7)),
        _screen("contrarian", False, 50, ("returns_5d", "<", -5, 1.0), ("roe", ">", 10, 0.9), ("pe_ratio", "<", 20, 0.8), ("debt_to_equity", "<", 1.5, 0.7)),
    )
}


def run_named(metrics: DataFrame, name: str, limit: int | None = None) -> DataFrame:
    if name not in SCREENS:
        raise ValueError(f"unknown screen {name!r}; known: {', '.join(SCREENS)}")
    return run(metrics, SCREENS[name], limit)


def run_all(metrics: DataFrame) -> DataFrame:
    """Every named screen in one pass: (screen, score) rows of the tickers that pass."""
    cols = metrics.columns
    results = []
    for s in SCREENS.values():
        tests = [predicate(c, cols) for c in s.criteria]
        passed = all_of(tests) if s.require_all else any_of(tests)
        value = score(s.criteria, cols)
        results.append(F.struct(F.lit(s.name).alias("screen"), F.when(passed & (value >= s.min_score), value).alias("score")))
    out = metrics.select("ticker", F.explode(F.array(*results)).alias("_s"))
    return out.select("ticker", "_s.screen", "_s.score").where(F.col("score").isNotNull())


def list_screens(spark) -> DataFrame:
    rows = [(s.name, s.require_all, float(s.min_score), len(s.criteria)) for s in SCREENS.values()]
    return spark.createDataFrame(rows, "name string, require_all boolean, min_score double, n_criteria int")
