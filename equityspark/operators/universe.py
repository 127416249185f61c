"""Universe and sector selection over (universe, sector, ticker) tables (ids B23, B24, C10, C15, D30, G3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def list_universes(universe: DataFrame) -> DataFrame:
    return universe.select("universe").distinct()


def list_sectors(universe: DataFrame, name: str | None = None) -> DataFrame:
    return _of(universe, name).where(F.col("sector").isNotNull()).select("sector").distinct()


def _of(universe: DataFrame, name: str | None) -> DataFrame:
    return universe if name is None else universe.where(F.col("universe") == name)


def require_universe(universe: DataFrame, name: str) -> DataFrame:
    """The rows of one universe; an unknown name is an error (one-row existence probe)."""
    rows = _of(universe, name)
    if rows.limit(1).count() == 0:
        raise ValueError(f"unknown universe: {name}")
    return rows


def members(universe: DataFrame, name: str, sector: str | None = None) -> DataFrame:
    """Tickers of a universe; the sector matches case-insensitively, unknown gives none."""
    rows = _of(universe, name)
    if sector is not None:
        rows = rows.where(F.lower("sector") == sector.lower())
    return rows.select("ticker").distinct()


def filter_members(universe: DataFrame, name: str, sectors: list[str] | None = None, exclude: DataFrame | list[str] | None = None) -> DataFrame:
    """Union of the sectors' tickers without duplicates, minus the excluded ones."""
    rows = _of(universe, name)
    if sectors:
        rows = rows.where(F.lower("sector").isin([s.lower() for s in sectors]))
    out = rows.select("ticker").distinct()
    if exclude is None:
        return out
    if isinstance(exclude, DataFrame):
        return out.join(exclude.select("ticker"), "ticker", "left_anti")
    return out.where(~F.col("ticker").isin(exclude)) if exclude else out


def restrict(df: DataFrame, tickers: DataFrame) -> DataFrame:
    return df.join(tickers.select("ticker"), "ticker", "left_semi")


def universe_info(universe: DataFrame) -> DataFrame:
    """Tickers per universe and sector."""
    return universe.groupBy("universe", "sector").agg(F.count_distinct("ticker").alias("n_tickers"))
