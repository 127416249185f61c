"""Small helpers for query definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# Prices are the same doubles in both engines and may lie on a rounding half, so they
# are compared as they are.
RAW = set(
    "open high low close price price_high price_low current_price entry_price exit_price latest_price period_high "
    "period_low support resistance current".split()
)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round computed double columns so that both engines print the same digits."""
    return df.select(
        *[F.round(F.col(c), digits).alias(c) if t in ("double", "float") and c not in RAW else F.col(c) for c, t in df.dtypes]
    )


def keep(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return rounded(df.select(*cols), digits)


def raw_or_round(expr: str, name: str, digits: int = 6) -> str:
    return f"{expr} AS {name}" if name in RAW else f"round({expr}, {digits}) AS {name}"


def r(*cols: str, digits: int = 6) -> str:
    """SQL list of the columns, rounded like ``rounded`` does."""
    return ", ".join(raw_or_round(c, c, digits) for c in cols)
