"""Inference features of the newest row."""

from __future__ import annotations

from equityspark.catalog.registry import query
from equityspark.catalog.util import keep, raw_or_round
from equityspark.operators import features
from equityspark.plans import snapshot
from equityspark.sources import views

COLS = features.BASE_FEATURES + ["price_to_sma20", "price_to_sma50", "volume_ratio"]
_LATEST = "(SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM indicators)"


def _sql(compat: bool) -> str:
    fill = {c: f"coalesce({c}, close)" for c in ("sma_20", "sma_50", "sma_200", "ema_12", "ema_26", "bb_upper", "bb_middle", "bb_lower")}
    if compat:
        fill |= {"open": "close", "ema_12": "coalesce(sma_20, close)", "ema_26": "coalesce(sma_50, close)"}
    fill |= {"rsi_14": "coalesce(rsi_14, 50)", "volume_sma_20": "coalesce(volume_sma_20, volume)",
             "price_to_sma20": "coalesce(close / coalesce(sma_20, close) - 1, 0)",
             "price_to_sma50": "coalesce(close / coalesce(sma_50, close) - 1, 0)",
             "volume_ratio": "coalesce(volume / coalesce(volume_sma_20, volume), 0)"}
    cols = ", ".join(raw_or_round(f"coalesce({fill.get(c, c)}, 0)", c) for c in COLS)
    return f"SELECT ticker, {cols} FROM {_LATEST} WHERE k = 1"


@query("b27_inference_features", _sql(False))
def b27(spark, d):
    return keep(features.inference_features(snapshot.flat_snapshot(views.bars(spark, d))), "ticker", *COLS)


@query("b27_inference_features_compat", _sql(True))
def b27_compat(spark, d):
    return keep(features.inference_features(snapshot.flat_snapshot(views.bars(spark, d)), compat=True), "ticker", *COLS)
