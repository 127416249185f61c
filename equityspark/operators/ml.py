"""Feature selection, walk-forward training, calibration and stacking on MLlib
(ids D26-D29, D34-D37, E31, E32, F13, F14, I1-I9, I13).

Models train on all executors, boosted trees and forests through MLlib, leaf-wise trees
through ``leafwise``; the driver only sees metrics, importances and parameters (a few values
per model).
"""

from __future__ import annotations

import json
import random
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from equityspark.functions import rules
from equityspark.functions.core import ratio
from equityspark.functions.quantiles import exact_quantiles
from equityspark.operators import isotonic, leafwise
from equityspark.session import cut_lineage, materialize

LABEL, TARGET = "direction_5d", "forward_5d_return"
GATE_FLOOR = 0.526

# Default settings per model family (boosted level-wise, boosted leaf-wise, forest).
DEFAULTS: dict[str, dict] = {
    "boosted": {"maxIter": 200, "maxDepth": 6, "stepSize": 0.1, "subsamplingRate": 0.8, "validationTol": 0.0},
    "boosted_wide": {"n_trees": 200, "max_leaves": 31, "max_depth": 6, "learning_rate": 0.1, "min_rows": 20, "patience": 20},
    "random_forest": {"numTrees": 200, "maxDepth": 10, "minInstancesPerNode": 5, "maxMemoryInMB": 1024},
}
# Search bounds (low, high) per tunable setting.
SEARCH: dict[str, dict[str, tuple[float, float]]] = {
    "boosted": {"maxIter": (100, 500), "maxDepth": (3, 8), "stepSize": (0.01, 0.3), "minInstancesPerNode": (1, 10)},
    "boosted_wide": {"max_leaves": (20, 150), "min_rows": (10, 100), "l2": (0.0, 10.0)},
    "random_forest": {"numTrees": (100, 500), "maxDepth": (5, 20), "minInstancesPerNode": (2, 20)},
}
ROUNDS = {"boosted": "maxIter", "boosted_wide": "n_trees", "random_forest": "numTrees"}  # what a trial is cut to in an early rung


# Columns ------------------------------------------------------------------------
def missing_share(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, missing): share of nulls, all features in one scan."""
    one = df.agg(*[F.avg((F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).cast("double")).alias(c) for c in features])
    return one.unpivot([], features, "feature", "missing")


def correlations(df: DataFrame, features: list[str]) -> DataFrame:
    """(a, b, corr) for every pair, over the rows where both are present.

    Each task turns its Arrow batches into small matrices of sums (count, first and second
    moments around a common shift) and only those p*p sums are shuffled and added up.
    """
    shift = df.agg(*[F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0)).alias(c) for c in features]).first()
    centre = np.array([shift[c] for c in features])
    p = len(features)
    left, right = np.triu_indices(p, 1)

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((6, p, p))
        for pdf in batches:
            x = pdf.to_numpy(dtype="float64", na_value=np.nan) - centre
            m = np.isfinite(x).astype("float64")
            x = np.where(m > 0, x, 0.0)
            sq = x * x
            total += np.stack([m.T @ m, x.T @ m, m.T @ x, sq.T @ m, m.T @ sq, x.T @ x])
        t = total[:, left, right]
        yield pd.DataFrame({"i": left, "j": right, "n": t[0], "sa": t[1], "sb": t[2], "saa": t[3], "sbb": t[4], "sab": t[5]})

    cols = [F.col(c).cast("double").alias(c) for c in features]
    sums = df.select(*cols).mapInPandas(moments, "i int, j int, n double, sa double, sb double, saa double, sbb double, sab double")
    g = sums.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")])
    c = F.col
    cov = c("sab") - ratio(c("sa") * c("sb"), c("n"))
    va, vb = c("saa") - ratio(c("sa") * c("sa"), c("n")), c("sbb") - ratio(c("sb") * c("sb"), c("n"))
    names = F.array(*[F.lit(f) for f in features])
    corr = F.when((va > 1e-12) & (vb > 1e-12), cov / F.sqrt(va * vb))
    return g.select(F.get(names, c("i")).alias("a"), F.get(names, c("j")).alias("b"), corr.alias("corr"))


def correlated_features(pairs: DataFrame, limit: float = 0.95) -> DataFrame:
    """Features with |corr| above the limit to any earlier feature (pairs have a before b)."""
    return pairs.where(F.abs("corr") > limit).select(F.col("b").alias("feature")).distinct()


def impute_median(df: DataFrame, features: list[str]) -> DataFrame:
    """Nulls become the exact column median."""
    long = df.select(*[F.col(f).cast("double").alias(f) for f in features]).unpivot([], features, "key", "value")
    medians = {r["key"]: r["quantiles"][0] for r in exact_quantiles(long, [0.5]).collect()}  # one row per feature
    return df.fillna(medians)


def class_balance(df: DataFrame, label: str = LABEL) -> DataFrame:
    """negatives, positives and their ratio (weight of the positive class)."""
    neg, pos = F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)
    out = df.agg(neg.alias("negatives"), pos.alias("positives"))
    return out.withColumn("scale_pos_weight", F.coalesce(ratio(F.col("negatives"), F.col("positives")), F.lit(1.0)))


def select_features(df: DataFrame, features: list[str], label: str = LABEL, top_n: int = 40, rounds: int = 100) -> list[str]:
    """Missing filter, correlation prune, boosted-tree importances, best ``top_n``.

    With fewer than 10 features left the prune is skipped and at most 20 are kept.
    """
    share = {r["feature"]: r["missing"] for r in missing_share(df, features).collect()}
    present = [f for f in features if share[f] <= 0.05]
    drop = {r["feature"] for r in correlated_features(correlations(df, present)).collect()} if len(present) > 1 else set()
    kept = [f for f in present if f not in drop]
    n_keep = top_n
    if len(kept) < 10:
        kept, n_keep = present, min(20, top_n)
    filled = impute_median(df.select(label, *kept), kept)
    gbt = GBTClassifier(labelCol=label, featuresCol="features", maxIter=rounds, maxDepth=5, seed=42)
    model = gbt.fit(VectorAssembler(inputCols=kept, outputCol="features").transform(filled))
    return [f for f, _ in top_importances(model, kept, n_keep)]


def top_importances(model: Model, features: list[str], n: int) -> list[tuple[str, float]]:
    ranked = sorted(zip(features, model.featureImportances.toArray().tolist()), key=lambda t: -t[1])
    return ranked[:n]


def importance_table(spark: SparkSession, model: Model, features: list[str]) -> DataFrame:
    return spark.createDataFrame(top_importances(model, features, len(features)), "feature string, importance double")


# Splits -------------------------------------------------------------------------
def walk_forward(df: DataFrame, n_splits: int = 3, compat: str | None = None) -> DataFrame:
    """Rows with (fold, role): expanding training part, then an equally long validation part.

    The split is on distinct dates, so validation is always strictly later. The date to
    fold mapping has (dates x folds) rows and is broadcast. ``compat="rows"`` splits by row
    position in (ticker, date) order instead.
    """
    if compat == "rows":
        return _walk_forward_rows(df, n_splits)
    return df.join(F.broadcast(_fold_dates(df, n_splits)), "date")


def _fold_dates(df: DataFrame, n_splits: int) -> DataFrame:
    """(date, fold, role) of a walk-forward split on dates."""
    dates = df.select("date").distinct()
    w = Window.orderBy("date")
    ranked = dates.withColumn("_rank", F.row_number().over(w) - 1)
    total = dates.agg(F.count("*").alias("_n"))
    return _folds(ranked.join(F.broadcast(total)), n_splits).select("date", "fold", "role")


def _folds(ranked: DataFrame, n_splits: int) -> DataFrame:
    size = F.floor(F.col("_n") / (n_splits + 1))
    out = ranked.withColumns({"fold": F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1)))})
    start = F.col("_n") - (n_splits - F.col("fold")) * size
    role = F.when(F.col("_rank") < start, "train").when(F.col("_rank") < start + size, "validation")
    return out.withColumn("role", role).where(F.col("role").isNotNull())


def _walk_forward_rows(df: DataFrame, n_splits: int) -> DataFrame:
    """Row positions in ticker-major order from two levels of counts (ticker prefix, ticker)."""
    sizes = df.groupBy("ticker").agg(F.count("*").alias("_size")).withColumn("_p", F.substring("ticker", 1, 3))
    before = Window.partitionBy("_p").orderBy("ticker").rowsBetween(Window.unboundedPreceding, -1)
    inner = sizes.withColumn("_in", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    tops = sizes.groupBy("_p").agg(F.sum("_size").alias("_t"))
    above = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.withColumn("_top", F.coalesce(F.sum("_t").over(above), F.lit(0)))
    offsets = inner.join(tops, "_p").select("ticker", (F.col("_in") + F.col("_top")).alias("_off"))
    w = Window.partitionBy("ticker").orderBy("date")
    ranked = df.withColumn("_rn", F.row_number().over(w) - 1).join(offsets, "ticker").withColumn("_rank", F.col("_rn") + F.col("_off"))
    total = df.agg(F.count("*").alias("_n"))
    return _folds(ranked.join(F.broadcast(total)), n_splits).drop("_rn", "_off", "_rank", "_n")


def early_stop_flag(df: DataFrame, share: float = 0.8, out: str = "is_validation") -> DataFrame:
    """Marks the rows of the latest dates once ``share`` of all rows lie before them."""
    per_day = df.groupBy("date").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = per_day.agg(F.sum("_c").alias("_n"))
    flags = per_day.withColumn("_b", before).join(F.broadcast(total)).select("date", (F.col("_b") >= F.col("_n") * share).alias(out))
    return df.join(F.broadcast(flags), "date")  # one row per date


# Metrics ------------------------------------------------------------------------
def classification_metrics(scored: DataFrame, label: str, prediction: str, keys: list[str] | None = None) -> DataFrame:
    """accuracy, precision, recall and F1 of class 1; empty denominators give 0."""
    y, p = F.col(label) == 1, F.col(prediction) == 1
    g = scored.groupBy(*(keys or [])).agg(
        F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("accuracy"),
        F.count_if(y & p).alias("_tp"), F.count_if(~y & p).alias("_fp"), F.count_if(y & ~p).alias("_fn"),
    )
    tp, fp, fn = F.col("_tp"), F.col("_fp"), F.col("_fn")

    def safe(a: Column, b: Column) -> Column:
        return F.coalesce(ratio(a, b), F.lit(0.0))

    return g.withColumns({"precision": safe(tp, tp + fp), "recall": safe(tp, tp + fn), "f1": safe(2 * tp, 2 * tp + fp + fn)}).drop("_tp", "_fp", "_fn")


def regression_metrics(scored: DataFrame, target: str, prediction: str, keys: list[str] | None = None) -> DataFrame:
    y, e = F.col(target), F.col(target) - F.col(prediction)
    g = scored.groupBy(*(keys or [])).agg(
        F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(y).alias("_var")
    )
    return g.withColumn("r2", 1.0 - ratio(F.col("mse"), F.col("_var"))).drop("_var")


def average_folds(folds: DataFrame, keys: list[str]) -> DataFrame:
    names = [c for c, t in folds.dtypes if t == "double" and c not in keys]
    return folds.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in names])


def regression_gate(new: DataFrame, baseline: DataFrame, floor: float = GATE_FLOOR) -> DataFrame:
    """new (model, accuracy) against the stored accuracy of that model, else the floor."""
    b = baseline.select("model", F.col("accuracy").alias("baseline"))
    out = new.join(b, "model", "left").withColumn("baseline", F.coalesce("baseline", F.lit(floor)))
    return out.withColumn("passed", F.col("accuracy") >= F.col("baseline"))


def best_model(scores: DataFrame) -> DataFrame:
    """Model with the highest accuracy; ties by name."""
    return scores.agg(F.min_by("model", F.struct(-F.col("accuracy"), F.col("model"))).alias("model"), F.max("accuracy").alias("accuracy"))


# Models -------------------------------------------------------------------------
def _vectors(df: DataFrame, features: list[str]) -> DataFrame:
    """Feature vector of every row; a missing (null or NaN) feature is 0, so no row is lost."""
    filled = df.withColumns({f: F.coalesce(F.nanvl(F.col(f).cast("double"), F.lit(0.0)), F.lit(0.0)) for f in features})
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="error").transform(filled)


def _params(family: str, params: dict | None) -> dict:
    if family not in DEFAULTS:
        raise ValueError(f"unknown model family {family!r}; known: {', '.join(DEFAULTS)}")
    return {**DEFAULTS[family], **(params or {})}


ROWS_EACH, ROWS_MOST = 50_000, 2_000_000
FITS_AT_ONCE = 4  # models of the folds that are fitted at the same time
NODES_KEPT = 1_000_000_000  # rows times trees whose nodes are kept while forests grow: some 12 GB over all executors


def _spread(df: DataFrame, rows: int) -> DataFrame:
    """Rows dealt by key into partitions of about ``ROWS_EACH``, one per core unless that gives a task more than
    ``ROWS_MOST``: a forest's node statistics are made once per partition, so few rows in many partitions cost more than they save."""
    keys = [c for c in ("ticker", "date") if c in df.columns]
    if not keys:
        return df
    return df.repartition(_parts_for(rows, int(df.sparkSession.sparkContext.defaultParallelism)), *keys)


def _forest(settings: dict, rows: int) -> dict:
    """Settings of a forest that keeps the node of every row in every tree from level to level, which gives the same
    trees without walking all of them down from the root at each level, as long as the nodes fit in memory."""
    return {"cacheNodeIds": rows * settings["numTrees"] <= NODES_KEPT, "checkpointInterval": -1, **settings}


def _fits_at_once(family: str, rows: int, settings: dict) -> int:
    """Forests grow at the same time as long as the nodes they keep fit in memory together."""
    if family != "random_forest":
        return FITS_AT_ONCE
    return max(1, min(FITS_AT_ONCE, NODES_KEPT // max(1, rows * settings["numTrees"])))


def _parts_for(rows: int, cores: int) -> int:
    return max(1, min(cores, -(-rows // ROWS_EACH)), -(-rows // ROWS_MOST))


class LeafwiseModel:
    """Leaf-wise trees behind the interface of an MLlib model."""

    def __init__(self, model: leafwise.Model):
        self.model = model

    @property
    def featureImportances(self):  # noqa: N802 - the name MLlib uses
        shares = self.model.importances()
        return Vectors.dense([shares[f] for f in self.model.features])

    def transform(self, df: DataFrame) -> DataFrame:
        out = leafwise.predict(df, vector_to_array("features"), {"_value": self.model})
        p = F.col("_value")
        if self.model.spec.objective == "logistic":
            out = out.withColumns({"probability": array_to_vector(F.array(1.0 - p, p)), "prediction": (p > 0.5).cast("double")})
        else:
            out = out.withColumn("prediction", p)
        return out.drop("_value")

    def save(self, spark: SparkSession, path: str) -> None:
        m = self.model
        trees = [{k: v.tolist() for k, v in t.items()} for t in m.trees[: m.best]]
        body = {"spec": vars(m.spec), "features": m.features, "edges": m.edges.tolist(), "base": m.base, "trees": trees, "gains": m.gains.tolist()}
        spark.createDataFrame([(json.dumps(body),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LeafwiseModel:
        body = json.loads(spark.read.text(path).first()[0])
        trees = [{k: np.array(v) for k, v in t.items()} for t in body["trees"]]
        return cls(leafwise.Model(leafwise.Spec(**body["spec"]), body["features"], np.array(body["edges"]), body["base"], trees, gains=np.array(body["gains"]), best=len(trees)))


def save_model(spark: SparkSession, model: Model | LeafwiseModel, path: str) -> None:
    model.save(spark, path) if isinstance(model, LeafwiseModel) else model.write().overwrite().save(path)


def _fit_leafwise(rows: DataFrame, features: list[str], settings: list[dict], target: str, objective: str) -> list[LeafwiseModel]:
    """One model per setting, all grown in step over the same rows; column ``_r<i>`` is 1 for the training rows of
    model i, 2 for those that stop its growth and 0 for the others."""
    keys = [c for c in ("ticker", "date") if c in rows.columns]
    roles = [f"_r{i}" for i in range(len(settings))]
    rows = materialize(rows.select(*keys, *features, target, *roles), "rows")
    edges = leafwise.bin_edges(rows, features)
    specs = [leafwise.Spec(role=i, objective=objective, **s) for i, s in enumerate(settings)]
    packed = leafwise.blocks(rows, features, target, roles, edges, keys or features)
    return [LeafwiseModel(m) for m in leafwise.train(packed, specs, features, edges, n_roles=len(roles))]


def _fold_parts(base: DataFrame, n_splits: int) -> DataFrame:
    """The training rows of all folds of a ``walk_forward`` table split on dates, each once, with the part it has in every fold.

    The folds' pasts lie inside each other, so the last one holds them all; what a row is in a fold depends on its date only.
    """
    train = base.where("role = 'train'")
    days = train.groupBy("fold", "date").agg(F.count("*").alias("_c"))
    fold = Window.partitionBy("fold")  # one row per date
    before = F.coalesce(F.sum("_c").over(fold.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    late = days.select("fold", "date", (before >= F.sum("_c").over(fold) * 0.8).alias("_late"))
    part = F.when(F.col("_late"), 2).otherwise(1)
    roles = late.groupBy("date").agg(*[F.coalesce(F.max(F.when(F.col("fold") == i, part)), F.lit(0)).alias(f"_r{i}") for i in range(n_splits)])
    return train.where(F.col("fold") == n_splits - 1).drop("fold", "role").join(F.broadcast(roles), "date")


def _parts(train: DataFrame) -> DataFrame:
    """``_r0`` 1 or 2 (the latest fifth of the rows) for training with early stopping."""
    if "date" not in train.columns:
        return train.withColumn("_r0", F.lit(1))
    return early_stop_flag(train).withColumn("_r0", F.when(F.col("is_validation"), 2).otherwise(1)).drop("is_validation")


def train_classifier(train: DataFrame, features: list[str], family: str = "boosted", params: dict | None = None, label: str = LABEL) -> Model:
    """Direction classifier; boosted trees stop early on the last fifth, forest and level-wise trees weight the classes."""
    settings = _params(family, params)
    if family == "boosted_wide":
        return _fit_leafwise(_parts(train), features, [settings], label, "logistic")[0]
    rows = train.count()
    train = _spread(train, rows)
    counts = class_balance(train, label).first()
    neg, pos = counts["negatives"], counts["positives"]
    if family == "random_forest":
        n = neg + pos
        w = F.when(F.col(label) == 1, n / (2.0 * max(pos, 1))).otherwise(n / (2.0 * max(neg, 1)))
    else:
        w = F.when(F.col(label) == 1, neg / max(pos, 1)).otherwise(1.0)
    data = train.withColumns({"_w": w, "_y": F.col(label).cast("double")})
    common = dict(labelCol="_y", featuresCol="features", weightCol="_w", seed=42)
    if family == "random_forest":
        return RandomForestClassifier(**common, **_forest(settings, rows)).fit(_vectors(data, features))
    if "date" in data.columns:
        data = early_stop_flag(data)
        common["validationIndicatorCol"] = "is_validation"
    return GBTClassifier(**common, **settings).fit(_vectors(data, features))


def train_regressor(train: DataFrame, features: list[str], family: str = "boosted", params: dict | None = None, target: str = TARGET) -> Model:
    settings = _params(family, params)
    if family == "boosted_wide":
        return _fit_leafwise(_parts(train), features, [settings], target, "squared")[0]
    rows = train.count()
    train = _spread(train, rows)
    common = dict(labelCol=target, featuresCol="features", seed=42)
    if family == "random_forest":
        return RandomForestRegressor(**common, **_forest(settings, rows)).fit(_vectors(train, features))
    data = train
    if "date" in data.columns:
        data = early_stop_flag(data)
        common["validationIndicatorCol"] = "is_validation"
    return GBTRegressor(**common, **settings).fit(_vectors(data, features))


def p_up() -> Column:
    return vector_to_array(F.col("probability"))[1]


def fold_models(base: DataFrame, features: list[str], family: str, n_splits: int, params: dict | None = None) -> list[Model | LeafwiseModel]:
    """One classifier per fold of a ``walk_forward`` table, fitted on the fold's past."""
    if family == "boosted_wide":
        return _fit_leafwise(_fold_parts(base, n_splits), features, [_params(family, params)] * n_splits, LABEL, "logistic")
    parts = [base.where((F.col("fold") == fold) & (F.col("role") == "train")).drop("fold", "role") for fold in range(n_splits)]
    with ThreadPoolExecutor(_fits_at_once(family, parts[-1].count(), _params(family, params))) as pool:
        return list(pool.map(lambda p: train_classifier(p, features, family, params), parts))


def fold_scores(base: DataFrame, features: list[str], family: str, n_splits: int, params: dict | None = None) -> DataFrame:
    """(ticker, date, label, fold, prediction, p_up) of the validation rows, each scored by a model of its past."""
    out = None
    for fold, model in enumerate(fold_models(base, features, family, n_splits, params)):
        held = base.where((F.col("fold") == fold) & (F.col("role") == "validation"))
        one = model.transform(_vectors(held, features)).select("ticker", "date", LABEL, "fold", "prediction", p_up().alias("p_up"))
        out = one if out is None else out.unionByName(one)
    return out


def _folded(df: DataFrame, features: list[str], n_splits: int) -> DataFrame:
    """``walk_forward`` over the rows written once: a fold is the rows of its dates, so the folds' rows are not written out."""
    return walk_forward(materialize(df.select("ticker", "date", LABEL, *features), "rows"), n_splits)


def walk_forward_validation(df: DataFrame, features: list[str], family: str = "boosted", n_splits: int = 3, params: dict | None = None) -> DataFrame:
    """(fold, accuracy, precision, recall, f1): fit on each fold's past, score its future."""
    base = _folded(df, features, n_splits)
    return classification_metrics(fold_scores(base, features, family, n_splits, params), LABEL, "prediction", ["fold"])


# What the search falls back to when most trials fail.
TUNER_FALLBACK = {
    "boosted": {"maxIter": 100, "maxDepth": 6, "stepSize": 0.1},
    "boosted_wide": {"max_leaves": 31, "min_rows": 20},
    "random_forest": {"numTrees": 100, "maxDepth": 10},
}


def _drawn(rng: random.Random, space: dict[str, tuple[float, float]]) -> dict:
    whole = lambda k, lo, hi: float(lo).is_integer() and float(hi).is_integer() and k not in ("subsamplingRate", "l2")
    return {k: rng.randint(int(lo), int(hi)) if whole(k, lo, hi) else rng.uniform(lo, hi) for k, (lo, hi) in space.items()}


def _search_blocks(df: DataFrame, features: list[str], n_splits: int) -> tuple[DataFrame, np.ndarray]:
    """(blocks, bin edges) of all rows with their role in every fold, which depends on the date only."""
    names = [f"_r{f}" for f in range(n_splits)]
    role = F.when(F.col("role") == "train", 1).otherwise(2)
    roles = _fold_dates(df, n_splits).groupBy("date").agg(*[F.coalesce(F.max(F.when(F.col("fold") == f, role)), F.lit(0)).alias(n) for f, n in enumerate(names)])
    rows = materialize(df.select("ticker", "date", LABEL, *features).join(F.broadcast(roles), "date"), "rows")
    edges = leafwise.bin_edges(rows, features)
    return leafwise.blocks(rows, features, LABEL, names, edges, ["ticker", "date"]), edges


def _rung_leafwise(packed: DataFrame, edges: np.ndarray, features: list[str], n_splits: int, trials: dict[int, dict], at_once: int, grown: dict[int, list[leafwise.Model]]) -> dict[int, float]:
    """Mean fold accuracy per trial; folds and trials grow in step, ``at_once`` models at a time. ``grown`` holds the
    trials' models from rung to rung: a tree depends on the trees before it only, so the next rung adds to them."""
    step = max(1, at_once // n_splits)
    numbers, out = list(trials), {}
    for a in range(0, len(numbers), step):
        some = numbers[a: a + step]
        specs = [leafwise.Spec(role=f, **{**_params("boosted_wide", trials[n]), "patience": None}) for n in some for f in range(n_splits)]
        models = [m for n in some for m in grown.get(n, [])] or None
        for m, s in zip(models or [], specs, strict=bool(models)):
            m.spec = s
        models = leafwise.train(packed, specs, features, edges, models, n_roles=n_splits)
        grown |= {n: models[i * n_splits: (i + 1) * n_splits] for i, n in enumerate(some)}
        hits = leafwise.accuracies(packed, models, len(features), n_splits)
        for i, n in enumerate(some):
            out[n] = float(np.mean(hits[i * n_splits: (i + 1) * n_splits]))
    return out


def _rung_mllib(base: DataFrame, features: list[str], family: str, n_splits: int, trials: dict[int, dict], at_once: int) -> dict[int, float | str]:
    """Mean fold accuracy per trial, or the message of its failure; at most ``at_once`` trials run at a time."""
    def one(number: int):
        try:
            scored = fold_scores(base, features, family, n_splits, trials[number])
            return float(classification_metrics(scored, LABEL, "prediction", ["fold"]).agg(F.avg("accuracy")).first()[0])
        except Exception as exc:  # noqa: BLE001 - a failed trial is a result, with its message
            return f"{type(exc).__name__}: {exc}"[:500]

    with ThreadPoolExecutor(at_once) as pool:
        return dict(zip(trials, pool.map(one, trials), strict=True))


def tune(
    df: DataFrame, features: list[str], family: str = "boosted", n_trials: int = 50, n_splits: int = 5, seed: int = 42,
    bounds: dict[str, tuple[float, float]] | None = None, rungs: tuple[float, ...] = (1 / 16, 1 / 4, 1.0), eta: int = 4, at_once: int | None = None, most_rounds: int | None = None,
) -> tuple[dict, DataFrame]:
    """Seeded search by successive halving over time-ordered folds: (best parameters, trial table).

    All trials are drawn first and run on one shared fold table with a share ``rungs[0]`` of their
    rounds (trees, at least one); the best of ``eta`` go on to the next share. A trial that stays behind is
    PRUNED with its last value and share, one that reaches the last rung COMPLETE, one that fails
    FAIL with its message; more than half failing gives the fallback. ``most_rounds`` bounds the rounds of
    the last rung. The trial table has one row per trial; ties go to the earlier trial.
    """
    rng = random.Random(seed)
    drawn = {n: _drawn(rng, bounds or SEARCH[family]) for n in range(n_trials)}
    base = None if family == "boosted_wide" else _folded(df, features, n_splits)
    packed, grown = None, {}
    key, rows, alive = ROUNDS[family], {}, list(drawn)
    for i, share in enumerate(rungs):
        full = lambda n: min(_params(family, drawn[n])[key], most_rounds or 10**9)
        trials = {n: {**drawn[n], key: max(1, round(full(n) * share))} for n in alive}
        if family == "boosted_wide":
            try:
                packed = packed or _search_blocks(df, features, n_splits)
                got: dict = _rung_leafwise(*packed, features, n_splits, trials, at_once or 40, grown)
            except Exception as exc:  # noqa: BLE001 - trials of a rung share their passes and so their failure
                got = dict.fromkeys(trials, f"{type(exc).__name__}: {exc}"[:500])
        else:
            got = _rung_mllib(base, features, family, n_splits, trials, at_once or 4)
        for n, value in got.items():
            failed = isinstance(value, str)
            rows[n] = (n, json.dumps(drawn[n], sort_keys=True), None if failed else value, "FAIL" if failed else "COMPLETE" if i + 1 == len(rungs) else "PRUNED", trials[n][key], value if failed else None)
        ranked = sorted((n for n in alive if rows[n][3] != "FAIL"), key=lambda n: (-rows[n][2], n))
        alive = ranked[: max(1, -(-len(ranked) // eta))]
        if not alive:
            break
    table = [rows[n] for n in sorted(rows)]
    trials = df.sparkSession.createDataFrame(table, "trial_number int, params string, value double, state string, rounds int, error string")
    done = [r for r in table if r[3] != "FAIL"]
    last = [r for r in done if r[3] == "COMPLETE"]
    if len(done) * 2 < len(table) or not last:
        return dict(TUNER_FALLBACK[family]), trials
    return json.loads(max(last, key=lambda r: (r[2], -r[0]))[1]), trials


def predict(df: DataFrame, features: list[str], classifier: Model, regressor: Model, name: str) -> DataFrame:
    """Batch predictions in the long form the ensembles take."""
    c = classifier.transform(_vectors(df, features)).select("ticker", "date", "features", p_up().alias("p_up"), "prediction")
    scored = regressor.transform(c.withColumnRenamed("prediction", "_class")).withColumnRenamed("prediction", "expected_return")
    up = F.col("p_up")
    conf = F.greatest(up, 1.0 - up) * 100.0
    out = scored.withColumns({"model": F.lit(name), "direction": F.when(F.col("_class") == 1, "bullish").otherwise("bearish"), "confidence": conf})
    args = (F.col("direction"), F.col("confidence"), F.col("expected_return"))
    out = out.withColumns({"score": rules.prediction_score(*args), "recommendation": rules.recommendation(*args)})
    return out.select("ticker", "date", "model", "direction", "confidence", "expected_return", "p_up", "score", "recommendation")


def train_and_save(
    df: DataFrame, features: list[str], out_dir: str, families: tuple[str, ...] = ("boosted", "random_forest", "boosted_wide"),
    n_splits: int = 3, params: dict[str, dict] | None = None, validated: DataFrame | None = None,
) -> DataFrame:
    """Validate, gate against the stored metadata, retrain on everything, save.

    A family that fails its gate saves nothing. ``validated`` (model, accuracy, ...) takes the place of
    the validation if it was done before. Returns (model, accuracy, baseline, passed).
    """
    spark = df.sparkSession
    frame = materialize(df.select("ticker", "date", LABEL, TARGET, *features), "rows")
    scores = None if validated is None else validated.where(F.col("model").isin(*families))
    for family in families if validated is None else ():
        folds = walk_forward_validation(frame, features, family, n_splits, (params or {}).get(family))
        one = average_folds(folds.drop("fold"), []).withColumn("model", F.lit(family))
        scores = one if scores is None else scores.unionByName(one)
    scores = cut_lineage(scores)
    try:
        baseline = spark.read.json(f"{out_dir}/metadata").select("model", "accuracy")
        baseline = cut_lineage(baseline)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        # the first run has no metadata
        baseline = spark.createDataFrame([], "model string, accuracy double")
    verdicts = cut_lineage(regression_gate(scores.select("model", "accuracy"), baseline))
    passed = [r["model"] for r in verdicts.where("passed").collect()]

    def fit(job):
        family, train, name = job
        save_model(spark, train(frame, features, family, (params or {}).get(family)), f"{out_dir}/{family}/{name}")

    jobs = [(f, train, name) for f in passed for train, name in ((train_classifier, "classifier"), (train_regressor, "regressor"))]
    with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
        list(pool.map(fit, jobs))
    if passed:
        kept = baseline.join(verdicts.where("passed").select("model"), "model", "left_anti")
        fresh = scores.where(F.col("model").isin(passed)).select("model", "accuracy")
        cut_lineage(kept.unionByName(fresh)).write.mode("overwrite").json(f"{out_dir}/metadata")
    return verdicts


class Calibrator:
    """Raw P(up) to calibrated P(up): isotonic (exact, on all rows), Platt, or identity when it cannot be fitted."""

    def __init__(self, method: str = "isotonic"):
        self.method = method
        self.model: Model | DataFrame | None = None

    def fit(self, scored: DataFrame, probability: str = "p_up", label: str = LABEL) -> Calibrator:
        counts = class_balance(scored, label).first()
        if counts["negatives"] + counts["positives"] < 100 or not counts["negatives"] or not counts["positives"]:
            self.model = None
            return self
        y = F.col(label).cast("double")
        if self.method == "isotonic":
            self.model = isotonic.fit(scored.select(F.col(probability).alias("x"), y.alias("y")), "x", "y")
        else:
            points = scored.groupBy(F.col(probability).alias("x"), y.alias("y")).agg(F.count("*").cast("double").alias("w"))
            lr = LogisticRegression(featuresCol="_x", labelCol="y", weightCol="w", regParam=0.0, maxIter=1000)
            self.model = lr.fit(VectorAssembler(inputCols=["x"], outputCol="_x").transform(points))
        return self

    def transform(self, scored: DataFrame, probability: str = "p_up", out: str = "p_calibrated") -> DataFrame:
        def clip(c: Column) -> Column:
            return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))

        if self.model is None:
            return scored.withColumn(out, clip(F.col(probability)))
        if self.method == "isotonic":
            return isotonic.predict(scored, probability, self.model, out).withColumn(out, clip(F.col(out)))
        keep = scored.columns
        res = self.model.transform(VectorAssembler(inputCols=[probability], outputCol="_x").transform(scored))
        return res.withColumn(out, clip(vector_to_array("probability")[1])).select(*keep, out)


def out_of_fold(df: DataFrame, features: list[str], families: tuple[str, ...], n_splits: int = 5, params: dict[str, dict] | None = None) -> DataFrame:
    """(ticker, date, label, <family> P(up) per column): each row scored by models that only saw its past."""
    base = _folded(df, features, n_splits)
    per_family = None
    for family in families:
        scored = fold_scores(base, features, family, n_splits, (params or {}).get(family)).select("ticker", "date", LABEL, F.col("p_up").alias(family))
        per_family = scored if per_family is None else per_family.join(scored.drop(LABEL), ["ticker", "date"])
    return per_family


def fit_stacking(oof: DataFrame, families: tuple[str, ...]) -> Model:
    """Logistic meta-learner on out-of-fold P(up)."""
    data = VectorAssembler(inputCols=list(families), outputCol="features").transform(oof.withColumn("_y", F.col(LABEL).cast("double")))
    return LogisticRegression(featuresCol="features", labelCol="_y", maxIter=1000).fit(data)


def stacking_probability(meta: Model, probabilities: DataFrame, families: tuple[str, ...]) -> DataFrame:
    """(ticker, date, direction_probability) from per-family P(up) columns."""
    scored = meta.transform(VectorAssembler(inputCols=list(families), outputCol="features").transform(probabilities))
    return scored.select("ticker", "date", p_up().alias("direction_probability"))
