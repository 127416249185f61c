"""Feature selection, split, metric, training, calibration and stacking queries."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from equityspark.catalog import oracle
from equityspark.catalog.q_features import model_frame
from equityspark.catalog.registry import query, register
from equityspark.catalog.util import keep, r, rounded
from equityspark.functions import indicators as ind
from equityspark.operators import ensemble, features, labels, ml
from equityspark.session import cut_lineage, materialize, scratch_folder
from equityspark.sources import views

SEL = ["close", "rsi_14", "sma_20", "sma_50", "sma_200", "bb_upper", "volume", "volume_sma_20"]


def select_frame(spark, d):
    close = F.col("close")
    up, _, _ = ind.bollinger(close)
    return views.bars(spark, d).withColumns(
        {"rsi_14": ind.rsi(close), "sma_20": ind.sma(close, 20), "sma_50": ind.sma(close, 50), "sma_200": ind.sma(close, 200),
         "bb_upper": up, "volume_sma_20": ind.sma(F.col("volume"), 20)}
    ).select("ticker", "date", *SEL)


oracle.define("sel_frame", "SELECT ticker, date, close, rsi_14, sma_20, sma_50, sma_200, sma_20 + 2 * sd_20 AS bb_upper, volume, volume_sma_20 FROM ind_rsi")


@query("d26_missing_share", " UNION ALL ".join(f"SELECT '{c}' AS feature, round(1 - count({c}) / count(*), 6) AS missing FROM sel_frame" for c in SEL))
def d26(spark, d):
    return keep(ml.missing_share(select_frame(spark, d), SEL), "feature", "missing")


_PAIRS = [(a, b) for i, a in enumerate(SEL) for b in SEL[i + 1:]]
oracle.define("sel_corr", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS corr FROM sel_frame" for a, b in _PAIRS))


@query("d27_correlations", f"SELECT a, b, {r('corr')} FROM sel_corr")
def d27(spark, d):
    return keep(ml.correlations(select_frame(spark, d), SEL), "a", "b", "corr")


@query("i05b_correlation_prune", "SELECT DISTINCT b AS feature FROM sel_corr WHERE abs(corr) > 0.95")
def i05b(spark, d):
    return ml.correlated_features(ml.correlations(select_frame(spark, d), SEL))


@query("d28_median_imputation", "SELECT ticker, date, " + ", ".join(f"round(coalesce({c}, (SELECT median({c}) FROM sel_frame)), 6) AS {c}" for c in ("rsi_14", "sma_50")) + " FROM sel_frame")
def d28(spark, d):
    return keep(ml.impute_median(select_frame(spark, d).select("ticker", "date", "rsi_14", "sma_50"), ["rsi_14", "sma_50"]), "ticker", "date", "rsi_14", "sma_50")


@query("d29_class_balance", "SELECT count(*) FILTER (direction_5d = 0) AS negatives, count(*) FILTER (direction_5d = 1) AS positives, round(count(*) FILTER (direction_5d = 0) / count(*) FILTER (direction_5d = 1), 6) AS scale_pos_weight FROM fwd_labels")
def d29(spark, d):
    return rounded(ml.class_balance(labels.forward_labels(views.bars(spark, d))))


oracle.define("scored", """
  SELECT p.ticker, p.date, p.model, CASE WHEN p.direction = 'bullish' THEN 1 ELSE 0 END AS prediction, p.expected_return, l.direction_5d, l.forward_5d_return
  FROM predictions p JOIN fwd_labels l ON l.ticker = p.ticker AND l.date = p.date""")


def scored(spark, d):
    p = views.predictions(spark, d).withColumn("prediction", (F.col("direction") == "bullish").cast("int"))
    return p.join(labels.forward_labels(views.bars(spark, d)), ["ticker", "date"])


CM = """avg(CASE WHEN prediction = direction_5d THEN 1.0 ELSE 0.0 END) AS accuracy,
  coalesce(count(*) FILTER (prediction = 1 AND direction_5d = 1) / nullif(count(*) FILTER (prediction = 1), 0), 0) AS precision,
  coalesce(count(*) FILTER (prediction = 1 AND direction_5d = 1) / nullif(count(*) FILTER (direction_5d = 1), 0), 0) AS recall,
  coalesce(2 * count(*) FILTER (prediction = 1 AND direction_5d = 1) / nullif(count(*) FILTER (prediction = 1) + count(*) FILTER (direction_5d = 1), 0), 0) AS f1"""


@query("d34_classification_metrics", f"SELECT model, {r('accuracy', 'precision', 'recall', 'f1')} FROM (SELECT model, {CM} FROM scored GROUP BY model)")
def d34(spark, d):
    return rounded(ml.classification_metrics(scored(spark, d), "direction_5d", "prediction", ["model"]))


@query("d35_regression_metrics", "SELECT model, round(m, 6) AS mse, round(1 - m / v, 6) AS r2, round(a, 6) AS mae FROM (SELECT model, avg(pow(forward_5d_return - expected_return, 2)) AS m, avg(abs(forward_5d_return - expected_return)) AS a, var_pop(forward_5d_return) AS v FROM scored GROUP BY model)")
def d35(spark, d):
    return rounded(ml.regression_metrics(scored(spark, d), "forward_5d_return", "expected_return", ["model"]))


_FOLD = "unnest(range(3)) AS fold, n - (3 - unnest(range(3))) * (n // 4) AS s, n // 4 AS size"
oracle.define("date_folds", f"""
  SELECT date, fold, CASE WHEN rk < s THEN 'train' WHEN rk < s + size THEN 'validation' END AS role FROM (
    SELECT date, rk, {_FOLD} FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS rk, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM bars))) WHERE rk < s + size""")


@query("e31_walk_forward", "SELECT b.ticker, b.date, CAST(fold AS INTEGER) AS fold, role FROM bars b JOIN date_folds f ON f.date = b.date")
def e31(spark, d):
    return ml.walk_forward(views.bars(spark, d)).select("ticker", "date", "fold", "role")


@query("e31_walk_forward_rows", f"""SELECT ticker, date, CAST(fold AS INTEGER) AS fold, CASE WHEN rk < s THEN 'train' ELSE 'validation' END AS role FROM (
    SELECT ticker, date, rk, {_FOLD} FROM (SELECT ticker, date, row_number() OVER (ORDER BY ticker, date) - 1 AS rk, count(*) OVER () AS n FROM bars)) WHERE rk < s + size""")
def e31_rows(spark, d):
    return ml.walk_forward(views.bars(spark, d), compat="rows").select("ticker", "date", "fold", "role")


@query("e32_early_stop_split", "SELECT b.ticker, b.date, f.v AS is_validation FROM bars b JOIN (SELECT date, coalesce(sum(c) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 0.8 * (SELECT count(*) FROM bars) AS v FROM (SELECT date, count(*) AS c FROM bars GROUP BY date)) f ON f.date = b.date")
def e32(spark, d):
    return ml.early_stop_flag(views.bars(spark, d)).select("ticker", "date", "is_validation")


oracle.define("fold_metrics", f"SELECT model, fold, {CM} FROM scored s JOIN date_folds f ON f.date = s.date WHERE role = 'validation' GROUP BY 1, 2")


def fold_metrics(spark, d):
    folds = ml.walk_forward(views.bars(spark, d)).where("role = 'validation'").select("ticker", "date", "fold")
    return ml.classification_metrics(scored(spark, d).join(folds, ["ticker", "date"]), "direction_5d", "prediction", ["model", "fold"])


AVG = "SELECT model, avg(accuracy) AS accuracy, avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1 FROM fold_metrics GROUP BY model"
oracle.define("fold_avg", AVG)


@query("d36_fold_average", f"SELECT model, {r('accuracy', 'precision', 'recall', 'f1')} FROM fold_avg")
def d36(spark, d):
    return rounded(ml.average_folds(fold_metrics(spark, d).drop("fold"), ["model"]))


@query("d37_regression_gate", """SELECT n.model, round(n.accuracy, 6) AS accuracy, round(coalesce(b.accuracy, 0.526), 6) AS baseline, n.accuracy >= coalesce(b.accuracy, 0.526) AS passed
    FROM fold_avg n LEFT JOIN (SELECT model, avg(CASE WHEN prediction = direction_5d THEN 1.0 ELSE 0.0 END) AS accuracy FROM scored WHERE model <> 'trend' GROUP BY model) b ON b.model = n.model""")
def d37(spark, d):
    new = ml.average_folds(fold_metrics(spark, d).drop("fold"), ["model"]).select("model", "accuracy")
    base = ml.classification_metrics(scored(spark, d).where("model <> 'trend'"), "direction_5d", "prediction", ["model"])
    return keep(ml.regression_gate(new, base), "model", "accuracy", "baseline", "passed")


@query("f14_best_model", "SELECT model, round(accuracy, 6) AS accuracy FROM fold_avg ORDER BY accuracy DESC, model LIMIT 1")
def f14(spark, d):
    return rounded(ml.best_model(ml.average_folds(fold_metrics(spark, d).drop("fold"), ["model"])))


# Trained models: default settings, all families, held-out rows ----------------------
FEATS = ["rsi_14", "macd_hist", "price_to_sma20", "price_to_sma50", "volume_ratio", "news_sentiment_score"]
FAMILIES = tuple(ml.DEFAULTS)
FOLDS = 5
TRIALS = 50
TRIAL_ROUNDS = 8  # trees of the last rung of the short search whose rungs SQL states (i04_search_rungs)
FOREST_TREES = 60  # of the default 200, in the registered queries: see the README
_DONE: dict[tuple, object] = {}


def settings(family):
    return {"numTrees": FOREST_TREES} if family == "random_forest" else None


def _once(spark, d, name, make):
    """Frames, fold tables and models that several queries of one application use are made once."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _DONE:
        _DONE[key] = make()
    return _DONE[key]


def _each(jobs):
    """Results of independent jobs run at the same time: the leaf-wise trees are many short passes, which leave room for the other families."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        return list(pool.map(lambda job: job(), jobs))


def frame(spark, d):
    """The columns the models use, written once."""
    return _once(spark, d, "frame", lambda: materialize(model_frame(spark, d).select("ticker", "date", ml.LABEL, ml.TARGET, *FEATS), "frame"))


def split(spark, d):
    """(rows before, rows of) the latest fifth by date."""
    flagged = _once(spark, d, "split", lambda: materialize(ml.early_stop_flag(frame(spark, d), out="held_out"), "split"))
    return flagged.where("NOT held_out").drop("held_out"), flagged.where("held_out").drop("held_out")


def classifier(spark, d, family):
    return _once(spark, d, f"classifier {family}", lambda: ml.train_classifier(split(spark, d)[0], FEATS, family, settings(family)))


def classifiers(spark, d):
    """Classifiers of all families by name, fitted at the same time."""
    split(spark, d)
    return dict(zip(FAMILIES, _each([lambda f=f: classifier(spark, d, f) for f in FAMILIES]), strict=True))


def fold_table(spark, d, family):
    """Validation rows of five folds, each scored by a model of its past."""
    def make():
        base = ml.walk_forward(frame(spark, d).select("ticker", "date", ml.LABEL, *FEATS), FOLDS)
        return materialize(ml.fold_scores(base, FEATS, family, FOLDS, settings(family)), "folds")

    return _once(spark, d, f"folds {family}", make)


def fold_tables(spark, d):
    """Fold tables of all families by name, made at the same time."""
    frame(spark, d)
    return dict(zip(FAMILIES, _each([lambda f=f: fold_table(spark, d, f) for f in FAMILIES]), strict=True))


def union(parts):
    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part)
    return out


oracle.define("model_days", """
  SELECT date, coalesce(sum(c) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 0.8 * (SELECT count(*) FROM model_frame) AS held_out
  FROM (SELECT date, count(*) AS c FROM model_frame GROUP BY date)""")
oracle.define("held_out_rows", "SELECT m.* FROM model_frame m JOIN model_days f ON f.date = m.date WHERE f.held_out")
oracle.define("model_folds", """
  SELECT date, fold, CASE WHEN rk < s THEN 'train' WHEN rk < s + size THEN 'validation' END AS role FROM (
    SELECT date, rk, unnest(range(5)) AS fold, n - (5 - unnest(range(5))) * (n // 6) AS s, n // 6 AS size FROM (
      SELECT date, row_number() OVER (ORDER BY date) - 1 AS rk, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM model_frame))) WHERE rk < s + size""")
MODELS = "(SELECT unnest(['" + "', '".join(FAMILIES) + "']) AS model)"


def counts():
    return [F.count("*").alias("n"), F.count_if(F.col(ml.LABEL) == 1).alias("positives")]


@query("i01_direction_classifier")
def i01(spark, d):
    """Held-out metrics of the three families."""
    held = split(spark, d)[1]
    return rounded(union(ml.classification_metrics(m.transform(ml._vectors(held, FEATS)), ml.LABEL, "prediction").withColumn("model", F.lit(f)) for f, m in classifiers(spark, d).items()))


@query("i01_held_out_confusion", f"""SELECT model, n, positives, n AS counted, positives AS found_or_missed, true AS beats_coin FROM {MODELS},
    (SELECT count(*) AS n, count(*) FILTER (direction_5d = 1) AS positives FROM held_out_rows)""")
def i01_confusion(spark, d):
    """The confusion counts of every family add up to the held-out rows, and it is better than chance there."""
    held = split(spark, d)[1]

    def one(f, model):
        y, p = F.col(ml.LABEL) == 1, F.col("prediction") == 1
        cells = [F.count_if(y & p).alias("tp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & p).alias("fp"), F.count_if(~y & ~p).alias("tn")]
        g = model.transform(ml._vectors(held, FEATS)).agg(*counts(), *cells)
        return g.select(F.lit(f).alias("model"), "n", "positives", (F.col("tp") + F.col("fn") + F.col("fp") + F.col("tn")).alias("counted"),
                        (F.col("tp") + F.col("fn")).alias("found_or_missed"), ((F.col("tp") + F.col("tn")) / F.col("n") > 0.5).alias("beats_coin"))

    return union(one(f, m) for f, m in classifiers(spark, d).items())


@query("i02_return_regressor")
def i02(spark, d):
    train, held = split(spark, d)
    jobs = [lambda f=f: _once(spark, d, f"regressor {f}", lambda: ml.train_regressor(train, FEATS, f, settings(f))) for f in FAMILIES]
    models = dict(zip(FAMILIES, _each(jobs), strict=True))
    return rounded(union(ml.regression_metrics(m.transform(ml._vectors(held, FEATS)), ml.TARGET, "prediction").withColumn("model", F.lit(f)) for f, m in models.items()))


def fold_metrics_of(spark, d, family):
    return ml.classification_metrics(fold_table(spark, d, family), ml.LABEL, "prediction", ["fold"]).withColumn("model", F.lit(family))


for _family in FAMILIES:
    register(f"i03_walk_forward_{_family}", lambda spark, d, f=_family: rounded(fold_metrics_of(spark, d, f)))


@query("i03_walk_forward_validation")
def i03(spark, d):
    fold_tables(spark, d)
    return rounded(union(fold_metrics_of(spark, d, f) for f in FAMILIES))


@query("i03_fold_rows", f"""SELECT model, CAST(fold AS INTEGER) AS fold, n, positives FROM {MODELS}, (SELECT fold, count(*) AS n, count(*) FILTER (direction_5d = 1) AS positives
    FROM model_frame m JOIN model_folds f ON f.date = m.date WHERE role = 'validation' GROUP BY fold)""")
def i03_rows(spark, d):
    """Every validation row is scored once per family, by a model that did not see it."""
    return union(t.groupBy("fold").agg(*counts()).withColumn("model", F.lit(f)) for f, t in fold_tables(spark, d).items()).select("model", "fold", "n", "positives")


def search(spark, d, most_rounds=None):
    """(best settings, trials); the last rung has all trees of the family's default unless ``most_rounds`` bounds them."""
    return _once(spark, d, f"search {most_rounds}", lambda: ml.tune(frame(spark, d), FEATS, "boosted_wide", TRIALS, FOLDS, most_rounds=most_rounds))


@query("i04_hyperparameter_search")
def i04(spark, d):
    return search(spark, d)[1]


@query("i04_search_rungs", "SELECT * FROM (VALUES (1, 'PRUNED', 37), (2, 'PRUNED', 9), (8, 'COMPLETE', 4)) t(rounds, state, trials)")
def i04_rungs(spark, d):
    """Fifty trials, a quarter of which goes on at each rung, here of at most ``TRIAL_ROUNDS`` trees as the SQL says."""
    return search(spark, d, TRIAL_ROUNDS)[1].groupBy("rounds", "state").agg(F.count("*").cast("int").alias("trials"))


@query("i05_select_features")
def i05(spark, d):
    f = select_frame(spark, d).join(labels.forward_labels(views.bars(spark, d)).select("ticker", "date", ml.LABEL), ["ticker", "date"])
    names = _once(spark, d, "selected", lambda: ml.select_features(cut_lineage(f), SEL, top_n=5))
    return spark.createDataFrame([(i, n) for i, n in enumerate(names, 1)], "rank int, feature string")


def importances(spark, d):
    return union(ml.importance_table(spark, m, FEATS).withColumn("model", F.lit(f)) for f, m in classifiers(spark, d).items())


@query("i06_feature_importances")
def i06(spark, d):
    return rounded(importances(spark, d))


@query("i06_importance_sums", f"SELECT model, 6 AS features, 1.0::DOUBLE AS total, true AS all_positive FROM {MODELS}")
def i06_sums(spark, d):
    total = F.round(F.sum("importance"), 6).alias("total")
    return importances(spark, d).groupBy("model").agg(F.count_distinct("feature").cast("int").alias("features"), total, F.min(F.col("importance") >= 0).alias("all_positive"))


@query("f13_top_features")
def f13(spark, d):
    return rounded(spark.createDataFrame(ml.top_importances(classifier(spark, d, "random_forest"), FEATS, 3), "feature string, importance double"))


def trained(spark, d):
    """(verdicts, folder) of the training job over all families."""
    def make():
        out = scratch_folder(spark, "models")
        folds = union(ml.average_folds(ml.classification_metrics(t, ml.LABEL, "prediction", ["fold"]).drop("fold"), []).withColumn("model", F.lit(f)) for f, t in fold_tables(spark, d).items())
        return ml.train_and_save(frame(spark, d), FEATS, out, FAMILIES, FOLDS, {f: settings(f) for f in FAMILIES}, validated=cut_lineage(folds)), out

    return _once(spark, d, "trained", make)


@query("i07_train_and_save")
def i07(spark, d):
    return rounded(trained(spark, d)[0])


def newest_rows(spark, d):
    """Inference features of every ticker's newest row."""
    last = ind.latest_indicators(views.bars(spark, d), ["date", "open", "high", "low", "close", "volume"]).withColumn("news_sentiment_score", F.lit(features.SENTIMENT_DEFAULTS["news_sentiment_score"]))
    return features.inference_features(last, FEATS).join(last.select("ticker", "date"), "ticker")


def model_predictions(spark, d):
    """Predictions of the leaf-wise models, fitted on all labelled rows, for the newest rows."""
    f = frame(spark, d)
    c, g = _each([lambda: _once(spark, d, "final classifier", lambda: ml.train_classifier(f, FEATS, "boosted_wide")),
                  lambda: _once(spark, d, "final regressor", lambda: ml.train_regressor(f, FEATS, "boosted_wide"))])
    return ml.predict(newest_rows(spark, d), FEATS, c, g, "boosted_wide")


@query("i08_batch_predictions")
def i08(spark, d):
    return rounded(model_predictions(spark, d))


@query("i08_newest_rows", "SELECT ticker, max(date) AS date, true AS consistent FROM bars GROUP BY ticker")
def i08_rows(spark, d):
    """One prediction per ticker, for its newest bar; class, confidence and probability agree."""
    p = model_predictions(spark, d)
    side = F.when(F.col("p_up") > 0.5, "bullish").otherwise("bearish")
    agree = (F.col("direction") == side) & (F.abs(F.col("confidence") - 100 * F.greatest("p_up", 1 - F.col("p_up"))) < 1e-9) & F.col("expected_return").isNotNull()
    return p.select("ticker", "date", agree.alias("consistent"))


@query("i09_calibrated_probabilities")
def i09(spark, d):
    """Out-of-fold probabilities of the forest, calibrated both ways."""
    both = fold_table(spark, d, "random_forest").select("ticker", "date", ml.LABEL, "p_up")
    iso = ml.Calibrator("isotonic").fit(both).transform(both, out="isotonic")
    return rounded(ml.Calibrator("platt").fit(both).transform(iso, out="platt").select("ticker", "date", "p_up", "isotonic", "platt"))


@query("i09_calibration_balance", """SELECT count(*) AS n, count(*) FILTER (direction_5d = 1) AS positives, count(*) FILTER (direction_5d = 1) AS expected
    FROM model_frame m JOIN model_folds f ON f.date = m.date WHERE role = 'validation'""")
def i09_balance(spark, d):
    """Isotonic regression keeps the total: its probabilities add up to the number of positives."""
    both = fold_table(spark, d, "random_forest").select("ticker", "date", ml.LABEL, "p_up")
    iso = ml.Calibrator("isotonic").fit(both)
    return iso.transform(both, out="isotonic").agg(*counts(), F.round(F.sum("isotonic")).cast("long").alias("expected"))


def stacked(spark, d):
    oof = None
    for f, table in fold_tables(spark, d).items():
        one = table.select("ticker", "date", ml.LABEL, F.col("p_up").alias(f))
        oof = one if oof is None else oof.join(one.drop(ml.LABEL), ["ticker", "date"])
    oof = cut_lineage(oof)
    meta = _once(spark, d, "meta", lambda: ml.fit_stacking(oof, FAMILIES))
    long = oof.select("ticker", "date", F.explode(F.array(*[F.struct(F.lit(x).alias("model"), F.col(x).alias("p")) for x in FAMILIES])).alias("m")).select("ticker", "date", "m.*")
    up = F.col("p") > 0.5
    preds = long.select("ticker", "date", "model", F.when(up, "bullish").otherwise("bearish").alias("direction"),
                        (F.greatest("p", 1 - F.col("p")) * 100).alias("confidence"), ((F.col("p") - 0.5) * 10).alias("expected_return"))
    return ensemble.stacked(preds, ml.stacking_probability(meta, oof, FAMILIES))


@query("i13_stacking")
def i13(spark, d):
    return rounded(stacked(spark, d))


@query("i13_stacked_rows", "SELECT m.ticker, m.date FROM model_frame m JOIN model_folds f ON f.date = m.date WHERE role = 'validation'")
def i13_rows(spark, d):
    """One stacked prediction for each row that all families scored out of fold."""
    return stacked(spark, d).select("ticker", "date")
