"""Leaf-wise trees, successive halving and exact isotonic regression against plain versions."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from equityspark.operators import isotonic, leafwise, ml

F3 = ["a", "b", "c"]


def make(n=900, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)).round(2)
    raw = 2 * (x[:, 0] > 0.3) - 1.5 * ((x[:, 1] < -0.2) & (x[:, 0] <= 0.3)) + 0.3 * x[:, 2]
    y = (raw + rng.logistic(size=n) * 0.5 > 0).astype(int)
    day = [dt.date(2024, 1, 1) + dt.timedelta(days=int(i)) for i in np.arange(n) // 9]
    return pd.DataFrame({"ticker": [f"T{i % 9}" for i in range(n)], "date": day, "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], ml.LABEL: y, ml.TARGET: raw})


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(make()).repartition(5).cache()


def plain_tree(bins, g, h, spec, n_bins):
    """One tree grown by always splitting the leaf of greatest gain; returns the leaf value of each row and the number of leaves."""
    def best(rows):
        out = (-np.inf, None, None)
        G, H = g[rows].sum(), h[rows].sum()
        for j in range(bins.shape[1]):
            for b in range(n_bins - 1):
                left = rows[bins[rows, j] <= b]
                right = rows[bins[rows, j] > b]
                if len(left) < spec.min_rows or len(right) < spec.min_rows:
                    continue
                gain = g[left].sum() ** 2 / (h[left].sum() + spec.l2) + g[right].sum() ** 2 / (h[right].sum() + spec.l2) - G**2 / (H + spec.l2)
                if gain > out[0] + 1e-9:
                    out = (gain, j, b)
        return out

    leaves = [(best(rows := np.arange(len(g))), 0, rows)]
    while len(leaves) < spec.max_leaves:
        able = [i for i, (s, depth, _) in enumerate(leaves) if s[1] is not None and s[0] > 1e-9 and depth < spec.max_depth]
        if not able:
            break
        i = max(able, key=lambda k: leaves[k][0][0])
        (_, j, b), depth, rows = leaves.pop(i)
        for part in (rows[bins[rows, j] <= b], rows[bins[rows, j] > b]):
            leaves.append((best(part), depth + 1, part))
    value = np.zeros(len(g))
    for _, _, rows in leaves:
        value[rows] = -spec.learning_rate * g[rows].sum() / (h[rows].sum() + spec.l2)
    return value, len(leaves)


@pytest.mark.parametrize("objective, target", [("logistic", ml.LABEL), ("squared", ml.TARGET)])
def test_trees_equal_plain_leafwise_growth(spark, frame, objective, target):
    spec = leafwise.Spec(objective=objective, n_trees=3, max_leaves=7, max_depth=4, min_rows=15, l2=0.5, patience=None)
    pdf = frame.toPandas()
    edges = leafwise.bin_edges(frame, F3, 16)
    bins = leafwise.binned(pdf[F3].to_numpy(), edges)
    packed = leafwise.blocks(frame.withColumn("r", F.lit(1)), F3, target, ["r"], edges, ["ticker", "date"], 1)
    model = leafwise.train(packed, [spec], F3, edges)[0]
    y = pdf[target].to_numpy(float)
    raw = np.full(len(y), np.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9)) if objective == "logistic" else y.mean())
    for tree in model.trees:
        p = 1 / (1 + np.exp(-raw))
        g, h = (p - y, p * (1 - p)) if objective == "logistic" else (raw - y, np.ones(len(y)))
        value, leaves = plain_tree(bins, g, h, spec, 16)
        assert leaves <= 7 and np.allclose(leafwise.leaf_values(tree, bins), value, atol=1e-9)
        raw += value
    assert np.allclose(model.raw(bins), raw) and model.best == 3
    assert sum(model.importances().values()) == pytest.approx(1.0)


def test_models_in_step_equal_models_alone_and_stop_early(spark, frame, monkeypatch):
    monkeypatch.setattr(leafwise, "REFRESH", 3)
    df = frame.withColumns({"r0": F.when(F.col("date") < "2024-03-10", 1).otherwise(2), "r1": F.when(F.col("date") < "2024-02-20", 1).otherwise(2)})
    edges = leafwise.bin_edges(df, F3)
    specs = [leafwise.Spec(role=0, n_trees=9, patience=4), leafwise.Spec(role=1, n_trees=4, max_leaves=5, patience=None), leafwise.Spec(role=1, n_trees=30, max_depth=3, patience=2, learning_rate=0.9)]
    packed = leafwise.blocks(df, F3, ml.LABEL, ["r0", "r1"], edges, ["ticker", "date"], 3)
    step = leafwise.train(packed, specs, F3, edges, n_roles=2)
    again = leafwise.train(leafwise.blocks(df.repartition(2), F3, ml.LABEL, ["r0", "r1"], edges, ["ticker", "date"], 3), specs, F3, edges, n_roles=2)
    for i, spec in enumerate(specs):
        own = leafwise.blocks(df, F3, ml.LABEL, ["r0", "r1"], edges, ["ticker", "date"], 1)
        alone = leafwise.train(own, [spec], F3, edges, n_roles=2)[0]
        assert step[i].best == alone.best == again[i].best and len(step[i].trees) == len(alone.trees)
        for a, b, c in zip(step[i].trees, alone.trees, again[i].trees, strict=True):
            assert all(np.allclose(a[k], b[k]) and np.allclose(a[k], c[k]) for k in a)
            assert (a["feature"] >= 0).sum() < 31
    assert step[2].stopped and len(step[2].trees) - step[2].best <= 2 and step[2].best < len(step[2].losses)
    assert step[1].best == 4 and min(step[0].losses) == step[0].losses[step[0].best] < step[0].losses[0]


def test_third_family_behind_the_common_interface(spark, frame, tmp_path):
    early, late = frame.where("date < '2024-03-15'"), frame.where("date >= '2024-03-15'")
    c = ml.train_classifier(early, F3, "boosted_wide", {"n_trees": 12, "learning_rate": 0.3})
    m = ml.classification_metrics(c.transform(ml._vectors(late, F3)), ml.LABEL, "prediction").first()
    assert m["accuracy"] > 0.75
    assert ml.top_importances(c, F3, 1)[0][0] == "a"
    g = ml.train_regressor(early, F3, "boosted_wide", {"n_trees": 15, "learning_rate": 0.4})
    assert ml.regression_metrics(g.transform(ml._vectors(late, F3)), ml.TARGET, "prediction").first()["r2"] > 0.9
    ml.save_model(spark, c, str(tmp_path / "m"))
    back = ml.LeafwiseModel.load(spark, str(tmp_path / "m"))
    p = ml.predict(late, F3, c, g, "boosted_wide").collect()
    q = ml.predict(late, F3, back, g, "boosted_wide").collect()
    assert sorted(map(str, p)) == sorted(map(str, q)) and len(p) == late.count()
    odd = late.limit(3).withColumn("a", F.lit(None).cast("double")).withColumn("b", F.lit(float("nan")))
    assert c.transform(ml._vectors(odd, F3)).count() == 3
    one = frame.where(f"{ml.LABEL} = 1").limit(30)
    assert {r["prediction"] for r in ml.train_classifier(one, F3, "boosted_wide", {"n_trees": 2}).transform(ml._vectors(one, F3)).collect()} == {1.0}


def test_successive_halving(frame):
    run = lambda at_once: ml.tune(frame, F3, "boosted_wide", n_trials=6, n_splits=2, rungs=(0.25, 0.5, 1.0), eta=3, at_once=at_once, most_rounds=4)
    best, trials = run(12)
    t = {r["trial_number"]: r for r in trials.collect()}
    assert len(t) == 6 and sorted(r["rounds"] for r in t.values()) == [1] * 4 + [2] + [4]
    assert [r["state"] for r in t.values()].count("PRUNED") == 5 and all(0 <= r["value"] <= 1 for r in t.values())
    assert set(best) == set(ml.SEARCH["boosted_wide"])
    again = run(4)
    assert again[0] == best and sorted(map(str, again[1].collect())) == sorted(map(str, t.values()))
    assert ml.TUNER_FALLBACK["random_forest"]["maxDepth"] == 10


def test_rungs_add_to_the_trees_of_the_rung_before(frame):
    """A trial carried from 2 over 5 to 8 trees has the trees and the accuracy of one grown to 8 at once."""
    packed, edges = ml._search_blocks(frame, F3, 2)
    trials = {0: {"max_leaves": 9, "min_rows": 12, "l2": 1.0}, 1: {"max_leaves": 20, "min_rows": 30, "l2": 0.0}}
    rung = lambda n, grown: ml._rung_leafwise(packed, edges, F3, 2, {t: {**p, "n_trees": n} for t, p in trials.items()}, 4, grown)
    grown, once = {}, {}
    for n in (2, 5, 8):
        got = rung(n, grown)
    assert got == rung(8, once) and [len(m.trees) for t in trials for m in grown[t]] == [8] * 4
    for t in trials:
        for a, b in zip(grown[t], once[t], strict=True):
            assert all(np.allclose(x[k], y[k]) for x, y in zip(a.trees, b.trees, strict=True) for k in x) and a.best == b.best


def test_registered_search_grows_all_trees_of_its_trials(spark, frame, monkeypatch):
    from equityspark.catalog import q_models

    monkeypatch.setattr(q_models, "_DONE", {})
    monkeypatch.setattr(q_models, "frame", lambda spark, d: frame)
    monkeypatch.setattr(q_models, "FEATS", F3)
    monkeypatch.setattr(q_models, "TRIALS", 5)
    monkeypatch.setattr(q_models, "FOLDS", 2)
    monkeypatch.setitem(ml.DEFAULTS, "boosted_wide", {**ml.DEFAULTS["boosted_wide"], "n_trees": 20})
    rows = q_models.i04(spark, "none").collect()
    assert sorted((r["rounds"], r["state"]) for r in rows) == [(1, "PRUNED")] * 3 + [(5, "PRUNED"), (20, "COMPLETE")]


def test_halving_of_an_mllib_family(frame):
    _, trials = ml.tune(frame, F3, "random_forest", n_trials=2, n_splits=2, bounds={"numTrees": (2, 3), "maxDepth": (2, 2)}, rungs=(0.5, 1.0), eta=2)
    assert sorted(r["state"] for r in trials.collect()) == ["COMPLETE", "PRUNED"]


# ---- isotonic ------------------------------------------------------------
def plain_pav(x, y):
    order = np.argsort(x, kind="stable")
    xs, at = np.unique(x[order], return_index=True)
    total, n = np.add.reduceat(y[order], at), np.diff([*at, len(x)])
    out = []
    for v, t, w in zip(xs, total, n, strict=True):
        out.append([v, v, t, w])
        while len(out) > 1 and out[-2][2] / out[-2][3] >= out[-1][2] / out[-1][3]:
            last = out.pop()
            out[-1] = [out[-1][0], last[1], out[-1][2] + last[2], out[-1][3] + last[3]]
    return [(a, b, t / w, w) for a, b, t, w in out]


@pytest.mark.parametrize("range_rows", [10, 37, 10**6])
@pytest.mark.parametrize("shape", ["rising", "falling", "noisy", "ties"])
def test_isotonic_equals_plain_pooling(spark, range_rows, shape):
    rng = np.random.default_rng(7)
    x = rng.random(400)
    y = {"rising": x, "falling": 1 - x, "noisy": (rng.random(400) < x**2).astype(float), "ties": rng.integers(0, 2, 400).astype(float)}[shape]
    if shape == "ties":
        x = np.round(x, 1)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y})).repartition(3)
    df = df.unionByName(spark.createDataFrame([(None, 1.0), (float("nan"), 0.0), (0.5, None)], "x double, y double"))
    blocks = isotonic.fit(df, "x", "y", range_rows)
    got = sorted((r["lo"], r["hi"], r["value"], r["weight"]) for r in blocks.collect())
    want = plain_pav(x, y)
    assert len(got) == len(want) and np.allclose(got, want)
    knots = sorted({(a, v) for a, _, v, _ in want} | {(b, v) for _, b, v, _ in want})
    ask = np.concatenate([x[:50], [-1.0, 2.0, 0.123]])
    out = {r["x"]: r["cal"] for r in isotonic.predict(spark.createDataFrame(pd.DataFrame({"x": ask})), "x", blocks, "cal", range_rows).collect()}
    assert np.allclose([out[v] for v in ask], np.interp(ask, [k[0] for k in knots], [k[1] for k in knots]))
    assert isotonic.predict(df, "x", blocks, "cal", range_rows).where("cal IS NULL").count() == 2


def test_no_frame_of_the_isotonic_values_shrinks(spark):
    """A range frame up to the last row is read again for every row: quadratic in the distinct x of a range."""
    df = spark.createDataFrame([(i / 50, float(i % 3 == 0)) for i in range(50)], "x double, y double")
    plan = isotonic.predict(df, "x", isotonic.fit(df, "x", "y"), "cal")._jdf.queryExecution().analyzed().toString()
    assert "specifiedwindowframe(RangeFrame, unboundedpreceding$(), currentrow$())" in plan
    assert "specifiedwindowframe(RangeFrame, currentrow$()" not in plan


# ---- passes of the leaf-wise trees ---------------------------------------
@pytest.mark.parametrize("d, depth", [(1, 4), (5, 6), (6, 6), (4, 8)])
def test_tables_of_a_tree_equal_the_walk(d, depth):
    rng = np.random.default_rng(depth * 10 + d)
    tree = {k: [] for k in ("feature", "bin", "left", "right")}

    def grow(level):
        node = len(tree["feature"])
        for k in tree:
            tree[k].append(-1)
        if level < depth and (level < 2 or rng.random() < 0.95):
            tree["feature"][node], tree["bin"][node] = int(rng.integers(d)), int(rng.integers(16))
            tree["left"][node] = grow(level + 1)
            tree["right"][node] = grow(level + 1)
        return node

    grow(0)
    arrays = {k: np.array(v) for k, v in tree.items()} | {"depth": np.array(depth), "value": rng.normal(size=len(tree["bin"]))}
    bins = rng.integers(0, 16, (3000, d)).astype(np.uint8)
    table = leafwise.Lookup(arrays, d, 16)
    assert (table.allowed is None) == (depth == 8)
    codes = leafwise.pair_codes(bins, 16)
    assert (table.nodes(codes, bins) == leafwise.nodes_of(arrays, bins)).all()
    assert (table.values(codes, bins) == leafwise.leaf_values(arrays, bins)).all()


def test_blocks_hold_no_scores_before_the_first_refresh(frame):
    df = frame.withColumn("r", F.lit(1))
    packed = leafwise.blocks(df, F3, ml.LABEL, ["r"], leafwise.bin_edges(df, F3), ["ticker", "date"], 40)
    assert packed.agg(F.sum(F.length("scores"))).first()[0] == 0 and packed.agg(F.sum("n")).first()[0] == 900


def test_tasks_follow_the_rows():
    assert [leafwise._tasks(n, 8) for n in (0, 49_000, 120_000, 7_000_000, 8_000_001, 40_000_000)] == [1, 1, 3, 8, 16, 40]


def test_training_writes_no_blocks_and_measures_the_smaller_child_only(spark, frame, monkeypatch):
    import os

    from equityspark.session import checkpoint_dir

    df = frame.withColumn("r", F.lit(1))
    edges = leafwise.bin_edges(df, F3)
    packed = leafwise.blocks(df, F3, ml.LABEL, ["r"], edges, ["ticker", "date"])
    seen, real, folder = [], leafwise._measure, checkpoint_dir(spark).removeprefix("file:")
    monkeypatch.setattr(leafwise, "_measure", lambda of, shapes, level, d, bins: seen.append((level, shapes[0])) or real(of, shapes, level, d, bins))
    there = sorted(os.listdir(folder))
    model = leafwise.train(packed, [leafwise.Spec(n_trees=leafwise.REFRESH + 2, patience=None)], F3, edges)[0]
    assert sorted(os.listdir(folder)) == there and len(model.trees) == leafwise.REFRESH + 2
    assert all(len(shape[1]) <= 2 ** (level - 1) for level, shape in seen if level) and max(level for level, _ in seen) == 5
    left = leafwise._Growing(np.array([0.0, 0.0, 9.0]))
    left.sums += [np.array([1.0, 1.0, 2.0]), np.array([-1.0, 1.0, 7.0])]
    left.kids[0], left.open = (1, 2), [1, 2]
    hist = np.random.default_rng(0).integers(0, 5, (2, 3, 4, 3)).astype(float)
    left.complete({0: hist.sum(0)}, hist[:1])
    assert left.measured() == [1] and (left.hist[1] == hist[0]).all()
    assert (left.hist[2] == np.where(hist[1][..., 2:] > 0, hist[1], 0)).all()


def test_fold_models_in_one_pass_equal_models_of_each_fold(frame):
    twice = frame.unionByName(frame.where("ticker = 'T3'"))  # equal keys stay rows of their own
    base = ml.walk_forward(twice.select("ticker", "date", ml.LABEL, *F3), 3)
    parts = ml._fold_parts(base, 3)
    assert parts.count() == base.where("fold = 2 AND role = 'train'").count()
    settings = {"n_trees": 6, "max_leaves": 5}
    for fold, model in enumerate(ml.fold_models(base, F3, "boosted_wide", 3, settings)):
        train = base.where(f"fold = {fold} AND role = 'train'").drop("fold", "role")
        late = ml._parts(train)
        assert parts.where(f"_r{fold} = 2").count() == late.where("_r0 = 2").count() and parts.where(f"_r{fold} > 0").count() == train.count()
        assert model.model.trees and model.model.base == pytest.approx(ml.train_classifier(train, F3, "boosted_wide", settings).model.base)


def test_a_forest_task_gets_a_bounded_number_of_rows():
    assert [ml._parts_for(n, 12) for n in (0, 49_000, 300_000, 5_000_000, 24_000_000, 96_000_000)] == [1, 1, 6, 12, 12, 48]


@pytest.mark.parametrize("train", [ml.train_classifier, ml.train_regressor])
def test_forests_that_keep_nodes_grow_the_same_trees(frame, monkeypatch, train):
    settings = {"numTrees": 6, "maxDepth": 5}
    kept = train(frame, F3, "random_forest", settings)
    monkeypatch.setattr(ml, "NODES_KEPT", 899 * 6)
    walked = train(frame, F3, "random_forest", settings)
    assert kept.getOrDefault("cacheNodeIds") and not walked.getOrDefault("cacheNodeIds")
    text = lambda m: m.toDebugString.split("\n", 1)[1]
    assert text(kept) == text(walked)


def test_forests_grow_at_once_while_their_nodes_fit():
    at_once = lambda family, rows: ml._fits_at_once(family, rows, {"numTrees": 60})
    assert [at_once("random_forest", n) for n in (0, 2_000_000, 7_000_000, 50_000_000)] == [4, 4, 2, 1]
    assert at_once("boosted", 50_000_000) == 4
