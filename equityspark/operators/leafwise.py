"""Boosted trees grown leaf by leaf over histograms that Spark adds up (ids I1-I4, third family).

Rows are binned once and packed into blocks of small matrices, which the executors keep. A pass
sends every block the trees grown so far and gets back, per model and open node, the sums of
gradients, curvatures and rows in each bin of each feature; a few numbers per node reach the
driver, which picks the splits. Of two children only the smaller is measured: the sums of the
other are its parent's less these. A tree is grown as if always the leaf of best gain were split next, up to
``max_leaves`` leaves and ``max_depth`` levels: the gain of a split does not depend on
other leaves, so the nodes of one level are measured in one pass and the order is applied
afterwards. Any number of models (folds, trials) grow in step over the same blocks and
share the passes. Nothing is random: the same rows give the same trees.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equityspark.functions.quantiles import sketches
from equityspark.session import materialize

BINS = 64
BLOCK_ROWS = 32_768
TASK_ROWS = 1_000_000  # rows that one task packs
LEAST_ROWS = 50_000  # rows worth a task of their own: every task of a pass sends sums for all nodes, however few its rows are
REFRESH = 4  # trees after which the scores so far are put into the blocks
TRAIN, VALIDATION = 1, 2


@dataclass
class Spec:
    """Settings of one model. ``role`` is the position of its role column in the blocks."""

    role: int = 0
    objective: str = "logistic"
    n_trees: int = 200
    max_leaves: int = 31
    max_depth: int = 6
    learning_rate: float = 0.1
    min_rows: int = 20
    l2: float = 0.0
    patience: int | None = 20


@dataclass
class Model:
    """Trees over bins; a tree is arrays of feature, bin (rows with at most this bin go left), children and leaf values."""

    spec: Spec
    features: list[str]
    edges: np.ndarray
    base: float = 0.0
    trees: list[dict[str, np.ndarray]] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)
    gains: np.ndarray | None = None
    best: int = 0
    stopped: bool = False

    def raw(self, bins: np.ndarray, n_trees: int | None = None) -> np.ndarray:
        n_bins = self.edges.shape[1] + 1
        codes, out = pair_codes(bins, n_bins), np.full(len(bins), self.base)
        for tree in self.trees[: self.best if n_trees is None else n_trees]:
            out += Lookup(tree, bins.shape[1], n_bins).values(codes, bins)
        return out

    def importances(self) -> dict[str, float]:
        """Share of the gain of all splits, per feature."""
        total = self.gains.sum() if self.gains is not None else 0.0
        return dict(zip(self.features, (self.gains / total if total > 0 else np.zeros(len(self.features))).tolist(), strict=True))


def nodes_of(tree: dict[str, np.ndarray], bins: np.ndarray) -> np.ndarray:
    at = np.zeros(len(bins), np.int64)
    for _ in range(int(tree["depth"])):
        f = tree["feature"][at]
        inner = f >= 0
        left = bins[np.arange(len(bins)), np.maximum(f, 0)] <= tree["bin"][at]
        at = np.where(inner, np.where(left, tree["left"][at], tree["right"][at]), at)
    return at


def leaf_values(tree: dict[str, np.ndarray], bins: np.ndarray) -> np.ndarray:
    return tree["value"][nodes_of(tree, bins)]


class Lookup:
    """A tree as tables. A bit stands for a leaf, a table says for every bin of two features which leaves it still
    allows, and what all tables allow is the leaf of the row: three lookups for six features instead of one step
    through all rows per level. Trees of more than 64 leaves are walked."""

    def __init__(self, tree: dict[str, np.ndarray], d: int, bins: int):
        self.tree, self.shape = tree, (d, bins)
        feature, left, right = tree["feature"], tree["left"], tree["right"]
        leaves: list[int] = []
        spans: dict[int, tuple[int, int]] = {}

        def visit(node: int) -> None:
            first = len(leaves)
            if feature[node] < 0:
                leaves.append(node)
            else:
                visit(int(left[node]))
                visit(int(right[node]))
            spans[node] = (first, len(leaves))

        visit(0)
        self.leaves, self.allowed, self.tables = np.array(leaves), None, None
        if len(leaves) > 64:
            return
        bits = lambda node: ((1 << spans[node][1]) - 1) ^ ((1 << spans[node][0]) - 1)
        whole = (1 << len(leaves)) - 1
        allowed = np.full((d, bins), whole, np.uint64)
        for node in spans:
            if feature[node] >= 0:
                f, cut = int(feature[node]), int(tree["bin"][node])
                allowed[f, : cut + 1] &= np.uint64(whole ^ bits(int(right[node])))
                allowed[f, cut + 1:] &= np.uint64(whole ^ bits(int(left[node])))
        self.allowed, self.whole = allowed, np.uint64(whole)

    def _pairs(self) -> dict[int, np.ndarray]:
        """The tables by number of the pair, made where they are used: they are larger than the tree."""
        out, d = {}, self.shape[0]
        for j in range(0, d, 2):
            if (self.allowed[j: j + 2] != self.whole).any():
                out[j // 2] = (self.allowed[j][:, None] & self.allowed[j + 1][None, :]).ravel() if j + 1 < d else self.allowed[j]
        return out

    def nodes(self, codes: np.ndarray, bins: np.ndarray | None) -> np.ndarray:
        """Node of every row's leaf; ``codes`` are the rows' ``pair_codes``, ``bins`` are needed for trees that are walked."""
        if self.allowed is None:
            return nodes_of(self.tree, bins)
        if self.tables is None:
            self.tables = self._pairs()
        mask = None
        for j, table in self.tables.items():
            mask = table[codes[j]] if mask is None else mask & table[codes[j]]
        return np.full(codes.shape[1], self.leaves[0]) if mask is None else self.leaves[np.bitwise_count(mask - np.uint64(1))]

    def values(self, codes: np.ndarray, bins: np.ndarray | None) -> np.ndarray:
        return self.tree["value"][self.nodes(codes, bins)]


def pair_codes(bins: np.ndarray, n_bins: int) -> np.ndarray:
    """Bins of features 0 and 1, 2 and 3, ... as one number per row."""
    wide = bins.T
    out = np.empty(((len(wide) + 1) // 2, len(bins)), np.int64)
    for j in range(0, len(wide), 2):
        out[j // 2] = wide[j]
        if j + 1 < len(wide):
            out[j // 2] *= n_bins
            out[j // 2] += wide[j + 1]
    return out


# Blocks ---------------------------------------------------------------------------------
def bin_edges(df: DataFrame, features: Sequence[str], bins: int = BINS) -> np.ndarray:
    """Upper edges of the bins of each feature, from sketched quantiles (one row per feature reaches the driver)."""
    cols = [present(f).alias(f) for f in features]
    long = df.select(*cols).unpivot([], list(features), "key", "value")
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    found = {r["key"]: r["q"] for r in sketches(long, 4096).select("key", F.kll_sketch_get_quantile_double("sketch", shares).alias("q")).collect()}
    out = np.full((len(features), bins - 1), np.inf)
    for i, f in enumerate(features):
        q = np.unique(found.get(f, []))
        out[i, : len(q)] = q
    return out


def present(feature: str) -> Column:
    """A missing feature (null or NaN) is 0, as in the vectors of the other families."""
    return F.coalesce(F.nanvl(F.col(feature).cast("double"), F.lit(0.0)), F.lit(0.0))


def binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Bin of every value."""
    return np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(x.shape[1])], 1).astype(np.uint8)


def _tasks(rows: int, cores: int) -> int:
    """One task per core, fewer for few rows; for many rows the next multiple of the cores that gives a task ``TASK_ROWS`` at most."""
    if rows <= cores * TASK_ROWS:
        return max(1, min(cores, -(-rows // LEAST_ROWS)))
    return -(-rows // (cores * TASK_ROWS)) * cores


PACKED = "n int, bins binary, y binary, roles binary, scores binary"


def blocks(df: DataFrame, features: Sequence[str], target: str, roles: Sequence[str], edges: np.ndarray, keys: Sequence[str], n_models: int = 1) -> DataFrame:
    """Rows dealt by key and packed; ``roles`` are columns with 1 (train), 2 (validation) or 0 for each row. Scores stay
    empty until the first trees are folded in, so the blocks do for any number of models, whatever ``n_models`` says."""
    spark = df.sparkSession
    parts = _tasks(df.count(), int(spark.sparkContext.defaultParallelism))
    rows = df.where(F.col(target).isNotNull()).select(
        *keys, F.array(*[present(f) for f in features]).alias("x"), F.col(target).cast("double").alias("y"),
        F.array(*[F.col(r).cast("int") for r in roles]).alias("r"))
    rows = rows.repartition(parts, *keys).sortWithinPartitions(*keys).select("x", "y", "r")
    d, k = len(features), len(roles)

    def pack(batches):
        held: list[tuple] = []

        def flush():
            x, y, r = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            n = len(y)
            cells = [binned(x, edges).tobytes(), y.tobytes(), r.tobytes(), b""]
            return pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), *[pa.array([c], pa.binary()) for c in cells]], names=["n", "bins", "y", "roles", "scores"])

        for b in batches:
            x = np.asarray(b.column("x").flatten(), np.float64).reshape(-1, d)
            r = np.asarray(b.column("r").flatten()).astype(np.uint8).reshape(-1, k)
            held.append((x, np.asarray(b.column("y"), np.float64), r))
            if sum(len(h[1]) for h in held) >= BLOCK_ROWS:
                yield flush()
        if held and sum(len(h[1]) for h in held):
            yield flush()

    return materialize(rows.mapInArrow(pack, PACKED), "blocks")


def _records(packed: DataFrame) -> RDD:
    """The blocks as (rows, bins by feature, target, roles by column, scores by model)."""
    def record(row):
        n = row["n"]
        by_column = [np.ascontiguousarray(np.frombuffer(row[c], np.uint8).reshape(n, -1).T).tobytes() for c in ("bins", "roles")]
        return n, by_column[0], bytes(row["y"]), by_column[1], bytes(row["scores"])

    return packed.rdd.map(record)


def _open(record: tuple) -> tuple[np.ndarray, ...]:
    """Bins (one array per feature), target, roles (one array per role) and scores (one array per model, none before the first refresh)."""
    n, bins, y, roles, scores = record
    return (np.frombuffer(bins, np.uint8).reshape(-1, n), np.frombuffer(y, np.float64),
            np.frombuffer(roles, np.uint8).reshape(-1, n), np.frombuffer(scores, np.float64).reshape(-1, n))


def _slopes(objective: str, raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if objective == "logistic":
        p = 1 / (1 + np.exp(-np.clip(raw, -500, 500)))
        return p - y, p * (1 - p)
    return raw - y, np.ones(len(y))


def _loss(objective: str, raw: np.ndarray, y: np.ndarray) -> float:
    return float((np.logaddexp(0, raw) - y * raw).sum() if objective == "logistic" else ((raw - y) ** 2).sum())


def _summed(blocks_: RDD, work) -> dict[int, np.ndarray]:
    """Arrays by model number added up over all blocks, in two steps when there are many tasks."""
    def task(records):
        total: dict[int, np.ndarray] = {}
        for record in records:
            for m, a in work(record):
                total[m] = total[m] + a if m in total else a
        return iter(total.items())

    tasks = blocks_.getNumPartitions()
    if tasks > 64:
        some = int(tasks**0.5)
        by = blocks_.mapPartitionsWithIndex(lambda p, records: (((m, p % some), a) for m, a in task(records)))
        parts = by.reduceByKey(np.add, some).map(lambda x: (x[0][0], x[1]))
    else:
        parts = blocks_.mapPartitions(task)
    out: dict[int, np.ndarray] = {}
    for m, a in parts.collect():
        out[m] = out[m] + a if m in out else a
    return out


# Growing --------------------------------------------------------------------------------
def _best_splits(hist: np.ndarray, spec: Spec) -> list[tuple[float, int, int, np.ndarray]]:
    """For each node (d, bins, 3 sums): gain, feature, bin and the left sums of its best split."""
    left = np.cumsum(hist, axis=2)[:, :, :-1]
    whole = hist[:, :1].sum(axis=2, keepdims=True)
    right = whole - left
    score = lambda s: s[..., 0] ** 2 / (s[..., 1] + spec.l2 + 1e-12)
    gain = score(left) + score(right) - score(whole)
    gain = np.where((left[..., 2] >= spec.min_rows) & (right[..., 2] >= spec.min_rows), gain, -np.inf)
    flat = gain.reshape(len(hist), -1)
    at = flat.argmax(1)
    return [(float(flat[i, a]), int(a // left.shape[2]), int(a % left.shape[2]), left[i].reshape(-1, 3)[a]) for i, a in enumerate(at)]


class _Growing:
    """One tree whose levels are measured one after the other."""

    def __init__(self, sums: np.ndarray):
        self.sums, self.split, self.kids, self.depth = [sums], {}, {}, [0]
        self.open = [0]
        self.hist: dict[int, np.ndarray] = {}  # of the open nodes

    def measured(self) -> list[int]:
        """The nodes to measure: the child of fewer rows of every split that made the open nodes (first come, first if equal)."""
        return [a if self.sums[a][2] <= self.sums[b][2] else b for a, b in zip(self.open[::2], self.open[1::2], strict=True)]

    def complete(self, parents: dict[int, np.ndarray], found: np.ndarray) -> None:
        """Histograms of all open nodes from the ``found`` ones of the measured nodes and those of their parents."""
        small = dict(zip(self.measured(), found, strict=True))
        parent_of = {c: p for p, kids in self.kids.items() for c in kids}
        for a, b in zip(self.open[::2], self.open[1::2], strict=True):
            one, other = (a, b) if a in small else (b, a)
            rest = parents[parent_of[a]] - small[one]
            rest[rest[..., 2] < 0.5] = 0.0  # a bin without rows is exactly empty, so equal cuts stay equal
            np.maximum(rest[..., 1], 0.0, out=rest[..., 1])
            self.hist[one], self.hist[other] = small[one], rest

    def arrays(self, keep: set[int] | None = None, rate: float = 1.0, l2: float = 0.0) -> dict[str, np.ndarray]:
        """The tree with the splits of ``keep`` (all: None)."""
        n = len(self.sums)
        used = {i for i in self.split if keep is None or i in keep}
        side = lambda j: np.array([self.kids[i][j] if i in used else -1 for i in range(n)], np.int64)
        return {
            "feature": np.array([self.split[i][1] if i in used else -1 for i in range(n)], np.int64), "bin": np.array([self.split[i][2] if i in used else 0 for i in range(n)], np.int64),
            "left": side(0), "right": side(1), "depth": np.array(max([self.depth[self.kids[i][0]] for i in used], default=0)),
            "value": np.array([-rate * s[0] / (s[1] + l2 + 1e-12) for s in self.sums])}

    def chosen(self, max_leaves: int) -> list[int]:
        """Nodes split when always the leaf of greatest gain is next (ties: the older node)."""
        heap, out = ([(-self.split[0][0], 0)] if 0 in self.split else []), []
        while heap and len(out) + 1 < max_leaves:
            _, i = heapq.heappop(heap)
            out.append(i)
            for c in self.kids[i]:
                if c in self.split:
                    heapq.heappush(heap, (-self.split[c][0], c))
        return out


def train(packed: DataFrame, specs: list[Spec], features: Sequence[str], edges: np.ndarray, models: list[Model] | None = None, n_roles: int = 1) -> list[Model]:
    """Grow all models in step, each until its number of trees or until its validation loss has not improved for ``patience`` trees.

    ``models`` continues earlier ones (their specs then say how many trees more in all). Model ``i`` uses score column ``i`` of the blocks.
    """
    blocks_ = _records(packed).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _train(blocks_, specs, list(features), edges, models)
    finally:
        blocks_.unpersist()


def _train(blocks_: RDD, specs: list[Spec], features: list[str], edges: np.ndarray, models: list[Model] | None) -> list[Model]:
    d, bins = len(features), edges.shape[1] + 1

    def start(record):
        _, y, roles, _ = _open(record)
        for i, s in enumerate(specs):
            own = y[roles[s.role] == TRAIN]
            yield i, np.array([own.sum(), len(own)])

    if models is None:
        first = _summed(blocks_, start)
        models = []
        for i, s in enumerate(specs):
            total, n = first.get(i, np.zeros(2))
            mean = total / n if n else 0.0
            base = float(np.log((mean + 1e-9) / (1 - mean + 1e-9))) if s.objective == "logistic" else float(mean)
            models.append(Model(s, features, edges, base, gains=np.zeros(d), stopped=not n))
    kept = [len(m.trees) for m in models]  # trees that are in the blocks' scores already
    made: list[RDD] = []  # blocks with scores; the newest come from the ones before when they are first read
    if any(kept):
        blocks_ = _refreshed(blocks_, [[Lookup(t, d, bins) for t in m.trees] for m in models], bins)
        made.append(blocks_)
    fresh: list[list[Lookup]] = [[Lookup(t, d, bins) for t in m.trees[k:]] for m, k in zip(models, kept, strict=True)]
    try:
        while True:
            live = [i for i, m in enumerate(models) if not m.stopped and len(m.trees) < m.spec.n_trees]
            if not live:
                break
            _grow(blocks_, models, fresh, live, d, bins)
            if max(len(m.trees) - k for m, k in zip(models, kept, strict=True)) >= REFRESH:
                blocks_ = _refreshed(blocks_, fresh, bins)
                made.append(blocks_)
                if len(made) > 2:
                    made.pop(0).unpersist()
                kept, fresh = [len(m.trees) for m in models], [[] for _ in models]
        _finish(blocks_, models, fresh, bins)
    finally:
        for old in made:
            old.unpersist()
    return models


def _grow(blocks_: RDD, models: list[Model], fresh: list[list[Lookup]], live: list[int], d: int, bins: int) -> None:
    """One more tree for every model of ``live`` that does not stop."""
    growing: dict[int, _Growing] = {}
    for level in range(max(models[i].spec.max_depth for i in live)):
        busy = [i for i in live if level < models[i].spec.max_depth and (level == 0 or growing[i].open)]
        if not busy:
            break
        shapes = {i: (Lookup(growing[i].arrays(), d, bins), growing[i].measured()) if level else None for i in busy}
        of = {i: (models[i].spec, models[i].base, fresh[i]) for i in busy}
        found = _summed(blocks_, _measure(of, shapes, level, d, bins))
        for i in busy:
            m, s = models[i], models[i].spec
            got = found[i]
            hist = got[2:].reshape(-1, d, bins, 3)
            if level == 0:
                growing[i] = _Growing(hist[0, 0].sum(0))
                growing[i].hist[0] = hist[0]
                if _stop(m, got[0], got[1]):
                    growing.pop(i)
                    live = [x for x in live if x != i]
                    continue
            else:
                parents, growing[i].hist = growing[i].hist, {}
                growing[i].complete(parents, hist)
            grow, nxt = growing[i], []
            for node, (gain, f, cut, left) in zip(grow.open, _best_splits(np.stack([grow.hist[o] for o in grow.open]), s), strict=True):
                if not np.isfinite(gain) or gain <= 1e-9:
                    continue
                grow.split[node] = (gain, f, cut)
                grow.kids[node] = (len(grow.sums), len(grow.sums) + 1)
                grow.sums += [left, grow.sums[node] - left]
                grow.depth += [grow.depth[node] + 1] * 2
                nxt += grow.kids[node]
            grow.open = nxt
    for i in live:
        m, grow = models[i], growing[i]
        order = grow.chosen(m.spec.max_leaves)
        if not order:
            m.stopped = True
            m.best = m.best if m.losses and m.spec.patience is not None else len(m.trees)
            continue
        for node in order:
            m.gains[grow.split[node][1]] += grow.split[node][0]
        m.trees.append(grow.arrays(set(order), m.spec.learning_rate, m.spec.l2))
        fresh[i].append(Lookup(m.trees[-1], d, bins))
        if m.spec.patience is None:
            m.best = len(m.trees)


def _measure(of: dict, shapes: dict, level: int, d: int, bins: int):
    """What a pass does with a block: the validation loss so far (at level 0) and the histograms of the nodes to measure."""
    walked = any(t.allowed is None for _, _, trees in of.values() for t in trees) or any(s and s[0].allowed is None for s in shapes.values())

    def measure(record):
        columns, y, roles, scores = _open(record)
        codes = pair_codes(columns.T, bins)
        for i, (s, base, trees) in of.items():
            role = roles[s.role]
            if level:
                tree, which = shapes[i]
                place = np.full(len(tree.tree["feature"]), -1)
                place[which] = np.arange(len(which))
                at = np.flatnonzero(role == TRAIN)
                if 2 * len(at) > len(role):  # cheaper for all rows than to pick most of them
                    node = place[tree.nodes(codes, columns.T)]
                    at = np.flatnonzero((node >= 0) & (role == TRAIN))
                    node = node[at]
                else:
                    node = place[tree.nodes(codes[:, at], columns.T[at] if walked else None)]
                    some = np.flatnonzero(node >= 0)
                    at, node = at[some], node[some]
                node, n_open = node * bins, len(which)
            else:
                at, n_open = np.flatnonzero(role), 1
            c, x = (codes, columns.T) if len(at) == len(role) else (codes[:, at], columns.T[at] if walked else None)
            raw = scores[i][at] + base if len(scores) else np.full(len(at), base)
            for tree in trees:
                raw += tree.values(c, x)
            own, tail = y[at], np.zeros(2)
            if level == 0:
                held = role[at] == VALIDATION
                tail = np.array([_loss(s.objective, raw[held], own[held]), held.sum()])
                at, raw, own = at[~held], raw[~held], own[~held]
                node = np.zeros(len(at), np.int64)
            g, h = _slopes(s.objective, raw, own)
            hist = np.zeros((n_open, d, bins, 3))
            for j in range(d):
                cell = node + columns[j][at]
                for k, w in ((0, g), (1, h if s.objective == "logistic" else None), (2, None)):
                    hist[:, j, :, k] = np.bincount(cell, w, n_open * bins).reshape(n_open, bins)
            yield i, np.concatenate([tail, hist.ravel()])

    return measure


def _stop(m: Model, loss: float, rows: float) -> bool:
    """Note the validation loss of the trees so far; True when it has not improved for ``patience`` trees."""
    if not rows or m.spec.patience is None:
        m.best = len(m.trees)
        return False
    m.losses.append(loss / rows)
    m.best = int(np.argmin(m.losses))
    m.stopped = len(m.losses) - 1 - m.best >= m.spec.patience
    return m.stopped


def _finish(blocks_: RDD, models: list[Model], fresh: list[list[Lookup]], bins: int) -> None:
    """Validation loss of the last tree, which no later level has measured."""
    late = [i for i, m in enumerate(models) if m.spec.patience is not None and len(m.losses) == len(m.trees) and m.trees]
    of = {i: (models[i].spec, models[i].base, fresh[i]) for i in late}

    def measure(record):
        columns, y, roles, scores = _open(record)
        codes = pair_codes(columns.T, bins)
        for i, (s, base, trees) in of.items():
            at = np.flatnonzero(roles[s.role] == VALIDATION)
            raw = scores[i][at] + base if len(scores) else np.full(len(at), base)
            for tree in trees:
                raw += tree.values(codes[:, at], columns.T[at])
            yield i, np.array([_loss(s.objective, raw, y[at]), len(at)])

    for i, (loss, rows) in (_summed(blocks_, measure) if late else {}).items():
        _stop(models[i], loss, rows)
    for m in models:
        if not m.losses:
            m.best = len(m.trees)


def accuracies(packed: DataFrame, models: list[Model], d: int, n_roles: int) -> list[float]:
    """Share of the validation rows of each model that it puts on the right side."""
    bins = models[0].edges.shape[1] + 1
    of = {i: (m.spec.role, m.base, [Lookup(t, d, bins) for t in m.trees[: m.best]]) for i, m in enumerate(models)}

    def measure(record):
        columns, y, roles, _ = _open(record)
        codes = pair_codes(columns.T, bins)
        for i, (role, base, trees) in of.items():
            at = np.flatnonzero(roles[role] == VALIDATION)
            raw, c, x = np.full(len(at), base), codes[:, at], columns.T[at]
            for tree in trees:
                raw += tree.values(c, x)
            yield i, np.array([((raw > 0) == (y[at] == 1)).sum(), len(at)], float)

    got = _summed(_records(packed), measure)
    return [float(got[i][0] / got[i][1]) if i in got and got[i][1] else 0.0 for i in range(len(models))]


def _refreshed(blocks_: RDD, fresh: list[list[Lookup]], bins: int) -> RDD:
    """The blocks with the scores of all trees so far, kept by the executors."""
    def run(record):
        columns, _, _, scores = _open(record)
        codes = pair_codes(columns.T, bins)
        new = scores.copy() if len(scores) else np.zeros((len(fresh), record[0]))
        for total, trees in zip(new, fresh, strict=True):
            for tree in trees:
                total += tree.values(codes, columns.T)
        return *record[:4], new.tobytes()

    return blocks_.map(run).persist(StorageLevel.MEMORY_AND_DISK)


# Use ------------------------------------------------------------------------------------
def predict(df: DataFrame, x: Column, models: dict[str, Model]) -> DataFrame:
    """``df`` with one column per model: the probability of class 1, or the value; ``x`` is the array of features."""
    names = list(models)
    first = models[names[0]]

    @F.pandas_udf("array<double>")
    def score(col: pd.Series) -> pd.Series:
        bins = binned(np.stack(col.to_numpy()), first.edges) if len(col) else np.zeros((0, len(first.features)), np.uint8)
        out = []
        for name in names:
            raw = models[name].raw(bins)
            out.append(1 / (1 + np.exp(-np.clip(raw, -500, 500))) if models[name].spec.objective == "logistic" else raw)
        return pd.Series(list(np.stack(out, 1)))

    return df.withColumn("_p", score(x)).withColumns({n: F.col("_p")[i] for i, n in enumerate(names)}).drop("_p")
