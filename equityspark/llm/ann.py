"""Approximate nearest neighbours by multiprobe p-stable hashing.

A table hashes a vector to a bucket of ``HASHES`` cells, floor((a.x + b) / width) with
Gaussian a. For a neighbour at distance r, a.x moves by a normal variable of deviation r,
so the chance that it lies in a perturbed bucket is a product of normal probabilities.
Buckets are visited in the order of that chance until their sum reaches the share a table
needs for the wanted recall; r is the query's own distance to its k-th nearest in a bounded
sample (an upper bound of the true one, so the search errs on the far side); candidates
beyond a larger distance of the same sample are not sent back. Candidates of
all tables are merged and ranked by exact distance.

Layout: vectors go to (table, coarse cell, split) groups; a coarse cell is the first
``COARSE`` coordinates of the bucket, and large cells are split evenly, so a dense region or
a vector that many rows share is spread. A query goes to those coarse cells that can hold a
visited bucket, and gets back only candidates below its bound. Equal vectors are one class
with its k + 1 smallest ids, which is all that a top-k can use. A query that finds too few
goes on through all buckets.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from equityspark.llm import common

TABLES, HASHES, COARSE, WIDTH = 4, 8, 3, 2.0
SAMPLE = 2048  # vectors in the fitting sample
TARGET = 0.96  # share of the neighbours that the probability model is to reach
_STEPS = np.array(np.meshgrid(*[[-1, 0, 1]] * HASHES, indexing="ij")).reshape(HASHES, -1).T


def _projections(dim: int, scale: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Directions (tables x hashes x dim), offsets and cell width for one dimension; the width follows the sample's distances."""
    rng = np.random.default_rng([17, dim])
    width = WIDTH * (scale if scale > 0 and math.isfinite(scale) else 1.0)
    return rng.normal(size=(TABLES, HASHES, dim)), rng.uniform(0, width, size=(TABLES, HASHES)), width


_erf = np.vectorize(math.erf, otypes=[float])


def _normal(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + _erf(x / math.sqrt(2.0)))


def cell_chances(place: np.ndarray, width: float, r: float) -> np.ndarray:
    """Chance of the neighbour's cell being -1, 0 or +1 away, per hash (hashes x 3), from the place inside the own cell."""
    if not r > 0:
        return np.tile([0.0, 1.0, 0.0], (len(place), 1))
    edges = np.stack([-place - width, -place, width - place, 2 * width - place], axis=1) / r
    return np.diff(_normal(edges), axis=1)


def cut_of(chances: np.ndarray, share: float) -> float:
    """Chance of the last bucket visited when the most likely ones are visited up to ``share``; 0 visits all."""
    p = np.ones(len(_STEPS))
    for i in range(HASHES):
        p *= chances[i, _STEPS[:, i] + 1]
    p = -np.sort(-p)
    total = np.cumsum(p)
    at = int(np.searchsorted(total, share))
    return float(p[at]) * (1 - 1e-9) if at < len(p) else 0.0


def _vectors(col: pa.Array) -> list[np.ndarray]:
    flat = np.asarray(col.values, np.float64) if not isinstance(col, pa.ChunkedArray) else None
    off = np.asarray(col.offsets)
    return [flat[a:z] for a, z in zip(off[:-1], off[1:], strict=True)]


def _groups_of(b: pa.RecordBatch, scales: dict[int, float]):
    """Per dimension of a batch: row numbers, matrix, and per table the integer buckets and projections."""
    vecs = _vectors(b.column("v"))
    dims = np.array([len(v) for v in vecs])
    for dim in np.unique(dims):
        rows = np.flatnonzero(dims == dim)
        x = np.stack([vecs[i] for i in rows])
        a, off, width = _projections(int(dim), scales.get(int(dim), 1.0))
        y = np.einsum("nd,thd->nth", x, a) + off
        cell = np.floor(y / width).astype(np.int64)
        yield int(dim), rows, x, y, cell, width


def _cell_name(dim: int, t: int, coarse: np.ndarray) -> str:
    return f"{dim}:{t}:" + ",".join(map(str, coarse.tolist()))


def valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v as array<double>) of the rows that take part."""
    v = F.col(vec_col).cast("array<double>")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    # + 0.0 makes -0.0 equal to 0.0
    return vectors.where(F.col(id_col).isNotNull() & F.coalesce(ok, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: x + F.lit(0.0)).alias("v"))


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k nearest rows of ``vectors`` found for each row of ``queries`` (a subset of its rows).

    Returns query_id, rank (from 1), vec_id, score (Euclidean distance in double precision on
    the original vectors); nearest first, ties to the smaller id; the query's own id is left
    out, all other rows are candidates. Null, zero, and not finite vectors, vectors with null
    components and rows without an id take no part; vectors of different length are not
    compared. Rows that repeat an id and a vector are one candidate. Extra columns are ignored.
    """
    spark = vectors.sparkSession
    rows = valid(vectors, id_col, vec_col)
    w = Window.partitionBy("v").orderBy("id")
    members = common.written(rows.distinct().withColumn("n", F.row_number().over(w)).where(F.col("n") <= k + 1), "members")
    reps = members.where("n = 1").select("id", "v")
    asked = valid(queries, id_col, vec_col).distinct().withColumnsRenamed({"id": "query_id"})
    asked = common.written(asked.join(reps, "v").select("query_id", "id"), "asked")
    total = reps.count()
    picked = reps.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    sample: dict[int, np.ndarray] = {}
    for x in picked["v"].to_pylist():
        sample.setdefault(len(x), []).append(x)
    sample = {d: np.array(x, np.float64) for d, x in sample.items()}
    # typical distance of near neighbours in the sample: sets the width of the cells
    scales = {}
    for d, x in sample.items():
        near = [np.sort(((x - q) ** 2).sum(axis=1))[min(k, len(x) - 1)] ** 0.5 for q in x[:256]]
        scales[d] = float(np.median(near))
    shared = spark.sparkContext.broadcast((sample, scales))
    share = 1 - (1 - TARGET) ** (1 / TABLES)
    split_rows = max(512, -(-total // 48))

    def place(batches):
        _, scales = shared.value
        for b in batches:
            name, at = [], []
            for dim, own, _, _, cell, _ in _groups_of(b, scales):
                for t in range(TABLES):
                    for i, c in zip(own, cell[:, t, :COARSE], strict=True):
                        at.append(i), name.append(_cell_name(dim, t, c))
            yield pa.RecordBatch.from_arrays([pa.array(name, pa.string()), b.column("id").take(pa.array(at, pa.int64()))], names=["cell", "id"])

    cells = common.written(reps.mapInArrow(place, "cell string, id long"), "cells")
    many = cells.groupBy("cell").count().select("cell", F.ceil(F.col("count") / split_rows).cast("int").alias("splits"))
    many = common.written(many, "splits")
    located = cells.join(many, "cell").select("cell", F.pmod(F.xxhash64("id"), F.col("splits")).cast("int").alias("split"), "id")
    data = located.join(reps, "id").select("cell", "split", "id", "v")

    def ask(full: bool):
        def run(batches):
            sample, scales = shared.value
            for b in batches:
                name, at, cuts, radii, bounds = [], [], [], [], []
                for dim, own, x, y, cell, width in _groups_of(b, scales):
                    known = sample.get(dim, np.zeros((0, dim)))
                    for i, row in enumerate(own):
                        r = bound = math.inf
                        if not full and len(known) > 4 * (k + 1):
                            near = np.partition(((known - x[i]) ** 2).sum(axis=1), (k, 4 * (k + 1))) ** 0.5
                            r, bound = float(near[k]), float(near[4 * (k + 1)])
                        for t in range(TABLES):
                            if not math.isfinite(bound):
                                if t == 0:  # all buckets of one table are all vectors
                                    name.append(f"{dim}:{t}:"), at.append(row), cuts.append(0.0), radii.append(r), bounds.append(bound)
                                continue
                            chance = cell_chances(y[i, t] - cell[i, t] * width, width, r)
                            cut = cut_of(chance, share)
                            rest = chance[COARSE:].max(axis=1).prod()
                            for step in np.ndindex(*[3] * COARSE):
                                if chance[range(COARSE), step].prod() * rest >= cut:
                                    name.append(_cell_name(dim, t, cell[i, t, :COARSE] + np.array(step) - 1))
                                    at.append(row), cuts.append(cut), radii.append(r), bounds.append(bound)
                take = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name, pa.string()), b.column("id").take(take), b.column("v").take(take), pa.array(cuts, pa.float64()), pa.array(radii, pa.float64()), pa.array(bounds, pa.float64())],
                    names=["cell", "query", "v", "cut", "r", "bound"])

        return run

    def compare(key, left, right):
        _, scales = shared.value
        out = [[], [], []]
        if left.num_rows and right.num_rows:
            dim, t = map(int, left.column("cell")[0].as_py().split(":")[:2])
            a, off, width = _projections(dim, scales.get(dim, 1.0))
            ids = np.asarray(left.column("id"))
            x = np.concatenate([np.asarray(c.flatten(), np.float64) for c in left.column("v").chunks]).reshape(-1, dim)
            cell = np.floor((x @ a[t].T + off[t]) / width).astype(np.int64)
            asks = np.concatenate([np.asarray(c.flatten(), np.float64) for c in right.column("v").chunks]).reshape(-1, dim)
            names = np.asarray(right.column("query"))
            for q, name, cut, r, bound in zip(asks, names, right.column("cut").to_pylist(), right.column("r").to_pylist(), right.column("bound").to_pylist(), strict=True):
                near = np.arange(len(ids))
                if cut > 0:
                    y = a[t] @ q + off[t]
                    home = np.floor(y / width).astype(np.int64)
                    chance = cell_chances(y - home * width, width, r)
                    step = cell - home
                    inside = (np.abs(step) <= 1).all(axis=1)
                    near = near[inside]
                    p = chance[np.arange(HASHES), step[near] + 1].prod(axis=1)
                    near = near[p >= cut]
                if not len(near):
                    continue
                dist = np.sqrt(((x[near] - q) ** 2).sum(axis=1))
                ok = dist <= bound * (1 + 1e-12)
                near, dist = near[ok], dist[ok]
                top = np.lexsort((ids[near], dist))[: k + 1]
                out[0].append(np.full(len(top), name)), out[1].append(ids[near[top]]), out[2].append(dist[top])
        cat = lambda v, kind: pa.array(np.concatenate(v) if v else np.zeros(0), kind)
        return pa.Table.from_arrays([cat(out[0], pa.int64()), cat(out[1], pa.int64()), cat(out[2], pa.float64())], names=["query", "id", "score"])

    def classes(wanted: DataFrame, full: bool) -> DataFrame:
        sent = wanted.mapInArrow(ask(full), "cell string, query long, v array<double>, cut double, r double, bound double")
        if full:
            # the name of a whole table stands for each of its cells
            table_of = F.concat_ws(":", F.element_at(F.split("cell", ":"), 1), F.element_at(F.split("cell", ":"), 2), F.lit(""))
            named = many.withColumn("_t", table_of).withColumnsRenamed({"cell": "_cell"})
            sent = sent.join(named, sent.cell == named._t).select(F.col("_cell").alias("cell"), "query", "v", "cut", "r", "bound", "splits")
        else:
            sent = sent.join(many, "cell")
        sent = sent.select("cell", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)).alias("split"), "query", "v", "cut", "r", "bound")
        met = data.groupBy("cell", "split").cogroup(sent.groupBy("cell", "split")).applyInArrow(compare, "query long, id long, score double")
        best = Window.partitionBy("query").orderBy("score", "id")
        return met.distinct().withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n")

    wanted = reps.join(asked.select("id").distinct(), "id")
    found = common.written(classes(wanted, False), "found")
    sizes = members.groupBy(F.size("v").alias("dim")).agg(F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("all"))
    counts = found.groupBy("query").count()
    short = wanted.join(counts, wanted.id == counts["query"], "left").withColumn("dim", F.size("v")).join(sizes, "dim")
    short = common.written(short.where(F.coalesce("count", F.lit(0)) < F.least(F.lit(k + 1), F.col("all"))).select("id", "v"), "short")
    if short.limit(1).count():
        found = found.join(short.select(F.col("id").alias("query")), "query", "left_anti").unionByName(classes(short, True))
    # classes to ids: the k + 1 best of a query class, then the own id goes
    listed = found.join(members.withColumnsRenamed({"id": "vec_id"}).join(reps, "v").select("id", "vec_id"), "id")
    order = Window.partitionBy("query").orderBy("score", "vec_id")
    listed = listed.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).select("query", "vec_id", "score")
    own = asked.withColumnsRenamed({"id": "query"}).join(listed, "query").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return own.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
