"""Quality classifier learned from trusted positives and unlabelled text only.

A logistic model over text features minimises the non-negative unbiased risk: with class
prior ``p``, mean ``P`` over trusted positives and mean ``U`` over all unlabelled rows, the
risk of the positive class is ``p P[l(g)]`` and that of the unseen negatives
``U[l(-g)] - p P[l(-g)]``, which cannot really be negative: a step that would make it so is
shortened. With the logistic loss the sum is convex in the weights, so each iteration is a
Newton step; its sums (gradient, curvature, risks of several step lengths) are taken over
all rows in Spark tasks and only ``d * d`` numbers come to the driver.

The class prior is estimated with the best-bin rule: rows scored above a threshold are
nearly all positive where the share of unlabelled rows above it, divided by the share of
positives above it, is smallest with its confidence terms. Positives set aside for that are
not fitted on until the prior is known.

Features are taken once from the whole texts and written; every later pass reads only them.
No label, source, language or id is among them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from equityspark.llm import common

BUCKETS = 64  # hashed byte trigrams
PLAIN = 27  # features before the buckets, the constant first
DIM = PLAIN + BUCKETS
RIDGE, BUCKET_RIDGE = 0.03, 1.0
STEPS = (1.0, 0.5, 0.25, 0.125, 1 / 16, 1 / 64, 1 / 256, 0.0)
BINS = 400
CLIP = 8.0
ADDED = ["held_out", "score", "predicted"]
_U = np.uint64


def _classes() -> np.ndarray:
    """Byte classes: other 0, lower 1, upper 2, digit 3, blank 4, newline 5, beyond ASCII 6, sentence marks 7."""
    c = np.zeros(256, np.uint8)
    for first, last, kind in (("a", "z", 1), ("A", "Z", 2), ("0", "9", 3), ("\t", "\r", 4), (" ", " ", 4), ("\n", "\n", 5)):
        c[ord(first): ord(last) + 1] = kind
    c[128:] = 6
    c[[ord(x) for x in ".,;:"]] = 7
    return c


CLASS = _classes()


def _distinct(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct hashes (44 bits of each) in every text of a block."""
    key = np.sort((doc.astype(np.uint64) << _U(44)) | (h >> _U(20)))
    new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    return np.bincount((key[new] >> _U(44)).astype(np.int64), minlength=n).astype(float)


def features(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Feature matrix of the texts of a block (UTF-8 bytes and offsets); an empty text has the constant and length marks only."""
    n = len(off) - 1
    size = np.diff(off)
    doc = np.repeat(np.arange(n), size)
    share = lambda a, b: a / np.maximum(b, 1)
    grams = np.zeros((n, BUCKETS))
    if len(buf) > 2:
        b = buf.astype(np.uint32)
        k = (b[:-2] | (b[1:-1] << np.uint32(8)) | (b[2:] << np.uint32(16))) * np.uint32(2654435761)
        inside = doc[2:] == doc[:-2]
        slot = (k >> np.uint32(32 - int(math.log2(BUCKETS)))).astype(np.int64) + doc[:-2] * BUCKETS
        grams = np.bincount(slot[inside], minlength=n * BUCKETS).reshape(n, BUCKETS).astype(float)
    grams = np.sqrt(share(grams, grams.sum(1, keepdims=True)))
    kinds = np.bincount(doc * 8 + CLASS[buf], minlength=n * 8).reshape(n, 8) / np.maximum(size, 1)[:, None]
    starts, ends, ptr = common.word_bounds(buf, off)
    words = np.diff(ptr).astype(float)
    h, at = common.word_hashes(buf, starts, ends), np.repeat(np.arange(n), np.diff(ptr))
    three = common.ngrams(h, 3)
    whole = common.within(ptr, 3, len(three)) if len(three) else np.zeros(0, bool)
    of = at[: len(three)][whole]
    count = lambda test: np.bincount(at[test], minlength=n).astype(float)
    more = [
        np.log1p(words) / 10, np.log1p(size) / 10, np.minimum(share(size, words), 20) / 20, share(_distinct(h, at, n), words),
        share(_distinct(three[whole], of, n), np.bincount(of, minlength=n)), share(count(CLASS[buf[ends - 1]] == 0), words),
        share(count(ends - starts == 1), words), share(count(CLASS[buf[starts]] == 2), words), (words < 50) * 1.0, (size == 0) * 1.0]
    return np.concatenate([np.ones((n, 1)), kinds, np.sqrt(kinds), np.stack(more, 1), grams], 1)


def _vectors(docs: DataFrame, text: str) -> DataFrame:
    """Every row without its text, with its feature vector as column ``x`` of the struct columns ``row`` and ``x``."""
    kept = [c for c in docs.columns if c != text]
    df = common.passable(docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{text}`").alias("text")))

    def extract(batches):
        for b in common.blocks(batches):
            x = features(*common.texts_buffer(b.column("text"))).astype(np.float32)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), DIM).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([b.column("row"), lists], names=["row", "x"])

    return df.mapInArrow(extract, f"row {df.schema['row'].dataType.simpleString()}, x array<float>")


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    return np.asarray(b.column("x").flatten(), np.float64).reshape(b.num_rows, DIM)


def _total(df: DataFrame, work) -> np.ndarray:
    """Sum over all tasks of the arrays that ``work(positive, matrix)`` gives; ``df`` has the columns ``positive`` and ``x``."""

    def task(batches):
        total = None
        for b in batches:
            x, positive = _matrix(b), np.asarray(b.column("positive"))
            for flag in (False, True):
                if (positive == flag).any():
                    got = work(flag, x[positive == flag])
                    total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], names=["slot", "v"])

    rows = df.mapInArrow(task, "slot int, v double").groupBy("slot").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(rows.num_rows)
    out[np.asarray(rows.column("slot"))] = np.asarray(rows.column("v"))
    return out


class Model:
    """Weights over standardised features; ``score`` is the probability of the positive class."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray):
        self.mean, self.scale, self.w, self.prior = mean, scale, np.zeros(DIM), 0.5

    def ready(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) * self.scale, -CLIP, CLIP)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.ready(x) @ self.w, -500, 500)))


def _penalty() -> np.ndarray:
    r = np.full(DIM, RIDGE)
    r[PLAIN:], r[0] = BUCKET_RIDGE, 1e-6
    return r


def _descend(model: Model, rows: DataFrame, n_pos: float, n_all: float, prior: float, most: int) -> None:
    """Newton steps on the risk; the non-negative part limits each step's length."""
    penalty, tri = _penalty(), np.triu_indices(DIM)
    for _ in range(most):
        w = model.w

        def slopes(positive, x, w=w):
            z = model.ready(x)
            if positive:
                return np.concatenate([z.sum(0), np.zeros(DIM + len(tri[0]))])
            s = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
            return np.concatenate([np.zeros(DIM), s @ z, ((z * (s * (1 - s))[:, None]).T @ z)[tri]])

        sums = _total(rows, slopes)
        slope = sums[DIM: 2 * DIM] / n_all - prior * sums[:DIM] / n_pos + penalty * w
        curve = np.zeros((DIM, DIM))
        curve[tri] = sums[2 * DIM:] / n_all
        curve = curve + np.triu(curve, 1).T + np.diag(penalty + 1e-9)
        way = -np.linalg.solve(curve, slope)

        def risks(positive, x, w=w, way=way):
            z = model.ready(x)
            g = (z @ w)[:, None] + (z @ way)[:, None] * np.array(STEPS)
            plus, minus = np.logaddexp(0, -g).sum(0), np.logaddexp(0, g).sum(0)
            none = np.zeros(len(STEPS))
            return np.concatenate([plus, minus, none] if positive else [none, none, minus])

        pos_plus, pos_minus, all_minus = _total(rows, risks).reshape(3, -1)
        unseen = all_minus / n_all - prior * pos_minus / n_pos
        weight = np.array([(penalty * (w + t * way) ** 2).sum() / 2 for t in STEPS])
        risk = np.where(unseen >= 0, prior * pos_plus / n_pos + unseen + weight, np.inf)
        best = int(np.argmin(risk))
        if not np.isfinite(risk[best]):  # the prior makes even the present point infeasible: no step is sound
            return
        model.w = w + STEPS[best] * way
        if risk[-1] - risk[best] < 1e-5:
            return


def best_bin(pos: np.ndarray, everything: np.ndarray, delta: float = 0.1, gamma: float = 0.01) -> float:
    """Class prior from two score histograms (low scores first): the best bin's ratio of the shares above it."""
    n, m = pos.sum(), everything.sum()
    if not n or not m:
        return 0.5
    above_pos, above_all = np.cumsum(pos[::-1])[::-1] / n, np.cumsum(everything[::-1])[::-1] / m
    ok = above_pos > 0
    spread = math.sqrt(math.log(4 / delta) / 2 / n) + math.sqrt(math.log(4 / delta) / 2 / m)
    bound = np.where(ok, (above_all + (1 + gamma) * spread) / np.where(ok, above_pos, 1), np.inf)
    at = int(np.argmin(bound))
    return float(np.clip(above_all[at] / above_pos[at], 0.01, 0.99))


def _estimate(model: Model, rows: DataFrame) -> float:
    def histogram(positive, x):
        counts = np.bincount(np.minimum((model.score(x) * BINS).astype(np.int64), BINS - 1), minlength=BINS).astype(float)
        none = np.zeros(BINS)
        return np.concatenate([counts, none] if positive else [none, counts])

    pos, everything = _total(rows, histogram).reshape(2, -1)
    return best_bin(pos, everything)


def fit(positives: DataFrame, unlabelled: DataFrame, rounds: int = 2, most: int = 8) -> Model | None:
    """Learn from two tables of feature vectors ``x``; ``positives`` has also ``aside`` (kept for the prior).

    None without positives or without unlabelled rows.
    """
    free = unlabelled.select(F.lit(False).alias("positive"), F.lit(False).alias("aside"), "x")
    rows = free.unionByName(positives.select(F.lit(True).alias("positive"), F.coalesce("aside", F.lit(False)).alias("aside"), "x"))
    known = {(r["positive"], r["aside"]): r["n"] for r in rows.groupBy("positive", "aside").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_all, n_aside, n_fit = known.get((False, False), 0), known.get((True, True), 0), known.get((True, False), 0)
    if not n_all or not n_aside + n_fit:
        return None
    moments = _total(free, lambda positive, x: np.concatenate([x.sum(0), (x * x).sum(0)])).reshape(2, -1) / n_all
    spread = np.sqrt(np.maximum(moments[1] - moments[0] ** 2, 0))
    mean, scale = moments[0], np.where(spread > 1e-6, 1 / np.maximum(spread, 1e-6), 0.0)
    mean[0], scale[0] = 0.0, 1.0
    model = Model(mean, scale)
    if n_aside and n_fit:
        some, held = rows.where("NOT positive OR NOT aside"), rows.where("NOT positive OR aside")
        for _ in range(rounds):
            _descend(model, some, n_fit, n_all, model.prior, most)
            model.prior = _estimate(model, held)
            model.w = model.w * 0.5  # back into the feasible region of the new prior
    _descend(model, rows, n_aside + n_fit, n_all, model.prior, 2 * most)
    return model


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", folds: int = 5, cut: float = 0.3) -> DataFrame:
    """Every row of ``docs`` without its text, with held_out, score (0 to 1) and predicted added (same-named columns replaced).

    Trusted positives are rows whose labels of ``quality`` are all 1; no other label is used.
    Unlabelled text is every row not held out, labelled or not. Held out are rows whose crc32
    of the id as text is divisible by ``folds`` and rows without an id; nothing is learned
    from them. Null texts are empty; empty texts get the score of their features like others.
    Repeated rows are scored alike and count as often as they occur. Without positives or
    unlabelled rows every score is 0.5.
    """
    own = docs.drop(*ADDED)
    kept = [c for c in own.columns if c != text]
    out = F.coalesce(F.pmod(F.crc32(F.col(f"row.`{id_col}`").cast("string")), F.lit(folds)) == 0, F.lit(True))
    found = common.written(_vectors(own, text).withColumn("held_out", out), "features")
    good = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(id_col).alias("id"))
    good = good.agg(F.min("quality").alias("q")).where("q = 1").select("id")
    free = found.where("NOT held_out").select(F.col(f"row.`{id_col}`").alias("id"), "x")
    aside = F.pmod(F.crc32(F.concat(F.lit("prior:"), F.col("id").cast("string"))), F.lit(4)) == 0
    positives = common.written(free.join(good, "id").select(aside.alias("aside"), "x"), "positives")
    model = fit(positives, free.select("x"))

    df = found.select("row", "held_out", "x")
    schema = to_arrow_schema(df.select("row", "held_out").withColumn("score", F.lit(0.0)).schema)

    def judge(batches):
        for b in batches:
            s = model.score(_matrix(b)) if model is not None else np.full(b.num_rows, 0.5)
            cols = [b.column("row"), b.column("held_out"), pa.array(s)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema, strict=True)], names=schema.names)

    got = df.mapInArrow(judge, f"row {df.schema['row'].dataType.simpleString()}, held_out boolean, score double")
    return got.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], "held_out", "score", (F.col("score") >= cut).cast("int").alias("predicted"))
