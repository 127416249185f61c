"""Language-model scoring by prediction by partial matching over byte contexts.

The model is a trie of byte contexts up to ``ORDER`` bytes with the counts of the byte that
follows, learned from all training texts (A-Z lower-cased). A byte that was seen behind the
longest known context gets its share of that node; otherwise the node's escape (its number
of distinct followers, method C) is paid and the next shorter context is asked, without the
symbols that the longer one already ruled out (symbol exclusion). The last resort is an even
share of the bytes that are left. The sum of the logarithms is the text's code length.

Counts are gathered from every training text: chunks of documents send their distinct words
and grams once each, and get back what they asked for: the counts of their words and the
costs of their grams. A gram's cost depends on the gram alone, so it is worked out once, in
the shard of the two bytes before its last one: a shard holds the contexts of two and more
bytes whole. Shorter contexts come from the counts of byte pairs, 65,536 at most, the only
part of the model that every task gets. No gram is left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equityspark.llm import common

ORDER = 4
MAX_NODES = 2_000_000  # grams costed at a time
PAIRS = 1 << 16
_U = np.uint64
GATHER = "part int, chunk int, kind int, keys binary, counts binary"
SHARD = "part int, keys binary, counts binary"
TOTALS = "kind int, chunk int, keys binary, counts binary, distinct long, total long"


def grams(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The byte at every place with the ``ORDER`` bytes before it (zero before the text's start), first byte highest."""
    n = len(buf)
    back = np.arange(n) - np.repeat(off[:-1], np.diff(off))
    key = buf.astype(np.uint64)
    for r in range(1, ORDER + 1):
        b = np.zeros(n, np.uint64)
        b[r:] = buf[: n - r] if n > r else 0
        b[back < r] = 0
        key |= b << _U(8 * r)
    return key


class Trie:
    """Counts of all contexts of 0 to ``ORDER`` bytes as sorted arrays, and the cost of any gram.

    ``keys`` are all learned grams of a shard, ``pairs`` the corpus's counts of byte pairs.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, pairs: np.ndarray):
        self.sym, self.ctx = [], []
        two = np.flatnonzero(pairs).astype(np.uint64)
        for j in range(ORDER + 1):
            mask = _U((1 << (8 * (j + 1))) - 1)
            own, times = (keys, counts) if j > 1 else (two, pairs[two.astype(np.int64)])
            k, inv = np.unique(own & mask, return_inverse=True)
            n = np.bincount(inv, times, len(k)) if len(k) else np.zeros(0)
            c, at = np.unique(k >> _U(8), return_index=True)
            total = np.add.reduceat(n, at) if len(k) else n
            self.sym.append((k, n))
            self.ctx.append([c, total, np.diff([*at, len(k)]).astype(float), np.zeros(len(c))])
        for j in range(1, ORDER + 1):
            # what the followers of a context count in the next shorter one
            k, _ = self.sym[j]
            below, n = self.sym[j - 1]
            if len(k):
                own = n[np.searchsorted(below, k & _U((1 << (8 * j)) - 1))]
                at = np.searchsorted(k >> _U(8), self.ctx[j][0])
                self.ctx[j][3] = np.add.reduceat(own, at)

    def cost(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of the last byte of each gram."""
        out = np.zeros(len(keys))
        open_ = np.arange(len(keys))
        ruled_out, weight = np.zeros(len(keys)), np.zeros(len(keys))
        for j in range(ORDER, -1, -1):
            if not len(open_):
                return out
            k = keys[open_] & _U((1 << (8 * (j + 1))) - 1)
            c, total, distinct, shorter = self.ctx[j]
            if not len(c):
                continue
            at = np.minimum(np.searchsorted(c, k >> _U(8)), len(c) - 1)
            seen = c[at] == k >> _U(8)
            rest_n = np.where(seen, total[at] - weight[open_], 0.0)
            rest_u = np.where(seen, distinct[at] - ruled_out[open_], 0.0)
            s, n = self.sym[j]
            sat = np.minimum(np.searchsorted(s, k), len(s) - 1)
            hit = seen & (s[sat] == k)
            whole = np.maximum(rest_n + rest_u, 1.0)
            out[open_[hit]] += np.log10(n[sat[hit]] / whole[hit])
            miss = seen & ~hit & (rest_u > 0)
            out[open_[miss]] += np.log10(rest_u[miss] / whole[miss])
            went = open_[seen]
            ruled_out[went], weight[went] = distinct[at[seen]], shorter[at[seen]]
            open_ = open_[~hit]
        out[open_] -= np.log10(256 - ruled_out[open_])
        return out


def _flag(id_col: str):
    """True for held-out rows: crc32 of the id as text is divisible by ten, or there is no id."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(10)) == 0, F.lit(True))


def _packed(chunk: int, parts: int, kind: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    b = common.pack(chunk, parts, keys, counts, np.zeros(len(keys), np.int8))
    return pa.RecordBatch.from_arrays([b.column("part"), b.column("chunk"), pa.array(np.full(b.num_rows, kind), pa.int32()), b.column("keys"), b.column("lo")], names=["part", "chunk", "kind", "keys", "counts"])


def _sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(counts, at)


def _read(b: pa.RecordBatch):
    buf, off = common.texts_buffer(b.column("text"))
    buf = common.lower_bytes(buf)
    starts, ends, ptr = common.word_bounds(buf, off)
    return buf, off, common.word_hashes(buf, starts, ends), ptr


def score(docs: DataFrame, id_col: str = "doc_id", max_nodes: int = MAX_NODES) -> DataFrame:
    """Every row of ``docs`` with held_out, n_tokens, n_known, train_tokens, base_score and score added.

    Rows whose crc32 of the id is divisible by ten are held out, all others are learned from;
    a row without an id is held out. Tokens are the words (A-Z lower-cased) and one end per
    row; ``base_score`` is their smoothed unigram log10 probability, ``score`` the model's
    log10 probability of the text's bytes. Null and empty texts have the end token only and
    score 0. Repeated rows count as often as they occur. Other columns are kept, columns named
    like the added ones are replaced.
    """
    spark = docs.sparkSession
    added = ["held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    df = common.passable(docs.drop(*added, "_chunk"))
    rest = df.columns
    parts = common.parts_for(df)
    df = df.withColumns({"held_out": _flag(id_col), "_chunk": F.pmod(F.xxhash64(id_col, "text"), F.lit(parts)).cast("int")})
    groups = df.groupBy("_chunk")

    def gather(key, table):
        words, learned = [], []
        rows = 0
        for b in common.blocks(table.to_batches()):
            buf, off, h, ptr = _read(b)
            held = np.asarray(b.column("held_out"))
            train_word = ~np.repeat(held, np.diff(ptr))
            words.append(_sums(h, train_word.astype(np.int64)))
            g, asked = grams(buf, off), np.repeat(held, np.diff(off))
            k, n = np.unique(g[~asked], return_counts=True)
            learned.append((k, n.astype(np.int64)))
            k = np.unique(g[asked])
            learned.append((k, np.zeros(len(k), np.int64)))
            rows += int((~held).sum())
        chunk = key[0].as_py()
        out = []
        for kind, found in ((0, words), (1, learned)):
            keys, counts = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            keys, counts = _sums(keys, counts)
            out.append(_packed(chunk, parts, kind, keys, counts if counts.max(initial=0) >= 1 << 31 else counts.astype(np.int64)))
        end = pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([chunk], pa.int32()), pa.array([2], pa.int32()), pa.array([b""], pa.binary()), pa.array([np.int64(rows).tobytes()], pa.binary())], names=["part", "chunk", "kind", "keys", "counts"])
        return pa.Table.from_batches([*out, end])

    def total(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        rows = pa.Table.from_batches(got)
        kinds = np.asarray(rows.column("kind"))

        def line(kind, chunk, keys, counts, distinct, all_):
            return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([chunk], pa.int32()), pa.array([keys.tobytes()], pa.binary()), pa.array([counts.tobytes()], pa.binary()), pa.array([distinct], pa.int64()), pa.array([all_], pa.int64())], names=["kind", "chunk", "keys", "counts", "distinct", "total"])

        none = np.zeros(0, np.int64)
        ends = sum(int(np.frombuffer(v, np.int64)[0]) for v, kind in zip(rows.column("counts").to_pylist(), kinds, strict=True) if kind == 2)
        if ends:
            yield line(2, -1, none, none, 0, ends)
        for kind in (0, 1):
            own = rows.filter(pa.array(kinds == kind))
            keys, counts = common.unpack(own, ("keys", "counts"), (np.uint64, np.int64))
            k, n = _sums(keys, counts)
            if kind == 1:
                if len(k):
                    yield line(1, -1, k, n, len(k), int(n.sum()))
                continue
            k, n = k[n > 0], n[n > 0]
            yield line(3, -1, none, none, len(k), int(n.sum()))
            at = 0
            for chunk, blob in zip(own.column("chunk").to_pylist(), own.column("keys").to_pylist(), strict=True):
                want = np.sort(np.frombuffer(blob, np.uint64))
                at = np.searchsorted(k, want)
                hit = (at < len(k)) & (k[np.minimum(at, max(len(k) - 1, 0))] == want) if len(k) else np.zeros(len(want), bool)
                if hit.any():
                    yield line(0, chunk, want[hit], n[at[hit]], 0, 0)

    asks = common.written(groups.applyInArrow(gather, GATHER), "asks")
    known = common.written(asks.repartition(parts, "part").mapInArrow(total, TOTALS), "counts")
    head = known.where("kind IN (2, 3)").groupBy("kind").agg(F.sum("distinct").alias("d"), F.sum("total").alias("t")).collect()
    by = {r["kind"]: r for r in head}
    ends = by[2]["t"] if 2 in by else 0
    all_tokens = ends + (by[3]["t"] if 3 in by else 0)
    distinct = (1 if ends else 0) + (by[3]["d"] if 3 in by else 0)
    costs = _costs(known.where("kind = 1").select("keys", "counts"), parts, max_nodes)
    floor = float(all_tokens) + 0.1 * (distinct + 1)

    def judge(key, table, reply):
        if table.num_rows == 0:
            return schema.empty_table()
        kinds = np.asarray(reply.column("kind"))
        (keys, counts), (known_grams, cost) = (
            _ordered(*common.unpack(reply.filter(pa.array(kinds == kind)), ("keys", "counts"), (np.uint64, value))) for kind, value in ((0, np.int64), (1, np.float64)))
        done = []
        for b in common.blocks(table.to_batches(), 2 << 20):
            buf, off, h, ptr = _read(b)
            held = np.asarray(b.column("held_out"))
            c = np.zeros(len(h), np.int64)
            if len(keys):
                u, inv = np.unique(h, return_inverse=True)
                at = np.minimum(np.searchsorted(keys, u), len(keys) - 1)
                c = np.where(keys[at] == u, counts[at], 0)[inv]
            add = lambda v, border: np.diff(np.concatenate([[0.0], np.cumsum(v)])[border])
            base = np.array([np.log10((c[a:z] + 0.1) / floor).sum() for a, z in zip(ptr[:-1], ptr[1:], strict=True)]) + np.log10((ends + 0.1) / floor)
            u, inv = np.unique(grams(buf, off), return_inverse=True)
            own = cost[np.searchsorted(known_grams, u)][inv] if len(u) else np.zeros(0)
            value = np.array([own[a:z].sum() for a, z in zip(off[:-1], off[1:], strict=True)])
            tokens = np.diff(ptr) + 1
            seen = add((c > 0).astype(float), ptr).round().astype(np.int64) + (1 if ends else 0)
            cols = [*[b.column(n) for n in rest], pa.array(held), pa.array(tokens, pa.int64()), pa.array(seen, pa.int64()), pa.array(np.full(len(held), all_tokens), pa.int64()), pa.array(base, pa.float64()), pa.array(value, pa.float64())]
            done.append(pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(cols, schema, strict=True)], schema=schema))
        return pa.Table.from_batches(done)

    from pyspark.sql.pandas.types import to_arrow_schema

    more = [("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
    schema = pa.schema([*to_arrow_schema(df.select(*rest).schema), *more])
    ddl = ", ".join([*[f"`{c}` {t}" for c, t in df.dtypes if c in rest], "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"])
    replies = known.where("kind = 0").select("kind", "chunk", "keys", "counts").unionByName(_answers(asks.where("kind = 1"), costs, parts))
    return groups.cogroup(replies.groupBy("chunk")).applyInArrow(judge, ddl)


def _ordered(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    return keys[order], values[order]


def _dealt(part: np.ndarray, keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(part, kind="stable")
    part, keys, values = part[order], keys[order], values[order]
    ids, at = np.unique(part, return_index=True)
    edges = [*at, len(keys)]
    cut = lambda a: pa.array([a[x:y].tobytes() for x, y in zip(edges[:-1], edges[1:], strict=True)], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), cut(keys), cut(values)], names=["part", "keys", "counts"])


def _costs(blobs: DataFrame, parts: int, at_a_time: int) -> DataFrame:
    """log10 probability of every gram that a text holds, packed by the part of the gram.

    Grams are dealt by the two bytes before the last one. ``at_a_time`` bounds memory only.
    """

    def pairs_of(batches):
        for b in batches:
            k, n = common.unpack(b, ("keys", "counts"), (np.uint64, np.int64))
            pair, n = _sums(k & _U(PAIRS - 1), n)
            yield pa.RecordBatch.from_arrays([pa.array(pair.astype(np.int64)), pa.array(n)], names=["pair", "n"])

    pairs = np.zeros(PAIRS)
    for r in blobs.mapInArrow(pairs_of, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        pairs[r["pair"]] = r["n"]
    sent = blobs.sparkSession.sparkContext.broadcast(pairs)

    def deal(batches):
        for b in batches:
            k, n = common.unpack(b, ("keys", "counts"), (np.uint64, np.int64))
            yield _dealt((common._mix((k >> _U(8)) & _U(PAIRS - 1)) % _U(parts)).astype(np.int64), k, n)

    def cost(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        k, n = common.unpack(pa.Table.from_batches(got), ("keys", "counts"), (np.uint64, np.int64))
        del got
        trie = Trie(k[n > 0], n[n > 0].astype(float), sent.value)
        for a in range(0, len(k), at_a_time):
            some = k[a: a + at_a_time]
            yield _dealt((some % _U(parts)).astype(np.int64), some, trie.cost(some))

    return blobs.mapInArrow(deal, SHARD).repartition(parts, "part").mapInArrow(cost, SHARD)


def _answers(asks: DataFrame, costs: DataFrame, parts: int) -> DataFrame:
    """The cost of each gram to each chunk that asked for it, as rows of kind 1."""

    def answer(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        rows = pa.Table.from_batches(got)
        del got
        asked = np.asarray(rows.column("chunk")) >= 0
        k, c = _ordered(*common.unpack(rows.filter(pa.array(~asked)), ("keys", "counts"), (np.uint64, np.float64)))
        own = rows.filter(pa.array(asked))
        for chunk, blob in zip(own.column("chunk").to_pylist(), own.column("keys").to_pylist(), strict=True):
            want = np.frombuffer(blob, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([chunk], pa.int32()), pa.array([blob], pa.binary()), pa.array([c[np.searchsorted(k, want)].tobytes()], pa.binary())], names=["kind", "chunk", "keys", "counts"])

    lines = asks.select("part", "chunk", "keys", F.lit(None).cast("binary").alias("counts")).unionByName(costs.select("part", F.lit(-1).alias("chunk"), "keys", "counts"))
    return lines.repartition(parts, "part").mapInArrow(answer, "kind int, chunk int, keys binary, counts binary")
