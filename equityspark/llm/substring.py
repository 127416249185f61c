"""Substring dedup by seed and extend over winnowed anchors.

A window is ``window`` consecutive words. Its anchor is the 5-word run of smallest hash in
it (the leftmost of equal ones), so equal windows have equal anchors.

Seed: every chunk of documents sends its distinct anchors once each and learns which of
them also lie in other documents. Extend: around such an anchor all windows that have it as
their anchor are looked up the same way; the reply holds the smallest document id that has
the same window. Neighbouring windows that match grow into one maximal repeat, to the left
and to the right, which ends where the next window has no earlier document.

Keys travel as packed arrays, one entry per chunk and key (see ``common``), so neither a
passage that a third of all documents share nor a group of copies lands in one task, and no
pairs of documents are made. Documents are shuffled once; all three passes read that shuffle.

Window identity is a 64-bit hash, compared only among keys of the same part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equityspark.llm import common

SEED = 5


class _Chunk:
    """Words and windows of a slice of a chunk's documents."""

    def __init__(self, ids: np.ndarray, text: pa.Array, window: int):
        self.buf, off = common.texts_buffer(text)
        self.starts, self.ends, self.ptr = common.word_bounds(self.buf, off)
        h = common.word_hashes(self.buf, self.starts, self.ends)
        self.doc_of = np.repeat(np.arange(len(ids)), np.diff(self.ptr))
        self.window = window
        n = max(len(h) - window + 1, 0)
        self.at = np.flatnonzero(common.within(self.ptr, window, n)) if n else np.zeros(0, np.int64)
        seeds = common.ngrams(h, SEED)
        span = window - SEED + 1
        self.anchor = np.zeros(len(self.at), np.uint64)
        view = np.lib.stride_tricks.sliding_window_view(seeds, span) if len(seeds) >= span else None
        for a in range(0, len(self.at), 1 << 18):
            i = self.at[a: a + (1 << 18)]
            self.anchor[a: a + len(i)] = view[i].min(axis=1)
        self.hash = common.ngrams(h, window)[self.at] if n else np.zeros(0, np.uint64)
        self.id = ids[self.doc_of[self.at]] if n else np.zeros(0, np.int64)


def _ids(col: pa.Array) -> np.ndarray:
    return np.asarray(pa.array(col).cast(pa.int64()).fill_null(int(common.NO_ID)), np.int64)


def _slices(table: pa.Table, window: int):
    for b in common.blocks(table.to_batches()):
        yield b, _Chunk(_ids(b.column("_id")), b.column("text"), window)


def _merge(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return common.reduce_keys(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def _lookup(keys: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each wanted key is among the sorted ``keys``, and where."""
    if len(keys) == 0:
        return np.zeros(len(want), bool), np.zeros(len(want), np.int64)
    at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
    return keys[at] == want, at


def _replied(reply: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys, lo = common.unpack(reply, ("keys", "lo"), (np.uint64, np.int64))
    order = np.argsort(keys)
    return keys[order], lo[order]


def repeats(docs: DataFrame, window: int = 13, id_col: str = "doc_id") -> DataFrame:
    """Every row of ``docs`` with ``n_words``, ``spans`` and ``kept`` added.

    ``spans`` are the maximal runs of words (start, end; end exclusive, disjoint and
    ascending) covered by windows whose word sequence also starts in a document with a
    smaller id; ``kept`` is the text of the other words, joined by one space. Windows are
    judged on the input, not on what is left.

    Null and empty texts have no words. A null id sorts behind all ids: such a document is
    never the earlier one. Rows that repeat an id are one document for the comparison. Ids
    are integers; other columns are kept, columns named like the added ones are replaced.
    """
    df = common.passable(docs.drop("n_words", "spans", "kept", "_id", "_chunk"))
    parts = common.parts_for(df)
    rest = df.columns
    df = df.withColumns({"_id": F.col(id_col).cast("long"), "_chunk": F.pmod(F.xxhash64(id_col, "text"), F.lit(parts)).cast("int")})
    groups = df.groupBy("_chunk")

    def seeds(key, table):
        found = []
        for _, c in _slices(table, window):
            new = np.concatenate([[True], (c.anchor[1:] != c.anchor[:-1]) | (c.id[1:] != c.id[:-1])]) if len(c.anchor) else np.zeros(0, bool)
            found.append(common.reduce_keys(c.anchor[new], c.id[new], c.id[new]))
        return pa.Table.from_batches([common.pack(key[0].as_py(), parts, *_merge(found))])

    def windows(key, table, reply):
        if table.num_rows == 0:
            return _no_asks()
        shared, _ = _replied(reply)
        found = []
        for _, c in _slices(table, window):
            hit, _ = _lookup(shared, c.anchor)
            found.append(common.reduce_keys(c.hash[hit], c.id[hit], c.id[hit]))
        return pa.Table.from_batches([common.pack(key[0].as_py(), parts, *_merge(found))])

    def cut(key, table, reply):
        if table.num_rows == 0:
            return out_schema.empty_table()
        keys, first = _replied(reply)
        done = []
        for b, c in _slices(table, window):
            hit, at = _lookup(keys, c.hash)
            if len(first):
                hit &= first[at] < c.id
            change = np.zeros(int(c.ptr[-1]) + 1, np.int32)
            np.add.at(change, c.at[hit], 1)
            np.add.at(change, c.at[hit] + window, -1)
            gone = np.cumsum(change)[:-1] > 0
            done.append(_result(b, c, gone, rest, out_schema))
        return pa.Table.from_batches(done)

    out_schema = _arrow_schema(docs.sparkSession, df.select(*rest))
    ddl = ", ".join([*[f"`{c}` {t}" for c, t in df.dtypes if c in rest], "n_words long, spans array<struct<start: bigint, `end`: bigint>>, kept string"])
    shared = common.known_elsewhere(groups.applyInArrow(seeds, common.ASK), parts)
    asked = groups.cogroup(shared.groupBy("chunk")).applyInArrow(windows, common.ASK)
    known = common.known_elsewhere(asked, parts)
    return groups.cogroup(known.groupBy("chunk")).applyInArrow(cut, ddl)


def _no_asks() -> pa.Table:
    empty = np.zeros(0, np.int64)
    return pa.Table.from_batches([common.pack(0, 1, np.zeros(0, np.uint64), empty, empty)])


def _arrow_schema(spark, df: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.schema([*to_arrow_schema(df.schema), ("n_words", pa.int64()), ("spans", span), ("kept", pa.string())])


def _result(b: pa.RecordBatch, c: _Chunk, gone: np.ndarray, rest: list[str], schema: pa.Schema) -> pa.RecordBatch:
    data = c.buf.tobytes()
    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
    # runs end at document borders too
    run_start, run_end = edge[::2], edge[1::2]
    spans, kept = [], []
    for d in range(b.num_rows):
        a, z = int(c.ptr[d]), int(c.ptr[d + 1])
        i, j = np.searchsorted(run_end, a, side="right"), np.searchsorted(run_start, z, side="left") if z > a else 0
        own = [(max(int(s), a) - a, min(int(e), z) - a) for s, e in zip(run_start[i:j], run_end[i:j], strict=True)]
        spans.append([{"start": s, "end": e} for s, e in own])
        keep = np.flatnonzero(~gone[a:z]) + a
        kept.append(b" ".join([data[s:e] for s, e in zip(c.starts[keep].tolist(), c.ends[keep].tolist(), strict=True)]).decode("utf-8"))
    cols = [b.column(n) for n in rest]
    arrays = [*cols, pa.array(np.diff(c.ptr), pa.int64()), pa.array(spans, schema.field("spans").type), pa.array(kept, pa.string())]
    return pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, schema, strict=True)], schema=schema)
