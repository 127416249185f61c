"""Byte-level BPE encoding and decoding over length-bucketed numpy matrices.

A text is split by the tokenizer's pattern; each distinct piece is encoded once per
batch run and remembered in a bounded table. Pieces that are not themselves entries of
the vocabulary are put, by byte length, into padded matrices of token ids with a second
matrix holding the rank of every adjacent pair (hashed lookup). In each round every row
merges its leftmost pair of minimum rank; the merged column is squeezed out (compaction),
so all active rows shrink by one, and rows without a pair leave the matrix. A long piece
is a matrix of one row; there, further occurrences of the minimum pair are merged in the
same round whenever no pair formed on the way has a lower rank, which gives the same
result as one merge at a time.

The rank file is read by the driver and sent to the tasks as arrays (its size is checked).
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from equityspark.llm import common

MAX_VOCABULARY = 4_000_000
_NONE = np.int64(1 << 40)  # rank of a pair that does not merge
_MULT = np.uint64(0x9E3779B97F4A7C15)


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank from a rank file (``base64 rank`` per line)."""
    tokens: dict[int, bytes] = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                tokens[int(rank)] = base64.b64decode(token)
    if len(tokens) > MAX_VOCABULARY or sorted(tokens) != list(range(len(tokens))):
        raise ValueError(f"{path}: ranks must be 0..n-1 with n <= {MAX_VOCABULARY}")
    return [tokens[i] for i in range(len(tokens))]


class Coder:
    """Encoder and decoder for one vocabulary."""

    def __init__(self, tokens: list[bytes], pattern: str, remembered: int = 400_000):
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.find = regex.compile(pattern).findall
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.of_byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        left, right, made = [], [], []
        for token, r in self.rank.items():
            for cut in range(1, len(token)):
                a, b = self.rank.get(token[:cut]), self.rank.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), made.append(r)
        self._hash_table(np.array(left, np.uint64) << np.uint64(32) | np.array(right, np.uint64), np.array(made, np.int64))
        self.remembered = remembered
        self._forget()

    # hashed pair lookup: open addressing, filled and probed a whole array at a time
    def _hash_table(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 3))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slot_key = np.full(1 << bits, np.uint64(2**64 - 1))
        self.slot_rank = np.full(1 << bits, _NONE)
        at = ((keys * _MULT) >> self.shift).astype(np.int64)
        todo = np.arange(len(keys))
        self.probes = 1
        while len(todo):
            free = todo[self.slot_key[at[todo]] == np.uint64(2**64 - 1)]
            where, one = np.unique(at[free], return_index=True)
            won = free[one]
            self.slot_key[where], self.slot_rank[where] = keys[won], ranks[won]
            todo = todo[self.slot_key[at[todo]] != keys[todo]]
            at[todo] = (at[todo] + 1) & self.mask
            self.probes += bool(len(todo))

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each merged pair; negative ids are padding and never merge."""
        key = (a.astype(np.uint64) << np.uint64(32)) | (b.astype(np.uint64) & np.uint64(0xFFFFFFFF))
        at = ((key * _MULT) >> self.shift).astype(np.int64)
        seen = self.slot_key[at]
        out = np.where(seen == key, self.slot_rank[at], _NONE)
        miss = np.flatnonzero(((seen != key) & (seen != np.uint64(2**64 - 1))).ravel())
        flat, kf, af = out.reshape(-1), key.reshape(-1), at.reshape(-1)
        while len(miss):
            af[miss] = (af[miss] + 1) & self.mask
            seen = self.slot_key[af[miss]]
            hit = seen == kf[miss]
            flat[miss[hit]] = self.slot_rank[af[miss[hit]]]
            miss = miss[~hit & (seen != np.uint64(2**64 - 1))]
        out[(a < 0) | (b < 0)] = _NONE
        return out

    def _merge_rows(self, ids: np.ndarray) -> list[np.ndarray]:
        """Token ids of each row of a padded (-1) id matrix."""
        done: list[np.ndarray | None] = [None] * len(ids)
        rows = np.arange(len(ids))
        ranks = self.pair_ranks(ids[:, :-1], ids[:, 1:])
        while len(rows):
            width = ids.shape[1]
            if width > 1:
                at = ranks.argmin(axis=1)  # the leftmost minimum
                low = ranks[np.arange(len(rows)), at]
            else:
                at, low = np.zeros(len(rows), np.int64), np.full(len(rows), _NONE)
            end = low == _NONE
            if end.any():
                for r, line in zip(rows[end], ids[end], strict=True):
                    done[r] = line[line >= 0]
                keep = ~end
                rows, ids, ranks, at, low = rows[keep], ids[keep], ranks[keep], at[keep], low[keep]
                if not len(rows):
                    break
            n = np.arange(len(rows))
            ids[n, at] = low
            gone = np.ones(ids.shape, bool)
            gone[n, at + 1] = False
            ids = ids[gone].reshape(len(rows), width - 1)
            if width == 2:
                ranks = np.zeros((len(rows), 0), np.int64)
                continue
            # the pair that ended in the merged token goes, its two neighbours are looked up again
            squeeze = np.ones(ranks.shape, bool)
            squeeze[n, at] = False
            ranks = ranks[squeeze].reshape(len(rows), width - 2)
            for where, ok in ((at - 1, at > 0), (at, at < width - 2)):
                w = where[ok]
                ranks[n[ok], w] = self.pair_ranks(ids[n[ok], w], ids[n[ok], w + 1])
        return done  # type: ignore[return-value]

    def _merge_long(self, ids: np.ndarray) -> np.ndarray:
        """One long row; all occurrences of the minimum pair at once where that is the same."""
        ranks = self.pair_ranks(ids[:-1], ids[1:])
        while len(ranks):
            low = ranks.min()
            if low == _NONE:
                break
            at = np.flatnonzero(ranks == low)
            if len(at) > 1:
                # overlapping occurrences: every second one of a run, from its left end
                run = np.concatenate([[True], np.diff(at) > 1])
                head = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - head) % 2 == 0]
                before = np.where(at > 0, ids[np.maximum(at - 1, 0)], -1)
                before[1:][np.diff(at) == 2] = low  # the left neighbour was merged just before
                after = np.where(at + 2 < len(ids), ids[np.minimum(at + 2, len(ids) - 1)], -1)
                made = np.full(len(at), low)
                formed = np.minimum(self.pair_ranks(before, made), self.pair_ranks(made, after))
                bad = np.flatnonzero(formed < low)
                if len(bad):
                    at = at[: bad[0] + 1]  # stop behind the merge that forms a lower pair
            ids[at] = low
            ids = np.delete(ids, at + 1)
            ranks = np.delete(ranks, at)
            new = at - np.arange(len(at))
            for w in (new - 1, new):
                w = w[(w >= 0) & (w < len(ids) - 1)]
                ranks[w] = self.pair_ranks(ids[w], ids[w + 1])
        return ids

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.pool = np.zeros(1 << 16, np.int32)
        self.pool_n = 0
        self.at = np.zeros(1 << 12, np.int64)
        self.count = np.zeros(1 << 12, np.int64)

    def _learn(self, pieces: list[str]) -> None:
        """Encode pieces that are not known yet."""
        raw = [p.encode("utf-8") for p in pieces]
        result: list[np.ndarray | None] = [None] * len(raw)
        groups: dict[int, list[int]] = {}
        for i, b in enumerate(raw):
            r = self.rank.get(b)
            if r is not None:
                result[i] = np.array([r])
            elif len(b) > 256:
                result[i] = self._merge_long(self.of_byte[np.frombuffer(b, np.uint8)])
            else:
                groups.setdefault((len(b) + 3) // 4 * 4, []).append(i)
        for width, members in groups.items():
            for a in range(0, len(members), 8192):
                part = members[a: a + 8192]
                mat = np.full((len(part), width), -1, np.int64)
                lens = np.array([len(raw[i]) for i in part])
                mat[np.arange(width) < lens[:, None]] = self.of_byte[np.frombuffer(b"".join(raw[i] for i in part), np.uint8)]
                for i, ids in zip(part, self._merge_rows(mat), strict=True):
                    result[i] = ids
        base = len(self.known)
        lens = np.array([len(x) for x in result], np.int64)
        total = self.pool_n + int(lens.sum())
        if total > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.pool_n], np.zeros(2 * total - self.pool_n, np.int32)])
        self.pool[self.pool_n: total] = np.concatenate(result)
        if base + len(raw) > len(self.at):
            more = np.zeros(2 * (base + len(raw)) - len(self.at), np.int64)
            self.at, self.count = np.concatenate([self.at, more]), np.concatenate([self.count, more])
        self.at[base: base + len(raw)] = self.pool_n + np.concatenate([[0], np.cumsum(lens)[:-1]])
        self.count[base: base + len(raw)] = lens
        self.pool_n = total
        for i, p in enumerate(pieces):
            self.known[p] = base + i

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and the border of each text (one more entry)."""
        split = [self.find(t) for t in texts]
        fresh: dict[str, None] = {}
        if len(self.known) > self.remembered:
            self._forget()
        known = self.known
        for line in split:
            for p in line:
                if p not in known:
                    fresh[p] = None
        if fresh:
            self._learn(list(fresh))
        sizes = np.array([len(s) for s in split], np.int64)
        code = np.fromiter((known[p] for line in split for p in line), np.int64, int(sizes.sum()))
        n = self.count[code]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.pool[np.repeat(self.at[code] - (ends - n), n) + np.arange(total)]
        return ids, np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])]

    def decode(self, ids: np.ndarray, border: np.ndarray) -> list[bytes]:
        """Bytes of each text."""
        n = self.length[ids]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        data = self.flat[np.repeat(self.start[ids] - (ends - n), n) + np.arange(total)].tobytes()
        at = np.concatenate([[0], ends])[border]
        return [data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


_CODERS: dict[object, Coder] = {}


def coder(shared) -> Coder:
    """The task process's coder for a broadcast vocabulary."""
    if shared.value["id"] not in _CODERS:
        _CODERS.clear()
        _CODERS[shared.value["id"]] = Coder(shared.value["tokens"], shared.value["pattern"])
    return _CODERS[shared.value["id"]]


def share(spark: SparkSession, path: str, pattern: str):
    """Broadcast a vocabulary (its size is bounded by ``MAX_VOCABULARY`` entries)."""
    return spark.sparkContext.broadcast({"id": f"{path}|{pattern}", "tokens": read_ranks(path), "pattern": pattern})


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add column ``ids`` (array of token ids) to every row of ``docs``.

    Null and empty texts have no ids. No special tokens: their spellings are ordinary text.
    Repeated rows are encoded alike; other columns are kept, a column named like ``ids`` is replaced.
    """
    shared = share(docs.sparkSession, path, pattern)
    df = common.passable(docs.drop(ids).withColumnsRenamed({text: "text"}) if text != "text" else docs.drop(ids))
    rest = df.columns

    def run(batches):
        c = coder(shared)
        for b in common.blocks(batches):
            flat, border = c.encode([t or "" for t in b.column("text").to_pylist()])
            col = pa.ListArray.from_arrays(pa.array(border, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, col], names=[*b.schema.names, ids])

    out = df.mapInArrow(run, ", ".join([*[f"`{n}` {t}" for n, t in df.dtypes], f"`{ids}` array<int>"]))
    return out.select(*rest, ids).withColumnsRenamed({"text": text})


def decode(coded: DataFrame, path: str, pattern: str, ids: str = "ids", data: str = "data") -> DataFrame:
    """Replace column ``ids`` by the bytes it stands for (column ``data``, binary); null ids give empty bytes."""
    shared = share(coded.sparkSession, path, pattern)
    df = common.passable(coded.drop(data))
    rest = [c for c in df.columns if c != ids]

    def run(batches):
        c = coder(shared)
        for b in batches:
            col = b.column(ids)
            flat = np.asarray(col.flatten(), np.int64)
            border = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(col).fill_null(0), np.int64))])
            out = pa.array(c.decode(flat, border), pa.binary())
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in rest], out], names=[*rest, data])

    return df.mapInArrow(run, ", ".join([*[f"`{n}` {t}" for n, t in df.dtypes if n != ids], f"`{data}` binary"]))


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Add ``ids`` and ``data`` (the decoded ids) in one pass over the texts."""
    shared = share(docs.sparkSession, path, pattern)
    df = common.passable(docs.drop("ids", "data"))

    def run(batches):
        c = coder(shared)
        for b in common.blocks(batches, 1 << 20):
            flat, border = c.encode([t or "" for t in b.column(text).to_pylist()])
            col = pa.ListArray.from_arrays(pa.array(border, pa.int32()), pa.array(flat, pa.int32()))
            keep = [n for n in b.schema.names if n != text]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in keep], col, pa.array(c.decode(flat, border), pa.binary())], names=[*keep, "ids", "data"])

    if text != "text":
        df = df.withColumn("text", df[text])
    return df.mapInArrow(run, ", ".join([*[f"`{n}` {t}" for n, t in df.dtypes if n != text], "ids array<int>", "data binary"]))
