"""Shared helpers: tables, partition counts, shared scratch files, word hashing and the ask/reply exchange.

The word kernel turns an Arrow string column into 64-bit word hashes with numpy only:
words are split on ASCII white space (byte 0x20 and 0x09-0x0D), so splitting the UTF-8
bytes is the same as splitting the characters.

The ask/reply exchange answers "what is known about this key in the whole corpus" for
chunks of documents without ever keying single rows by a hot value: each chunk sends a
key at most once, packed with the other keys of the same part, so a key that is in a
third of all documents costs one entry per chunk.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from equityspark.session import checkpoint_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
NO_ID = np.int64(2**63 - 1)  # stands for a null document id: it sorts last


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def scratch(spark: SparkSession, prefix: str) -> str:
    """Name of a new folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{prefix}-{uuid.uuid4().hex}"


def written(df: DataFrame, prefix: str) -> DataFrame:
    """Write ``df`` to the shared folder and continue from the files."""
    spark = df.sparkSession
    path = scratch(spark, prefix)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _open(t: T.DataType) -> T.DataType:
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, _open(f.dataType)) for f in t.fields])
    if isinstance(t, T.ArrayType):
        return T.ArrayType(_open(t.elementType))
    if isinstance(t, T.MapType):
        return T.MapType(_open(t.keyType), _open(t.valueType))
    return t


def passable(df: DataFrame) -> DataFrame:
    """The same columns with nested fields nullable, as the results of Python tasks are declared."""
    return df.select(*[F.col(f"`{f.name}`").cast(_open(f.dataType)).alias(f.name) for f in df.schema.fields])


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many more underscores in front as the columns of ``df`` make necessary."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def parts_for(df: DataFrame, part_bytes: int = 32 << 20) -> int:
    """Partition count: the session's setting, or more when the planner's size estimate asks for more."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return n if size > 1 << 56 else max(n, size // part_bytes)


# ---- words ---------------------------------------------------------------

_U = np.uint64
_SPAN = 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of the splitmix64 generator, in place on a copy."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n:
        n = max(n, _SPAN)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def texts_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is the empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    col = col.cast(pa.large_string()).fill_null("")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset: col.offset + len(col) + 1]
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[off[0]: off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def lower_bytes(buf: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes unchanged."""
    return np.where((buf >= 65) & (buf <= 90), buf + 32, buf).astype(np.uint8)


def word_bounds(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of every word, and per text the index of its first word (one more entry at the end)."""
    word = ~((buf == 32) | ((buf >= 9) & (buf <= 13)))
    first = np.zeros(len(buf) + 1, bool)
    first[off[:-1]] = True
    first = first[:-1]
    before = np.concatenate([[False], word[:-1]])
    starts = np.flatnonzero(word & (~before | first))
    after = np.concatenate([word[1:], [False]])
    last = np.concatenate([first[1:], [True]])
    ends = np.flatnonzero(word & (~after | last)) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, computed over spans of about a megabyte."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _SPAN, side="right")))
        a, b = int(starts[i]), int(ends[j - 1])
        up, down = _powers(b - a + 1)
        total = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_BYTE[buf[a:b]] * up[: b - a], out=total[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = _mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * _U(0x9E3779B97F4A7C15))
        i = j
    return out


def ngrams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` entries (runs over text borders included)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    g = h[:n].copy()
    for j in range(1, k):
        g *= _U(0xD6E8FEB86659FD93)
        g += h[j: j + n]
    return _mix(g)


def within(ptr: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of the first ``n`` entry positions start a run of ``k`` entries inside one text."""
    ok = np.zeros(int(ptr[-1]) + 1, np.int32)
    last = np.maximum(ptr[1:] - (k - 1), ptr[:-1])
    np.add.at(ok, ptr[:-1], 1)
    np.add.at(ok, last, -1)
    return np.cumsum(ok)[:n] > 0


def blocks(batches, size: int = 4 << 20):
    """Re-slice record batches so that each slice holds about ``size`` text bytes (column ``text``)."""
    for b in batches:
        if b.num_rows == 0:
            continue
        lens = np.asarray(pc.binary_length(b.column("text").cast(pa.large_string())).fill_null(0), np.int64)
        group = np.cumsum(lens) // size
        edges = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(lens)]])
        for a, z in zip(edges[:-1], edges[1:], strict=True):
            yield b.slice(int(a), int(z - a))


# ---- ask and reply -------------------------------------------------------

ASK = "part int, chunk int, keys binary, lo binary, hi binary"
REPLY = "chunk int, keys binary, lo binary"


def pack(chunk: int, parts: int, keys: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    """One row per part with the chunk's distinct ``keys`` (unsigned) and two values for each."""
    part = (keys % _U(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    keys, lo, hi = keys[order], lo[order], hi[order]
    ids, at = np.unique(part[order], return_index=True)
    edges = [*at, len(keys)]
    cut = lambda a: [a[x:y].tobytes() for x, y in zip(edges[:-1], edges[1:], strict=True)]
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int32()), pa.array(np.full(len(ids), chunk), pa.int32()), pa.array(cut(keys), pa.binary()), pa.array(cut(lo), pa.binary()), pa.array(cut(hi), pa.binary())],
        names=["part", "chunk", "keys", "lo", "hi"])


def reduce_keys(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys with their smallest ``lo`` and largest ``hi``."""
    if len(keys) == 0:
        return keys, lo, hi
    order = np.argsort(keys, kind="stable")
    keys, lo, hi = keys[order], lo[order], hi[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)


def unpack(rows: pa.Table | pa.RecordBatch, names: tuple[str, ...], kinds: tuple) -> list[np.ndarray]:
    out = []
    for name, kind in zip(names, kinds, strict=True):
        vals = [v for v in rows.column(name).to_pylist() if v]
        out.append(np.concatenate([np.frombuffer(v, kind) for v in vals]) if vals else np.zeros(0, kind))
    return out


def known_elsewhere(asks: DataFrame, parts: int) -> DataFrame:
    """Reply to each chunk with its keys that lie in documents of different ids, and the smallest id of each."""

    def reply(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        rows = pa.Table.from_batches(got)
        del got
        keys, lo, hi = unpack(rows, ("keys", "lo", "hi"), (np.uint64, np.int64, np.int64))
        chunk = np.repeat(np.asarray(rows.column("chunk")), [len(v) // 8 for v in rows.column("keys").to_pylist()])
        del rows
        k, a, z = reduce_keys(keys, lo, hi)
        k, a = k[a < z], a[a < z]
        if len(k) == 0:
            return
        at = np.minimum(np.searchsorted(k, keys), len(k) - 1)
        hit = k[at] == keys
        keys, at, chunk = keys[hit], at[hit], chunk[hit]
        order = np.argsort(chunk, kind="stable")
        keys, val, chunk = keys[order], a[at[order]], chunk[order]
        ids, first = np.unique(chunk, return_index=True)
        edges = [*first, len(keys)]
        for i, x, y in zip(ids, edges[:-1], edges[1:], strict=True):
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(i)], pa.int32()), pa.array([keys[x:y].tobytes()], pa.binary()), pa.array([val[x:y].tobytes()], pa.binary())], names=["chunk", "keys", "lo"])

    return asks.repartition(parts, "part").mapInArrow(reply, REPLY)
