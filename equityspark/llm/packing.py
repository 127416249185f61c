"""Packing token pieces into fixed-size sequences, shortest pack first over the length histogram.

Lengths are placed from the longest to the shortest. A pattern is a list of lengths with a
count of sequences built like it; a length goes to the pattern with the shortest pack (the
most room), whose count is split when it is larger than what is left to place. Only the
histogram (at most ``size`` numbers) and the patterns live on the driver. Pieces get a rank
within their length and find their sequence and offset from it: rank ranges of a length
belong to pattern slots.

The rank is made from counts per (length, bucket) and a row number inside a bucket, so a
length that a third of all pieces have is spread over all buckets.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from equityspark.llm import common

SLOT_LIMIT = 1 << 22


def _byte_of() -> dict[str, int]:
    """Byte of each printable stand-in character of byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def read_tokenizer(path: str) -> dict:
    """Ranks and added tokens of a byte-level BPE tokenizer file whose ids follow the merge order."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    byte = _byte_of()
    ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}
    merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    made = [spec["model"]["vocab"][a + b] for a, b in merges]
    if made != sorted(made) or len(ranks) > 1_000_000:
        raise ValueError(f"{path}: token ids must follow the merges, with at most 1,000,000 tokens")
    return {"ranks": ranks, "added": added}


_ENCODERS: dict[str, object] = {}


def _encoder(shared):
    spec = shared.value
    if spec["id"] not in _ENCODERS:
        import tiktoken

        _ENCODERS[spec["id"]] = tiktoken.Encoding(spec["id"], pat_str=spec["pattern"], mergeable_ranks=spec["ranks"], special_tokens=spec["added"])
    return _ENCODERS[spec["id"]]


def pieces(docs: DataFrame, path: str, pattern: str, size: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Token pieces of at most ``size`` ids of every document (``doc_id``, ``text``).

    A document is its text's ids (null: none; spellings of added tokens are those tokens)
    and ``end_id``. Returns doc_id, start, length, ids_crc32, doc_tokens and, if asked, ids.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast({"id": path, "pattern": pattern, **read_tokenizer(path)})
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]

    def run(batches):
        enc = _encoder(shared)
        for b in common.blocks(batches):
            row, start, ids = [], [], []
            total = []
            for i, t in enumerate(b.column("text").to_pylist()):
                own = np.append(enc.encode_to_numpy(t or "", allowed_special="all"), np.uint32(end_id)).astype("<u4")
                for a in range(0, len(own), size):
                    row.append(i), start.append(a), ids.append(own[a: a + size]), total.append(len(own))
            cols = [
                b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array([len(x) for x in ids], pa.int64()),
                pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()), pa.array(total, pa.int64())]
            if with_ids:
                cols.append(pa.array(ids, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<long>" * with_ids)


def patterns(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns (lengths of one sequence) and how many sequences are built like each."""
    rooms: dict[int, list[list]] = {}  # room left: [pattern, count]
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        if not 0 < length <= size:
            raise ValueError(f"length {length} is not in 1..{size}")
        while left:
            room = max(rooms, default=0)
            if room < length:
                # nothing has room: open packs that hold as many of this length as fit
                each = size // length
                for per, count in ((each, left // each), (left % each, 1)):
                    if per and count:
                        rooms.setdefault(size - per * length, []).append([(length,) * per, count])
                left = 0
                continue
            pattern, count = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
            take = min(count, left)
            if take < count:
                rooms.setdefault(room, []).append([pattern, count - take])
            rooms.setdefault(room - length, []).append([pattern + (length,), take])
            left -= take
    return [(p, c) for room in sorted(rooms) for p, c in rooms[room]]


def slots(packs: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rank ranges: rows of (length, first rank, sequence of the first rank, offset), by length and rank."""
    rows, base, used = [], 0, {}
    for pattern, count in packs:
        at = 0
        for length in pattern:
            rank = used.get(length, 0)
            rows.append((length, rank, base, at))
            used[length] = rank + count
            at += length
        base += count
    if len(rows) > SLOT_LIMIT:
        raise ValueError("too many packing slots")
    out = np.array(rows, np.int64).reshape(-1, 4)
    return out[np.lexsort((out[:, 1], out[:, 0]))]


def pack(parts: DataFrame, size: int = 2048, order: tuple[str, ...] = ("doc_id", "start", "ids_crc32", "doc_tokens"), length: str = "length") -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to every piece; each has a ``length`` of 1 to ``size``.

    Pieces are read several times: pass a written table. Rows equal in ``order`` are
    interchangeable. Other columns are kept; columns named like the added ones are replaced.
    """
    spark = parts.sparkSession
    parts = common.passable(parts.drop("sequence_id", "offset", "_bucket", "_rank"))
    histogram = {r[0]: r[1] for r in parts.groupBy(F.col(length).cast("long")).count().collect()}
    plan = slots(patterns(histogram, size))
    buckets = common.parts_for(parts, 8 << 20)
    parts = parts.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    # at most size x buckets counts
    counts = parts.groupBy(F.col(length).alias("_length"), F.col("_bucket").alias("_b")).count()
    before = Window.partitionBy("_length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("_length", "_b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    own = Window.partitionBy(length, "_bucket").orderBy(*order)
    ranked = parts.withColumn("_n", F.row_number().over(own)).join(
        base, (F.col(length) == F.col("_length")) & (F.col("_bucket") == F.col("_b"))
    ).withColumn("_rank", F.col("_base") + F.col("_n") - 1).drop("_length", "_b", "_base", "_n", "_bucket")
    shared = spark.sparkContext.broadcast(plan)
    keep = [c for c in ranked.columns if c != "_rank"]

    def place(batches):
        plan = shared.value
        key = (plan[:, 0] << 44) | plan[:, 1]
        for b in batches:
            n, r = np.asarray(b.column(length), np.int64), np.asarray(b.column("_rank"), np.int64)
            at = np.searchsorted(key, (n << 44) | r, side="right") - 1
            hit = plan[at] if len(at) else np.zeros((0, 4), np.int64)
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in keep], pa.array(hit[:, 2] + r - hit[:, 1], pa.int64()), pa.array(hit[:, 3], pa.int64())], names=[*keep, "sequence_id", "offset"])

    return ranked.mapInArrow(place, ", ".join([*[f"`{c}` {t}" for c, t in ranked.dtypes if c != "_rank"], "sequence_id long, offset long"]))


def sequences(packed: DataFrame) -> DataFrame:
    """Ids of each sequence (at most the pack size): sequence_id, ids."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return parts.select("sequence_id", F.flatten(F.col("p.ids")).alias("ids"))
