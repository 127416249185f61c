"""Fill-in-the-middle transformation with a piece table.

A document is a list of descriptors (buffer, start, end) over buffers that never change: the
text's UTF-8 bytes and the three sentinels. Cutting splits descriptors, an arrangement is a
permutation of the cut parts with sentinels before them, and the inverse permutation
restores the text from the output. Lengths and hashes stream over the descriptors; bytes are
copied once, when the output is written.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from equityspark.llm import common

SENTINELS = (b"<P>", b"<S>", b"<M>")  # before prefix, suffix, middle
PARTS = {b"<P>": 0, b"<M>": 1, b"<S>": 2}  # a sentinel's part, in the text's order
ARRANGED = {"psm": (0, 2, 1), "spm": (2, 0, 1)}  # parts in the output's order
SENTINEL_OF = {part: s for s, part in PARTS.items()}
ADDED = ["n", "form", "prefix_chars", "middle_chars", "output", "output_sha256"]

Piece = tuple[bytes, int, int]


class PieceTable:
    """Descriptors over immutable buffers."""

    def __init__(self, pieces: list[Piece]):
        self.pieces = [p for p in pieces if p[1] < p[2]]

    @classmethod
    def of(cls, buffer: bytes) -> PieceTable:
        return cls([(buffer, 0, len(buffer))])

    def __len__(self) -> int:
        return sum(end - start for _, start, end in self.pieces)

    def cut(self, places: list[int]) -> list[PieceTable]:
        """Tables of the parts between ascending byte places; descriptors across a place are split."""
        parts: list[list[Piece]] = [[]]
        left, at = list(places), 0
        for buffer, start, end in self.pieces:
            while left and at + (end - start) >= left[0]:
                middle = start + left.pop(0) - at
                parts[-1].append((buffer, start, middle))
                parts.append([])
                at, start = at + middle - start, middle
            parts[-1].append((buffer, start, end))
            at += end - start
        parts += [[] for _ in left]
        return [PieceTable(p) for p in parts]

    @classmethod
    def joined(cls, tables: list[PieceTable]) -> PieceTable:
        return cls([p for t in tables for p in t.pieces])

    def views(self):
        for buffer, start, end in self.pieces:
            yield memoryview(buffer)[start:end]

    def sha256(self) -> str:
        h = hashlib.sha256()
        for view in self.views():
            h.update(view)
        return h.hexdigest()

    def chars(self) -> int:
        """Code points: bytes that do not continue one."""
        return sum(int(np.count_nonzero((np.frombuffer(v, np.uint8) & 0xC0) != 0x80)) for v in self.views())

    def tobytes(self) -> bytes:
        return b"".join(self.views())


def arrange(parts: list[PieceTable], form: str) -> PieceTable:
    """Prefix, middle and suffix with their sentinels, in the order of ``form``."""
    return PieceTable.joined([t for p in ARRANGED[form] for t in (PieceTable.of(SENTINEL_OF[p]), parts[p])])


def unarrange(output: bytes, form: str) -> PieceTable:
    """Table of the text behind an arranged output: cut at the sentinels, put back by the inverse permutation.

    Each sentinel stands in the output once, as texts that hold one are left plain.
    """
    order = ARRANGED[form]
    marks = [SENTINEL_OF[p] for p in order]
    at = [output.index(m) for m in marks]
    pieces = [PieceTable([(output, a + len(m), z)]) for a, m, z in zip(at, marks, [*at[1:], len(output)], strict=True)]
    inverse = sorted(range(len(order)), key=order.__getitem__)
    return PieceTable.joined([pieces[i] for i in inverse])


def _draws(seed: str, n_draws: int = 4) -> list[int]:
    digest = hashlib.sha256(seed.encode()).hexdigest()
    return [int(digest[8 * i: 8 * i + 8], 16) for i in range(n_draws)]


def token_ends(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte ends (from the block's start) of all tokens and the border index of every text.

    A token is a word with the white space before it; white space behind the last word is one more.
    """
    _, ends, ptr = common.word_bounds(buf, off)
    last = np.where(np.diff(ptr) > 0, ends[np.maximum(ptr[1:] - 1, 0)] if len(ends) else 0, off[:-1])
    tail = np.flatnonzero(last < off[1:])
    ends = np.insert(ends, ptr[1:][tail], off[1:][tail])
    more = np.zeros(len(off), np.int64)
    more[1:] = np.cumsum(last < off[1:])
    return ends, ptr + more


def transform(docs: DataFrame, id_col: str = "doc_id", text: str = "text", seed: str = "42:", rate: int = 50, spm_share: int = 80) -> DataFrame:
    """Every row of ``docs`` with ``ADDED`` (same-named columns replaced).

    ``n`` counts the tokens, ``form`` is plain, psm or spm, ``output`` the arranged text. Cut
    places and form are drawn from the sha256 of ``seed`` and the decimal id, so they do not
    depend on partitioning; a null id draws like the empty id. ``rate`` of 100 texts are cut
    and ``spm_share`` of 100 of those begin with the suffix. Null texts count as empty; empty
    texts and texts that hold a sentinel stay plain. Repeated rows are treated alike.
    """
    df = common.passable(docs.drop(*ADDED))
    kept = df.columns
    df = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text}`").alias("text"))
    typed = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string"
    schema = pa.schema([*to_arrow_schema(df.select("row").schema), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string()), ("output_sha256", pa.string())])

    def work(batches):
        for b in common.blocks(batches):
            buf, off = common.texts_buffer(b.column("text"))
            ends, ptr = token_ends(buf, off)
            data, got = buf.tobytes(), []
            for i, key in enumerate(b.column("id").to_pylist()):
                a, z, first, n = int(off[i]), int(off[i + 1]), int(ptr[i]), int(ptr[i + 1] - ptr[i])
                h = _draws(seed + (key or ""))
                table = PieceTable([(data, a, z)])
                if a == z or h[2] % 100 >= rate or any(data.find(s, a, z) >= 0 for s in SENTINELS):
                    form, chars = "plain", (None, None)
                else:
                    form = "spm" if h[3] % 100 < spm_share else "psm"
                    units = sorted(x % (n + 1) for x in h[:2])
                    parts = table.cut([int(ends[first + u - 1]) - a if u else 0 for u in units])
                    chars = (parts[0].chars(), parts[1].chars())
                    table = arrange(parts, form)
                got.append((n, form, *chars, table.tobytes().decode(), table.sha256()))
            cols = [pa.array(c, t) for c, t in zip(zip(*got, strict=True), schema.types[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("row").cast(schema.types[0]), *cols], schema=schema)

    got = df.mapInArrow(work, f"row {df.schema['row'].dataType.simpleString()}, {typed}")
    return got.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], *ADDED)


def restore(docs: DataFrame, output: str = "output", form: str = "form") -> DataFrame:
    """Every row with ``restored`` and ``restored_sha256`` added: the text rebuilt from ``output`` and ``form`` alone.

    A null output is the empty text; a null form is plain.
    """
    df = common.passable(docs.drop("restored", "restored_sha256"))
    kept = df.columns
    df = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{form}`").alias("form"), F.col(f"`{output}`").alias("text"))
    schema = pa.schema([*to_arrow_schema(df.select("row").schema), ("restored", pa.string()), ("restored_sha256", pa.string())])

    def work(batches):
        for b in common.blocks(batches):
            texts, got = b.column("text").cast(pa.large_binary()).to_pylist(), []
            for data, kind in zip(texts, b.column("form").to_pylist(), strict=True):
                data = data or b""
                table = unarrange(data, kind) if kind in ARRANGED else PieceTable.of(data)
                got.append((table.tobytes().decode(), table.sha256()))
            cols = [pa.array(c, pa.string()) for c in zip(*got, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("row").cast(schema.types[0]), *cols], schema=schema)

    got = df.mapInArrow(work, f"row {df.schema['row'].dataType.simpleString()}, restored string, restored_sha256 string")
    return got.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], "restored", "restored_sha256")
