"""Periodic runs of words by descending-LCP Kruskal.

The suffixes of a document are sorted and the longest common prefixes (LCP) of neighbours
are the weights of a path over the positions. Taking its edges in descending order, each
unites two classes of suffixes (union-find with ordered position sets, the smaller moved
into the larger). Two positions that become neighbours in a set share exactly the edge's
LCP; if their distance is within it, the stretch from the first on has that distance as a
period, and with unequal words before both it is a run's beginning. The first two periods
of every run become neighbours this way: a position between them with so long a common
prefix would give the stretch a smaller period. Of several distances found for the same
stretch the smallest is its period.

A run of ``min_length`` words and ``min_exponent`` periods has an LCP of at least
``least_lcp``; so documents in which no window of so many words occurs twice have none and
leave early, and lower edges are not taken. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from equityspark.llm import common

MIN_LENGTH, MIN_EXPONENT = 24, 3
CHUNK = 1024
ADDED = ["n_words", "runs", "collapsed"]
_U = np.uint64
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def least_lcp(min_length: int, min_exponent: int) -> int:
    """Smallest LCP of the first two periods of any wanted run."""
    return min(max(min_length - q, (min_exponent - 1) * q) for q in range(1, min_length + 1))


class PositionSet:
    """Ordered positions in chunks; ``add`` gives the neighbours of the new one."""

    __slots__ = ("chunks", "tops", "size")

    def __init__(self, position: int):
        self.chunks, self.tops, self.size = [[position]], [position], 1

    def add(self, p: int) -> tuple[int | None, int | None]:
        chunks, tops = self.chunks, self.tops
        c = min(bisect_left(tops, p), len(tops) - 1)
        chunk = chunks[c]
        k = bisect_left(chunk, p)
        before = chunk[k - 1] if k else chunks[c - 1][-1] if c else None
        after = chunk[k] if k < len(chunk) else chunks[c + 1][0] if c + 1 < len(chunks) else None
        chunk.insert(k, p)
        self.size += 1
        if len(chunk) > CHUNK:
            half = len(chunk) // 2
            chunks.insert(c + 1, chunk[half:])
            del chunk[half:]
            tops[c: c + 1] = [chunk[-1], chunks[c + 1][-1]]
        else:
            tops[c] = chunk[-1]
        return before, after

    def __iter__(self):
        for chunk in self.chunks:
            yield from chunk


def neighbours(edges) -> list[tuple[int, int, int]]:
    """(first, second, LCP) of all positions that become neighbours; ``edges`` (position, position, LCP) come in descending LCP."""
    parent: dict[int, int] = {}
    classes: dict[int, PositionSet] = {}
    found = []

    def root(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent[x]
        return top

    for a, b, lcp in edges:
        a, b = root(a), root(b)
        small, large = classes.pop(a, None), classes.pop(b, None)
        if (small.size if small else 1) > (large.size if large else 1):
            a, b, small, large = b, a, large, small
        large = large or PositionSet(b)
        moved = set(small) if small else (a,)
        for p in small or (a,):
            before, after = large.add(p)
            # neighbours that moved together have met before, with a longer common prefix
            if before is not None and p - before <= lcp and before not in moved:
                found.append((before, p, lcp))
            if after is not None and after - p <= lcp and after not in moved:
                found.append((p, after, lcp))
        parent[a] = b
        classes[b] = large
    return found


def suffix_edges(h: np.ndarray, doc: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbours in suffix order (positions a, b of one document) with an LCP of at least ``least`` words.

    Ranks of windows of 1, 2, 4, ... words by prefix doubling over all documents of the block
    at once; a document's end ranks before every word.
    """
    n = len(h)
    end = np.searchsorted(doc, doc, side="right")
    ranks = np.unique(common._mix(h ^ (doc.astype(np.uint64) * _U(0x9E3779B97F4A7C15))), return_inverse=True)[1].astype(np.int64)
    levels, k, at = [ranks], 1, np.arange(n)
    while True:
        nxt = np.where(at + k < end, ranks[np.minimum(at + k, n - 1)] + 1, 0)
        distinct, ranks = np.unique(ranks * np.int64(n + 1) + nxt, return_inverse=True)
        k *= 2
        if len(distinct) == n:
            break
        levels.append(ranks)
    order = np.empty(n, np.int64)
    order[ranks] = at
    a, b = order[:-1], order[1:]
    same = doc[a] == doc[b]
    a, b = a[same], b[same]
    lcp = np.zeros(len(a), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        x, y = a + lcp, b + lcp
        ok = (x < end[a]) & (y < end[b])
        r = levels[level]
        ok &= r[np.minimum(x, n - 1)] == r[np.minimum(y, n - 1)]
        lcp += ok.astype(np.int64) << level
    wide = lcp >= least
    return a[wide], b[wide], lcp[wide]


def block_runs(h: np.ndarray, ptr: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> dict[int, list[tuple[int, int, int]]]:
    """Runs (start, length, period) of the texts of a block that have any, by start, then period."""
    least = least_lcp(min_length, min_exponent)
    n = max(len(h) - least + 1, 0)
    doc = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    at = np.flatnonzero(common.within(ptr, least, n)) if n else np.zeros(0, np.int64)
    if not len(at):
        return {}
    window = common._mix(common.ngrams(h, least)[at] ^ (doc[at].astype(np.uint64) * _U(0x9E3779B97F4A7C15)))
    order = np.argsort(window)
    twice = window[order][1:] == window[order][:-1]
    some = np.unique(doc[at[order[1:][twice]]])
    if not len(some):
        return {}
    own = np.isin(doc, some)
    h, where, doc = h[own], np.flatnonzero(own), doc[own]
    a, b, lcp = suffix_edges(h, doc, least)
    order = np.lexsort((-lcp, doc[a]))
    a, b, lcp = a[order], b[order], lcp[order]
    borders = np.flatnonzero(np.concatenate([[True], doc[a][1:] != doc[a][:-1], [True]])) if len(a) else [0]
    out = {}
    for x, y in zip(borders[:-1], borders[1:], strict=True):
        d = int(doc[a[x]])
        found = neighbours(zip(a[x:y].tolist(), b[x:y].tolist(), lcp[x:y].tolist(), strict=True))
        if not found:
            continue
        i, j, shared = np.array(found, np.int64).T
        q, first = j - i, int(ptr[d])
        begins = (where[i] == first) | (h[i - 1] != h[j - 1])
        keep = begins & (shared >= (min_exponent - 1) * q) & (shared + q >= min_length)
        runs: dict[tuple[int, int], int] = {}
        for s, length, period in zip((where[i] - first)[keep].tolist(), (shared + q)[keep].tolist(), q[keep].tolist(), strict=True):
            runs[s, length] = min(period, runs.get((s, length), period))
        if runs:
            out[d] = sorted(((s, length, q) for (s, length), q in runs.items()), key=lambda r: (r[0], r[2]))
    return out


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """True for the words that no run covers behind its first period."""
    marks = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        marks[start + period] += 1
        marks[start + length] -= 1
    return np.cumsum(marks)[:n] == 0


def collapse(docs: DataFrame, text: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """Every row of ``docs`` with ``n_words``, ``runs`` (structs of start, length and period in words, by start,
    then period) and ``collapsed`` (the words that no run covers behind its first period, joined by one space) added.

    Same-named columns are replaced, all others kept. Null, empty and blank texts have no words
    and no runs; repeated rows are treated alike. A text is worked on whole, however long.
    """
    df = common.passable(docs.drop(*ADDED))
    kept = df.columns
    df = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{text}`").alias("text"))
    schema = pa.schema([*to_arrow_schema(df.select("row").schema), ("n_words", pa.int64()), ("runs", pa.list_(RUN)), ("collapsed", pa.string())])

    def work(batches):
        for b in common.blocks(batches):
            buf, off = common.texts_buffer(b.column("text"))
            starts, ends, ptr = common.word_bounds(buf, off)
            found = block_runs(common.word_hashes(buf, starts, ends), ptr, min_length, min_exponent)
            data, counts, runs, left = buf.tobytes(), np.diff(ptr), [], []
            for d in range(len(counts)):
                own = found.get(d, [])
                words = data[off[d]: off[d + 1]].split()
                if own:
                    words = [words[i] for i in np.flatnonzero(kept_words(len(words), own))]
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in own])
                left.append(b" ".join(words).decode())
            cols = [b.column("row"), pa.array(counts, pa.int64()), pa.array(runs, pa.list_(RUN)), pa.array(left, pa.string())]
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)

    row = df.schema["row"].dataType.simpleString()
    got = df.mapInArrow(work, f"row {row}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    return got.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], *ADDED)


def strongest(runs: str = "runs") -> Column:
    """The run of greatest length by period (exact; the first of equals), null if there is none."""
    return F.expr(f"aggregate(`{runs}`, CAST(NULL AS struct<start: bigint, length: bigint, period: bigint>), "
                  "(a, x) -> CASE WHEN a IS NULL OR x.length * a.period > a.length * x.period THEN x ELSE a END)")


def planted(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """A tenth of the texts (crc32 of the id divisible by 10) made periodic from a word on, as test rows for runs.

    With ``g = floor(crc32 / 10)`` and ``n`` words, the words from ``a = g % n`` on repeat with
    period ``1 + floor((n - a) / (3 + g % 8))``. Such texts are joined by one space; all others,
    also those without words or id, stay as they are.
    """
    words = r"array_remove(split(`{}`, '[\\x20\\x09-\\x0D]+', -1), '')".format(text)
    again = f"""get(transform(array({words}), w -> CASE WHEN size(w) = 0 THEN `{text}` ELSE
        get(transform(array(named_struct('a', CAST(g % size(w) AS INT), 'p', CAST(1 + (size(w) - g % size(w)) DIV (3 + g % 8) AS INT))), k ->
            array_join(transform(sequence(0, size(w) - 1), i -> get(w, CASE WHEN i < k.a THEN i ELSE k.a + (i - k.a) % k.p END)), ' ')), 0) END), 0)"""
    draw = f"crc32(CAST(`{id_col}` AS STRING))"
    again = again.replace("g %", f"({draw} DIV 10) %")
    return docs.withColumn(text, F.expr(f"CASE WHEN {draw} % 10 = 0 THEN {again} ELSE `{text}` END"))
