"""N-gram Jaccard join as a size-aware heavy-light join.

A document is the set of its distinct word shingles; equal sets are one class. Two classes
that reach the threshold share at least ``t = ceil(threshold * size)`` shingles of either,
so, in one global order of shingles, they share one of the first ``size - t + 1`` and two
of the first ``size - t + 2``. Small sets enumerate all subsets of two shingles of that
prefix, large sets go to the inverted lists of its single shingles; sets just below the
boundary do both, as they may meet a large one. The boundary is the size of least cost,
from the size histogram and the measured repetition of shingles.

The order puts often seen shingles last (a bounded table of the most frequent ones is sent
to all tasks; it only changes the order, never the result), so lists stay short for
passages that many documents share.

Lists are scanned in two rounds, because the result is the components of the link graph
and not all pairs of a group of copies: first each member is compared with the list's
centre (the set with the fewest rare shingles among those of about its size), then, after the links found are joined to components, members
of different components. Pairs whose sizes or parity signatures rule a link out are left
aside (a bound, never a guess); every other candidate pair that could join two components is verified
on the whole sets, so no link between components is lost.

All links lie inside components, so they are counted there: every two different sets of a component whose
sizes allow a link are compared as a whole, in blocks of bounded size, and only counts leave a block.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equityspark.llm import common

SIGNATURE = 8  # 64-bit words of a set's signature
FREQUENT = 1 << 20  # most entries of the table of frequent shingles
OFTEN = 8  # documents of one batch run or more that make a shingle frequent
PAIR_COST = 20  # cost of one more candidate pair, in list entries
LIGHT_MOST = 256  # largest size that may count as small
BLOCK = 1 << 20  # shingles of the sets of one component that are compared as one block
SET_COST = 256  # what a set counts for in a block besides its shingles
_U = np.uint64


def shingle_sets(text: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text and the borders of the texts."""
    buf, off = common.texts_buffer(text)
    buf = common.lower_bytes(buf)
    starts, ends, ptr = common.word_bounds(buf, off)
    h = common.word_hashes(buf, starts, ends)
    n = max(len(h) - k + 1, 0)
    at = np.flatnonzero(common.within(ptr, k, n)) if n else np.zeros(0, np.int64)
    keys = common.ngrams(h, k)[at] if n else np.zeros(0, np.uint64)
    docs = np.searchsorted(ptr, at, side="right") - 1
    size = np.diff(ptr)
    short = np.flatnonzero((size > 0) & (size < k))
    if len(short):
        # fewer words than a shingle: the whole sequence is the only one
        whole = np.array([common.ngrams(h[ptr[d]: ptr[d + 1]], int(size[d]))[0] + _U(size[d]) for d in short], np.uint64)
        keys, docs = np.concatenate([keys, whole]), np.concatenate([docs, short])
    order = np.lexsort((keys, docs))
    keys, docs = keys[order], docs[order]
    new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])]) if len(keys) else np.zeros(0, bool)
    keys, docs = keys[new], docs[new]
    return keys, np.searchsorted(docs, np.arange(len(size) + 1))


def set_ids(keys: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """64-bit id of each set (0: empty)."""
    total = np.concatenate([[_U(0)], np.cumsum(common._mix(keys), dtype=np.uint64)])
    n = np.diff(ptr).astype(np.uint64)
    out = common._mix((total[ptr[1:]] - total[ptr[:-1]]) + n)
    return np.where(n == 0, _U(0), out).view(np.int64)


def least(n: np.ndarray | int, threshold: int) -> np.ndarray | int:
    """Smallest overlap a set of ``n`` must have with any partner, for a threshold in percent."""
    return (threshold * n + 99) // 100


def signatures(keys: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Parity bits of each set (sets x ``SIGNATURE`` int64): bit b tells whether an odd number of shingles falls on it.

    Two sets differ in at least as many shingles as their signatures in bits.
    """
    n, bits = len(ptr) - 1, 64 * SIGNATURE
    owner = np.repeat(np.arange(n), np.diff(ptr))
    odd = np.bincount(owner * bits + (common._mix(keys + _U(7)) % _U(bits)).astype(np.int64), minlength=n * bits) & 1
    return np.packbits(odd.astype(np.uint8).reshape(n, bits), axis=1).view(np.int64)


def most_apart(n_a, n_b, threshold: int):
    """Largest number of shingles in which sets of these sizes may differ and still reach the threshold."""
    return n_a + n_b - 2 * ((threshold * (n_a + n_b) + 99 + threshold) // (100 + threshold))


def _survey(docs: DataFrame, k: int) -> DataFrame:
    """One scan: per document (id, set, minus size, signature, compressed text: once per batch and set), and shingles seen
    in several sets of a batch run with their counts."""

    def run(batches):
        pool, held, z = [], 0, zstandard.ZstdCompressor(level=1)

        def repeated():
            both = np.concatenate(pool)
            key, count = np.unique(both, return_counts=True)
            key, count = key[count > 1], count[count > 1]
            return pa.RecordBatch.from_arrays(
                [pa.nulls(len(key), pa.int64()), pa.array(key.view(np.int64)), pa.array(count.astype(np.int64))], names=["doc_id", "item", "n"]
            ).append_column("sig", pa.nulls(len(key), pa.list_(pa.int64()))).append_column("body", pa.nulls(len(key), pa.binary()))

        for b in common.blocks(batches, 2 << 20):
            keys, ptr = shingle_sets(b.column("text"), k)
            ids, n = set_ids(keys, ptr), np.diff(ptr)
            sig = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * SIGNATURE, pa.int32()), pa.array(signatures(keys, ptr).ravel()))
            one = np.unique(ids, return_index=True)[1]  # equal sets count once
            body = [None] * len(n)
            with_set = np.sort(one[n[one] > 0])
            for i, t in zip(with_set.tolist(), b.column("text").take(pa.array(with_set)).to_pylist(), strict=True):
                body[i] = z.compress(t.encode())
            yield pa.RecordBatch.from_arrays([b.column("_row"), pa.array(ids), pa.array(-n.astype(np.int64)), sig, pa.array(body, pa.binary())], names=["doc_id", "item", "n", "sig", "body"])
            pool.append(np.concatenate([keys[ptr[i]: ptr[i + 1]] for i in one]) if len(one) else keys)
            held += len(pool[-1])
            if held > 1 << 22:
                yield repeated()
                pool, held = [], 0
        if pool:
            yield repeated()

    return docs.select(F.col("doc_id").cast("long").alias("_row"), "text").mapInArrow(run, "doc_id long, item long, n long, sig array<long>, body binary")


def boundary(sizes: dict[int, int], repeat: float, threshold: int) -> int:
    """Largest size that counts as small: least cost of subsets enumerated plus lists scanned.

    ``repeat`` is the mean number of further sets in a shingle's list, each of which is a
    pair to verify; two-shingle subsets are taken to meet only in similar sets.
    """
    best, cost = 0, math.inf
    for x in range(0, LIGHT_MOST + 1):
        c = 0.0
        for n, many in sizes.items():
            miss = n - least(n, threshold)
            if n <= x:
                c += many * (miss + 2) * (miss + 1) / 2
            if 100 * n >= threshold * (x + 1):
                c += many * (miss + 1) * (1 + PAIR_COST * repeat)
        if c < cost:
            best, cost = x, c
    return best


def _postings(docs: DataFrame, k: int, threshold: int, light: int, frequent) -> DataFrame:
    """(key, set, size, rare shingles) of every set that can have a partner other than its equals."""

    def run(batches):
        often, weight = frequent.value
        for b in common.blocks(batches):
            keys, ptr = shingle_sets(b.column("text"), k)
            ids, size = set_ids(keys, ptr), np.diff(ptr)
            if len(keys) == 0:
                continue
            owner = np.repeat(np.arange(len(size)), size)
            rank = np.zeros(len(keys), np.int64)
            if len(often):
                at = np.minimum(np.searchsorted(often, keys), len(often) - 1)
                rank = np.where(often[at] == keys, weight[at], 0)
            order = np.lexsort((keys, rank, owner))
            keys = keys[order]
            pos = np.arange(len(keys)) - np.repeat(ptr[:-1], size)
            miss = size - least(size, threshold)
            rare = np.add.reduceat(np.concatenate([rank == 0, [False]]).astype(np.int32), ptr[:-1]) * (size > 0)
            first = np.zeros(len(size), bool)
            first[np.unique(ids, return_index=True)[1]] = True
            # the smallest size with a partner of another size: below it only equal sets reach the threshold
            able = first & (100 * size >= threshold * (size + 1))
            single = able & (100 * size >= threshold * (light + 1))
            take = single[owner] & (pos <= miss[owner])
            out_key, out_set = [keys[take]], [owner[take]]
            for m in np.unique(miss[able & (size <= light)]):
                # all subsets of two of the prefix, for the small sets with this prefix length
                rows = np.flatnonzero(able & (size <= light) & (miss == m))
                prefix = keys[ptr[rows][:, None] + np.arange(m + 2)]
                i, j = np.triu_indices(m + 2, 1)
                a, z = np.minimum(prefix[:, i], prefix[:, j]), np.maximum(prefix[:, i], prefix[:, j])
                out_key.append(common._mix(a * _U(0xD6E8FEB86659FD93) + z + _U(1)).ravel())
                out_set.append(np.repeat(rows, len(i)))
            at = np.concatenate(out_set)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(out_key).view(np.int64)), pa.array(ids[at]), pa.array(size[at].astype(np.int32)), pa.array(rare[at].astype(np.int32))], names=["key", "item", "n", "rare"])

    return docs.select("text").mapInArrow(run, "key long, item long, n int, rare int")


def _runs(batches):
    """Merge sorted batches so that no key is cut; a long list is carried as arrays, never as rows."""
    rest = None
    for b in batches:
        if b.num_rows == 0:
            continue
        cols = [np.asarray(c) if not pa.types.is_list(c.type) else np.asarray(c.flatten()).reshape(b.num_rows, -1) for c in b.columns]
        if rest is not None:
            cols = [np.concatenate([r, c]) for r, c in zip(rest, cols, strict=True)]
        cut = int(np.searchsorted(cols[0], cols[0][-1], side="left"))
        rest = [c[cut:] for c in cols]
        if cut:
            yield [c[:cut] for c in cols]
    if rest is not None:
        yield rest


def _sizes_fit(n: np.ndarray, other: int, threshold: int) -> np.ndarray:
    """Sizes that allow the threshold with a set of size ``other``."""
    return 100 * np.minimum(n, other) >= threshold * np.maximum(n, other)


def _scan_lists(postings: DataFrame, parts: int, threshold: int) -> DataFrame:
    """Star pairs (``a`` < ``b``: each member with the list's centre of about its size; ``list`` null) and the members of lists of three or more."""

    def run(batches):
        seen: set[bytes] = set()
        pairs: list[np.ndarray] = []
        held = 0

        def flush():
            p = np.unique(np.concatenate(pairs), axis=0)
            return pa.RecordBatch.from_arrays([pa.nulls(len(p), pa.int64()), pa.array(p[:, 0]), pa.array(p[:, 1]), pa.nulls(len(p), pa.int32())], names=["list", "a", "b", "n"])

        for key, rare, item, n in _runs(batches):
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (item[1:] != item[:-1])])
            key, item, n = key[new], item[new], n[new]
            edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
            out: list[np.ndarray] = []
            sizes: list[np.ndarray] = []
            names: list[int] = []
            for i in np.flatnonzero(np.diff(edge) > 1):
                a, z = int(edge[i]), int(edge[i + 1])
                who, size = item[a:z], n[a:z]
                # the set with the fewest rare shingles is the likeliest origin of the copies
                left = np.arange(z - a)
                while len(left) > 1:
                    near = _sizes_fit(size[left], size[left[0]], threshold)
                    mates = left[near][1:]
                    if len(mates):
                        p = np.stack([np.full(len(mates), who[left[0]]), who[mates]], axis=1)
                        p.sort(axis=1)
                        pairs.append(p)
                        held += len(p)
                    left = left[~near]
                if z - a > 2:
                    name = who.tobytes()
                    mark = hash(name)
                    if mark not in seen:
                        if len(seen) < 1 << 20:
                            seen.add(mark)
                        out.append(who)
                        sizes.append(size)
                        names += [int(key[a])] * (z - a)
            if out:
                who = np.concatenate(out)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(who), pa.nulls(len(who), pa.int64()), pa.array(np.concatenate(sizes), pa.int32())], names=["list", "a", "b", "n"])
            if held > 1 << 20:
                yield flush()
                pairs, held = [], 0
        if pairs:
            yield flush()

    dealt = postings.select("key", "rare", "item", "n").repartition(parts, "key").sortWithinPartitions("key", "rare", "item")
    return dealt.mapInArrow(run, "list long, a long, b long, n int")


def verify(pairs: DataFrame, sets: DataFrame, k: int, threshold: int) -> DataFrame:
    """Those (a, b) whose whole sets reach the threshold; ``sets`` has (item, body), the compressed text of one document with the set."""
    left = pairs.join(sets.withColumnsRenamed({"item": "a", "body": "body_a"}), "a")
    both = left.join(sets.withColumnsRenamed({"item": "b", "body": "body_b"}), "b").select("a", "b", "body_a", "body_b")

    def run(batches):
        z = zstandard.ZstdDecompressor()
        for b in batches:
            for c in range(0, b.num_rows, 256):
                part = b.slice(c, 256)
                bodies = [*part.column("body_a").to_pylist(), *part.column("body_b").to_pylist()]
                once = {x: i for i, x in enumerate(dict.fromkeys(bodies))}
                keys, ptr = shingle_sets(pa.array([z.decompress(x).decode() for x in once], pa.large_string()), k)
                ok = []
                for x, y in zip(bodies[: part.num_rows], bodies[part.num_rows:], strict=True):
                    p, q = (keys[ptr[once[v]]: ptr[once[v] + 1]] for v in (x, y))
                    same = len(np.intersect1d(p, q, assume_unique=True))
                    ok.append(100 * same >= threshold * (len(p) + len(q) - same))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], names=["a", "b"]).filter(pa.array(ok))

    return both.mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(item, label) of every linked item: the smallest item it can reach."""
    edges = common.written(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = common.written(edges.groupBy(F.col("a").alias("item")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        # smallest label among the neighbours, then the label of that label
        near = edges.join(labels, edges.b == labels.item).groupBy(F.col("a").alias("item")).agg(F.min("label").alias("near"))
        step = labels.join(near, "item").select("item", "label", F.least("label", "near").alias("new"))
        jump = labels.select(F.col("item").alias("new"), F.col("label").alias("far"))
        step = common.written(step.join(jump, "new").select("item", "label", F.least("new", "far").alias("new")), "labels")
        moved = step.where("label <> new").limit(1).count()
        labels = step.select("item", F.col("new").alias("label"))
        if not moved:
            return labels


def _possible(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Those (a, b) whose sizes and signatures allow the threshold."""
    one = lambda x: sets.select(F.col("item").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"s_{x}"))
    apart = F.expr("aggregate(zip_with(s_a, s_b, (x, y) -> bit_count(x ^ y)), 0, (t, x) -> t + x)")
    most = F.expr(f"n_a + n_b - 2 * (({threshold} * (n_a + n_b) + {99 + threshold}) div {100 + threshold})")
    return pairs.join(one("a"), "a").join(one("b"), "b").where(apart <= most).select("a", "b")


def _cross_pairs(lists: DataFrame, labels: DataFrame, sets: DataFrame, parts: int, threshold: int) -> DataFrame:
    """Pairs of list members in different components whose sizes and signatures allow a link."""
    open_ = lists.join(labels, "item", "left").withColumn("label", F.coalesce("label", "item"))
    mixed = open_.groupBy("list").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("list")
    rows = open_.join(mixed, "list").join(sets.select("item", "sig"), "item").select("list", "n", "item", "label", "sig")

    def run(batches):
        for name, n, item, label, sig in _runs(batches):
            edge = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1], [True]]))
            n = n.astype(np.int64)
            out = []
            for a, z in zip(edge[:-1], edge[1:], strict=True):
                for i in range(a, z - 1):
                    stop = a + int(np.searchsorted(n[a:z], n[i] * 100 // threshold, side="right"))
                    other = np.arange(i + 1, stop)[label[i + 1: stop] != label[i]]
                    if len(other):
                        apart = np.bitwise_count(sig[other] ^ sig[i]).sum(axis=1, dtype=np.int64)
                        other = other[apart <= most_apart(n[other], n[i], threshold)]
                        out.append(np.stack([np.full(len(other), item[i]), item[other]], axis=1))
            if out:
                p = np.concatenate(out)
                p.sort(axis=1)
                p = np.unique(p, axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], names=["a", "b"])

    dealt = rows.repartition(parts, "list").sortWithinPartitions("list", "n", "item")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _block_links(key, table: pa.Table, k: int, threshold: int) -> pa.Table:
    """(item, links) of the sets of one pair of blocks: documents of other sets of the pair that reach the threshold with them."""
    _, band, step, s, t = (x.as_py() for x in key)
    table = table.sort_by("n")
    z = zstandard.ZstdDecompressor()
    keys, ptr = shingle_sets(pa.array([z.decompress(x).decode() for x in table.column("body").to_pylist()], pa.large_string()), k)
    n, copies = np.diff(ptr), np.asarray(table.column("copies"))
    words, flat = np.unique(keys, return_inverse=True)
    left = (np.asarray(table.column("band")) == band) & (np.asarray(table.column("slot")) == s)
    inside = step == 0 and s == t
    right = np.arange(len(n)) if inside else np.flatnonzero(~left)
    near = flat if inside else np.concatenate([flat[:0], *(flat[ptr[j]: ptr[j + 1]] for j in right)])
    at = np.concatenate([[0], np.cumsum(n[right])])
    links, mark = np.zeros(len(n), np.int64), np.zeros(len(words), bool)
    for i in np.flatnonzero(left):
        first = np.searchsorted(n[right], least(n[i], threshold))
        first, last = max(first, i + 1) if inside else first, np.searchsorted(n[right], n[i] * 100 // threshold, side="right")
        if first >= last:
            continue
        mark[flat[ptr[i]: ptr[i + 1]]] = True
        same = np.add.reduceat(mark[near[at[first]: at[last]]], at[first:last] - at[first], dtype=np.int64)
        mark[flat[ptr[i]: ptr[i + 1]]] = False
        other = right[first:last]
        other = other[100 * same >= threshold * (n[i] + n[other] - same)]
        links[i] += copies[other].sum()
        links[other] += copies[i]
    return pa.table({"item": table.column("item"), "links": pa.array(links)})


def link_counts(labels: DataFrame, sets: DataFrame, bodies: DataFrame, k: int, threshold: int, parts: int) -> DataFrame:
    """(item, links) of every linked set: the number of documents with another set that it links with.

    Two sets of a component are one link. A larger component is one block, or, above ``BLOCK``, blocks by band of sizes and
    hash; only sets of the same or of neighbouring bands can link, so each such pair of blocks is one group.
    """
    own = labels.join(sets.select("item", "n", "copies"), "item")
    cost = F.sum(F.col("n") + SET_COST)
    whole = own.groupBy("label").agg(F.count("*").alias("m"), F.sum("copies").alias("total"), cost.alias("cost"))
    own = own.join(whole, "label")
    two = own.where("m = 2").select("item", (F.col("total") - F.col("copies")).alias("links"))
    # a little wider than the threshold, so that rounding never puts two bands between sets that may link
    width = max(math.log(100 / threshold) * 1.001, 1e-3)
    band = F.when(F.col("cost") <= BLOCK, 0).otherwise(F.floor(F.log("n") / width)).cast("int")
    more = own.where("m > 2").select("label", "item", "copies", "n", band.alias("band"))
    slots = more.groupBy("label", "band").agg(F.ceil(cost / BLOCK).cast("int").alias("slots"))
    beside = lambda by, name: slots.select("label", (F.col("band") + by).alias("band"), F.col("slots").alias(name))
    slots = slots.join(beside(-1, "above"), ["label", "band"], "left").join(beside(1, "below"), ["label", "band"], "left")
    slot = F.pmod(F.xxhash64("item"), F.col("slots")).cast("int")
    pairs = F.expr("""concat(
        transform(sequence(0, slots - 1), x -> struct(band AS of, 0 AS step, least(slot, x) AS s, greatest(slot, x) AS t)),
        if(above IS NULL, array(), transform(sequence(0, above - 1), x -> struct(band AS of, 1 AS step, slot AS s, x AS t))),
        if(below IS NULL, array(), transform(sequence(0, below - 1), x -> struct(band - 1 AS of, 1 AS step, x AS s, slot AS t))))""")
    dealt = more.join(slots, ["label", "band"]).withColumn("slot", slot).withColumn("pair", F.explode(pairs))
    body = bodies.join(more.select("item"), "item", "left_semi").groupBy("item").agg(F.first("body").alias("body"))
    keys = ["label", "of", "step", "s", "t"]
    rows = dealt.select("label", "pair.*", "item", "copies", "n", "band", "slot").join(body, "item")
    many = rows.repartition(parts, *keys).groupBy(*keys).applyInArrow(lambda key, table: _block_links(key, table, k, threshold), "item long, links long")
    return two.union(many).groupBy("item").agg(F.sum("links").alias("links"))


def join(docs: DataFrame, k: int = 5, threshold: int = 80) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, n_links.

    Words are lower-cased A-Z and split on ASCII white space; a text of fewer than ``k``
    words is one shingle. Two rows link when 100 * |both| >= threshold * |either|;
    ``component_id`` is the smallest doc_id reachable by links. Null, empty and blank texts
    have no shingles and are linked with nothing. Repeated rows share their component; a
    row with a null doc_id gets the component of its class (null if the class has no id).
    ``n_links`` is the number of other rows that the row links with, its copies among them.
    """
    spark: SparkSession = docs.sparkSession
    docs = docs.select("doc_id", "text")
    parts = common.parts_for(docs)
    survey = common.written(_survey(docs, k), "sets")
    info = survey.where("n <= 0").select("doc_id", "item", (-F.col("n")).alias("n"), "sig")
    bodies = survey.where("body IS NOT NULL").select("item", "body")
    counts = common.written(survey.where("n > 0").groupBy("item").agg(F.sum("n").alias("n")), "counts")
    # shingles of the frequent table go last in the order, so the lists are those of the others
    met = counts.where(f"n < {OFTEN}").agg(F.sum(F.expr("n * (n - 1)"))).first()[0] or 0
    counts = counts.where(f"n >= {OFTEN}")
    top = counts.orderBy(F.desc("n"), "item").limit(FREQUENT).toArrow()
    often, weight = np.asarray(top["item"]).view(np.uint64), np.asarray(top["n"])
    order = np.argsort(often)
    # by powers of two: shingles of about one frequency keep their hash order
    frequent = spark.sparkContext.broadcast((often[order], np.log2(weight[order]).astype(np.int64)))
    sizes = {r[0]: r[1] for r in info.where(f"n BETWEEN 1 AND {2 * LIGHT_MOST}").select("item", "n").distinct().groupBy("n").count().collect()}
    total = info.agg(F.sum("n")).first()[0] or 0
    light = boundary(sizes, float(met) / max(total, 1), threshold)
    scan = common.written(_scan_lists(_postings(docs, k, threshold, light, frequent), parts, threshold), "lists")
    stars = scan.where("list IS NULL").select("a", "b").distinct()
    sets = common.written(info.where("n > 0").groupBy("item").agg(F.first("n").alias("n"), F.first("sig").alias("sig"), F.count("*").alias("copies")), "sets")
    links = common.written(verify(common.written(_possible(stars, sets, threshold), "pairs"), bodies, k, threshold), "links")
    labels = components(links)
    lists = scan.where("list IS NOT NULL").select("list", F.col("a").alias("item"), "n")
    rest = common.written(_cross_pairs(lists, labels, sets, parts, threshold).join(stars, ["a", "b"], "left_anti"), "pairs")
    more = common.written(verify(rest, bodies, k, threshold), "links")
    if more.limit(1).count():
        labels = components(links.union(more))
    counted = common.written(link_counts(labels, sets, bodies, k, threshold, parts), "counts")
    first = info.where("n > 0").groupBy("item").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    whole = first.join(labels, "item").groupBy("label").agg(F.min("first").alias("least"))
    found = first.join(labels.join(whole, "label").select("item", "least"), "item", "left")
    links = F.col("copies") - 1 + F.coalesce("links", F.lit(0))
    component = found.join(counted, "item", "left").select("item", F.coalesce("least", "first").alias("component_id"), links.alias("n_links"))
    return info.join(component, "item", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"))
