"""Encoding, packing, substring dedup, Jaccard join, scoring: against brute force on a small corpus."""

import hashlib
import math
import random
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from equityspark.llm import bpe, common, jaccard, packing, ppm, substring

WORD = re.compile(r"[^\x20\x09-\x0d]+")
FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference_encoder():
    tokens = bpe.read_ranks(RANKS)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})


def test_bpe_equals_tiktoken_and_round_trips(docs, corpus, reference_encoder):
    got = bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN).collect()
    want = Counter((i, tuple(reference_encoder.encode_ordinary(t or "")), (t or "").encode()) for i, t in corpus)
    assert Counter((r.doc_id, tuple(r.ids), bytes(r.data)) for r in got) == want
    coded = bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    assert coded.columns.count("ids") == 1 and "n_words" in coded.columns
    back = bpe.decode(coded.select("doc_id", "ids"), RANKS, public_tokenizers.PATTERN)
    assert Counter((r.doc_id, bytes(r.data)) for r in back.collect()) == Counter((i, (t or "").encode()) for i, t in corpus)


def test_bpe_random_and_long_pieces(reference_encoder):
    coder = bpe.Coder(bpe.read_ranks(RANKS), public_tokenizers.PATTERN, remembered=50)
    rng = random.Random(3)
    for size in [0, 1, 5, 40, 200, 300, 900, 20000]:
        for alphabet in ("ab", "abé漢 \n'12", "thernoi", "\x1c\x85 \ta"):
            text = "".join(rng.choice(alphabet) for _ in range(size))
            ids, border = coder.encode([text, "", text[::-1]])
            for k, t in enumerate((text, "", text[::-1])):
                assert ids[border[k]: border[k + 1]].tolist() == reference_encoder.encode_ordinary(t)
            assert coder.decode(ids, border) == [text.encode(), b"", text[::-1].encode()]


def test_bpe_empty_table(no_docs):
    assert bpe.round_trip(no_docs, RANKS, public_tokenizers.PATTERN).count() == 0


def test_packing_pieces_and_sequences(docs, corpus):
    path = public_tokenizers.path("byte_bpe_50k.json")
    parts = common.written(packing.pieces(docs, path, public_tokenizers.PATTERN, with_ids=True), "t")
    packed = packing.pack(parts)
    rows = packed.collect()
    tok = Tokenizer.from_file(path)
    want = Counter()
    for i, t in corpus:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        for a in range(0, len(ids), 2048):
            piece = ids[a: a + 2048]
            want[(i, a, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes()), len(ids))] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for s in by.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 2048
    assert sorted(by) == list(range(len(by)))
    for r in packing.sequences(packed).collect():
        assert len(r.ids) == sum(n for _, n in by[r.sequence_id])


def test_packing_added_token_text_and_odd_spaces():
    path = public_tokenizers.path("byte_bpe_50k.json")
    spec = packing.read_tokenizer(path)
    enc = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=spec["ranks"], special_tokens=spec["added"])
    tok = Tokenizer.from_file(path)
    for t in ("a<|endoftext|>b <|endoftext|>", "\x1c \x1d\x85​ a", "𝔘 ñ ٣", "it's  don't\n\n x", "﻿á"):
        assert enc.encode(t, allowed_special="all") == tok.encode(t, add_special_tokens=False).ids


def test_packing_patterns_use_every_piece_once():
    rng = random.Random(1)
    for size in (8, 64):
        histogram = {n: rng.randint(1, 40) for n in range(1, size + 1) if rng.random() < 0.7}
        packs = packing.patterns(histogram, size)
        used = Counter()
        for p, c in packs:
            assert sum(p) <= size and c > 0
            for n in p:
                used[n] += c
        assert used == Counter(histogram)
    assert packing.patterns({}, 8) == []
    with pytest.raises(ValueError):
        packing.patterns({9: 1}, 8)


def test_packing_empty_table(no_docs):
    parts = packing.pieces(no_docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    assert packing.pack(parts).count() == 0


def brute_repeats(rows, window=13):
    first = {}
    ident = lambda i: 2**63 - 1 if i is None else i
    split = [(ident(i), WORD.findall(t or "")) for i, t in rows]
    for i, w in split:
        for j in range(len(w) - window + 1):
            k = tuple(w[j: j + window])
            first[k] = min(first.get(k, i), i)
    out = Counter()
    for (i, t), (key, w) in zip(rows, split, strict=True):
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if first[tuple(w[j: j + window])] < key:
                gone[j: j + window] = [True] * window
        out[(i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))] += 1
    return out


def test_substring_equals_brute_force(docs, corpus):
    cut = substring.repeats(docs)
    got = Counter((r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), r.kept) for r in cut.collect())
    assert got == brute_repeats(corpus)
    assert cut.columns.count("kept") == 1 and "score" in cut.columns
    for r in cut.collect():
        ends = [(s.start, s.end) for s in r.spans]
        assert ends == sorted(ends) and all(a < b for a, b in ends) and all(x[1] < y[0] for x, y in zip(ends, ends[1:], strict=False))


def test_substring_empty_table(no_docs):
    assert substring.repeats(no_docs).count() == 0


def brute_join(rows, k=5, threshold=80):
    sets = []
    for i, t in rows:
        w = WORD.findall((t or "").translate(FOLD))
        sets.append(frozenset(tuple(w[j: j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            same = len(sets[a] & sets[b])
            if same and 100 * same >= threshold * (len(sets[a]) + len(sets[b]) - same):
                up[top(a)] = top(b)
    least = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            least[top(x)] = min(least.get(top(x), i), i)
    return Counter((i, len(sets[x]), least.get(top(x)) if sets[x] else i) for x, (i, _) in enumerate(rows))


def test_jaccard_equals_brute_force(docs, corpus):
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(docs).collect())
    assert got == brute_join(corpus)


def test_jaccard_chain_of_near_copies_and_hot_passage(spark):
    """A chain a-b-c... whose ends are dissimilar, short sets around the boundary, and a passage in all texts."""
    rng = random.Random(9)
    hot = [f"h{i}" for i in range(40)]
    rows, w = [], [f"w{i}" for i in range(200)]
    for i in range(30):
        rows.append((i, " ".join(w)))
        at = (i * 6) % 190
        w[at: at + 4] = [f"v{i}{j}" for j in range(4)]
    for i in range(100, 160):
        rows.append((i, " ".join([f"u{rng.randrange(10**9)}" for _ in range(30)] + hot)))
    for i in range(200, 260):
        n = rng.randint(5, 30)
        start = rng.randint(0, 3)
        rows.append((i, " ".join(f"s{j}" for j in range(start, start + n))))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(df).collect()) == brute_join(rows)


@pytest.mark.parametrize("block", [1 << 20, 3000, 400])
def test_jaccard_counts_every_link(spark, corpus, block, monkeypatch):
    """A group of near copies whose members do not all link with each other, copies of them and a chain, as one block and as many."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(11)
    rows, w = list(corpus), [f"w{i}" for i in range(60)]
    for i in range(300, 340):
        near = w[: rng.randint(45, 60)]
        for _ in range(rng.randint(0, 3)):
            near[rng.randrange(len(near))] = f"z{rng.randrange(5)}"
        rows += [(i, " ".join(near))] * rng.randint(1, 3)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sets = []
    for _, t in rows:
        v = WORD.findall((t or "").translate(FOLD))
        sets.append({tuple(v[j: j + 5]) for j in range(len(v) - 4)} if len(v) >= 5 else {tuple(v)} if v else set())
    n = [sum(1 for j, b in enumerate(sets) if j != i and a and 5 * len(a & b) >= 4 * len(a | b)) for i, a in enumerate(sets)]
    got = jaccard.join(df).collect()
    assert Counter((r.doc_id, r.n_links) for r in got) == Counter((r[0], x) for r, x in zip(rows, n, strict=True))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_join(rows)


def test_jaccard_boundary_by_cost():
    assert jaccard.boundary({10: 100, 500: 10}, 0.0, 80) == 0  # lists without repetition are cheapest
    assert jaccard.boundary({10: 1000, 500: 10}, 50.0, 80) >= 10  # repetitive lists: subsets pay for small sets


@pytest.mark.parametrize("light", [0, 12, 60, 256])
def test_jaccard_any_boundary_gives_the_same(spark, docs, corpus, light, monkeypatch):
    monkeypatch.setattr(jaccard, "boundary", lambda *a: light)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(docs).collect())
    assert got == brute_join(corpus)


def test_jaccard_empty_table(no_docs):
    assert jaccard.join(no_docs).count() == 0


def test_ppm_equals_brute_force(docs, corpus):
    got = sorted(((r.doc_id is None, r.doc_id, r.text or "", r) for r in ppm.score(docs).collect()), key=lambda x: (x[0], x[1] or 0, x[2]))
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    rows = sorted(corpus, key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))
    count, after = Counter(), [defaultdict(Counter) for _ in range(ppm.ORDER + 1)]
    for i, t in rows:
        if not held(i):
            text = (t or "").translate(FOLD)
            count.update([*WORD.findall(text), None])
            b = b"\0" * ppm.ORDER + text.encode()
            for p in range(ppm.ORDER, len(b)):
                for j in range(ppm.ORDER + 1):
                    after[j][b[p - j: p]][b[p]] += 1
    n, v = sum(count.values()), len(count)

    def cost(ctx, s):
        out, gone = 0.0, set()
        for j in range(ppm.ORDER, -1, -1):
            seen = after[j].get(ctx[len(ctx) - j:])
            if not seen:
                continue
            rest = {x: c for x, c in seen.items() if x not in gone}
            total = sum(rest.values()) + len(rest)
            if s in rest:
                return out + math.log10(rest[s] / total)
            if rest:
                out += math.log10(len(rest) / total)
            gone = set(seen)
        return out - math.log10(256 - len(gone))

    assert abs(sum(10 ** cost(b"her ", s) for s in range(256)) - 1) < 1e-9
    assert len(got) == len(rows)
    for (i, t), (_, gi, gt, r) in zip(rows, got, strict=True):
        assert (i, t or "") == (gi, gt)
        text = (t or "").translate(FOLD)
        w = [*WORD.findall(text), None]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(w), sum(count[x] > 0 for x in w), n)
        assert abs(r.base_score - sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)) < 1e-6
        b = b"\0" * ppm.ORDER + text.encode()
        assert abs(r.score - sum(cost(b[p - ppm.ORDER: p], b[p]) for p in range(ppm.ORDER, len(b)))) < 1e-6


def test_ppm_empty_table_and_bounded_trie(no_docs, docs):
    assert ppm.score(no_docs).count() == 0
    small = ppm.score(docs, max_nodes=50).where("score < 0").count()
    assert small == ppm.score(docs).where("score < 0").count()


def test_ppm_leaves_no_gram_out(docs):
    """Scores do not depend on how many grams are held at a time."""
    few, all_ = ([(r.doc_id or 0, r.text or "", round(r.score, 6)) for r in ppm.score(docs, max_nodes=n).collect()] for n in (50, ppm.MAX_NODES))
    assert sorted(few) == sorted(all_)


def test_word_hashes_follow_words():
    import pyarrow as pa

    texts = ["a b", None, "", "b a", "é" * 3 + " a", "x" * 3_000_000 + " b"]
    buf, off = common.texts_buffer(pa.array(texts))
    s, e, ptr = common.word_bounds(buf, off)
    h = common.word_hashes(buf, s, e)
    assert np.diff(ptr).tolist() == [2, 0, 0, 2, 2, 2]
    assert h[0] == h[3] == h[5] and h[1] == h[2] == h[7] and len(set(h.tolist())) == 4


def test_queries_digests(spark, corpus):
    """The op4 digest columns on the smallest table."""
    from equityspark.llm import queries

    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    want = Counter((i, n, m, hashlib.sha256(k.encode()).hexdigest()) for (i, n, m, k), c in brute_repeats(rows).items() for _ in range(c))
    got = queries.QUERIES["op4_substring_dedup"](spark, d)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()) == want
    near = queries.QUERIES["op10_jaccard_join"](spark, d)
    assert Counter(tuple(r) for r in near.collect()) == brute_join(rows)
    coded = queries.QUERIES["op1_byte_bpe"](spark, d).where(F.col("doc_id") < 5).collect()
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(bpe.read_ranks(RANKS))}, special_tokens={})
    texts = dict(rows)
    for r in coded:
        ids = enc.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_survey_keeps_one_packed_text_per_set(spark):
    import zstandard

    from equityspark.llm import jaccard

    long = "a b c d e f g h"
    docs = spark.createDataFrame([(1, long), (2, long.upper()), (3, "x y"), (4, None), (5, " ")], "doc_id long, text string").coalesce(1)
    rows = jaccard._survey(docs, 5).where("n <= 0").collect()
    packed = [r for r in rows if r["body"] is not None]
    assert [zstandard.ZstdDecompressor().decompress(bytes(r["body"])).decode() for r in sorted(packed, key=lambda r: r["doc_id"])] == [long, "x y"]
    # whole sets are compared from the packed texts alone
    pairs = spark.createDataFrame([(packed[0]["item"], packed[0]["item"]), (packed[0]["item"], packed[1]["item"])], "a long, b long")
    sets = spark.createDataFrame([(r["item"], r["body"]) for r in packed], "item long, body binary")
    assert [tuple(r) for r in jaccard.verify(pairs, sets, 5, 80).collect()] == [(packed[0]["item"], packed[0]["item"])]
