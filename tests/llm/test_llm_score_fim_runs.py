import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from equityspark.llm import common, fim, positive_unlabelled, runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


# ---- fill in the middle --------------------------------------------------


def plain_fim(doc_id, text, seed="42:"):
    text = text or ""
    tokens = TOKEN.findall(text)
    n = len(tokens)
    digest = hashlib.sha256(f"{seed}{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i: 8 * i + 8], 16) for i in range(4)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, z = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:z]), "".join(tokens[z:])
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fim_equals_plain_version_and_restores(docs, corpus):
    got = fim.restore(fim.transform(docs)).collect()
    assert len(got) == len(corpus)
    assert {"fixed", "kept", "score", "spans"} <= set(got[0].asDict())
    for r in got:
        n, form, p, m, out = plain_fim(r["doc_id"], r["text"])
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == (n, form, p, m, out)
        assert r["output_sha256"] == sha(out) and r["restored"] == (r["text"] or "") and r["restored_sha256"] == sha(r["text"] or "")


def test_fim_forms_sentinels_marks_and_odd_texts(spark, no_docs):
    odd = ["", None, " ", "\n\t", "a", " a", "a ", "é漢字 \x0b ü\n\n", "has <P> inside", "ends <", "<S", "<M> <P>", "<<P", "x" * 5000, "a b " * 800]
    rows = [(i, odd[i % len(odd)]) for i in range(600)] + [(None, "no id a b c"), (5, "again"), (5, "again")]
    got = fim.restore(fim.transform(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))).collect()
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain_fim(r["doc_id"], r["text"])
        assert r["restored"] == (r["text"] or "")
    assert fim.restore(fim.transform(no_docs)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab é\n\t<PSM>", max_size=40), st.integers(0, 60), st.integers(0, 60))
def test_piece_table_cuts_and_inverts(text, x, y):
    data = text.encode()
    a, z = sorted((min(x, len(data)), min(y, len(data))))
    parts = fim.PieceTable.of(data).cut([a, z])
    assert [p.tobytes() for p in parts] == [data[:a], data[a:z], data[z:]]
    twice = fim.PieceTable.joined(parts).cut([z])
    assert [t.tobytes() for t in twice] == [data[:z], data[z:]] and sum(map(len, parts)) == len(data)
    assert fim.PieceTable.joined(parts).sha256() == hashlib.sha256(data).hexdigest()
    if not any(s in data for s in fim.SENTINELS):
        for form in fim.ARRANGED:
            assert fim.unarrange(fim.arrange(parts, form).tobytes(), form).tobytes() == data


# ---- periodic runs -------------------------------------------------------


def brute_runs(words, min_length=24, min_exponent=3):
    n, found = len(words), {}
    for q in range(1, n // min_exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(min_length, min_exponent * q) and (i, length) not in found:
                found[i, length] = q  # the smallest period comes first
            i = j + 1
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_planted(doc_id, words):
    if doc_id is None:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def brute_kept(words, found):
    gone = set()
    for s, length, q in found:
        gone.update(range(s + q, s + length))
    return [w for i, w in enumerate(words) if i not in gone]


def own_runs(texts, **more):
    buf, off = common.texts_buffer(pa.array(texts))
    starts, ends, ptr = common.word_bounds(buf, off)
    found = runs.block_runs(common.word_hashes(buf, starts, ends), ptr, **more)
    return [found.get(i, []) for i in range(len(texts))]


def repetitive(rng, n):
    """Words with planted powers, nested powers and near misses."""
    out = []
    while len(out) < n:
        unit = [rng.choice("abc") for _ in range(rng.randint(1, 9))]
        part = unit * rng.randint(1, 9)
        if rng.random() < 0.5:
            part = (part + [rng.choice("abcd")]) * rng.randint(1, 5)
        if rng.random() < 0.3 and part:
            part[rng.randrange(len(part))] = "z"
        out += part[: rng.randint(1, len(part))] if rng.random() < 0.5 else part
    return out[:n]


def test_runs_equal_brute_force_on_repetitive_words():
    rng = random.Random(3)
    texts = [" ".join(repetitive(rng, rng.randint(0, 160))) for _ in range(150)] + ["", "a", "a " * 23, "a " * 24, "a b " * 12, "a b " * 40, "a b c d e f g h i " * 3]
    texts += [" ".join(rng.choice("ab") for _ in range(200)) for _ in range(30)]
    for text, got in zip(texts, own_runs(texts), strict=True):
        assert got == brute_runs(text.split()), text
    for text, got in zip(texts, own_runs(texts, min_length=6, min_exponent=2), strict=True):
        assert got == brute_runs(text.split(), 6, 2), text


def test_runs_of_long_periodic_texts():
    rng = random.Random(4)
    unit = [f"w{rng.randrange(10**6)}" for _ in range(700)]
    texts = ["x " * 30000, " ".join((unit * 12)[:8000]), " ".join(unit * 2 + ["end"])]
    got = own_runs(texts)
    assert got == [[(0, 30000, 1)], [(0, 8000, 700)], []]


@pytest.mark.parametrize("order", ["up", "down", "random"])
def test_position_set_gives_neighbours(order):
    rng = random.Random(order)
    values = rng.sample(range(10**6), 5000)
    values = sorted(values, reverse=order == "down") if order != "random" else values
    own, seen = runs.PositionSet(values[0]), [values[0]]
    for v in values[1:]:
        before, after = own.add(v)
        below, above = [x for x in seen[-50:] if x < v], [x for x in seen[-50:] if x > v]
        assert (not below or before >= max(below)) and (not above or after <= min(above))
        seen.append(v)
    assert list(own) == sorted(values) and own.size == len(values)


def test_collapse_frame_equals_brute_force(spark, docs, corpus, no_docs):
    got = runs.collapse(runs.planted(docs)).withColumn("best", runs.strongest()).collect()
    assert len(got) == len(corpus)
    texts = sorted(((i, t) for i, t in corpus), key=str)
    want = []
    for i, t in texts:
        words = brute_planted(i, WORD.findall(t or ""))
        found = brute_runs(words) if len(words) < 4000 else None
        want.append((i, len(words), found, " ".join(brute_kept(words, found)) if found is not None else None))
    rows = sorted(got, key=lambda r: str((r["doc_id"], r["n_words"])))
    for w in want:
        hit = [r for r in rows if r["doc_id"] == w[0] and r["n_words"] == w[1]]
        assert hit
        if w[2] is None:
            continue
        assert any([tuple(x) for x in r["runs"]] == w[2] and r["collapsed"] == w[3] for r in hit)
        best = max(w[2], key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
        assert any((tuple(r["best"]) if r["best"] else None) == best for r in hit)
    assert {"fixed", "score", "ids", "kept"} <= set(rows[0].asDict())
    assert runs.collapse(runs.planted(no_docs)).count() == 0


def test_planted_rows_are_periodic(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["aa", "bb", "cc", "dd"]) for _ in range(rng.randint(0, 90)))) for i in range(300)]
    got = runs.collapse(runs.planted(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    planted = 0
    for r in got:
        words = brute_planted(r["doc_id"], dict(rows)[r["doc_id"]].split())
        found = brute_runs(words)
        planted += bool(found)
        assert [tuple(x) for x in r["runs"]] == found and r["collapsed"] == " ".join(brute_kept(words, found))
    assert planted > 10


# ---- positive-unlabelled classifier --------------------------------------


def _quality_rows(n, rng, good_share=0.8):
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < good_share
        words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(40, 120))]
        if not good:
            kind = i % 3
            words = [w + "$%" for w in words] if kind == 0 else [w.upper() + "!" for w in words] if kind == 1 else words[:3] * 25
        rows.append((i, " ".join(words)))
        if rng.random() < 0.4:
            labels.append((i, int(good)))
    return rows, labels


def auc(pairs):
    s, y = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
    order = np.argsort(s)
    rank = np.empty(len(s))
    rank[order] = np.arange(len(s))
    n1 = y.sum()
    return (rank[y == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * (len(y) - n1))


def test_classifier_separates_held_out_rows_and_never_uses_negative_labels(spark):
    rng = random.Random(1)
    rows, labels = _quality_rows(900, rng)
    docs = spark.createDataFrame([(*r, 9.0, "x") for r in rows], "doc_id long, text string, score double, x string").repartition(4)
    quality = spark.createDataFrame(labels, "doc_id long, quality int")
    got = positive_unlabelled.score(docs, quality).collect()
    assert len(got) == 900 and got[0]["x"] == "x" and "text" not in got[0].asDict()
    known = dict(labels)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [(r["score"], known[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] in known]
    assert auc(held) > 0.95 and np.mean([p == y for _, y, p in held]) > 0.9
    # labels of held-out rows and negative labels change nothing
    other = spark.createDataFrame([(i, q if zlib.crc32(str(i).encode()) % 5 else 1 - q) for i, q in labels if q or zlib.crc32(str(i).encode()) % 5 == 0], "doc_id long, quality int")
    again = {r["doc_id"]: r["score"] for r in positive_unlabelled.score(docs, other).collect()}
    assert all(abs(again[r["doc_id"]] - r["score"]) < 1e-9 for r in got)


def test_classifier_edges(spark, docs, corpus, no_docs):
    quality = spark.createDataFrame([(10, 1), (12, 1), (60, 0), (None, 1), (11, None), (11, 1), (11, 0), (40, 1), (41, 1), (42, 1)], "doc_id long, quality int")
    got = positive_unlabelled.score(docs, quality).collect()
    assert len(got) == len(corpus) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] for r in got if r["doc_id"] is None) and {"fixed", "kept", "ids", "spans"} <= set(got[0].asDict())
    assert len({r["score"] for r in got if r["doc_id"] == 11}) == 1
    none = positive_unlabelled.score(docs, quality.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5} and len(none) == len(corpus)
    assert positive_unlabelled.score(no_docs, quality).count() == 0


def test_features_of_a_text_do_not_depend_on_its_block():
    texts = ["", "One two.\nTwo ONE!!", "é漢 字", "a " * 500, None, "x"]
    block = lambda t: positive_unlabelled.features(*common.texts_buffer(pa.array(t, pa.string())))
    assert np.allclose(block(texts), np.concatenate([block([t]) for t in texts]))


def test_best_bin_finds_the_share_of_positives():
    rng = np.random.default_rng(2)
    pos, neg = rng.beta(6, 2, 20000), rng.beta(2, 6, 20000)
    hist = lambda s: np.bincount((s * 400).astype(int), minlength=400).astype(float)
    for share in (0.2, 0.5, 0.85):
        mixed = np.concatenate([pos[: int(20000 * share)], neg[: int(20000 * (1 - share))]])
        assert abs(positive_unlabelled.best_bin(hist(rng.beta(6, 2, 5000)), hist(mixed)) - share) < 0.05
    assert positive_unlabelled.best_bin(np.zeros(4), np.ones(4)) == 0.5
