import random

import pytest
from pyspark.sql import functions as F

SYL = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()


def words(rng, n):
    return ["".join(rng.choice(SYL) for _ in range(rng.randint(1, 4))) for _ in range(n)]


@pytest.fixture(scope="session")
def corpus():
    """Rows (doc_id, text): nulls, empties, one word, copies, near copies, shared passages, repeated rows, a long text."""
    rng = random.Random(5)
    base = words(rng, 120)
    passage = " ".join(words(rng, 60))
    rows = [(1, None), (2, ""), (3, " \n\t\r\x0b "), (4, "one"), (5, "two words"), (6, "Two Words"), (7, "a b c d e"), (8, "A b C d E")]
    rows += [(10, " ".join(base)), (11, " ".join(base)), (11, " ".join(base)), (12, "\n".join(base).upper())]
    for i in range(20, 32):
        near = list(base)
        for _ in range(rng.randint(1, 4)):
            near[rng.randrange(len(near))] = "x" + str(rng.randrange(99))
        rows.append((i, " ".join(near)))
    for i in range(40, 50):
        rows.append((i, " ".join(words(rng, 30)) + "  " + passage + "\n" + " ".join(words(rng, 30))))
    rows += [(60, "ab " * 3000), (61, "ab " * 2999 + "é漢\x1c字"), (62, "".join(rng.choice("abcé") for _ in range(4000)))]
    rows += [(None, " ".join(base)), (None, "no id here " + passage), (70, " ".join(words(rng, 6000)))]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with extra columns whose names clash with the operators' own."""
    wide = [(i, t, 1, "x", 2.0, [1], "y") for i, t in corpus]
    return spark.createDataFrame(wide, "doc_id long, text string, n_words int, kept string, score double, spans array<int>, ids string").repartition(3).withColumn("fixed", F.struct(F.lit(1).alias("a"), F.array(F.lit(2)).alias("b")))


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string")
