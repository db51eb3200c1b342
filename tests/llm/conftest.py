import random

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def corpus(spark):
    """Documents with copies, near copies, shared passages, nulls, empty and long texts, and clashing extra columns."""
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(400)] + ["the", "of", "and"] * 30

    def words(n):
        return [rng.choice(vocab) for _ in range(n)]

    passage = words(70)
    rows, base = [], words(120)
    for i in range(60):
        w = words(rng.choice([3, 4, 5, 30, 80, 200]))
        if i % 7 == 0:
            w[len(w) // 2:len(w) // 2] = passage
        if i % 5 == 0:  # near copies of one text, some further away than others
            w = list(base)
            for _ in range(i // 5):
                w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((i, (" " if i % 2 else "\n").join(w)))
    rows += [(60, None), (61, ""), (62, " \t\n"), (63, rows[0][1]), (64, rows[0][1].upper()), (65, "one two"),
             (66, "one  two"), (67, " ".join(words(6000))), (None, rows[0][1]), (63, rows[0][1]),
             (68, " a b \x1c c\x85d"), (69, " ".join(["same line of words again"] * 60))]
    rows += [(100 + i, " ".join(passage[:52 + i])) for i in range(4)]
    full = [(i, t, None if i == 5 else "en", f"src{(i or 0) % 3}", len(t or "")) for i, t in rows]
    return (spark.createDataFrame(full, DOCS).repartition(3)
            .withColumn("a", F.lit(1)).withColumn("rep", F.lit("x")).withColumn("score", F.lit(0.5)))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
