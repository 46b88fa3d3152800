import random

import pytest
from pyspark.sql import functions as F


def prose(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def corpus(spark):
    """Rows with nulls, empties, ties, repeated rows, copies, shared passages, a long text and columns with clashing names."""
    rng = random.Random(5)
    base = [prose(rng, rng.randrange(40, 200)) for _ in range(30)]
    passage = prose(rng, 60)
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(base)]
    rows += [(100 + i, base[i], "en", "s0") for i in range(4)] + [(110 + i, prose(rng, 20) + " " + passage + " " + prose(rng, 15 + i), "en", "s1") for i in range(6)]
    near = base[7].split()
    rows += [(120, " ".join([*near[:20], "changed", *near[21:]]), "en", "s2"), (121, base[8].upper(), "en", None)]
    rows += [(130, None, None, None), (131, "", "en", "s0"), (132, " \t\n ", "en", "s0"), (133, "one", "en", "s0"), (134, "é ß # $ % & <b> ü", "de", "s1")]
    rows += [(140, "same line\nsame line\n" + base[3] + "\nfoot", "en", "s1"), (141, "x\x0by\x0cz\rw v u", "en", "s1"), (142, "a b c d e " * 20, "en", "s0")]
    rows += [(150, base[0], "en", "s0"), (150, base[0], "en", "s0"), (None, base[1], "en", "s1"), (160, prose(rng, 9000), "en", "s0"), (161, passage + " " + passage, "fr", "s0")]
    rows += [(200 + i, f"page {i} {prose(rng, 12)}\nshared footer line\n", "en", "s2") for i in range(12)]
    schema = "doc_id long, text string, lang string, source string"
    df = spark.createDataFrame(rows, schema)
    clash = {c: F.lit(1) for c in ("row_key", "size", "fp", "n", "part", "bucket", "spans", "n_words", "kept", "class", "copies", "word", "target")}
    return df.withColumns(clash), rows
