import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghiklmnoprstuv") for _ in range(rng.randint(2, 8))) for _ in range(n)).capitalize() + rng.choice(".!?")


def prose(rng, sentences):
    return " ".join(sentence(rng, rng.randint(4, 12)) for _ in range(sentences))


@pytest.fixture(scope="session")
def rows():
    """Documents with copies, near copies, a shared passage, nulls, empties, ties, repeated rows and a very long text."""
    rng = random.Random(5)
    out = []
    passage = prose(rng, 12)
    for i in range(40):
        t = prose(rng, rng.randint(1, 30))
        if i % 7 == 0:
            t = prose(rng, 4) + "\n" + passage + "\n" + prose(rng, 4)
        out.append((i, t, "en" if i % 2 else "de", f"s{i % 4}"))
    base = prose(rng, 40)
    words = base.split()
    for i in range(40, 52):
        w = list(words)
        for _ in range(3):
            w[rng.randrange(len(w))] = f"changed{i}"
        out.append((i, " ".join(w) if i > 41 else base, "en", "hot"))
    out.append((60, None, None, None))
    out.append((61, "", "en", "s1"))
    out.append((62, "   \n\t ", "de", "s2"))
    out.append((63, "!!! ???", "en", "s0"))
    out.append((64, "Short one.", "en", "s0"))
    out.append((65, "with " * 700, "en", "hot"))
    out.append((66, prose(rng, 3000), "en", "hot"))
    out.append((67, "Ünïcödé 😀 text\nwith lines.\nwith lines.\n\n" * 3, "de", "hot"))
    out.append((3, out[3][1], out[3][2], out[3][3]))  # a repeated row
    out.append((5, "Another text of the same number. It differs.", "en", "s1"))  # a repeated doc_id
    out.append((None, prose(rng, 6), "en", "s1"))
    return [(*r, len(r[1]) if r[1] is not None else None) for r in out]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("extra", F.lit(1)).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
