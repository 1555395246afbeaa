import random

import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, score double, key long, part int, hits string, "
          "line_no int, first long, batch string, bucket int")


def prose(rng, n):
    """n words from a small vocabulary, with some line breaks, capitals and letters that are not ASCII."""
    out = []
    for _ in range(n):
        word = "".join(rng.choice(["ta", "ri", "Mo", "é", "ß", "lu", "ne", "ko"]) for _ in range(rng.randint(1, 4)))
        out.append(word + rng.choice([" ", " ", " ", "  ", "\n", "\t", ", "]))
    return "".join(out)


@pytest.fixture(scope="session")
def texts():
    """Texts with copies, near copies, shared passages, and odd ones."""
    rng = random.Random(5)
    base = [prose(rng, rng.randint(5, 260)) for _ in range(25)]
    shared = prose(rng, 80)
    out = [*base, base[3], base[3], base[7] + " end", "start " + base[8], base[9][:200], shared, base[1] + shared,
           shared + base[2], base[4] + shared + base[5], shared[20:], "a " * 130, "a " * 130 + "b", "", None, "   \n\t ",
           "one", "One  two", "x" * 3000, prose(rng, 4000), base[6].lower(), base[6].upper()]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts as documents with gaps in doc_id, repeated rows, no id, and columns of clashing names."""
    rows = [(3 * i + 1, t) for i, t in enumerate(texts)]
    rows += [rows[2], rows[2], (rows[5][0], texts[0]), (None, texts[3]), (None, None)]
    full = [(i, t, "en", "s", len(t or ""), 0.5, 7, 1, "h", 3, 9, "b", 2) for i, t in rows]
    random.Random(1).shuffle(full)
    return spark.createDataFrame(full, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
