import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids string, score string, run string, label string, starts string, fingerprint string, rep string, vector string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def sentence(r, n):
    return " ".join(r.choice(WORDS) + str(r.randrange(400)) for _ in range(n))


def corpus():
    """Copies, near copies, shared passages, nulls, blanks, a long text,
    characters of every length, odd white space, repeated rows."""
    r = random.Random(5)
    shared = sentence(r, 40)
    texts = [sentence(r, r.randrange(1, 120)) for _ in range(30)]
    texts += [texts[3], texts[3], texts[4] + " tail", "head " + texts[5], shared, texts[6] + " " + shared, shared + "\n" + texts[7], "\t" + shared.replace(" ", "  ") + "\r\n"]
    texts += [None, "", " \n\t ", "one", "one two three", "a b c d", "A B C D", "same " * 60, "same " * 61, "x" * 350, "x" * 351, "é" * 120 + " naïve ÉCOLE straße 日本語 😀 don't I'll 12,5", " non breaking   spaces \x1c\x1d \x85 end  "]
    texts += [sentence(r, 6000), texts[8] * 2, texts[9][:300] + "ü" + texts[9][300:]]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    rows += [(rows[6][0], rows[6][1]), (rows[38][0], rows[38][1])]  # repeated rows
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    full = [(i, t, "en", None, None, "x", "x", "x", "x", "x", "x", "x", "x") for i, t in rows]
    full += [(None, "a row without id", None, None, None, *["x"] * 8)]
    return spark.createDataFrame(full, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
