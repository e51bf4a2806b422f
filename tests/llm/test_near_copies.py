"""Near copies against a comparison of all pairs."""

import random

import corpus_pipeline as C
from canvass.llm import near_copies, simhash

from .conftest import sentence
from .test_dedup import WORD


def shingles(text):
    w = [x.lower() for x in WORD.findall(text or "")]
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))}


def brute(rows):
    """Each document's component over all pairs."""
    rows = sorted({(i, t or "") for i, t in rows})
    found, name = [shingles(t) for _, t in rows], {i: i for i, _ in rows}
    for k, (a, _) in enumerate(rows):
        for n, (b, _) in enumerate(rows[:k]):
            if found[k] == found[n] or 5 * len(found[k] & found[n]) >= 4 * len(found[k] | found[n]):
                old, new = max(name[a], name[b]), min(name[a], name[b])
                name = {i: new if c == old else c for i, c in name.items()}
    return name


def edited(r, text, times):
    words = text.split(" ")
    for _ in range(times):
        words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
    return " ".join(words)


def families(seed):
    """Texts, copies with one to six words changed, copies of copies, and texts that share passages."""
    r = random.Random(seed)
    texts = [sentence(r, r.choice([3, 5, 8, 30, 60, 200])) for _ in range(20)]
    texts += [edited(r, t, r.randrange(1, 7)) for t in texts for _ in range(3)]
    texts += [edited(r, t, 1) for t in texts[20:50]]
    shared = sentence(r, 70)
    base = [shared + " " + sentence(r, 40) for _ in range(4)]
    texts += base + [edited(r, t, 1) for t in base] + [t.upper() for t in base]
    r.shuffle(texts)
    return list(enumerate(texts))


def test_near_copies(spark, rows):
    for given in (rows, families(1), families(2)):
        d = spark.createDataFrame([*given, (None, "a row without id")], "doc_id long, text string").repartition(3)
        got = near_copies.near_copies(d).collect()
        assert len(got) == len(given)
        assert {r["doc_id"]: r["component_id"] for r in got} == brute(given)


def test_pairs_beside_the_smallest(spark):
    """An entry's smallest text is no near copy; two others that share it are."""
    r = random.Random(3)
    shared = sentence(r, 30)
    tail = shared + " " + sentence(r, 30)
    rows = [(0, shared), (1, tail), (2, tail + " end")]
    assert brute(rows) == {0: 0, 1: 1, 2: 1}
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(d).collect()} == {0: 0, 1: 1, 2: 1}


def test_stage_drops_what_four_bits_miss(spark):
    r = random.Random(9)
    texts = [sentence(r, 100) for _ in range(40)]
    rows = [*enumerate(texts), *((100 + i, edited(r, t, 1)) for i, t in enumerate(texts))]
    d = spark.createDataFrame([(i, t, "en", "x", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in C.near_dedup_stage(spark, d, "").collect()} == set(brute(rows).values()) == set(range(40))
    assert simhash.near_duplicates(d).where("doc_id = component_id").count() > 40


def test_no_near_copies(no_docs):
    assert near_copies.near_copies(no_docs).count() == 0


def test_slices_change_nothing(spark, monkeypatch):
    """The joins by entry and by pair in slices give what they give at once, and
    each slice reads a part of the entries."""
    texts = [" ".join(f"w{(i * 7 + j) % 900}" for j in range(60)) for i in range(60)]
    texts += [t.replace("w5 ", "x ", 1) for t in texts[:30]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(map(tuple, near_copies.near_copies(docs).collect()))
    monkeypatch.setattr(near_copies, "SLICE_ENTRIES", 200)
    monkeypatch.setattr(near_copies, "SLICE_PAIRS", 20)
    tables = []
    keep = near_copies.Scratch.keep
    monkeypatch.setattr(near_copies.Scratch, "keep", lambda self, df: tables.append(keep(self, df)) or tables[-1])
    assert sorted(map(tuple, near_copies.near_copies(docs).collect())) == want
    assert len({c for _, c in want}) < len(texts)
    assert sum(t.columns == ["entry", "one", "to"] for t in tables) > 3
