"""The three deduplication operators against their plain definitions."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from canvass.llm import simhash, substring_dedup, suffix_dedup
from canvass.llm import textbytes as tb
from canvass.llm.common import Scratch
from canvass.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_bytes(rows, length):
    seen, out = set(), {}
    for i, text in sorted({(i, t or "") for i, t in rows}):
        b = text.encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            s = b[k : k + length]
            if s in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(s)
        out[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(x for x, g in zip(b, gone, strict=True) if not g))
    return out


def brute_words(rows, window):
    words = {i: WORD.findall(t or "") for i, t in rows}
    owner = {}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            owner.setdefault(tuple(words[i][k : k + window]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if owner[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out[i] = (len(w), sum(gone), [x for x, g in zip(w, gone, strict=True) if not g])
    return out


@pytest.mark.parametrize("length", [100, 40])
def test_suffixes(docs, rows, length):
    got = suffix_dedup.remove_repeats(docs, length).collect()
    assert len(got) == len(rows)
    want = brute_bytes(rows, length)
    for r in got:
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) == want[r["doc_id"]], r["doc_id"]


@pytest.mark.parametrize(("per_bucket", "chunk"), [(6, 100), (400, 7), (25, 5)])
def test_suffixes_across_buckets(docs, rows, monkeypatch, per_bucket, chunk):
    """Buckets and chunks of a few suffixes: a run fills many, whose ends are compared."""
    monkeypatch.setattr(suffix_dedup, "SUFFIXES_PER_BUCKET", per_bucket)
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    got = suffix_dedup.remove_repeats(docs, 100).collect()
    want = brute_bytes(rows, 100)
    assert all((r["n_removed"], bytes(r["kept"])) == (want[r["doc_id"]][1], want[r["doc_id"]][3]) for r in got)


@pytest.mark.parametrize("small", [2048, 4])
def test_multikey_sort_is_bytewise_order(monkeypatch, small):
    monkeypatch.setattr(suffix_dedup, "SMALL_RANGE", small)
    r = np.random.default_rng(2)
    rows = r.integers(0, 3, (500, 24)).astype(np.uint8)
    rows[100:300] = rows[7]
    order = suffix_dedup.multikey_sort(rows)
    assert [bytes(rows[i]) for i in order] == sorted(map(bytes, rows))
    lcp = suffix_dedup.common_prefix(rows, order)
    for k in range(1, 500):
        a, b = rows[order[k - 1]], rows[order[k]]
        n = int(lcp[k])
        assert (a[:n] == b[:n]).all()
        assert n == 24 or a[n] != b[n]


@pytest.mark.parametrize("window", [13, 5, 20])
def test_substrings(docs, rows, window):
    got = substring_dedup.remove_repeats(docs, window, keep=("lang",)).collect()
    assert len(got) == len(rows)
    want = brute_words(rows, window)
    for r in got:
        assert (r["n_words"], r["n_removed"], WORD.findall(r["kept"])) == want[r["doc_id"]], r["doc_id"]
        assert r["lang"] == "en"


def thue_morse(n):
    return "".join("ab"[i.bit_count() % 2] for i in range(n))


def test_long_words_that_cancel_out_in_polynomials(spark):
    """A Thue-Morse word and its mirror have equal values in every odd base."""
    a = thue_morse(1024)
    b = a.translate(str.maketrans("ab", "ba"))
    before, after = " ".join(f"w{i}" for i in range(6)), " ".join(f"v{i}" for i in range(6))
    rows = [(1, f"{before} {a} {after}"), (2, f"{before} {b} {after}"), (3, f"{before} {a} {after}")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_repeats(d, 13).collect()} == {1: 0, 2: 0, 3: 13}
    # The same with whole words in the place of letters, for long windows.
    words = [" ".join(w.translate(str.maketrans({"a": "one ", "b": "two "})).split()) for w in (a[:512], b[:512])]
    d = spark.createDataFrame(list(enumerate([*words, words[0]])), "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_repeats(d, 512).collect()} == {0: 0, 1: 0, 2: 512}
    d = spark.createDataFrame(list(enumerate([a, b, a])), "doc_id long, text string")
    got = suffix_dedup.remove_repeats(d, 1000).collect()
    want = brute_bytes([(i, t) for i, t in enumerate([a, b, a])], 1000)
    assert {r["doc_id"]: r["n_removed"] for r in got} == {i: v[1] for i, v in want.items()}


def test_untouched_texts_keep_their_white_space(spark):
    rows = [(1, " a\n\nb  c\t"), (2, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["kept"] for r in substring_dedup.remove_repeats(d, 13).collect()} == {1: " a\n\nb  c\t", 2: ""}


def fingerprint(text, width=4, seed=42):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = WORD.findall(low)
    s = [" ".join(w[k : k + width]) for k in range(len(w) - width + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), seed) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(prints, most=4):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= most:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash(docs, rows):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    prints = {i: fingerprint(t) for i, t in rows}
    want = groups(prints)
    for r in got:
        assert r["fingerprint"] % (1 << 64) == prints[r["doc_id"]]
        assert r["component_id"] == want[r["doc_id"]]


@pytest.mark.parametrize("block", [4096, 5])
def test_no_link_is_lost(spark, block, monkeypatch):
    """Random fingerprints around few centers, so that entries are crowded."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "SHORT_RUN", 3)
    r = np.random.default_rng(8)
    prints = {}
    for i in range(400):
        p = int(r.integers(0, 4)) * 0x123456789ABCDEF % (1 << 64)
        for b in r.choice(64, int(r.integers(0, 5)), replace=False):
            p ^= 1 << int(b)
        prints[i] = p
    classes = {}
    for i, p in prints.items():
        classes.setdefault(p, i)
    table = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p, i) for p, i in classes.items()], "fingerprint long, rep long")
    scratch = Scratch(spark, "test")
    found = {x["node"]: x["component"] for x in components(simhash.links(table, scratch), scratch).collect()}
    want = groups({i: p for p, i in classes.items()})
    assert {i: found.get(i, i) for i in want} == want


def test_stars_need_no_round(spark):
    """Each round is some fifteen stages that the driver plans and keeps account of."""
    scratch = Scratch(spark, "test")
    edges = [(1, 2), (3, 1), (1, 4), (9, 7), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 9: 7}
    assert scratch.count == 1


def test_components_of_a_chain_and_a_ring(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, 9), (9, 7), (7, 5), (3, 3)]
    scratch = Scratch(spark, "test")
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {5: 5, 7: 5, 9: 5}


def test_anchors_depend_on_content_alone():
    r = np.random.default_rng(4)
    a = r.integers(0, 4, 300).astype(np.uint64)
    joined = np.concatenate([r.integers(0, 4, 37).astype(np.uint64), a])
    for gram, window in ((4, 13), (3, 9)):
        at, low, high = tb.anchors(tb.grams(a, gram), np.full(300, 300), gram, window)
        at2, low2, high2 = tb.anchors(tb.grams(joined, gram), np.full(337, 337), gram, window)
        pins = lambda x, lo, hi, shift: {(int(p - o - shift), int(p - shift)) for p, l, h in zip(x, lo, hi, strict=True) for o in range(l, h + 1) if p - o - shift >= 0}  # noqa: E731, E741
        assert pins(at, low, high, 0) == pins(at2, low2, high2, 37)


def test_empty_tables(no_docs):
    assert suffix_dedup.remove_repeats(no_docs).count() == 0
    assert substring_dedup.remove_repeats(no_docs).count() == 0
    assert simhash.near_duplicates(no_docs).count() == 0


def test_bad_parameters(docs):
    with pytest.raises(ValueError, match="window"):
        substring_dedup.remove_repeats(docs, 4)
    with pytest.raises(ValueError, match="bytes"):
        suffix_dedup.remove_repeats(docs, 10)


def test_hash_of_short_texts_only(spark):
    d = spark.createDataFrame([(1, "a"), (2, "A"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(d).select("*", F.lit(1)).collect()}
    assert got[1] == got[2]
    assert got[3] == (0, 3)
