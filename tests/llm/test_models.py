"""Classifiers by held-out accuracy, searches by brute force, gradients by differences."""

import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from canvass.llm import decontaminate, hnsw, language, quality, toxicity
from canvass.llm import textbytes as tb
from canvass.llm.common import read

SF = "/root/testdata/sf0.01"
crc = lambda i: zlib.crc32(str(i).encode())
LABELS = "doc_id long, quality int, toxic int, score string"


def col(texts):
    return tb.column(pa.array(texts, pa.large_string()))


def accuracy(spark, scores, target, parts, held):
    truth = {r["doc_id"]: r[target] for r in read(spark, SF, "labels").collect()}
    got = {r["doc_id"]: r["score"] for r in scores.collect()}
    test = [i for i in truth if crc(i) % parts == held and truth[i] is not None]
    return np.mean([(got[i] >= 0.5) == truth[i] for i in test])


def test_quality_held_out(spark):
    d = read(spark, SF, "documents")
    assert accuracy(spark, quality.score(d, quality.fit(d, read(spark, SF, "labels"))), "quality", 3, 1) > 0.95


def test_toxicity_held_out(spark):
    d = read(spark, SF, "documents")
    assert accuracy(spark, toxicity.score(d, toxicity.fit(d, read(spark, SF, "labels"))), "toxic", 5, 0) > 0.9


def test_language_held_out(spark):
    d = read(spark, SF, "documents")
    truth = {r["doc_id"]: r["lang"] for r in d.select("doc_id", "lang").collect()}
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict(d, language.fit(d)).collect()}
    assert np.mean([got[i] == truth[i] for i in truth if crc(i) % 4 == 2]) > 0.97


def test_marginals_equal_enumeration():
    r = np.random.default_rng(0)
    first = np.array([0, 1, 4, 9])
    e, table = r.standard_normal(9), r.standard_normal((2, 2))
    good, joint, z = quality.marginals(e, first, table)
    all_joint = np.zeros((2, 2))
    for k in range(3):
        n = first[k + 1] - first[k]
        weight, mean, pair = 0.0, np.zeros(n), np.zeros((2, 2))
        for code in range(1 << n):
            y = [code >> t & 1 for t in range(n)]
            w = np.exp(sum(e[first[k] + t] for t in range(n) if y[t]) + sum(table[y[t - 1], y[t]] for t in range(1, n)))
            weight += w
            mean += w * np.array(y)
            for t in range(1, n):
                pair[y[t - 1], y[t]] += w
        assert np.allclose(good[first[k] : first[k + 1]], mean / weight)
        assert z[k] == pytest.approx(np.log(weight))
        all_joint += pair / weight
    assert np.allclose(joint, all_joint)


def test_long_chains_equal_short_steps(monkeypatch):
    r = np.random.default_rng(6)
    first = np.array([0, 700, 701, 1701])
    e, table = r.standard_normal(1701) * 3, r.standard_normal((2, 2))
    whole = quality.marginals(e, first, table)
    monkeypatch.setattr(quality, "STRETCH", 10)
    for a, b in zip(whole, quality.marginals(e, first, table), strict=True):
        assert np.allclose(a, b)


def test_lines_change_sides_within_bounds():
    y, first = np.array([0.0, 1.0]), np.array([0, 4, 9])
    good = np.array([0.9, 0.8, 0.7, 0.1, 0.9, 0.9, 0.1, 0.2, 0.9])
    assert quality.sides(y, good, np.full(9, 10), first).tolist() == [1, 1, 0, 0, 1, 1, 0, 1, 1]


def test_a_text_of_very_many_lines():
    sample = [("Good lines stand here.\nAnd one more of them.", 1), ("$$$ BUY !!! ||\n@@ ## !!", 0)] * 20
    model = quality.train(sample)
    long = model.score(*col(["Good lines stand here.\n" * 300_000, "@@ ## !!\n" * 300_000]))
    assert long[0] > 0.5 > long[1]


def test_learning_holds_a_few_texts_at_a_time():
    """The driver learns quality: what it holds is a table of lines, not several arrays as long as all texts."""
    sample = [(f"word{i} more words{i % 7} here, " * 60 + "\nend", i % 2) for i in range(2400)]
    tracemalloc.start()
    quality.train(sample, steps=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5 * sum(len(text) for text, _ in sample)


def test_features_of_a_text_are_its_own():
    texts = ["one two three", "three two one two", "", "one\none", "one one"]
    whole, _, first = quality.features(*col(texts))
    for k, text in enumerate(texts):
        assert (whole[first[k] : first[k + 1]] == quality.features(*col([text]))[0]).all()
    assert all((a == b).all() for a, b in zip(quality.features(*col(texts)), quality.sample_features(texts), strict=True))


def test_seventy_languages(spark):
    """Every language that a document names is learned, rare ones too."""
    r = random.Random(9)
    letters = [[chr(0x1400 + 8 * k + j) for j in range(8)] for k in range(70)]
    text = lambda k: " ".join("".join(r.choice(letters[k]) for _ in range(r.randrange(2, 6))) for _ in range(30))
    rows = [(70 * n + k, text(k), f"l{k:02d}") for n in range(12) for k in range(70) if k < 66 or n < 6]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    truth = {i: x for i, _, x in rows}
    model = language.fit(d)
    assert set(model.names) == {x for i, _, x in rows if crc(i) % 4 != 2}
    assert len(model.names) == 70
    assert all(row.lang_pred == truth[row.doc_id] for row in language.predict(d, model).collect())


def test_samples(spark):
    """Labels of absent documents, repeated rows and long texts."""
    from canvass.llm import samples

    texts = [(i, f"text {i} " * (1 + i % 7), "en" if i % 2 else "de") for i in range(40)]
    texts += [texts[3]] * 10_000 + [(100, "lang " * 100_000, "xx"), (101, None, "yy"), (None, "t", "zz")]
    d = spark.createDataFrame(texts, "doc_id long, text string, lang string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(20_000)], "doc_id long, quality int")
    there = {i for i, t, _ in texts if i is not None and t}
    got = samples.labelled(d, labels, "quality", 3, 1, 1000)
    assert len(got) == len({i for i in there if crc(i) % 3 != 1})
    assert {(t, i % 2) for i, t, _ in texts[:40] if crc(i) % 3 != 1} <= set(got)
    assert len(samples.labelled(d, labels, "quality", 3, 1, 5)) == 10
    found = samples.languages(d, 4, 2, 1000)
    assert len(found) == len({i for i in there if crc(i) % 4 != 2})
    assert all(len(t) <= samples.LONGEST for t, _ in found)
    if crc(100) % 4 != 2:
        assert "xx" in {x for _, x in found}


def test_network_slopes_equal_differences():
    words = toxicity.Words(*col(["Some words here, and more of them idiot", "réeuxment le la", "one two three " * 30]))
    net = toxicity.Network(3)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    begin, size, _ = words.windows()
    y = np.arange(len(begin)) % 2.0
    weight = np.full(len(begin), 0.3)
    g = net.slopes(words, begin, size, y, weight)

    def value():
        v = net.run(*net.layout(words, begin, size), net.ready(net.inputs(words)))
        return float((weight * (y * -np.logaddexp(0, -v) + (1 - y) * -np.logaddexp(0, v))).sum())

    r = np.random.default_rng(1)
    for k in net.p:
        flat = net.p[k].reshape(-1)
        for at in r.choice(len(flat), min(6, len(flat)), replace=False) if k not in ("word", "tri", "start") else np.flatnonzero(g[k].reshape(-1))[:6]:
            old, h = flat[at], 1e-3
            flat[at] = old + h
            up = value()
            flat[at] = old - h
            down = value()
            flat[at] = old
            assert g[k].reshape(-1)[at] == pytest.approx((up - down) / (2 * h), rel=0.05, abs=2e-5), k


def test_code_lengths_follow_the_definition():
    texts = ["abracadabra", "abc"]
    tree = language.Tree(language.keys(*col(texts)))
    counts: dict[bytes, dict[int, int]] = {}
    for t in texts:
        b = b"\n\n\n" + t.encode()
        for i in range(3, len(b)):
            for o in range(4):
                counts.setdefault(b[i - o : i], {})
                counts[b[i - o : i]][b[i]] = counts[b[i - o : i]].get(b[i], 0) + 1

    def bits(context, symbol):
        total = 0.0
        for o in range(3, -1, -1):
            seen = counts.get(context[len(context) - o :])
            if seen is None:
                continue
            n, d = sum(seen.values()), len(seen)
            if symbol in seen:
                return total - np.log2(seen[symbol] / (n + d))
            total -= np.log2(d / (n + d))
        return total + 8

    probe = "abrazcad"
    b = b"\n\n\n" + probe.encode()
    want = [bits(b[i - 3 : i], b[i]) for i in range(3, len(b))]
    assert np.allclose(tree.lengths(language.keys(*col([probe]))), want)


def test_code_lengths_in_parts(monkeypatch):
    sample = [("the cat sat on the mat " * 9, "en"), ("die katze sitzt auf der matte " * 9, "de")]
    m = language.Model(sample)
    texts = ["", "x", "the mat and die matte " * 40000, "sat"]
    whole = m.lengths(*col(texts))
    assert np.allclose(whole[2], [t.lengths(language.keys(*col([texts[2]]))).sum() for t in m.trees])
    assert m.predict(*col(["12 34", "", "é", "der katze"]))[0] == ["und", "und", m.predict(*col(["é"]))[0][0], "de"]


def test_odd_rows_are_scored(docs, rows, spark):
    labels = spark.createDataFrame([(i, k % 2, k % 2, None) for k, (i, _) in enumerate(rows)] + [(None, 1, 1, None), (0, None, None, None)], LABELS)
    for model, score in ((quality.fit(docs, labels, per_label=20), quality.score), (toxicity.fit(docs, labels, per_label=20), toxicity.score)):
        got = score(docs, model).collect()
        assert len(got) == len(rows)
        assert all(0 <= r["score"] <= 1 for r in got)
    got = language.predict(docs, language.fit(docs)).collect()
    assert len(got) == len(rows)
    assert {r["lang_pred"] for r in got} == {"en", "und"}


def test_empty_tables(spark, no_docs, docs, rows):
    none = spark.createDataFrame([], LABELS)
    for m, s in ((quality, quality.score), (toxicity, toxicity.score)):
        model = m.fit(docs, none)
        assert model is None
        assert {r["score"] for r in s(docs, model).collect()} == {0.5}
        assert s(no_docs, model).count() == 0
    nothing = language.fit(no_docs)
    assert {r["lang_pred"] for r in language.predict(docs, nothing).collect()} == {"und"}
    assert decontaminate.contaminated(no_docs, spark.createDataFrame([], "item_id long, text string")).count() == 0


def vectors(spark, n=1500, d=16, seed=3):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, d)) * r.uniform(0.2, 3, (n, 1))
    x[200:260] = x[5]
    return x, [(i, x[i].tolist(), "z") for i in range(n)]


def test_neighbours_against_brute_force(spark, monkeypatch):
    x, rows = vectors(spark)
    odd = [(9001, None, "z"), (9002, [], "z"), (9003, [0.0] * 16, "z"), (9004, [float("nan")] * 16, "z"), (9005, [None] * 16, "z"), (None, [1.0] * 16, "z"), (9006, [float("inf")] * 16, "z"), (9020, [1.0] * 5, "z"), rows[7]]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, score string")
    got = {}
    for r in hnsw.nearest(table, k=20, every=20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {i for i in range(1500) if i % 20 == 0}
    hit = 0
    ids = np.arange(1500)
    for q, found in got.items():
        s = x @ x[q]
        best = [i for i in np.lexsort((ids, -np.round(s, 9))) if i != q][:20]
        found = sorted(found)
        assert [k for k, _, _ in found] == list(range(1, 21))
        assert q not in [i for _, i, _ in found]
        assert all(v == pytest.approx(s[i]) for _, i, v in found)
        hit += len({i for _, i, _ in found} & set(best))
    assert hit / (20 * len(got)) >= 0.95
    assert [i for _, i, _ in sorted(got[200])][:3] == [5, 201, 202]


def test_one_id_with_several_vectors(spark):
    """One candidate a row, by its best vector; also as a query."""
    rows = [(0, [1.0, 0.0]), (0, [0.0, 3.0]), (1, [5.0, 0.0]), (1, [4.0, 1.0]), (2, [0.0, 1.0]), (3, [2.0, 2.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in hnsw.nearest(table).collect())
    assert got == [(0, 1, 3, 6.0), (0, 2, 1, 5.0), (0, 3, 2, 3.0)]


@pytest.mark.parametrize(("n", "spread"), [(9000, 0.0), (9000, 2.0)])
def test_recall_in_one_shard(n, spread):
    """Gaussian vectors of 64 components, the hard case, and clustered ones:
    one graph of a third of all rows, in and out of its table."""
    r = np.random.default_rng(1)
    x = r.standard_normal((n, 64)) + spread * r.standard_normal((50, 64))[r.integers(0, 50, n)]
    graph = hnsw.Graph(x)
    width = graph.beam(x, 21, hnsw.SEARCH_BEAM)
    again = hnsw.Graph.read(x, graph.rows(), graph.top, graph.entry)
    q = x[7:: n // 150]
    near, _ = again.search(q, width)
    assert (near == graph.search(q, width)[0]).all()
    best = np.argsort(-(q @ x.T), axis=1)[:, :21]
    found = np.take_along_axis(near, np.argsort(-np.where(near >= 0, hnsw._scores(q, x, near), -np.inf), axis=1)[:, :21], axis=1)
    assert np.mean([len(set(a) & set(b)) / 21 for a, b in zip(found.tolist(), best.tolist(), strict=True)]) >= 0.93


def test_blocks_of_queries(spark, monkeypatch):
    """Several blocks meet several graphs, each in chunks, and find the same."""
    _, rows = vectors(spark, 600)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, z string")
    want = {(r["query_id"], r["rank"], r["vec_id"]) for r in hnsw.nearest(table).collect()}
    monkeypatch.setattr(hnsw, "QUERY_ROWS", 7)
    monkeypatch.setattr(hnsw, "SHARDS", 3)
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in hnsw.nearest(table).collect()} == want


def test_fewer_candidates_than_wanted(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.5, 0.5]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in hnsw.nearest(table).collect())
    assert got == [(0, 1, 20), (0, 2, 3), (20, 1, 0), (20, 2, 3)]
    assert hnsw.nearest(table.limit(0)).count() == 0


def test_items_are_found(spark):
    d, b = read(spark, SF, "documents"), read(spark, SF, "benchmark")
    texts = {r["item_id"]: r["text"] for r in b.collect()}
    words = texts[0].split()
    words[5], words[11] = "otherword", "changed"
    clean = d.where("doc_id = 14").first()["text"]
    filler = " ".join(f"filler{i} text{i * 7}" for i in range(60))
    more = spark.createDataFrame([(90001, filler + "\n" + " ".join(words).upper() + " " + filler), (90002, clean), (90003, None), (90004, ""), (90005, filler)], "doc_id long, text string")
    items = b.unionByName(spark.createDataFrame([(777, None), (778, ""), (None, "x")], "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(d.select("doc_id", "text").unionByName(more), items).collect()}
    assert (90001, 0) in got
    assert 0.7 <= got[90001, 0]["common"] < 1
    assert not {k for k in got if k[0] in (90002, 90003, 90004, 90005)}
    plain = lambda t: " ".join(t.split())
    docs = {r["doc_id"]: plain(r["text"] or "") for r in d.collect()}
    want = {(i, k) for i, t in docs.items() for k, v in texts.items() if plain(v) in t}
    assert want <= set(got)


def test_recall_and_precision_against_comparing_all(spark, monkeypatch):
    """Whole items, paraphrases with up to a quarter of the words changed, dropped
    or added, and halves; every document is compared with every item in full.
    The items come in several blocks, and documents repeat or are very long."""
    monkeypatch.setattr(decontaminate, "ITEMS", 9)
    r = np.random.default_rng(12)
    vocabulary = [f"w{i}" for i in range(3000)]
    rank = 1 / np.arange(1, 3001)
    say = lambda n: [vocabulary[i] for i in r.choice(3000, n, p=rank / rank.sum())]
    items = {k: say(int(r.integers(25, 60))) for k in range(40)}
    docs = {i: say(int(r.integers(0, 250))) for i in range(400)}
    for i in range(0, 200):
        own = list(items[i % 40])
        if i % 4 == 1:
            for j in r.choice(len(own), len(own) // 8, replace=False):
                own[j] = say(1)[0]
        elif i % 4 == 2:
            own = [w for w in own if r.random() > 0.2]
        elif i % 4 == 3:
            own = own[: len(own) // 2]
        at = int(r.integers(0, len(docs[i]) + 1))
        docs[i] = docs[i][:at] + own + docs[i][at:]
    docs[500] = say(60_000) + items[3] + say(100)
    rows = [(i, " ".join(w), "clash") for i, w in docs.items()] + [(3, " ".join(docs[3]), "clash"), (600, None, ""), (601, "", "")]
    b = spark.createDataFrame([(k, " ".join(w), "x") for k, w in items.items()], "item_id long, text string, cosine string")
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string, item_id string"), b).collect()}

    def found(doc, item):
        """The definition, over all places of the document."""
        margin = max(len(item) // 2, 4)
        for at in range(0, len(doc), decontaminate.STRIDE):
            span = doc[max(at - margin, 0) : at + decontaminate.PASSAGE + margin]
            if len(set(item) & set(span)) < 0.3 * len(set(item)):
                continue
            share = decontaminate.common(item, span) / len(item)
            said = decontaminate.common(item[-decontaminate.ANSWER :], span) / decontaminate.ANSWER
            if share >= decontaminate.FOUND or share >= decontaminate.LIKELY and said >= decontaminate.ANSWER_FOUND:
                return True
        return False

    want = {(i, k) for i, d in docs.items() for k, w in items.items() if found(d, w)}
    planted = {(i, i % 40) for i in range(200) if i % 4 != 3} | {(500, 3)}
    assert len(planted & want) >= 0.95 * len(planted)
    assert got <= want
    assert len(got) >= 0.9 * len(want)
    assert len(planted & got) >= 0.95 * len(planted & want)


def test_common_subsequence():
    r = np.random.default_rng(0)
    for _ in range(50):
        a, b = r.integers(0, 4, 12).tolist(), r.integers(0, 4, 15).tolist()
        table = np.zeros((13, 16), int)
        for i in range(12):
            for j in range(15):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        assert decontaminate.common(a, b) == table[12, 15]
