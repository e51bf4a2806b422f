"""The stages one after the other, each against a plain version on its own input."""

import re

import public_tokenizers as P
import tiktoken

import corpus_pipeline as C
from canvass.llm import byte_bpe
from canvass.llm.common import read

from .test_dedup import WORD, brute_words

SF = "/root/testdata/sf0.001"


def brute_groups(texts):
    """doc_id -> the smallest doc_id that texts of the similarity 0.8 lead to."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets, root = {}, {i: i for i in texts}
    for i, t in texts.items():
        w = WORD.findall((t or "").translate(low))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and (sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in texts}


def test_stages(spark, tmp_path):
    docs = read(spark, SF, "documents")
    kept = [docs]
    for k, (_, stage) in enumerate(C.STAGES):
        stage(spark, kept[-1], SF).write.parquet(str(tmp_path / str(k)))
        kept.append(spark.read.parquet(str(tmp_path / str(k))))
    rows = [{r["doc_id"]: r for r in x.collect()} for x in kept]
    assert all(tuple(x.columns) == C.COLUMNS for x in kept[:-1])
    labels = {r["doc_id"]: r["quality"] for r in read(spark, SF, "labels").collect()}
    right = [(i in rows[1]) == bool(labels[i]) for i in labels if i in rows[0]]
    assert sum(right) / len(right) > 0.9
    assert set(rows[2]) == set(brute_groups({i: r["text"] for i, r in rows[1].items()}).values())
    cut = brute_words([(i, r["text"]) for i, r in rows[2].items()], 13)
    assert {i: re.findall(r"[^\x20\x09-\x0D]+", r["text"]) for i, r in rows[3].items()} == {i: v[2] for i, v in cut.items()}
    items = [" ".join(r["text"].split()) for r in read(spark, SF, "benchmark").collect()]
    dirty = {i for i, r in rows[3].items() if any(v in " ".join(r["text"].split()) for v in items)}
    assert not dirty & set(rows[4])
    assert len(rows[4]) >= 0.9 * (len(rows[3]) - len(dirty))
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(f.read()), special_tokens={})
    assert {i: list(r["ids"]) for i, r in rows[5].items()} == {i: library.encode_ordinary(r["text"]) for i, r in rows[4].items()}
    assert C.run(spark, SF).count() == len(rows[5])


def test_odd_rows(spark, rows, tmp_path):
    """Every stage over nulls, blanks, long texts, repeated rows and clashing
    columns, and over an empty table."""
    kinds = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, ids string"
    for n in (None, 0):
        docs = spark.createDataFrame([(i, t, None, None, None, "x", "x", "x") for i, t in rows] + [(None, "none", None, None, None, "x", "x", "x")], kinds)
        docs = docs if n is None else docs.limit(0)
        for k, (_, stage) in enumerate(C.STAGES):
            stage(spark, docs, SF).write.parquet(str(tmp_path / f"{n}-{k}"))
            docs = spark.read.parquet(str(tmp_path / f"{n}-{k}"))
            assert docs.where("doc_id IS NULL").isEmpty()
            assert k == 4 or tuple(docs.columns) == C.COLUMNS
            kept = [r["doc_id"] for r in docs.select("doc_id").collect()]
            if n is None:  # repeated rows stay or go together
                assert kept
                assert {kept.count(i) for i in set(kept)} <= {1, 2}
                assert all(kept.count(i) in (0, 2) for i in (rows[6][0], rows[38][0]))
            else:
                assert not kept
