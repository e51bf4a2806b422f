"""Packing, token alignment and periodic runs against plain versions."""

import bisect
import hashlib
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from canvass.llm import alignment, packing, periodic_runs, queries, words_bpe

WORD, A, B = (P.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = ["a", "B", "the", "The", " hello", " world", "'s", "'LL", "é", "É", "ß", "İ", "Σ", "é", "日本", "😀", "1", "２", "½", "_", "-", "(", ")", " {", "}\n\n", ";\r", "▁", "ª", "…", "’", "ǅ"]
ODD += ["<|endoftext|>", "<|ENDOFTEXT|>", "<s>", "<0x0A>", "\0", "\x1c", "\x1f", "\x85", "\xa0", "　", "᠎", " ", " ", "  ", "\n", "\t", "\x0b", "\x0c", "\r"]


def odd_texts(n, seed=4):
    r = random.Random(seed)
    return ["".join(r.choice(ODD) for _ in range(r.randrange(0, 25))) for _ in range(n)]


def table(spark, rows):
    """With columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, 1, 2, "x", 3, 4) for i, t in rows], "doc_id long, text string, length long, _key long, units string, seq long, key long").repartition(3)


# --- words ---------------------------------------------------------------


def test_words_as_the_library(monkeypatch):
    library = Tokenizer.from_file(WORD)
    texts = odd_texts(3000) + ["".join(map(chr, range(256))), "x" * 5000, ""]
    with open(WORD) as f:
        encoder = words_bpe.Encoder(f.read())
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == want
    monkeypatch.setattr(words_bpe, "STRETCH", 40)  # long texts in parts, and few words kept
    monkeypatch.setattr(words_bpe, "KEEP", 30)
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == want


# --- packing ---------------------------------------------------------------


def best_fit(lengths, capacity):
    """The number of sequences that sequential best-fit decreasing takes."""
    gaps, n = [], 0
    for x in sorted(lengths, reverse=True):
        i = bisect.bisect_left(gaps, x)
        n += i == len(gaps)
        room = capacity if i == len(gaps) else gaps.pop(i)
        bisect.insort(gaps, room - x)
    return n


def filled(rows, capacity):
    """The number of sequences, once it's sure that they are sound."""
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize(("lengths", "capacity"), [([1], 8), ([7] * 40, 20), ("any", 64), ("short", 64)])
def test_packing_takes_as_few_as_best_fit(spark, monkeypatch, lengths, capacity):
    monkeypatch.setattr(packing, "RANGE_ROWS", 50)  # several ranges, so that they exchange what is left over
    r = random.Random(1)
    lengths = {"any": [r.randrange(1, 65) for _ in range(400)], "short": [r.randrange(1, 9) for _ in range(300)]}.get(lengths, lengths) if isinstance(lengths, str) else lengths
    out = packing.pack(spark.createDataFrame([(i, x) for i, x in enumerate(lengths)], "n long, length long"), capacity).collect()
    assert {(r.n, r.length) for r in out} == set(enumerate(lengths)) and len(out) == len(lengths)
    assert filled(out, capacity) <= best_fit(lengths, capacity) * 1.02


def test_ranges_meet_as_one_sweep():
    r = random.Random(2)
    for _ in range(300):
        items = sorted((r.randrange(30), r.randrange(2), i) for i in range(r.randrange(40)))
        waiting, whole = [], {}
        for size, kind, i in items:  # one sweep over all
            if kind == packing.DOC:
                waiting.append(i)
            elif waiting:
                whole[i] = waiting.pop()
        ends = sorted(r.randrange(len(items) + 1) for _ in range(3))
        parts, left, docs, slots, joined = [items[a:b] for a, b in zip([0, *ends], [*ends, len(items)], strict=True)], [], {}, {}, {}
        for p, part in enumerate(parts):
            inside, free = [], []
            for _, kind, i in part:
                if kind == packing.DOC:
                    inside.append(i)
                elif inside:
                    joined[i] = inside.pop()
                else:
                    free.append(i)
            docs[p], slots[p] = inside, free
            left.append((p, len(free), len(inside)))
        meet, none = packing.matches(left)
        for source, high, part, low, n in meet:
            joined |= {slots[part][low + j]: docs[source][high - j] for j in range(n)}
        assert joined == whole
        assert sum(none.values()) == len(waiting)
        stay = packing.longest(none, 3)
        assert sum(none.values()) - sum(stay.values()) == min(3, len(waiting))


def test_pieces_and_packing_of_documents(spark, rows, docs):
    rows = [(i, t) for i, t in rows]
    with open(WORD) as f:
        encoder = words_bpe.Encoder(f.read())
    pieces = packing.pieces(docs, WORD, capacity=100)
    want = Counter()
    for i, t in rows:
        ids = encoder.encode([t or ""])[0] + b"\1\0\0\0"
        for k in range(0, len(ids), 400):
            want[i, k // 400, k // 4, len(ids[k : k + 400]) // 4, zlib.crc32(ids[k : k + 400])] += 1
    out = packing.pack(pieces, 100).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    assert filled(out, 100) <= best_fit([k[3] for k, n in want.items() for _ in range(n)], 100) * 1.02


def test_packing_of_nothing(spark, no_docs):
    assert packing.pack(packing.pieces(no_docs, WORD)).collect() == []


# --- alignment ---------------------------------------------------------------


def plain_alignment(rows):
    """Token by token, text by text."""
    a_library, b_library, code = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), alignment.byte_level()
    a_library.encode_special_tokens = True
    docs = []
    for i, t in rows:
        a, b, groups = [], [], []
        if t:
            a, b = a_library.encode(" " + t, add_special_tokens=False).ids, b_library.encode(t)
            a_bytes = [bytes(code[c] for c in a_library.id_to_token(x)) for x in a]
            b_bytes = [bytes([int(b_library.id_to_piece(x)[3:5], 16)]) if b_library.is_byte(x) else b_library.id_to_piece(x).replace("▁", " ").encode() for x in b]
            if b"".join(a_bytes) == b"".join(b_bytes) == (" " + t).encode():
                a_ends, b_ends = (np.cumsum([len(x) for x in side]).tolist() for side in (a_bytes, b_bytes))
                before = 0
                for cut in sorted(set(a_ends) & set(b_ends)):
                    groups.append(tuple([x for x, e in zip(side, ends, strict=True) if before < e <= cut] for side, ends in ((a, a_ends), (b, b_ends))))
                    before = cut
            else:
                a, b = [], []
        docs.append((i, a, b, groups, [(x, y) for g in groups for x in g[0] for y in g[1]]))
    n = Counter(p for d in docs for p in set(d[4]))
    best = {x: max(c for (y, _), c in n.items() if x == y) for x in {x for x, _ in n}}
    out = []
    for i, a, b, groups, links in docs:
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        out.append((i, len(a), len(b), len(groups), len(links), sum(n[p] == best[p[0]] for p in links), sum(n[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return sorted(out)


def test_alignment(spark, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK", 300)  # several blocks a task
    monkeypatch.setattr(alignment, "AT_ONCE", 50)
    texts = [*odd_texts(150), None, "", " ", "  ", "\n", "x" * 3000, " word ", " word "]
    rows = list(enumerate(texts)) + [(7, texts[7])]
    docs = table(spark, rows).union(spark.createDataFrame([(None, "no id", 1, 2, "x", 3, 4)], "doc_id long, text string, length long, _key long, units string, seq long, key long"))
    assert sorted(map(tuple, alignment.aligned(docs, A, B).collect())) == plain_alignment(rows)


def test_alignment_of_nothing(spark, no_docs):
    assert alignment.aligned(no_docs, A, B).collect() == []


def shuffled(spark):
    """Bytes that this session's stages have shuffled so far."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    stages = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_units_go_to_their_blocks_in_few_bytes(spark):
    r = random.Random(7)
    words = [f"{r.choice('abcdefgh')}{r.randrange(10**6)}" for _ in range(3000)]
    docs = table(spark, [(i, " ".join(r.sample(words, len(words)))) for i in range(32)]).repartition(32).cache()  # blocks, most of one document
    assert docs.count() == 32
    before = shuffled(spark)
    assert len(alignment.aligned(docs, A, B).collect()) == 32
    assert shuffled(spark) - before < 58 * 32 * len(words)
    docs.unpersist()


def test_a_block_is_put_together_in_little_memory():
    r = np.random.default_rng(3)
    docs = [r.integers(0, 20_000, 5000, np.int32) for _ in range(240)]
    docs[4][9] = 0  # not spelt
    wrong = [bool((d == 0).any()) for d in docs]
    block = pa.table({"doc_id": range(240), "units": [alignment.packed(d) for d in docs]})
    numbers = r.permutation(20_000)
    common = {"blocks": [[0]] * 20_000, "units": [[k] for k in numbers], "spelt": [k > 0 for k in numbers]}
    pairs = [[k, k // 2 << 32, 7] if k else None for k in numbers.tolist()]
    sums = {c: numbers + j for j, c in enumerate(alignment.SUMS)} | {"groups": [f"{k}|{k}" if k else None for k in numbers.tolist()]}

    def dealt(schema, **columns):
        return pa.Table.from_batches(alignment._deal(schema)(iter(pa.table(common | columns).to_batches(max_chunksize=3000))))

    names = dealt(alignment.PAIRS, pairs=pa.array(pairs, pa.list_(pa.int64()))), dealt(alignment.RATED, **sums)
    tracemalloc.start()
    held, summed = alignment._held(block, names[0]), alignment._summed(block, names[1])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    fine = [d.tolist() for d, bad in zip(docs, wrong, strict=True) if not bad]
    n = Counter(p for d in fine for p in {q for k in set(d) for q in (k, k // 2 << 32, 7)})
    assert dict(zip(held["pair"].to_pylist(), held["n"].to_pylist(), strict=True)) == n and 0 < len(fine) < 240
    for j, c in enumerate(alignment.SUMS):
        assert summed[c].to_pylist() == [0 if bad else int(d.sum()) + j * len(d) for d, bad in zip(docs, wrong, strict=True)]
    assert summed["groups_sha256"].to_pylist() == ["" if bad else hashlib.sha256(";".join(f"{k}|{k}" for k in d).encode()).hexdigest() for d, bad in zip(docs, wrong, strict=True)]
    assert peak < 24 << 20, peak


def test_units_begin_where_neither_joins():
    with open(A) as f, open(B, "rb") as g:
        pair = alignment.Pair(f.read(), g.read())
    assert " " in pair.cut_before() and "\n" in pair.cut_before() and "\r" not in pair.cut_before()
    find = alignment.unit_pattern(pair.cut_before()).findall
    assert find(" a  b;\rc\n d ")[:-1] == [" a", "  b;\rc", "\n d", " "]


# --- periodic runs ---------------------------------------------------------------


def plain_runs(words):
    found = set()
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q) and not any((i, j + q, p) in found for p in range(1, q)):
                found.add((i, j + q, q))
            i = max(j, i + 1)
    return sorted(((s, e - s, q) for s, e, q in found), key=lambda r: (r[0], r[2]))


def repeating(r):
    words, kinds = [], r.choice([1, 2, 3, 5])
    for _ in range(r.randrange(6)):
        words += [b"%d" % r.randrange(kinds) for _ in range(r.randrange(1, 9))] * r.randrange(1, 8)
        words = words[: len(words) - r.randrange(3)]
    return words


def test_runs_of_many_texts():
    r = random.Random(1)
    for _ in range(400):
        texts = [repeating(r) for _ in range(4)]
        assert periodic_runs.runs_of(texts) == [plain_runs(w) for w in texts]


def test_runs_in_a_long_text():
    words = [b"%d" % (i % 7) for i in range(60_000)]
    words[30_000] = b"x"
    (runs,) = periodic_runs.runs_of([words])
    assert runs == [(0, 30_000, 7), (30_001, 29_999, 7)]
    assert periodic_runs.overlap() == 5


def test_op13_against_plain(spark, tmp_path, rows):
    r = random.Random(6)
    rows = rows + [(1000 + k, b" ".join(repeating(r)).decode()) for k in range(150)]
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op13_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    want = []
    for i, t in rows:
        words = (t or "").encode().split()
        n, h = len(words), zlib.crc32(str(i).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        runs = plain_runs(words) if len(words) < 3000 else periodic_runs.runs_of([words])[0]
        gone = {k for s, length, q in runs for k in range(s + q, s + length)}
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        want.append((i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
    assert got == sorted(want, key=str)
    assert sum(x[1] > 0 for x in want) > 50


def test_runs_of_nothing(spark, no_docs):
    assert periodic_runs.find(no_docs).collect() == []
