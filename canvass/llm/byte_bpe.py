"""Byte-level BPE: encoding and decoding of whole texts.

A text is cut by the tokenizer's pattern and each piece is encoded on its own.
A piece's bytes are read as Latin-1 so that one Aho-Corasick automaton finds
every vocabulary entry in it in one pass.  From the longest entry at each place
the encoder goes forward while neighbouring tokens fit, and back to the next
shorter entry where they don't.  Two tokens fit if merging their joined bytes
gives back just these two; the answers are kept, so that each pair is merged
once.  A place from which no way leads on is never tried again, which makes the
work linear in the piece.  The result equals that of applying the merges in
rank order.

A long piece is gone through in stretches, so that it takes some twenty bytes of
memory a byte.  Every text is encoded whole; a null text counts as empty and has no tokens.
Repeated rows give repeated results, rows without doc_id are left out, and
other columns are ignored unless named in ``keep``.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Sequence
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.llm import textbytes as tb
from canvass.llm.common import documents, parts, small_batches

#: Pieces and pairs whose answers a worker keeps at once; when full, it starts anew.
KEEP_PIECES = 150_000
KEEP_PAIRS = 300_000
#: Places of a long piece whose entries are held together, and how many such stretches.
STRETCH, STRETCHES = 1 << 15, 3
#: Unicode's white space, and the letters and numbers of Latin-1.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LATIN_WHITE = r"\t-\r \x85\xa0"
LATIN_LETTER = "a-zA-Zªµº\xc0-\xd6\xd8-\xf6\xf8-\xff"
LATIN_NUMBER = "0-9²³¹¼-¾"


def read_ranks(lines: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from the lines of a rank file."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines.splitlines()) if token}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The plain definition: join the neighbours of least rank, leftmost first."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 62), i) for i in range(len(parts) - 1))
        if rank == 1 << 62:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


class _Fits(dict):
    """(left, right) -> may these tokens stand side by side?  left -1: the start."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, pair: tuple[int, int]) -> bool:
        if len(self) >= KEEP_PAIRS:
            self.clear()
        left, right = pair
        tokens, ranks = self.codec.tokens, self.codec.ranks
        want = [right] if left < 0 else [left, right]
        self[pair] = found = merge(b"".join(tokens[t] for t in want), ranks) == want
        return found


class _Pieces(dict):
    """piece -> its token ids."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= KEEP_PIECES:
            self.clear()
        ids = self.codec.encode_piece(piece.encode())
        if len(piece) < 200:
            self[piece] = ids
        return ids


class _Entries:
    """The vocabulary entries that start at each place of a long piece, a
    stretch of it at a time."""

    def __init__(self, codec: Codec, piece: bytes):
        self.codec, self.piece, self.kept = codec, piece, {}

    def __getitem__(self, at: int) -> list[tuple[int, int]]:
        number = at // STRETCH
        if number not in self.kept:
            if len(self.kept) == STRETCHES:
                self.kept.pop(next(iter(self.kept)))
            low = number * STRETCH
            size = min(STRETCH, len(self.piece) + 1 - low)
            self.kept[number] = self.codec.entries(self.piece[low : low + size + self.codec.longest], size)
        return self.kept[number][at % STRETCH]


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), i))
        self.automaton.make_automaton()
        self.any = regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]"))
        latin = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{LATIN_WHITE}{LATIN_LETTER}{LATIN_NUMBER}]").replace(r"\S", f"[^{LATIN_WHITE}]").replace(r"\s", f"[{LATIN_WHITE}]")
        latin = latin.replace(r"\p{L}", f"[{LATIN_LETTER}]").replace(r"\p{N}", f"[{LATIN_NUMBER}]")
        #: Python's own engine is faster, and for texts in Latin-1 it can say the same.
        self.latin = None if r"\p" in latin else re.compile(latin)
        self.longest = max(map(len, ranks))
        self.fits = _Fits(self)
        self.pieces = _Pieces(self)
        size = max(self.tokens) + 1
        lengths = np.zeros(size, np.int64)
        for i, t in self.tokens.items():
            lengths[i] = len(t)
        self.lengths = lengths
        self.begins = np.cumsum(lengths) - lengths
        self.bytes = np.frombuffer(b"".join(self.tokens.get(i, b"") for i in range(size)), np.uint8)

    def entries(self, piece: bytes, size: int) -> list[list[tuple[int, int]]]:
        """Length and id of the entries that start at each of the first ``size`` places."""
        found: list[list[tuple[int, int]]] = [[] for _ in range(size)]
        for end, entry in self.automaton.iter(piece.decode("latin-1")):
            if end + 1 - entry[0] < size:
                found[end + 1 - entry[0]].append(entry)  # shorter entries come first
        return found

    def encode_piece(self, piece: bytes) -> Sequence[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        n, fits = len(piece), self.fits
        found = self.entries(piece, n + 1) if n < STRETCH else _Entries(self, piece)
        dead = bytearray(n + 1)
        if n < STRETCH:
            path, steps, left = [], [0], [len(found[0])]  # left: at each step, entries not tried yet
        else:
            path, steps, left = array("i"), array("q", [0]), array("i", [len(found[0])])
        while steps[-1] < n:
            at, last = steps[-1], path[-1] if len(path) else -1
            k = left[-1] - 1
            while k >= 0 and (dead[at + found[at][k][0]] or not fits[last, found[at][k][1]]):
                k -= 1
            if k >= 0:
                left[-1] = k
                length, token = found[at][k]
                path.append(token)
                steps.append(at + length)
                left.append(len(found[at + length]))
            elif len(path):
                dead[at] = 1
                path.pop(), steps.pop(), left.pop()
            else:
                raise ValueError("the vocabulary has no token for some byte")
        return tuple(path) if n < STRETCH else path

    def encode(self, text: str) -> np.ndarray:
        pattern = self.any
        if self.latin is not None:
            try:
                text.encode("latin-1")
                pattern = self.latin
            except UnicodeEncodeError:
                pass
        pieces = pattern.findall(text) if len(text) < 1 << 20 else (m.group() for m in pattern.finditer(text))
        return np.fromiter(chain.from_iterable(map(self.pieces.__getitem__, pieces)), np.int32)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and offsets of many id lists at once."""
        lengths = self.lengths[ids]
        data = self.bytes[tb.repeat_ranges(self.begins[ids], lengths)]
        return data, np.concatenate([[0], np.cumsum(lengths)])[offsets]


_codecs: dict[tuple[int, str], Codec] = {}


def _codec(lines: bytes, pattern: str) -> Codec:
    key = hash(lines), pattern
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(read_ranks(lines), pattern)
    return _codecs[key]


def encode(docs: DataFrame, vocabulary: str, pattern: str, decoded: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, ids array<int>`` for every document, by the rank file at the
    path ``vocabulary``; with ``decoded`` also the bytes that the ids decode to.
    The driver reads the file (under 1 MB, a fixed size) and broadcasts it."""
    spark = docs.sparkSession
    small_batches(spark)
    with open(vocabulary, "rb") as f:
        lines = spark.sparkContext.broadcast(f.read())
    base = documents(docs) if not keep else docs.where("doc_id IS NOT NULL").withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.coalesce(F.col("text").cast("string"), F.lit(""))}).select("doc_id", "text", *keep)

    def run(batches):
        codec = _codec(lines.value, pattern)
        for batch in parts(batches):
            each = [codec.encode(t) for t in batch.column("text").to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)
            ids = np.concatenate([*each, np.zeros(0, np.int32)])
            columns = [batch.column("doc_id"), *(batch.column(k) for k in keep), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))]
            if decoded:
                columns.append(tb.binary(*codec.decode(ids, offsets)))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *keep, "ids", *["decoded"] * decoded])

    kinds = dict(base.dtypes)
    schema = ", ".join(["doc_id long", *(f"`{k}` {kinds[k]}" for k in keep), "ids array<int>", *["decoded binary"] * decoded])
    return base.mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """``doc_id, decoded binary`` from ``doc_id, ids``."""
    spark = encoded.sparkSession
    small_batches(spark)
    with open(vocabulary, "rb") as f:
        lines = spark.sparkContext.broadcast(f.read())

    def run(batches):
        codec = _codec(lines.value, pattern)
        for batch in batches:
            ids, offsets = tb.lists(batch.column("ids"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), tb.binary(*codec.decode(ids.astype(np.int64), offsets))], ["doc_id", "decoded"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, decoded binary")
