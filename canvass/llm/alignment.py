"""Aligning the tokens of two tokenizers.

Both tokenizers spell the same bytes.  Places where both end a token cut a text's
tokens into groups; tokens of one group are linked.  That is relational work:
tokens are exploded with their places, a window gives each the byte where it ends,
an equi-join on text and end gives the common cuts, the running count of these
numbers the groups, and what lies between two cuts are a group's tokens, whose pairs
are the links.

A text is made of units: white space with the word that follows.  Neither
tokenizer joins what stands on two sides of a unit's start (``cut_before`` looks
this up in the vocabulary), so units are encoded and aligned by themselves, each
distinct one of the corpus once, and a text's groups are those of its units in
turn.  A text without white space is one unit, so nothing else is needed for it.

Blocks of documents (``BLOCK`` bytes of text, or one longer text) number their own
units.  A unit is one row that lists the blocks that have it and its number in each
(12 bytes a block).  What is found for units is dealt out to these blocks by
columns, compressed, many units in one row, and is put together there, a block at a
time: how many documents hold a pair of ids linked, and in the end each document's
sums and its groups in order.

A null or empty text has no tokens, nor has a text that a tokenizer doesn't spell
byte by byte.  Each row is a document, repeated ones too; rows without doc_id are
left out; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canvass.llm import textbytes as tb
from canvass.llm.common import Scratch, documents, parts, settings, small_batches

#: Bytes of text whose units are numbered together.
BLOCK = 32 << 20
#: Occurrences of units that are gone through at once: numpy's working arrays have a
#: few entries for each of them and of their pairs.
AT_ONCE = 1 << 16
#: Units that are encoded in one call.
JOINED = 256
#: Bytes of units' rows that are dealt out to blocks together.
DEALT = 16 << 20
#: White space of any kind, and that before which a unit may begin.
WHITE, BEFORE = r"\s᠎", " \t\n\x0b\x0c\r"
#: White space that isn't simply a space or a line's end.
ODD = re.compile(rf"(?![ \n])[{WHITE}]")
#: Tables split by the text alone can be joined on text and end without a new shuffle.
SPLIT_BY_SOME = "spark.sql.requireAllClusterKeysForCoPartition"
#: Rows that arrive in the order of their key are summed up one key at a time.
HASHED_LISTS = "spark.sql.execution.useObjectHashAggregateExec"
SUMS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
#: What a block gets of each of its units: for the counts of pairs, and in the end.
UNIT = pa.schema([("unit", pa.int32()), ("spelt", pa.bool_())])
PAIRS = UNIT.append(pa.field("pairs", pa.list_(pa.int64())))
RATED = pa.schema([*UNIT, *((c, pa.int64()) for c in SUMS), ("groups", pa.string())])


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable
    ones of Latin-1 for themselves, the others by the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = sorted(set(range(256)) - set(plain))
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Pair:
    """The two tokenizers: A byte-level, of a tokenizer file's text, which gets a
    space before the text; B with word-start marks, of a model's bytes, which adds
    one itself."""

    def __init__(self, a: str, b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a)
        self.a.encode_special_tokens = True
        code = byte_level()
        self.a_bytes = {i: bytes(code[c] for c in t) for t, i in json.loads(a)["model"]["vocab"].items() if all(c in code for c in t)}
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = {i: bytes([int(n[3:5], 16)]) if self.b.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)}
        self.mark = self.b.piece_to_id("▁")
        self.a_sizes, self.b_sizes = (np.array([len(e.get(i, b"")) for i in range(max(e) + 1)]) for e in (self.a_bytes, self.b_bytes))
        self.names = [n for i, n in enumerate(names) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]

    def cut_before(self) -> str:
        """The white space that no entry of B has after a visible character."""
        return "".join(c for c in BEFORE if not any(re.search(f"[^{WHITE}▁]{c.replace(' ', chr(0x2581))}", n) for n in self.names))

    def one(self, unit: str) -> tuple[list[int], list[int], bool]:
        """Ids of A and of B of a unit, and whether both spell it."""
        a = self.a.encode(unit, add_special_tokens=False).ids
        if unit == " ":
            b = [self.mark]
        else:
            b = self.b.encode(unit[1:]) if unit[0] == " " else self.b.encode(unit)[1:]  # without the mark that B adds
        data = unit.encode()
        return a, b, b"".join([self.a_bytes[i] for i in a]) == data == b"".join([self.b_bytes[i] for i in b])

    def _joined(self, units: list[str]) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """Ids and the units' offsets in them, for A and for B: units one behind the
        other are encoded as they are alone.  None if some unit isn't spelt."""
        text = " x" + "".join(units)
        data, out = text.encode(), []
        ends = np.cumsum([2, *(len(u.encode()) for u in units)])
        for ids, entries, sizes in ((self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.a_bytes, self.a_sizes), (self.b.encode(text[1:], num_threads=1), self.b_bytes, self.b_sizes)):
            if b"".join([entries[i] for i in ids]) != data:
                return None
            ids = np.array(ids, np.int32)
            stops = np.cumsum(sizes[ids])
            at = np.searchsorted(stops, ends)
            if not np.array_equal(stops[at], ends):
                return None
            out.append((ids[at[0] + 1 :], at - at[0]))
        return out

    def encode(self, units: list[str]) -> tuple[pa.Array, pa.Array, pa.Array]:
        """Columns of the ids of A, of B, and whether both spell the unit."""
        inner = [k for k, u in enumerate(units) if not u[-1].isspace() and u[-1] != "\u180e"]
        a: list = [None] * len(units)
        b, spelt = a.copy(), [True] * len(units)
        alone = sorted(set(range(len(units))) - set(inner))
        for low in range(0, len(inner), JOINED):
            part = inner[low : low + JOINED]
            found = self._joined([units[k] for k in part])
            if found is None:
                alone += part
                continue
            for side, (ids, at) in zip((a, b), found, strict=True):
                for k, x, y in zip(part, at[:-1].tolist(), at[1:].tolist(), strict=True):
                    side[k] = ids[x:y]
        for k in alone:
            a[k], b[k], spelt[k] = self.one(units[k])
        kind = pa.list_(pa.int32())
        columns = []
        for side in (a, b):
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in side])])
            columns.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *side]).astype(np.int32))).cast(kind))
        return *columns, pa.array(spelt)


_pairs: dict[int, Pair] = {}


def _pair(source: tuple[str, bytes]) -> Pair:
    key = hash(source)
    if key not in _pairs:
        _pairs.clear()
        _pairs[key] = Pair(*source)
    return _pairs[key]


def unit_pattern(cuts: str) -> re.Pattern:
    """White space and all up to the next of ``cuts`` that follows a visible character."""
    inner = f"(?![{re.escape(cuts)}])[{WHITE}][{WHITE}]*"
    return re.compile(f"[{WHITE}]*(?:[^{WHITE}]+(?:{inner})?)*")


class _Numbers(dict):
    """What stands for a unit -> its number, in the order of first sight."""

    def __missing__(self, name: str) -> int:
        self[name] = n = len(self)
        return n


def _names(text: str, find, cuts: str) -> list[str]:
    """The units of a text; one that is a space and then something visible without
    its space."""
    plain = " " in cuts and "\n" in cuts and text[0] not in " \n" and text[-1] not in " \n" and not any(x in text for x in ("  ", " \n", "\n ", "\n\n"))
    if plain and not ODD.search(text):
        return text.replace("\n", " \n").split(" ")
    return [u[1:] if len(u) > 1 and u[0] == " " and not (u[1].isspace() or u[1] == "\u180e") else u for u in find(" " + text)[:-1]]  # the last match is empty


def _whole(name: str) -> str:
    """The unit that a name stands for."""
    return name if name[0].isspace() or name[0] == "\u180e" else " " + name


def _code(cuts: str):
    """Documents as numbers of units, and each block's units."""
    pattern = unit_pattern(cuts).pattern

    def rows(block, doc_ids, units, numbers, names):
        n, m = len(doc_ids), len(names)
        columns = [pa.array([block] * (n + m), pa.int64()), pa.array([*doc_ids, *[None] * m], pa.int64()), pa.array([*units, *[None] * m], pa.binary()), pa.array([*[None] * n, *numbers], pa.int32()), pa.array([*[None] * n, *names], pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["block", "doc_id", "units", "unit", "name"])

    def run(batches):
        find = re.compile(pattern).findall
        block = TaskContext.get().partitionId() << 32
        known = _Numbers()
        size = 0

        def ended():
            names = list(known)
            for low in range(0, len(names), 10_000):
                part = [_whole(u) for u in names[low : low + 10_000]]
                yield rows(block, [], [], range(low, low + len(part)), part)

        for batch in parts(batches):
            if size > BLOCK:
                yield from ended()
                known.clear()
                block, size = block + 1, 0
            out = []
            for text in batch.column("text").to_pylist():
                units = _names(text, find, cuts) if text else []
                out.append(packed(np.fromiter(map(known.__getitem__, units), np.int32, len(units))))
                size += len(text)
            yield rows(block, batch.column("doc_id").to_pylist(), out, [], [])
        yield from ended()

    return run


def align(tokens: DataFrame, a_sizes: DataFrame, b_sizes: DataFrame, scratch: Scratch) -> DataFrame:
    """``tokens``: ``key, a array<int>, b array<int>``, ids that spell the same
    bytes; sizes: ``id, size`` of every entry (a vocabulary, so of bounded size).
    Returns ``key, n_a, n_b, n_groups, n_links, groups, pairs``: every linked pair of
    ids (A's in the upper half) as often as it is linked."""
    # Dealt out once; explode, windows and joins all stay within a key's partition.
    dealt = tokens.repartition("key")

    def ended(column: str, sizes: DataFrame) -> DataFrame:
        exploded = dealt.select("key", F.posexplode(column).alias(f"{column}_place", "id")).join(F.broadcast(sizes), "id")
        return exploded.select("key", f"{column}_place", F.sum("size").over(Window.partitionBy("key").orderBy(f"{column}_place")).alias("end"))

    cuts = ended("a", a_sizes).join(ended("b", b_sizes), ["key", "end"])
    # A group is what lies between a cut and the one before it.
    in_order = Window.partitionBy("key").orderBy("end")
    before = lambda c: F.coalesce(F.lag(c).over(in_order), F.lit(-1))
    groups = cuts.select("key", F.row_number().over(in_order).alias("group"), "a_place", "b_place", before("a_place").alias("a_before"), before("b_place").alias("b_before"))
    part = lambda c: F.slice(c, F.col(f"{c}_before") + 2, F.col(f"{c}_place") - F.col(f"{c}_before"))
    both = groups.join(dealt, "key").select("key", "group", part("a").alias("a"), part("b").alias("b"))
    written = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("group", F.concat(written("a"), F.lit("|"), written("b")).alias("text")))), lambda x: x.text), ";")
    n_a, n_b = F.size("a").cast("long"), F.size("b").cast("long")
    pair = lambda x, y: F.shiftleft(x.cast("long"), 32).bitwiseOR(y.cast("long"))
    pairs = F.flatten(F.collect_list(F.flatten(F.transform("a", lambda x: F.transform("b", lambda y: pair(x, y))))))
    with settings(tokens.sparkSession, **{SPLIT_BY_SOME: "false", HASHED_LISTS: "false"}):
        return scratch.keep(both.groupBy("key").agg(F.sum(n_a).alias("n_a"), F.sum(n_b).alias("n_b"), F.count("*").alias("n_groups"), F.sum(n_a * n_b).alias("n_links"), text.alias("groups"), pairs.alias("pairs")))


def packed(numbers: np.ndarray) -> bytes:
    """Numbers of units in few bytes: like bytes side by side, compressed."""
    return zlib.compress(np.ascontiguousarray(numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T).view("<i4").ravel()


def _stretches(units: pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Some documents at a time: first, end, their units, and the document of each."""
    low, size, some = 0, 0, []
    for k, data in enumerate(units):
        some.append(unpacked(data.as_py()))
        size += len(some[-1])
        if size >= AT_ONCE or k + 1 == len(units):
            yield low, k + 1, np.concatenate(some).astype(np.int64), np.repeat(np.arange(len(some)), [len(x) for x in some])
            low, size, some = k + 1, 0, []


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows in the order of their names, and where each name begins and the last ends;
    no name goes on in the next rows."""
    rest = None
    for batch in parts(batches, rows=16_384, column="name"):
        table = pa.Table.from_batches([batch])
        table = (table if rest is None else pa.concat_tables([rest, table])).combine_chunks()
        names = table.column("name")
        new = np.flatnonzero(np.asarray(pc.not_equal(names.slice(1), names.slice(0, len(names) - 1)))) + 1
        if len(new):
            yield table.slice(0, new[-1]), np.concatenate([[0], new])
        rest = table.slice(new[-1]) if len(new) else table
    if rest is not None:
        yield rest, np.array([0, len(rest)])


def _deal(schema: pa.Schema):
    """Rows of units with ``blocks`` and ``units``, as one row for each of the blocks
    with these columns of all its units here."""

    def shared_out(batches):
        table = pa.Table.from_batches(batches)
        blocks, bounds = tb.lists(table.column("blocks"))
        units, _ = tb.lists(table.column("units"))
        row = np.repeat(np.arange(len(table)), np.diff(bounds))
        values = table.select(schema.names[1:]).combine_chunks()
        order = np.argsort(blocks, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(blocks[order])) + 1):
            part = values.take(pa.array(row[at])).add_column(0, "unit", pa.array(units[at])).cast(schema)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(part)
            yield pa.RecordBatch.from_arrays([pa.array(blocks[at[:1]]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "names"])

    def run(batches):
        some, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            some.append(batch)
            size += batch.nbytes
            if size >= DEALT:
                yield from shared_out(some)
                some, size = [], 0
        if some:
            yield from shared_out(some)

    return run


def _by_unit(names: pa.Table, schema: pa.Schema) -> tuple[pa.Table, np.ndarray]:
    """What was dealt to a block, and the row of each of its units."""
    found = pa.concat_tables([schema.empty_table(), *(pa.ipc.open_stream(x.as_buffer()).read_all() for x in names.column("names"))]).combine_chunks()
    row = np.empty(len(found), np.int64)
    row[np.asarray(found.column("unit"))] = np.arange(len(found))
    return found, row


def _held(docs: pa.Table, names: pa.Table) -> pa.Table:
    """How many of a block's documents hold each pair linked."""
    names, row = _by_unit(names, PAIRS)
    flat, bounds = tb.lists(names.column("pairs"))
    bad = ~np.asarray(names.column("spelt")).astype(bool)
    del names
    coded = pc.dictionary_encode(pa.array(flat))
    pairs, local, size = np.asarray(coded.dictionary), np.asarray(coded.indices), np.diff(bounds)
    n = np.zeros(len(pairs), np.int64)
    for low, high, units, doc in _stretches(docs.column("units")):
        units = row[units]
        wrong = np.zeros(high - low, bool)
        wrong[doc[bad[units]]] = True
        use = ~wrong[doc]
        once = np.unique(doc[use] * len(size) + units[use])
        doc, units = np.divmod(once, max(len(size), 1))
        held = np.repeat(doc, size[units]) * len(pairs) + local[tb.repeat_ranges(bounds[units], size[units])]
        found, times = np.unique(np.unique(held) % max(len(pairs), 1), return_counts=True)
        n[found] += times
    has = np.flatnonzero(n)
    return pa.table({"pair": pairs[has].astype(np.int64), "n": n[has]})


def _digest(texts: pa.Array, units: np.ndarray) -> str:
    """Of the units' texts with a semicolon between."""
    found = hashlib.sha256()
    for low in range(0, len(units), AT_ONCE):
        some = texts.take(pa.array(units[low : low + AT_ONCE]))
        found.update(b";" * bool(low))
        found.update(pc.binary_join(pa.LargeListArray.from_arrays([0, len(some)], some), pa.scalar(";", pa.large_string()))[0].as_buffer())
    return found.hexdigest()


def _summed(docs: pa.Table, names: pa.Table) -> pa.Table:
    """Each document's sums over its units, and its groups."""
    names, row = _by_unit(names, RATED)
    values = {c: np.asarray(names.column(c)) for c in SUMS}
    bad = ~np.asarray(names.column("spelt")).astype(bool)
    texts = pc.fill_null(names.column("groups").cast(pa.large_string()).combine_chunks(), "")
    del names
    out: dict[str, list] = {c: [] for c in SUMS}
    digests: list[str] = []
    for low, high, units, doc in _stretches(docs.column("units")):
        units = row[units]
        wrong = np.bincount(doc[bad[units]], minlength=high - low) > 0
        for c in SUMS:
            sums = np.zeros(high - low, np.int64)
            np.add.at(sums, doc, values[c][units])
            out[c].append(np.where(wrong, 0, sums))
        ends = np.searchsorted(doc, np.arange(high - low + 1))
        for k in range(high - low):
            one = units[ends[k] : ends[k + 1]]
            digests.append("" if wrong[k] or not len(one) else _digest(texts, one))
    table = {"doc_id": docs.column("doc_id")} | {c: np.concatenate([np.zeros(0, np.int64), *out[c]]) for c in SUMS}
    return pa.table(table | {"groups_sha256": pa.array(digests, pa.string())})


def _sizes(spark: SparkSession, entries: dict[int, bytes]) -> DataFrame:
    return spark.createDataFrame(pa.table({"id": pa.array(list(entries), pa.int32()), "size": pa.array([len(x) for x in entries.values()], pa.int64())}))


def aligned(docs: DataFrame, a_path: str, b_path: str, scratch: Scratch | None = None) -> DataFrame:
    """For every document ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256``.  A pair's count is the number of documents that hold it linked;
    ``n_best`` counts links whose count is the highest of their A id.  The driver
    reads both vocabularies (some 2 MB, a fixed size) and broadcasts them."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = scratch or Scratch(spark, "alignment")
    with open(a_path, encoding="utf-8") as f, open(b_path, "rb") as g:
        source = f.read(), g.read()
    pair, shared = Pair(*source), spark.sparkContext.broadcast(source)
    coded = scratch.keep(documents(docs).mapInArrow(_code(pair.cut_before()), "block long, doc_id long, units binary, unit int, name string"))
    coded_docs, names = scratch.keep(coded.where("units IS NOT NULL").select("block", "doc_id", "units")), coded.where("unit IS NOT NULL").select("block", "unit", "name")

    def encode(batches):
        both = _pair(shared.value)
        for rows, bounds in _alike(batches):
            columns = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), rows.column(c).combine_chunks()) for c in ("block", "unit")]
            columns += both.encode(rows.column("name").take(pa.array(bounds[:-1])).to_pylist())
            yield pa.RecordBatch.from_arrays(columns, ["blocks", "units", "a", "b", "spelt"])

    encoded = names.repartition("name").sortWithinPartitions("name").mapInArrow(encode, "blocks array<long>, units array<int>, a array<int>, b array<int>, spelt boolean")
    units = scratch.keep(encoded.withColumn("key", F.monotonically_increasing_id()))
    scratch.drop(coded)
    placed = units.select("key", "blocks", "units", "spelt")
    groups = align(units.where("spelt").select("key", "a", "b"), _sizes(spark, pair.a_bytes), _sizes(spark, pair.b_bytes), scratch)

    def in_blocks(rows: DataFrame, schema: pa.Schema, summed, kind: str) -> DataFrame:
        """For each block, its documents with what its units were given."""
        dealt = rows.mapInArrow(_deal(schema), "block long, names binary")
        return coded_docs.groupBy("block").cogroup(dealt.groupBy("block")).applyInArrow(summed, kind)

    held = in_blocks(placed.join(groups.select("key", "pairs"), "key", "left"), PAIRS, _held, "pair long, n long")
    counts = scratch.keep(held.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("a", F.shiftright("pair", 32)))
    counts = counts.join(counts.groupBy("a").agg(F.max("n").alias("most")), "a").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))
    rated = groups.select("key", F.explode("pairs").alias("pair")).join(counts, "pair").groupBy("key").agg(F.sum("best").alias("n_best"), F.sum("n").alias("count_sum"))
    # Units of documents that aren't spelt only have no counts.
    found = placed.join(groups.drop("pairs"), "key", "left").join(rated, "key", "left")
    whole = scratch.keep(found.select("blocks", "units", "spelt", *[F.coalesce(c, F.lit(0)).alias(c) for c in SUMS], "groups"))
    scratch.drop(units, groups)
    return in_blocks(whole, RATED, _summed, ", ".join(["doc_id long", *(f"{c} long" for c in SUMS), "groups_sha256 string"]))
