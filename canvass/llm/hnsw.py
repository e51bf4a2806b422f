"""Nearest neighbours by inner product: a small-world graph in each shard.

Equal vectors are one point; of each only the ids that can still be among the
nearest are kept at hand.  Points are dealt to shards by a hash.  A shard's
points form a hierarchical navigable small-world graph, written as a table of
flat neighbour arrays.  Queries are dealt to blocks; every block meets every
shard's graph in a task of its own, so a task holds one graph and a bounded
number of queries, and the shards' results are merged.

How wide a search must be depends on the vectors and on a shard's size: each graph
is tried on ``PROBES`` of its own points against all others, and the beam doubles
until ``RECALL`` of their nearest are found, if need be until it holds the shard.

One more component makes the longest vectors' distance order that of inner
products, so that the graph is one of Euclidean distances.  Points are added in
blocks: a block is searched for at once, its points see each other as well, and
all beams of a block advance together in numpy.

Vectors that are null, empty, zero or hold null or non-finite components take no
part, nor do rows without id; if lengths of vectors differ, a query meets those
of its own length.  Repeated rows of one id and vector count once.  Rows of one id
with several vectors are one candidate, and one query: the largest inner product
of any of their vectors counts.  With fewer candidates than asked for, all are
returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from canvass.llm.common import Scratch

LINKS = 16  # neighbours a point has in the upper layers, and twice as many at the bottom
BUILD_BEAM = 64
SEARCH_BEAM = 160  # at least
PROBES, RECALL = 48, 0.97
BLOCK = 256
SHARDS = 8  # at least
SHARD_ROWS = 50_000  # at most, by expectation
QUERY_BLOCK = 512  # queries searched at once
QUERY_ROWS = 16_384  # of a block, by expectation
CHUNK = 4096  # points in a row of the table of graphs


class Graph:
    """A navigable small-world graph over the rows of ``points``."""

    def __init__(self, points: np.ndarray, links: int = LINKS, beam: int = BUILD_BEAM, seed: int = 5):
        n = len(points)
        self._place(points)
        r = np.random.default_rng(seed)
        order = r.permutation(n)
        level = np.minimum((-np.log(1 - r.random(n)) / np.log(links)).astype(int), 12)
        if n:
            level[order[0]] = level.max()
        self.level, self.top, self.entry = level, int(level.max(initial=0)), int(order[0]) if n else -1
        #: Row p of layer l: p's neighbours there, then -1.
        self.layers = [np.full((n, links * (2 if at == 0 else 1)), -1, np.int32) for at in range(self.top + 1)]
        done = 1
        while done < n:  # the first blocks are small: their points see few others
            block = order[done : done + min(BLOCK, max(done, 16))]
            self._add(block, beam)
            done += len(block)

    def _place(self, points: np.ndarray) -> None:
        length = (points**2).sum(axis=1)
        self.points = np.concatenate([points, np.sqrt(np.maximum(length.max(initial=0) - length, 0))[:, None]], axis=1).astype(np.float32)
        self.square = (self.points**2).sum(axis=1)

    def distance(self, vectors: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Of each row of vectors from its row of ids, squared and without the vector's own square."""
        return self.square[ids] - 2 * np.matmul(self.points[ids], vectors[:, :, None])[:, :, 0]

    def _beam(self, vectors: np.ndarray, start: np.ndarray, layer: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest points that a beam of this width meets from ``start``:
        ids and distances in rows, nearest first, -1 where there are fewer."""
        n, q = len(self.points), len(vectors)
        near = np.full((q, width), -1, np.int64)
        far = np.full((q, width), np.inf, np.float32)
        open_ = np.zeros((q, width), bool)
        seen = np.zeros((q, n), bool)
        rows = np.arange(q)
        near[:, : start.shape[1]] = start
        far[:, : start.shape[1]] = np.where(start >= 0, self.distance(vectors, start), np.inf)
        open_[:, : start.shape[1]] = start >= 0
        seen[rows[:, None], np.maximum(start, 0)] |= start >= 0
        order = np.argsort(far, axis=1, kind="stable")
        near, far, open_ = (np.take_along_axis(x, order, axis=1) for x in (near, far, open_))
        while len(rows):
            k = open_[rows].argmax(axis=1)  # the nearest that isn't expanded yet
            rows, k = rows[(more := open_[rows, k])], k[more]
            if not len(rows):
                break
            at = near[rows, k]
            open_[rows, k] = False
            new = self.layers[layer][at].astype(np.int64)
            fresh = (new >= 0) & ~seen[rows[:, None], np.maximum(new, 0)]
            seen[np.repeat(rows, fresh.sum(axis=1)), new[fresh]] = True
            d = np.where(fresh, self.distance(vectors[rows], np.maximum(new, 0)), np.inf)
            ids = np.concatenate([near[rows], np.where(fresh, new, -1)], axis=1)
            d = np.concatenate([far[rows], d], axis=1)
            o = np.concatenate([open_[rows], fresh], axis=1)
            order = np.argsort(d, axis=1, kind="stable")[:, :width]
            near[rows], far[rows], open_[rows] = (np.take_along_axis(x, order, axis=1) for x in (ids, d, o))
            open_[rows] &= np.isfinite(far[rows])
        return near, far

    def _down(self, vectors: np.ndarray, to: int) -> np.ndarray:
        """Greedy steps from the entry point through the layers above ``to``."""
        at = np.full((len(vectors), 1), self.entry)
        for layer in range(self.top, to, -1):
            at = self._beam(vectors, at, layer, 1)[0]
        return at

    def search(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        vectors = np.concatenate([queries, np.zeros((len(queries), 1))], axis=1).astype(np.float32)
        return self._beam(vectors, self._down(vectors, 0), 0, width)

    def _choose(self, centers: np.ndarray, ids: np.ndarray, far: np.ndarray, most: int) -> np.ndarray:
        """Of candidates in rows, nearest first, those nearer to the center than
        to any one chosen before; then the nearest others while there is room."""
        q, c = ids.shape
        vectors = self.points[np.maximum(ids, 0)]
        cross = np.matmul(vectors, vectors.transpose(0, 2, 1))
        square = self.square[np.maximum(ids, 0)]
        apart = square[:, :, None] + square[:, None, :] - 2 * cross
        own = self.square[centers][:, None] + far
        good = (ids >= 0) & np.isfinite(far)
        taken = np.zeros((q, c), bool)
        for j in range(c):
            close = (taken[:, :j] & (apart[:, j, :j] < own[:, j, None])).any(axis=1)
            taken[:, j] = good[:, j] & ~close & (taken[:, :j].sum(axis=1) < most)
        rank = np.where(taken, np.arange(c), np.where(good, c + np.arange(c), 3 * c))
        order = np.argsort(rank, axis=1)[:, :most]
        out = np.where(np.take_along_axis(rank, order, axis=1) < 3 * c, np.take_along_axis(ids, order, axis=1), -1)
        return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1) if out.shape[1] < most else out

    def _add(self, block: np.ndarray, beam: int) -> None:
        vectors = self.points[block]
        mutual = self.square[block][None, :] - 2 * vectors @ vectors.T
        np.fill_diagonal(mutual, np.inf)
        at = np.full((len(block), 1), self.entry)
        for layer in range(self.top, -1, -1):
            inside = self.level[block] >= layer
            if not inside.all():
                rest = np.flatnonzero(~inside)
                at = at.copy()
                at[rest, :1] = self._beam(vectors[rest], at[rest, :1], layer, 1)[0]
            rows = np.flatnonzero(inside)
            if not len(rows):
                continue
            near, far = self._beam(vectors[rows], at[rows], layer, beam)
            # Points of the block that are in this layer are candidates too.
            ids = np.concatenate([near, np.broadcast_to(block[rows], (len(rows), len(rows)))], axis=1)
            d = np.concatenate([far, mutual[np.ix_(rows, rows)]], axis=1)
            order = np.argsort(d, axis=1, kind="stable")[:, :beam]
            ids, d = np.take_along_axis(ids, order, axis=1), np.take_along_axis(d, order, axis=1)
            ids = np.where(np.isfinite(d), ids, -1)
            table = self.layers[layer]
            most = table.shape[1]
            chosen = self._choose(block[rows], ids, d, most // 2 if layer == 0 else most)
            table[block[rows], : chosen.shape[1]] = chosen
            self._back(block[rows], chosen, layer)
            at[rows, :1] = near[:, :1]

    def _back(self, centers: np.ndarray, chosen: np.ndarray, layer: int) -> None:
        """Links back from the chosen points; where there is no room, the best stay."""
        table = self.layers[layer]
        most = table.shape[1]
        source, column = np.nonzero(chosen >= 0)
        target, source = chosen[source, column], centers[source]
        order = np.argsort(target, kind="stable")
        target, source = target[order], source[order]
        who, first, count = np.unique(target, return_index=True, return_counts=True)
        for low in range(0, len(who), BLOCK):
            part = slice(low, low + BLOCK)
            width = int(count[part].max())
            slot = first[part][:, None] + np.arange(width)
            fresh = np.where(np.arange(width) < count[part][:, None], source[np.minimum(slot, len(source) - 1)], -1)
            ids = np.concatenate([table[who[part]], fresh], axis=1).astype(np.int64)
            ordered = np.sort(ids, axis=1)
            twin = np.zeros_like(ordered, bool)
            twin[:, 1:] = (ordered[:, 1:] == ordered[:, :-1]) & (ordered[:, 1:] >= 0)
            ids = np.where(twin, -1, ordered)
            d = np.where(ids >= 0, self.distance(self.points[who[part]], np.maximum(ids, 0)), np.inf)
            order = np.argsort(d, axis=1, kind="stable")
            ids, d = np.take_along_axis(ids, order, axis=1), np.take_along_axis(d, order, axis=1)
            full = np.flatnonzero((ids >= 0).sum(axis=1) > most)
            out = ids[:, :most] if ids.shape[1] >= most else np.pad(ids, ((0, 0), (0, most - ids.shape[1])), constant_values=-1)
            out = out.copy()
            if len(full):
                out[full] = self._choose(who[part][full], ids[full], d[full], most)
            table[who[part]] = out

    def beam(self, points: np.ndarray, k: int, width: int) -> int:
        """How wide a search has to be to find ``RECALL`` of the k nearest."""
        n = len(points)
        some = points[np.linspace(0, n - 1, min(PROBES, n)).astype(int)]
        true = some @ points.T
        last = np.partition(true, -min(k, n), axis=1)[:, -min(k, n)]
        while width < n:
            near, _ = self.search(some, width)
            score = np.where(near >= 0, np.take_along_axis(true, np.maximum(near, 0), axis=1), -np.inf)
            if (score >= last[:, None] - 1e-9 * np.abs(last[:, None])).sum() >= RECALL * len(some) * min(k, n):
                break
            width *= 2
        return width

    def rows(self) -> list[bytes]:
        """The neighbour arrays as bytes, ``CHUNK`` points each: for every
        layer the members' places and neighbours."""
        out = []
        for low in range(0, len(self.points), CHUNK):
            parts = []
            for layer, table in enumerate(self.layers):
                members = np.flatnonzero(self.level[low : low + CHUNK] >= layer).astype(np.int32)
                parts += [np.int32([len(members)]), members, table[low + members].ravel()]
            out.append(np.concatenate(parts).tobytes())
        return out

    @classmethod
    def read(cls, points: np.ndarray, rows: list[bytes], top: int, entry: int) -> Graph:
        """The graph that ``rows`` wrote, for searches."""
        graph = cls(points[:0])
        graph._place(points)
        graph.top, graph.entry = top, entry
        graph.layers = [np.full((len(points), LINKS * (2 if layer == 0 else 1)), -1, np.int32) for layer in range(top + 1)]
        for k, row in enumerate(rows):
            data, at = np.frombuffer(row, np.int32), 0
            for table in graph.layers:
                n, wide = int(data[at]), table.shape[1]
                members = data[at + 1 : at + 1 + n]
                table[k * CHUNK + members] = data[at + 1 + n : at + 1 + n + n * wide].reshape(n, wide)
                at += 1 + n + n * wide
        return graph


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return np.zeros((0, 0))
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


GRAPHS = "shard long, size int, chunk int, top int, entry int, beam int, points binary, vectors binary, links binary"


def _build(k: int, width: int):
    def run(table: pa.Table) -> pa.Table:
        ids = np.asarray(table.column("point").combine_chunks())
        order = np.argsort(ids)
        ids, x = ids[order], _matrix(table.column("vector"))[order]
        graph = Graph(x)
        beam, links = graph.beam(x, k, max(width, k)), graph.rows()
        chunks = range(0, len(x), CHUNK)
        n = len(links)
        shard, size = (table.column(c)[0].as_py() for c in ("shard", "size"))
        columns = [pa.array([shard] * n, pa.int64()), pa.array([size] * n, pa.int32()), pa.array(range(n), pa.int32()), *(pa.array([v] * n, pa.int32()) for v in (graph.top, graph.entry, beam))]
        columns += [pa.array([ids[c : c + CHUNK].tobytes() for c in chunks], pa.binary()), pa.array([x[c : c + CHUNK].tobytes() for c in chunks], pa.binary()), pa.array(links, pa.binary())]
        return pa.table(columns, names=["shard", "size", "chunk", "top", "entry", "beam", "points", "vectors", "links"])

    return run


def _search(k: int):
    def run(graphs: pa.Table, queries: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("point", pa.int64()), ("score", pa.float64())])
        if not graphs.num_rows or not queries.num_rows:
            return schema.empty_table()
        rows = sorted(graphs.select(["chunk", "top", "entry", "beam", "points", "vectors", "links"]).to_pylist(), key=lambda r: r["chunk"])
        ids = np.concatenate([np.frombuffer(r["points"], np.int64) for r in rows])
        x = np.concatenate([np.frombuffer(r["vectors"], np.float64) for r in rows]).reshape(len(ids), -1)
        graph = Graph.read(x, [r["links"] for r in rows], rows[0]["top"], rows[0]["entry"])
        width = rows[0]["beam"]
        del rows
        out = []
        # As many beams at once as keeps them and their marks of seen points within bounds.
        step = max(16, min(QUERY_BLOCK, (1 << 25) // len(ids), (1 << 21) // width))
        for low in range(0, queries.num_rows, step):
            part = queries.slice(low, step)
            q = _matrix(part.column("vector"))
            near, _ = graph.search(q, width)
            score = np.where(near >= 0, _scores(q, x, near), -np.inf)
            own = np.asarray(part.column("query_id").combine_chunks())
            order = np.lexsort((ids[np.maximum(near, 0)], -score), axis=1)[:, :k]
            near, score = np.take_along_axis(near, order, axis=1), np.take_along_axis(score, order, axis=1)
            row, column = np.nonzero(near >= 0)
            out.append(pa.table([pa.array(own[row]), pa.array(ids[near[row, column]]), pa.array(score[row, column])], schema=schema))
        return pa.concat_tables(out)

    return run


def _scores(q: np.ndarray, x: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Inner products in double precision with all that a beam holds."""
    out = np.empty(near.shape)
    for k in range(0, near.shape[1], 64):
        out[:, k : k + 64] = np.einsum("qd,qkd->qk", q, x[np.maximum(near[:, k : k + 64], 0)])
    return out


def clean(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``vec_id, vector array<double>`` of the rows that take part."""
    v = F.col(vector_column).cast("array<double>")
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0) & finite & F.exists("vector", lambda x: x != 0)).distinct()


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, id_column: str = "vec_id", vector_column: str = "embedding", width: int = SEARCH_BEAM, scratch: Scratch | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose id is divisible by
    ``every`` its ``k`` nearest other rows by inner product, found by the
    graphs, nearest first, ties to the smaller id."""
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark, "hnsw")
    rows = scratch.keep(clean(vectors, id_column, vector_column).withColumn("key", F.sha2(F.to_json("vector"), 256)))
    # A query can name at most k copies of a vector, and one may be its own row.
    copies = rows.select("key", "vec_id").withColumn("n", F.row_number().over(W.partitionBy("key").orderBy("vec_id"))).where(F.col("n") <= k + 1).select("key", "vec_id")
    points = rows.groupBy("key").agg(F.min_by("vector", "vec_id").alias("vector"), F.min("vec_id").alias("point"))
    # An id's vectors may stand for several points: a number for each point beside its key.
    points = scratch.keep(points.withColumn("point", F.xxhash64("key")))
    most = rows.groupBy("vec_id").count().agg(F.max("count")).first()[0] or 1
    # One candidate more than wanted, which may be the query's own row, and each may be found by all of its vectors.
    wanted = (k + 1) * most
    n = max(SHARDS, -(-points.count() // SHARD_ROWS))
    dealt = points.select("point", "vector", F.pmod(F.xxhash64("key"), F.lit(n)).alias("shard"), F.size("vector").alias("size"))
    graphs = scratch.keep(dealt.groupBy("shard", "size").applyInArrow(_build(wanted, width), GRAPHS))
    queries = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "vector", F.size("vector").alias("size"))
    blocks = max(1, -(-queries.count() // QUERY_ROWS))
    number = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("query_id", "vector"), F.lit(blocks))).withColumn("shard", number(n))
    found = graphs.withColumn("block", number(blocks)).groupBy("shard", "size", "block").cogroup(queries.groupBy("shard", "size", "block")).applyInArrow(_search(wanted), "query_id long, point long, score double")
    found = found.groupBy("query_id", "point").agg(F.max("score").alias("score"))
    best = found.withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "point"))).where(F.col("n") <= wanted)
    best = scratch.keep(best.select("query_id", "point", "score"))
    members = points.select("point", "key").join(copies, "key").select("point", "vec_id")
    each = best.join(members, "point").where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    each = each.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return each.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
