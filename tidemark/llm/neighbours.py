"""Approximate nearest neighbours by largest inner product: NN-descent builds a graph, greedy search walks it.

Vectors are stretched by one component to a common norm, so that neighbours by inner product are neighbours on a sphere.
Directions are kept in half precision and norms in double, and stretched vectors are compared by their squared distance, not
by their inner product, so that one long vector does not drown the differences between all others.
Equal vectors are one node.  A hash draws pivots among the nodes, about one per SHARD_NODES / 2 nodes and at most PIVOTS;
each node belongs to the cells of its two nearest pivots, and a cell is a shard, or several if it outgrows one.  Pivots are
drawn from the nodes, so dense regions get more of them and cells stay alike in size.  Each shard has a graph of its own.
NN-descent starts from the best neighbours within random blocks; each round joins every node's list with its members'
vectors, compares neighbours of one node with each other (pairs with something new), and merges what beats the lists of
those it concerns: joins of neighbours of neighbours, all in Spark, until few entries change.  When a shard is written, links
that a nearer neighbour already covers are left out, so that the remaining ones lead in all directions.

A query goes to the cells of its PROBES nearest pivots (and on, while those hold too few nodes); in each it walks the graph
from the best of its entry points, one node in ENTRY, with a beam: the best unexpanded nodes are expanded until the beam's best EF nodes all are.  What
the cells found is merged per query, ranked in double precision on the original vectors.  Recall against brute force and
the share of nodes that a query scores are measured in the tests and stated in the README.

Edge cases: vectors that are null, zero, of no component, or hold null or non-finite components take no part, nor do those
of another length than most; rows without an id neither; rows that repeat an id and vector count once per row; equal
vectors are all found, ties to the smaller id; fewer candidates than asked for give shorter lists; an empty table gives an
empty result; other columns play no part.
"""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import files
from .common import drop, ranked, scratch, ship, table, written

DEGREE = 32
#: Links of a node in a shard's file, at most.
LINKS = 32
SHARD_NODES = 1 << 16
#: Pivots are held by every task that deals nodes or queries: at most so many.
PIVOTS = 1 << 14
PROBES = 8
BLOCK = 512
ROUNDS = 8
#: A round that changes fewer entries than this share of all ends the descent.
STILL = 0.01
EF = 128
#: One node of so many is compared with every query that comes to the shard, to start its walk.
ENTRY = 32
QUERY_BLOCK = 128


def usable(v: Column) -> Column:
    """Whether a vector takes part."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return v.isNotNull() & F.forall(v, fine) & F.exists(v, lambda x: x != 0)


def _matrix(column: pa.ChunkedArray | pa.Array, kind: str) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, kind).reshape(len(column), -1) if len(column) else np.zeros((0, 1), kind)


def _packed(x: np.ndarray, top: float) -> pa.Array:
    """Each vector as its norm over `top` (a double) and its direction (halves)."""
    norm = np.linalg.norm(x, axis=1)
    unit = (x / norm[:, None]).astype("<f2")
    return pa.array([n.tobytes() + u.tobytes() for n, u in zip((norm / top).astype("<f8"), unit)], pa.binary())


def _unpacked(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors over `top`, and by how much their stretching component falls short of one."""
    raw = _matrix(column, "u1")
    norm = raw[:, :8].copy().view("<f8")[:, 0]
    x = raw[:, 8:].copy().view("<f2").astype(np.float32) * norm[:, None].astype(np.float32)
    return x, (norm * norm / (1 + np.sqrt(np.maximum(0, 1 - norm * norm)))).astype(np.float32)


def _nearness(x: np.ndarray, short: np.ndarray) -> np.ndarray:
    """Minus the squared distances between stretched vectors (of each list, where there are lists)."""
    square, near = (x * x).sum(axis=-1), x @ np.swapaxes(x, -1, -2)
    near *= 2
    near -= square[..., :, None]
    near -= square[..., None, :]
    near -= (short[..., :, None] - short[..., None, :]) ** 2
    return near


def _edges(u: np.ndarray, v: np.ndarray, s: np.ndarray, new: np.ndarray, shard: int) -> pa.Table:
    return pa.table({"shard": pa.array(np.full(len(u), shard, np.int64)), "u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "s": pa.array(s.astype(np.float32)), "new": pa.array(new.astype(bool))})


_EDGES = "shard long, u long, v long, s float, new boolean"


def best(u: np.ndarray, v: np.ndarray, s: np.ndarray, old: np.ndarray, degree: int) -> tuple[np.ndarray, ...]:
    """The best distinct entries of each u; old entries stay old."""
    order = np.lexsort((~old, v, u))
    u, v, s, old = u[order], v[order], s[order], old[order]
    first = np.concatenate(([True], (u[1:] != u[:-1]) | (v[1:] != v[:-1]))) if len(u) else np.zeros(0, bool)
    u, v, s, old = u[first], v[first], s[first], old[first]
    order = np.lexsort((v, -s, u))
    u, v, s, old = u[order], v[order], s[order], old[order]
    starts = np.flatnonzero(np.concatenate(([True], u[1:] != u[:-1]))) if len(u) else np.zeros(0, np.int64)
    place = np.arange(len(u)) - np.repeat(starts, np.diff(np.concatenate((starts, [len(u)]))))
    keep = place < degree
    return u[keep], v[keep], s[keep], old[keep]


def build_graph(nodes: DataFrame, degree: int = DEGREE, rounds: int = ROUNDS) -> DataFrame:
    """nodes: shard, node, half (the packed vector).  Returns edges shard, u, v, s, new."""
    # Blocks are within a shard, so their number follows from the largest shard's nodes.
    most = nodes.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
    block = lambda c, salt: F.pmod(F.xxhash64(F.lit(salt), c), F.lit(max(1, -(-most // BLOCK))))

    def start(t: pa.Table) -> pa.Table:
        ids, shard = t.column("node").to_numpy(), t.column("shard")[0].as_py()
        near = _nearness(*_unpacked(t.column("half")))
        np.fill_diagonal(near, -np.inf)
        k = min(degree, len(ids) - 1)
        at = np.argpartition(-near, k - 1, axis=1)[:, :k] if k else np.zeros((len(ids), 0), np.int64)
        return _edges(np.repeat(ids, k), ids[at].ravel(), np.take_along_axis(near, at, axis=1).ravel(), np.ones(k * len(ids)), shard)

    def merge(t: pa.Table) -> pa.Table:
        u, v, s, old = best(t.column("u").to_numpy(), t.column("v").to_numpy(), t.column("s").to_numpy(), t.column("old").to_numpy(zero_copy_only=False), degree)
        return _edges(u, v, s, ~old, t.column("shard")[0].as_py())

    def compare(t: pa.Table) -> pa.Table:
        """Lists of several nodes with their members' vectors: which members are near each other."""
        c, u, floor, new = (t.column(k).to_numpy(zero_copy_only=False) for k in ("c", "u", "floor", "new"))
        x, short = _unpacked(t.column("half"))
        order = np.argsort(c, kind="stable")
        starts = np.flatnonzero(np.concatenate(([True], np.diff(c[order]) != 0)))
        sizes = np.diff(np.concatenate((starts, [len(c)])))
        us, vs, ss = [], [], []
        for size in np.unique(sizes):
            rows = order[starts[sizes == size][:, None] + np.arange(size)]
            for part in np.array_split(rows, max(1, len(rows) // 256)):
                near = _nearness(x[part], short[part])
                good = (near > floor[part][:, :, None]) & (new[part][:, :, None] | new[part][:, None, :])
                good &= ~np.eye(size, dtype=bool)
                a, i, j = np.nonzero(good)
                us.append(u[part[a, i]])
                vs.append(u[part[a, j]])
                ss.append(near[a, i, j])
        u2, v2, s2 = np.concatenate(us), np.concatenate(vs), np.concatenate(ss)
        apart = u2 != v2
        u2, v2, s2, _ = best(u2[apart], v2[apart], s2[apart], np.zeros(int(apart.sum()), bool), degree)
        return _edges(u2, v2, s2, np.ones(len(u2)), t.column("shard")[0].as_py())

    starts = [nodes.groupBy("shard", block(F.col("node"), k)).applyInArrow(start, _EDGES) for k in range(2)]
    first = starts[0].union(starts[1]).withColumn("old", F.lit(False))
    edges = written(first.groupBy("shard", block(F.col("u"), 7)).applyInArrow(merge, _EDGES), "graph")
    vectors = nodes.select(F.col("shard").alias("of"), F.col("node").alias("n"), "half")
    for _ in range(rounds):
        floors = edges.groupBy("shard", "u").agg(F.when(F.count(F.lit(1)) >= degree, F.min("s")).otherwise(F.lit(float("-inf"))).cast("float").alias("floor"), F.max("new").alias("moved"))
        about = written(vectors.join(floors, (F.col("of") == F.col("shard")) & (F.col("n") == F.col("u")), "left").select("of", "n", "half", F.coalesce("floor", F.lit(float("-inf"))).cast("float").alias("floor"), F.coalesce("moved", F.lit(False)).alias("moved")), "floors")
        # Each list holds its owner too: neighbours learn of those that name them.
        lists = edges.select("shard", F.col("u").alias("c"), F.col("v").alias("m"), "new").union(edges.groupBy("shard", "u").agg(F.max("new").alias("new")).select("shard", F.col("u").alias("c"), F.col("u").alias("m"), "new"))
        active = about.filter("moved").select(F.col("of").alias("at"), F.col("n").alias("a"))
        lists = lists.join(active, (F.col("shard") == F.col("at")) & (F.col("c") == F.col("a")), "left_semi")
        joined = lists.join(about, (F.col("shard") == F.col("of")) & (F.col("m") == F.col("n"))).select("shard", "c", F.col("m").alias("u"), "new", "floor", "half")
        found = joined.groupBy("shard", block(F.col("c"), 11)).applyInArrow(compare, _EDGES)
        both = found.withColumn("old", F.lit(False)).union(edges.withColumn("old", F.lit(True)))
        before, edges = edges, written(both.groupBy("shard", block(F.col("u"), 7)).applyInArrow(merge, _EDGES), "graph")
        drop(before, about)
        changed = edges.agg(F.sum(F.col("new").cast("long")), F.count(F.lit(1))).first()
        if (changed[0] or 0) <= STILL * (changed[1] or 1):
            break
    return edges


def spread(x: np.ndarray, short: np.ndarray, links: np.ndarray, most: int, least: int) -> np.ndarray:
    """links: per node its neighbours, nearest first, -1 where there are fewer.  Leaves out those that a kept neighbour is nearer
    to than the node itself is, but keeps the `least` nearest; -1 fills the rest of `most` columns."""
    out = np.full((len(links), most), -1, np.int32)
    for a in range(0, len(links), 512):
        own = links[a : a + 512]
        at = np.maximum(own, 0)
        y, t = np.concatenate((x[at], x[a : a + 512, None]), axis=1), np.concatenate((short[at], short[a : a + 512, None]), axis=1)
        far = -_nearness(y, t)
        mine, far = far[:, -1, :-1], far[:, :-1, :-1]
        keep = np.zeros(own.shape, bool)
        for j in range(own.shape[1]):
            covered = (keep[:, :j] & (far[:, :j, j] < mine[:, j, None])).any(axis=1)
            keep[:, j] = (own[:, j] >= 0) & ((j < least) | ~covered) & (keep[:, :j].sum(axis=1) < most)
        row, col = np.nonzero(keep)
        place = np.cumsum(keep, axis=1)[row, col] - 1
        out[a + row, place] = own[row, col]
    return out


def _write_shard(to: str, degree: int):
    """One shard's nodes (node, raw vector, members) and edges as a file."""

    def run(nodes: pa.Table, edges: pa.Table) -> pa.Table:
        shard = nodes.column("shard")[0].as_py()
        nodes = nodes.take(np.argsort(nodes.column("node").to_numpy()))
        ids = nodes.column("node").to_numpy()
        u, v, s = (np.searchsorted(ids, edges.column("u").to_numpy()), np.searchsorted(ids, edges.column("v").to_numpy()), edges.column("s").to_numpy()) if edges.num_rows else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))
        # Walks go both ways along an edge; of many that name a node the nearest stay.
        a, b, _, _ = best(np.concatenate((u, v)), np.concatenate((v, u)), np.concatenate((s, s)), np.zeros(2 * len(u), bool), 2 * degree)
        graph = np.full((len(ids), 2 * degree), -1, np.int32)
        starts = np.searchsorted(a, np.arange(len(ids)))
        graph[a, np.arange(len(a)) - starts[a]] = b
        graph = spread(*_unpacked(nodes.column("half")), graph, LINKS, 8)
        graph = np.where(graph < 0, np.arange(len(ids), dtype=np.int32)[:, None], graph)
        members = nodes.column("members").to_pylist()
        data = io.BytesIO()
        np.savez(data, ids=ids, x=_matrix(nodes.column("raw"), "<f8"), graph=graph, members=np.array([m for own in members for m in own], np.int64), sizes=np.array([len(own) for own in members], np.int64))
        return pa.table({"shard": pa.array([shard], pa.int64()), "path": pa.array([files.put(f"{to}/shard-{shard}", data.getvalue())])})

    return run


class Shard:
    def __init__(self, uri: str):
        got = np.load(io.BytesIO(files.get(uri)))
        self.ids, self.x, self.graph, self.members = got["ids"], got["x"], got["graph"], got["members"]
        self.small = self.x.astype(np.float32)
        self.begins = np.concatenate(([0], np.cumsum(got["sizes"])))
        #: Nodes compared with a query, over all walks.
        self.scored = 0

    def walk(self, q: np.ndarray, ef: int, most: int, expand: int = 16) -> np.ndarray:
        """Positions of the `most` nearest nodes that a beam of ef finds for each query; -1 where there are fewer."""
        n, count = len(self.ids), len(q)
        ef = min(ef, n)
        seen = np.zeros((count, n), bool)
        # Clusters apart from each other share no link, so walks start from the best of many nodes.
        entry = np.unique(np.linspace(0, n - 1, min(n, max(64, n // ENTRY))).astype(np.int64))
        seen[:, entry] = True
        score, beam = q @ self.small[entry].T, np.tile(entry, (count, 1))
        if len(entry) > ef:
            keep = np.argpartition(-score, ef - 1, axis=1)[:, :ef]
            score, beam = np.take_along_axis(score, keep, axis=1), np.take_along_axis(beam, keep, axis=1)
        open_ = np.ones(beam.shape, bool)
        while open_.any():
            ready = np.where(open_, score, -np.inf)
            k = min(expand, ready.shape[1])
            at = np.argpartition(-ready, k - 1, axis=1)[:, :k]
            chosen = np.take_along_axis(ready, at, axis=1) > -np.inf
            np.put_along_axis(open_, at, False, axis=1)
            near = self.graph[np.take_along_axis(beam, at, axis=1)].reshape(count, -1)
            fresh = np.repeat(chosen, self.graph.shape[1], axis=1) & ~np.take_along_axis(seen, near.astype(np.int64), axis=1)
            rows, cols = np.nonzero(fresh)
            if not len(rows):
                continue
            found = np.unique(rows * np.int64(n) + near[rows, cols])
            rows, nodes = found // n, found % n
            seen[rows, nodes] = True
            s = np.einsum("ij,ij->i", self.small[nodes], q[rows])
            per = np.bincount(rows, minlength=count)
            place = np.arange(len(rows)) - np.repeat(np.cumsum(per) - per, per)
            more = np.full((count, per.max()), -np.inf, np.float32)
            which = np.zeros((count, per.max()), np.int64)
            more[rows, place], which[rows, place] = s, nodes
            score, beam, open_ = np.concatenate((score, more), axis=1), np.concatenate((beam, which), axis=1), np.concatenate((open_, more > -np.inf), axis=1)
            if score.shape[1] > ef:
                keep = np.argpartition(-score, ef - 1, axis=1)[:, :ef]
                score, beam, open_ = (np.take_along_axis(a, keep, axis=1) for a in (score, beam, open_))
        self.scored += int(seen.sum())
        order = np.argsort(-score, axis=1, kind="stable")[:, :most]
        return np.where(np.take_along_axis(score, order, axis=1) > -np.inf, np.take_along_axis(beam, order, axis=1), -1)


@dataclass
class Index:
    """pivots: their vectors, one row each; cells: per pivot its shards; sizes: nodes per pivot's cell; files: shard -> path."""

    pivots: np.ndarray
    cells: list[list[int]]
    sizes: np.ndarray
    files: dict[int, str]

    def route(self, q: np.ndarray, probes: int, least: int) -> list[list[int]]:
        """Shards for each query: the cells of its nearest pivots, and on while those hold fewer than `least` nodes."""
        order = np.argsort(-(q @ self.pivots.T), axis=1, kind="stable")
        held = np.cumsum(self.sizes[order], axis=1)
        need = np.maximum(probes, (held < least).sum(axis=1) + 1)
        return [[s for p in row[:n] for s in self.cells[p]] for row, n in zip(order.tolist(), need.tolist())]


_shards: dict[str, Shard] = {}


def search(index: Index | None, queries: DataFrame, k: int = 20, ef: int = EF, probes: int = PROBES) -> DataFrame:
    """queries: query_id, raw.  The k nearest found: query_id, rank, vec_id, score; a query's own id is no candidate of it."""
    spark = queries.sparkSession
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    paths = index.files

    def route(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, QUERY_BLOCK):
                part = batch.slice(a, QUERY_BLOCK)
                to = index.route(_matrix(part.column(1), "<f8"), probes, 8 * k)
                at = np.repeat(np.arange(len(to)), [len(x) for x in to])
                yield pa.RecordBatch.from_arrays([pa.array([s for x in to for s in x], pa.int64()), *(part.column(c).take(pa.array(at)) for c in (0, 1))], names=["shard", "query_id", "raw"])

    def walk(batches):
        for batch in batches:
            shards = batch.column(0).to_numpy()
            edges = np.flatnonzero(np.concatenate(([True], shards[1:] != shards[:-1], [True])))
            for start, end in zip(edges, edges[1:]):
                uri = paths[int(shards[start])]
                if uri not in _shards:
                    _shards.clear()
                    _shards[uri] = Shard(uri)
                shard = _shards[uri]
                for a in range(start, end, QUERY_BLOCK):
                    part = batch.slice(a, min(QUERY_BLOCK, end - a))
                    ids, q = part.column(1).to_numpy(), _matrix(part.column(2), "<f8")
                    found = shard.walk(q.astype(np.float32), ef, 2 * k + 24)
                    out: list[tuple[int, int, float]] = []
                    for own, row, vector in zip(ids.tolist(), found, q):
                        row = row[row >= 0]
                        to = [(-s, m) for node, s in zip(row.tolist(), (shard.x[row] @ vector).tolist()) for m in shard.members[shard.begins[node] : shard.begins[node + 1]].tolist() if m != own]
                        out += [(own, m, -s) for s, m in sorted(to)[:k]]
                    yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    asked = queries.select("query_id", "raw").mapInArrow(route, "shard long, query_id long, raw binary")
    parts = max(1, min(len(paths) * 8, 20_000))
    asked = asked.repartition(parts, "shard", F.pmod(F.xxhash64("query_id"), F.lit(8))).sortWithinPartitions("shard")
    found = asked.mapInArrow(walk, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    # A query's rows number k times its shards.
    ranks = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", ranks.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)


def build_index(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 20) -> tuple[Index | None, DataFrame]:
    """Index all usable rows.  Returns the index and the rows as written: id, raw (64-bit floats, little-endian)."""
    spark = vectors.sparkSession
    ship(spark)

    @F.arrow_udf("binary")
    def raw(v: pa.Array) -> pa.Array:
        return pa.array([np.array(x.as_py(), "<f8").tobytes() for x in v], pa.binary())

    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).filter(F.col("id").isNotNull() & usable(F.col("v")))
    rows = written(rows.select("id", raw(F.transform("v", lambda x: x.cast("double") + 0.0)).alias("raw"), F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")).alias("square"), F.size("v").alias("width")), "vectors")
    widths = rows.groupBy("width").count().orderBy(F.desc("count"), "width").first()
    rows = rows.filter(F.col("width") == (widths[0] if widths else 0))
    seen = rows.agg(F.max("square"), F.count(F.lit(1))).first()
    if not seen[1]:
        return None, rows
    top = float(np.sqrt(seen[0]))
    classes = rows.groupBy("raw").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("n"))
    classes = written(classes, "classes")
    many = classes.filter("n > 1").select(F.col("raw").alias("same"), "node")
    copies = rows.join(many, F.col("raw") == F.col("same")).select("node", "id")
    first = ranked(copies, ["node"], ["id"], "place", "copies").filter(F.col("place") <= k + 1)
    listed = first.groupBy(F.col("node").alias("of")).agg(F.sort_array(F.collect_list("id")).alias("list"))
    count = classes.count()
    wanted = 1 if count <= SHARD_NODES else min(PIVOTS, -(-2 * count // SHARD_NODES))
    pivots = _matrix(pa.array([bytes(r[0]) for r in classes.orderBy(F.xxhash64("node"), "node").limit(wanted).select("raw").collect()]), "<f8")
    norm = np.minimum(np.linalg.norm(pivots, axis=1) / top, 1.0)
    short = norm * norm / (1 + np.sqrt(1 - norm * norm))

    @F.arrow_udf("struct<half: binary, pivots: array<long>>")
    def dealt(v: pa.Array) -> pa.Array:
        x = _matrix(v, "<f8")
        near = []
        for a in range(0, len(x), 1024):
            y = x[a : a + 1024] / top
            own = np.minimum(np.linalg.norm(y, axis=1), 1.0)
            far = (own**2)[:, None] + norm**2 - 2 * (y @ (pivots / top).T) + ((own**2 / (1 + np.sqrt(1 - own**2)))[:, None] - short) ** 2
            near.append(np.argsort(far, axis=1, kind="stable")[:, :2])
        two = np.concatenate(near) if near else np.zeros((0, 1), np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, two.size + 1, two.shape[1], dtype=np.int32)), pa.array(two.ravel()))
        return pa.StructArray.from_arrays([_packed(x, top) if len(x) else pa.array([], pa.binary()), lists], names=["half", "pivots"])

    nodes = classes.join(listed, F.col("node") == F.col("of"), "left").select("node", "raw", dealt("raw").alias("to"), F.coalesce("list", F.array("node")).alias("members"))
    nodes = written(nodes.select("node", "raw", "to.half", "members", F.explode("to.pivots").alias("pivot")), "dealt")
    sizes = np.zeros(len(pivots), np.int64)
    for r in nodes.groupBy("pivot").count().collect():
        sizes[r[0]] = r[1]
    # A cell that outgrows a shard twice is dealt to several by a hash.
    parts = np.maximum(1, -(-sizes // (2 * SHARD_NODES)))
    of = F.element_at(F.lit(parts.tolist()), (F.col("pivot") + 1).cast("int"))
    nodes = written(nodes.select((F.col("pivot") * (1 << 24) + F.pmod(F.xxhash64("node"), of)).alias("shard"), "node", "raw", "half", "members"), "nodes")
    edges = build_graph(nodes.select("shard", "node", "half"))
    to = scratch(spark, "index")
    made = nodes.groupBy("shard").cogroup(edges.select("shard", "u", "v", "s").groupBy("shard")).applyInArrow(_write_shard(to, DEGREE), "shard long, path string")
    paths = {r[0]: r[1] for r in written(made, "index-files").collect()}
    cells = [[p << 24 | j for j in range(parts[p]) if (p << 24 | j) in paths] for p in range(len(pivots))]
    return Index(pivots, cells, sizes, paths), rows


def op5_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, rows = build_index(table(spark, sf_dir, "embeddings"))
    return search(index, rows.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "raw"))
