"""Approximate nearest neighbours: NN-descent builds a neighbour graph, queries search it greedily.

Equal vectors are one point, so a vector that a third of all rows repeat is one node. Vectors are scaled to length 1 (float32
for the graph, double for what is returned), nearness is the cosine.

1. Start: points meet in blocks of about LEAF points, once in random blocks and STARTS times in leaves of random hyperplanes
   (dealt out by hash where a leaf is larger), and keep their nearest there as edges.
2. NN-descent: neighbours of neighbours are likely neighbours. In each round every node's list (the nodes that it points to
   and at most `reverse` nodes that point to it, new ones first) is joined with the vectors; pairs of a list of which one
   is new are compared, and what is nearer than a node's worst edge is handed to it. An aggregation by edge and a window by
   node keep each node's `k` best. The rounds end when at most `delta` of all edges are new.
3. Search graph: each node's edges and at most `reverse` of the edges to it, nearest first.
4. Queries: all search at once. A beam of the `beam` nearest points seen so far starts with the edges of the query's own point; in
   a round the points of the beam not yet expanded (the nearest `width` of them) are joined with the search graph, their
   neighbours with the vectors, and each query's beam is renewed. The search ends when no beam holds a point to expand.
5. The best points of a beam are measured again in double precision and give way to their rows by vec_id.

Every vector is a node and can be found; the result is approximate, as the method is: tests hold its recall against brute force.
What limits lists (k, reverse, beam) belongs to the method, and no list, however many nodes point to one, is gathered
before it is limited. Work and shuffles grow with points x (k + reverse) a round; the driver sees counts only.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, as queries neither; rows with
a null id take no part; vectors of different lengths are never neighbours; rows that repeat an id and its vector are one
row; different vectors under one id are rows of their own; other rows with the query's very vector are candidates; a table
without vectors gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.common import Scratch, table, written
from tickloom.llm.metric_join import member_rows, points

K = 32
REVERSE = 32
STARTS = 3
LEAF = 128
HANDED = 8  # pairs that a node of a list is handed at most
DELTA = 0.002
BEAM = 160
WIDTH = 64
NODES = 256  # of a bucket
ASKERS = 16
BROADCAST_ROWS = 50_000  # of three numbers: leaves that are dealt out
EXACT = 16  # points of a beam that are measured again, at least
EDGES = "a bigint, b bigint, sim float, fresh boolean"


def _binary(column: pa.ChunkedArray | pa.Array, kind) -> np.ndarray:
    """Vectors of one length, a row each."""
    array = column.combine_chunks()
    at = np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + len(array) + 1]
    return np.frombuffer(array.buffers()[2], np.uint8)[at[0] : at[-1]].view(kind).reshape(len(array), -1)


def units(found: DataFrame) -> DataFrame:
    """point, w (length), unit (float32) and code (signs against random hyperplanes) of each point."""

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            sizes = pc.divide(pc.binary_length(rows.column("data")), 8).to_numpy()
            for w in np.unique(sizes).tolist():
                part = rows.filter(pa.array(sizes == w))
                x = _binary(part.column("data"), np.float64)
                x = (x / np.sqrt((x * x).sum(1, keepdims=True))).astype(np.float32)
                if w not in planes:
                    planes[w] = np.random.default_rng(w).standard_normal((w, 20 * STARTS)).astype(np.float32)
                bits = (x @ planes[w] > 0).reshape(len(x), STARTS, 20)
                codes = (bits << np.arange(20)).sum(2).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * STARTS), pa.array(codes.ravel()))
                unit = pa.array([r.tobytes() for r in x], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("point").combine_chunks(), pa.array(np.full(len(x), w, np.int32)), unit, lists], ["point", "w", "unit", "code"])

    return found.select("point", "data").mapInArrow(scale, "point bigint, w int, unit binary, code array<int>")


def _best(a: np.ndarray, b: np.ndarray, sim: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k best distinct b of each a."""
    order = np.lexsort((-sim, b, a))
    a1, b1 = a[order], b[order]
    order = order[np.concatenate([[True], (a1[1:] != a1[:-1]) | (b1[1:] != b1[:-1])])] if len(order) else order
    order = order[np.lexsort((b[order], -sim[order], a[order]))]
    run = np.flatnonzero(np.concatenate([[True], a[order][1:] != a[order][:-1]])) if len(order) else np.zeros(0, np.int64)
    within = np.arange(len(order)) - np.repeat(run, np.diff(np.append(run, len(order))))
    return order[within < k]


def _edges(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> pa.Table:
    a, b, sim = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))
    top = _best(a, b, sim, k)
    return pa.table({"a": a[top], "b": b[top], "sim": sim[top].astype(np.float32), "fresh": np.ones(len(top), bool)})


def start(nodes: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """EDGES of each node to its nearest in the blocks of the start."""
    size = nodes.groupBy("w").count().withColumn("bits", F.least(F.lit(20), F.greatest(F.lit(0), F.ceil(F.log2(F.col("count") / LEAF)))).cast("int")).drop("count")
    random = F.pmod(F.xxhash64("point"), F.lit(1 << 20)).cast("int")
    leaf = F.posexplode(F.concat(F.array(random), "code")).alias("turn", "code")
    placed = nodes.join(size, "w").select("point", "w", "unit", "bits", leaf).withColumn("leaf", F.col("code").bitwiseAND(F.call_function("shiftleft", F.lit(1), F.col("bits")) - 1))
    large = scratch.table(placed.groupBy("w", "turn", "leaf").count().where(F.col("count") > 2 * LEAF), "leaves")
    known = F.broadcast(large) if large.count() <= BROADCAST_ROWS else large
    salted = placed.join(known, ["w", "turn", "leaf"], "left").withColumn("salt", F.pmod(F.xxhash64("point", "turn"), F.ceil(F.coalesce("count", F.lit(1)) / LEAF)))

    def meet(rows: pa.Table) -> pa.Table:
        x, point = _binary(rows.column("unit"), np.float32), rows.column("point").to_numpy()
        parts = []
        for low in range(0, len(x), 1024):
            sim = x[low : low + 1024] @ x.T
            sim[np.arange(len(sim)), low + np.arange(len(sim))] = -3
            take = min(k, len(x) - 1)
            near = np.argpartition(-sim, take - 1, axis=1)[:, :take] if take else np.zeros((len(sim), 0), np.int64)
            parts.append((np.repeat(point[low : low + 1024], take), point[near].ravel(), np.take_along_axis(sim, near, 1).ravel()))
        return _edges(parts, k)

    return best_edges(salted.select("w", "turn", "leaf", "salt", "point", "unit").groupBy("w", "turn", "leaf", "salt").applyInArrow(meet, EDGES), k)


def best_edges(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest b of each a; an edge is fresh only if all its rows are."""
    once = edges.groupBy("a", "b").agg(F.max("sim").alias("sim"), F.bool_and("fresh").alias("fresh"))
    nth = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))
    return once.withColumn("nth", nth).where(F.col("nth") <= k).drop("nth")


def compared(rows: pa.Table, k: int) -> pa.Table:
    """EDGES found by comparing the members of lists. rows: v, id, fresh, kth (below which id wants no edge), w, unit."""
    parts = []
    size = rows.column("w").to_numpy()
    for w in np.unique(size).tolist():
        part = rows.filter(pa.array(size == w))
        v, member, fresh, kth = (part.column(c).to_numpy(zero_copy_only=False) for c in ("v", "id", "fresh", "kth"))
        order = np.lexsort((~fresh, member, v))
        order = order[np.concatenate([[True], (v[order][1:] != v[order][:-1]) | (member[order][1:] != member[order][:-1])])]
        unit = _binary(part.column("unit"), np.float32)
        _, begin, n = np.unique(v[order], return_index=True, return_counts=True)
        for low in range(0, len(begin), 32):
            b, c = begin[low : low + 32], n[low : low + 32]
            at = b[:, None] + np.arange(c.max())
            there = np.arange(c.max()) < c[:, None]
            at = order[np.where(there, at, b[:, None])]
            x = unit[at]
            sim = x @ x.transpose(0, 2, 1)
            new = fresh[at] & there
            fits = there[:, :, None] & there[:, None, :] & (new[:, :, None] | new[:, None, :]) & (sim > kth[at][:, :, None])
            fits[:, np.arange(fits.shape[1]), np.arange(fits.shape[1])] = False
            sim = np.where(fits, sim, -3)
            take = min(HANDED, sim.shape[2])
            near = np.argpartition(-sim, take - 1, axis=2)[:, :, :take]
            got = np.take_along_axis(sim, near, 2)
            i, j, t = np.nonzero(got > -3)
            parts.append((member[at[i, j]], member[at[i, near[i, j, t]]], got[i, j, t]))
    return _edges(parts, k)


def descended(nodes: DataFrame, edges: DataFrame, n: int, k: int, reverse: int, delta: float, scratch: Scratch) -> DataFrame:
    """EDGES after NN-descent. nodes: units(), written; edges: start(), written; n: points."""
    while True:
        turned = edges.select(F.col("b").alias("v"), F.col("a").alias("id"), "fresh")
        nth = F.row_number().over(Window.partitionBy("v").orderBy(F.desc("fresh"), F.xxhash64("id", "v")))
        back = turned.withColumn("nth", nth).where(F.col("nth") <= reverse).drop("nth")
        lists = edges.select(F.col("a").alias("v"), F.col("b").alias("id"), "fresh").unionByName(back)
        worst = edges.groupBy("a").agg(F.when(F.count("*") >= k, F.min("sim")).otherwise(F.lit(-2.0)).cast("float").alias("kth"))
        known = nodes.select(F.col("point").alias("id"), "w", "unit").join(worst.withColumnRenamed("a", "id"), "id", "left").na.fill(-2.0, ["kth"])
        sent = lists.join(known, "id").withColumn("bucket", F.pmod(F.xxhash64("v"), F.lit(max(1, n // NODES))))
        found = sent.select("bucket", "v", "id", "fresh", "kth", "w", "unit").groupBy("bucket").applyInArrow(lambda rows: compared(rows, k), EDGES)
        old = edges
        edges = scratch.table(best_edges(edges.withColumn("fresh", F.lit(False)).unionByName(found), k), "edges")
        scratch.drop(old)
        if edges.where("fresh").count() <= delta * n * k:
            return edges


def renewed(rows: pa.Table, beam: int, width: int) -> pa.Table:
    """The beams of a bucket of queries: q, id, sim, expanded, turn (to be expanded next). rows: q, id, sim, expanded, w, unit.

    Rows with id null have the query's vector, rows of a beam have sim, rows to be measured have a vector.
    """
    ask = pc.is_null(rows.column("id"))
    asked, rest = rows.filter(ask), rows.filter(pc.invert(ask))
    fresh = pc.is_null(rest.column("sim"))
    held, seen = rest.filter(pc.invert(fresh)), rest.filter(fresh)
    parts = [(held.column("q").to_numpy(), held.column("id").to_numpy(), held.column("sim").to_numpy(), held.column("expanded").to_numpy(zero_copy_only=False))]
    size = seen.column("w").to_numpy()
    for w in np.unique(size).tolist():
        mine = asked.filter(pc.equal(asked.column("w"), w))
        part = seen.filter(pa.array(size == w))
        names = mine.column("q").to_numpy()
        order = np.argsort(names)
        at = order[np.searchsorted(names[order], part.column("q").to_numpy())]
        sim = np.einsum("ij,ij->i", _binary(mine.column("unit"), np.float32)[at], _binary(part.column("unit"), np.float32))
        parts.append((part.column("q").to_numpy(), part.column("id").to_numpy(), sim, np.zeros(len(part), bool)))
    q, point, sim, done = (np.concatenate(x) for x in zip(*parts, strict=True))
    first = np.lexsort((~done, point, q))
    q, point, sim, done = q[first], point[first], sim[first], done[first]
    top = _best(q, point, sim.astype(np.float32), beam)
    q, point, sim, done = q[top], point[top], sim[top], done[top]
    rank = np.cumsum(~done)
    run = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, np.int64)
    rank = rank - np.repeat(rank[run] - ~done[run], np.diff(np.append(run, len(q)))) if len(q) else rank
    return pa.table({"q": q, "id": point, "sim": sim.astype(np.float32), "expanded": done, "turn": ~done & (rank <= width)})


BEAMS = "q bigint, id bigint, sim float, expanded boolean, turn boolean"


def searched(nodes: DataFrame, edges: DataFrame, asked: DataFrame, beam: int, width: int, reverse: int, scratch: Scratch) -> DataFrame:
    """BEAMS of each asked point (q) when nothing is left to expand; a query's own point is in none."""
    turned = edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim")
    nth = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))
    both = edges.select("a", "b").unionByName(turned.withColumn("nth", nth).where(F.col("nth") <= reverse).select("a", "b"))
    graph = scratch.table(both.groupBy("a").agg(F.collect_set("b").alias("near")), "graph")
    bucket = F.pmod(F.xxhash64("q"), F.lit(max(1, asked.count() // ASKERS)))
    null = lambda kind: F.lit(None).cast(kind)
    own = asked.join(nodes.select(F.col("point").alias("q"), "w", "unit"), "q").select("q", null("bigint").alias("id"), null("float").alias("sim"), null("boolean").alias("expanded"), "w", "unit")
    own = scratch.table(own, "asked")
    vectors = nodes.select(F.col("point").alias("id"), "w", "unit")
    beams = None
    while True:
        at = asked.select("q", F.col("q").alias("id")) if beams is None else beams.where("turn").select("q", "id")
        reached = at.join(graph.withColumnRenamed("a", "id"), "id").select("q", F.explode("near").alias("id")).where("q <> id").distinct()
        if beams is not None:
            reached = reached.join(beams.select("q", "id"), ["q", "id"], "left_anti")
        measured = reached.join(vectors, "id").select("q", "id", null("float").alias("sim"), null("boolean").alias("expanded"), "w", "unit")
        rows = own.unionByName(measured)
        if beams is not None:
            held = beams.select("q", "id", "sim", (F.col("expanded") | F.col("turn")).alias("expanded"), null("int").alias("w"), null("binary").alias("unit"))
            rows = rows.unionByName(held)
        old = beams
        beams = scratch.table(rows.groupBy(bucket.alias("bucket")).applyInArrow(lambda part: renewed(part, beam, width), BEAMS), "beams")
        if old is not None:
            scratch.drop(old)
        if beams.where("turn").limit(1).count() == 0:
            return beams


def exact_cosines(pairs: DataFrame) -> DataFrame:
    """q, id, score in double precision. pairs: q, id, left, right (doubles)."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            size = pc.binary_length(rows.column("left")).to_numpy()
            for w in np.unique(size):
                part = rows.filter(pa.array(size == w))
                a, b = (_binary(part.column(c), np.float64) for c in ("left", "right"))
                score = np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))
                yield pa.RecordBatch.from_arrays([part.column("q").combine_chunks(), part.column("id").combine_chunks(), pa.array(score)], ["q", "id", "score"])

    return pairs.mapInArrow(measure, "q bigint, id bigint, score double")


def nearest(
    vectors: DataFrame, asked: str = "id % 50 = 0", top: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
    k: int = K, reverse: int = REVERSE, delta: float = DELTA, beam: int = BEAM, width: int = WIDTH,
) -> DataFrame:
    """query_id, rank, vec_id, score: the `top` nearest rows found for each row that `asked` (a condition on id) holds for.

    The result is written; the tables behind it are deleted.
    """
    scratch = Scratch()
    all_rows = scratch.keep(member_rows(vectors, id_col, vector_col))
    rows = all_rows.where("data is not null and id is not null").select("id", "data")
    found = scratch.table(points(rows.withColumn("times", F.lit(1))), "points")
    nodes = scratch.table(units(found), "nodes")
    n = nodes.count()
    edges = descended(nodes, scratch.table(start(nodes, k, scratch), "edges"), n, k, reverse, delta, scratch)
    placed = scratch.table(rows.join(found.select("data", "point"), "data").select("id", "point"), "placed")
    askers = placed.where(asked)
    beams = searched(nodes, edges, scratch.table(askers.select(F.col("point").alias("q")).distinct(), "askers"), beam, width, reverse, scratch)

    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "id"))
    best = beams.withColumn("nth", nth).where(F.col("nth") <= max(EXACT, 2 * top)).select("q", "id")
    best = best.unionByName(askers.select(F.col("point").alias("q"), F.col("point").alias("id")).distinct())
    data = found.select("point", "data")
    pairs = best.join(data.select(F.col("point").alias("id"), F.col("data").alias("right")), "id").join(data.select(F.col("point").alias("q"), F.col("data").alias("left")), "q")
    first = F.row_number().over(Window.partitionBy("point").orderBy("id"))
    few = placed.withColumn("nth", first).where(F.col("nth") <= top + 1).select(F.col("point").alias("id"), F.col("id").alias("vec_id"))
    order = [F.desc("score"), F.col("vec_id")]
    rows_of = exact_cosines(pairs).join(few, "id").withColumn("nth", F.row_number().over(Window.partitionBy("q").orderBy(*order))).where(F.col("nth") <= top + 1)
    got = askers.select(F.col("id").alias("query_id"), F.col("point").alias("q")).join(rows_of.withColumnRenamed("id", "of"), "q").where("not (query_id = vec_id and q = of)")
    got = got.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "q").orderBy(*order))).where(F.col("rank") <= top)
    got = written(got.select("query_id", "rank", "vec_id", "score"), "nearest")
    scratch.drop(*scratch.held.values())
    return got


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
