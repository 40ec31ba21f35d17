"""Embedding near-dedup: an exact metric range join.

Vectors are scaled to length 1, where cosine >= c is a chord of at most sqrt(2 - 2c); chords are a metric. A bounded set
of pivots (distinct vectors with the smallest hashes; from 24 up to the square root of their number, 1024 at most, as far
as copies on a sample of 1024 stay few) cuts the vectors into cells by nearest pivot. A vector can be
linked with a member of another cell only if the triangle inequality allows it, so it is copied to the cells where
- its distance to the pivot is at most the cell's radius plus the range, and at least the least distance of a member
  minus the range, and
- it lies within the range of the plane half way between its own pivot and the cell's (the same inequality, tightened
  for unit vectors).
Cells then join independently: members against members and copies. A vector's links are all found where it is a member.

Equal vectors are one point with a multiplicity, so a vector that a third of all rows repeat is one point. A cell with
more than `block` members or copies is dealt into blocks of members times blocks of copies; each is a task of bounded size.

Within a block a float32 product finds what may be linked, and cosines near the threshold are decided in double precision.
A block returns for each member the number of its links, and edges of a spanning forest of its links, never all pairs.
Components follow from the edges (connected_components).

In noise of many dimensions no pivot can rule out much: then each vector is copied to nearly all cells, and the work is
that of all pairs, in blocks. Pruning sets in where vectors cluster more tightly than the range.

Vectors of each length are compared among themselves: lengths of more than `block` points one after the other by cells,
all shorter groups at once, a length a task.

Defined cases: null, empty and zero vectors and vectors with null or non-finite components link with nothing (a row each,
component their own id); vectors of different lengths do not link; rows that repeat an id and its vector are one row;
different vectors under one id are rows of their own; rows with a null id are each a row of their own. component_id is the
least id of the component (null only if it has none) and one row of a component is kept: of that id, the first by vector.
An empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.common import connected_components, written

PIVOTS = 24
MOST_PIVOTS = 1024
MOST_COPIES = 24.0
SAMPLE = 1024
BLOCK = 4096
SLACK = 1e-5
NO_EDGE = -(1 << 63)  # stands in rows that count links


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def stacked(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1)


def points(rows: DataFrame) -> DataFrame:
    """point (a number of the vector), n (rows), data (doubles, little-endian) of each distinct usable vector. rows: member_rows()."""
    each = rows.where("data is not null").groupBy("data").agg(F.sum("times").alias("n"))
    # 63 bits of a hash; vectors that share them are told apart by their order.
    nth = F.row_number().over(Window.partitionBy("h").orderBy("data"))
    hashed = each.withColumn("h", F.shiftrightunsigned(F.xxhash64("data"), 1)).withColumn("nth", nth)
    return hashed.select("data", F.when(F.col("nth") == 1, F.col("h")).otherwise(F.shiftrightunsigned(F.xxhash64("data", "nth"), 1)).alias("point"), "n")


def packed_vectors(lists: pa.ListArray) -> pa.Array:
    """Doubles, little-endian, of each vector; null for vectors that are null, empty or zero, or hold null or non-finite components.

    Vectors of very large or small components are scaled by a power of two first, so that squares stay finite.
    """
    n = len(lists)
    size = np.where(lists.is_null().to_numpy(zero_copy_only=False), 0, lists.value_lengths().fill_null(0).to_numpy()).astype(np.int64)
    x = lists.flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    top = np.zeros(n)
    some = np.flatnonzero(size)
    ends = np.cumsum(size)
    if len(some):
        top[some] = np.maximum.reduceat(np.abs(x), (ends - size)[some])  # NaN if any is
    good = np.isfinite(top) & (top > 0)
    scale = np.ones(n)
    odd = good & ((top > 1e100) | (top < 1e-100))
    scale[odd] = np.exp2(-np.clip(np.floor(np.log2(top[odd])), -1000, 1000))
    take = np.repeat(good, size)
    data = (x * np.repeat(scale, size))[take].astype("<f8") + 0.0  # one zero
    offsets = np.append(0, np.cumsum(np.where(good, size, 0)) * 8).astype(np.int32)
    valid = pa.py_buffer(np.packbits(good, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.binary(), n, [valid, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def joined_block(members: pd.DataFrame, others: pd.DataFrame, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of other vectors linked with each member (multiplicities included), and forest edges among points."""
    a, b = unit(stacked(members["data"])), unit(stacked(others["data"]))
    n = others["n"].to_numpy()
    links = np.zeros(len(a), np.int64)
    a32, b32 = a.astype(np.float32), b.astype(np.float32)
    slack = max(SLACK, 4 * np.finfo(np.float32).eps * a.shape[1])  # more than a float32 product of unit vectors can err
    mine, theirs = members["point"].to_numpy(), others["point"].to_numpy()
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for low in range(0, len(a), 512):
        near = a32[low : low + 512] @ b32.T
        i, j = np.nonzero(near >= np.float32(cosine - slack))
        sure = near[i, j] >= np.float32(cosine + slack)
        if not sure.all():
            exact = np.einsum("ij,ij->i", a[low + i[~sure]], b[j[~sure]])
            sure[~sure] = exact >= cosine
        i, j = i[sure] + low, j[sure]
        apart = mine[i] != theirs[j]
        i, j = i[apart], j[apart]
        np.add.at(links, i, n[j])
        found.append(forest(mine[i], theirs[j]))
    return links, *forest(*(np.concatenate(c) for c in zip(*found, strict=True)))


def forest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, least node of its component) with the same components as the edges x, y."""
    if not len(x):
        return x, y
    nodes, ends = np.unique(np.concatenate([x, y]), return_inverse=True)
    a, b = ends[: len(x)], ends[len(x) :]
    label = np.arange(len(nodes))
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]
        if np.array_equal(low, label):
            break
        label = low
    child = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[child], nodes[label[child]]


def dealt(found: DataFrame, pivots: np.ndarray, cosine: float) -> DataFrame:
    """Points with their cell (nearest pivot) and their distances to all pivots, for the radii of the cells."""

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            cos = unit(stacked(frame["data"])) @ pivots.T
            yield frame.assign(cell=cos.argmax(1), near=np.sqrt(np.maximum(0, 2 - 2 * cos.max(1))))

    return found.mapInPandas(assign, "data binary, point bigint, n bigint, cell int, near double")


def block_links(members: pd.DataFrame, others: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """Rows (point, NO_EDGE, links) of the members, and rows (a, b, 0) of the forest."""
    count, a, b = joined_block(members, others, cosine)
    return pd.concat([pd.DataFrame({"a": members["point"].to_numpy(), "b": NO_EDGE, "c": count}), pd.DataFrame({"a": a, "b": b, "c": 0})])


def links(found: DataFrame, cosine: float = 0.9, pivots: int = PIVOTS, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(point, data, n, n_links) of every point, and the edges (a, b) of a forest of their links. found: points(), written."""
    width = F.length("data")
    large = [r["w"] for r in found.groupBy(width.alias("w")).count().where(F.col("count") > block).select("w").collect()]  # at most a row a block
    small = found.where(~width.isin(large)).withColumn("w", width) if large else found.withColumn("w", width)
    blocks = written(small.groupBy("w").applyInPandas(lambda frame: block_links(frame, frame, cosine), "a bigint, b bigint, c bigint"), "links")
    for w in large:
        blocks = blocks.unionByName(links_by_cells(found.where(width == w), cosine, pivots, block))
    counts = blocks.where(F.col("b") == NO_EDGE).groupBy(F.col("a").alias("point")).agg(F.sum("c").alias("n_links"))
    return found.join(counts, "point", "left").select("point", "data", "n", F.coalesce("n_links", F.lit(0)).alias("n_links")), blocks.where(F.col("b") != NO_EDGE).select("a", "b")


def pivot_count(pivots: np.ndarray, sample: np.ndarray, reach: float, least: int) -> int:
    """How many of the pivots to use: the number, doubled from least on, at which a vector meets the least share of all others.

    That share is about copies / pivots, with the copies of a vector measured on the sample; numbers at which there are more
    than MOST_COPIES are left out, so the shuffle stays in proportion to the input. In noise this is least itself.
    """
    best, k = (math.inf, least), least
    while k <= len(pivots) and len(sample):
        cos = sample @ pivots[:k].T
        own = cos.argmax(1)
        gap = np.sqrt(np.maximum(1e-12, 2 - 2 * pivots[:k] @ pivots[:k].T))[own]
        copies = ((cos[np.arange(len(own)), own][:, None] - cos) / gap <= reach).sum(1).mean()
        if k == least or copies <= MOST_COPIES:
            best = min(best, (copies / k, k))
        k = min(2 * k, len(pivots)) if k < len(pivots) else k + 1
    return min(best[1], len(pivots))


def links_by_cells(found: DataFrame, cosine: float, pivots: int, block: int) -> DataFrame:
    """block_links() of all points of one length, written."""
    most = max(pivots, min(MOST_PIVOTS, math.isqrt(found.count())))
    chosen = found.orderBy(F.xxhash64("data"), "point").limit(most + SAMPLE).select("data").toPandas()
    chosen = unit(stacked(chosen["data"]))
    reach = math.sqrt(2 - 2 * cosine) + SLACK
    centre = chosen[: pivot_count(chosen[:most], chosen[most:], reach, pivots)]
    cells = written(dealt(found, centre, cosine), "cells")
    shape = {r["cell"]: r for r in cells.groupBy("cell").agg(F.count("*").alias("c"), F.max("near").alias("far"), F.min("near").alias("near")).collect()}  # a row a pivot
    k = len(centre)
    far, near = (np.array([shape[c][x] if c in shape else (-1.0 if x == "far" else 9.0) for c in range(k)]) for x in ("far", "near"))
    member_blocks = np.array([-(-shape[c]["c"] // block) if c in shape else 0 for c in range(k)])
    gap = np.sqrt(np.maximum(1e-12, 2 - 2 * centre @ centre.T))

    def copied_to(frame: pd.DataFrame) -> np.ndarray:
        cos = unit(stacked(frame["data"])) @ centre.T
        away = np.sqrt(np.maximum(0, 2 - 2 * cos))
        own = frame["cell"].to_numpy()
        beyond = (cos[np.arange(len(own)), own][:, None] - cos) / gap[own]
        to = (away <= far + reach) & (away >= near - reach) & (beyond <= reach) & (member_blocks > 0)
        to[np.arange(len(own)), own] = True
        return to

    def copies(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"cell": np.arange(k), "c": copied_to(frame).sum(0)})

    sizes = {r["cell"]: r["c"] for r in cells.mapInPandas(copies, "cell int, c bigint").groupBy("cell").agg(F.sum("c").alias("c")).collect()}
    copy_blocks = np.array([max(1, -(-sizes.get(c, 0) // (2 * block))) for c in range(k)])

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Members go to every block of copies of their cell, copies to every block of its members."""
        for frame in frames:
            for low in range(0, len(frame), 1000):
                part = frame.iloc[low : low + 1000].reset_index(drop=True)
                point = part["point"].to_numpy().astype(np.uint64)
                mixed = (point * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                own = part["cell"].to_numpy()
                rows, cell, of_members, of_copies, member = [], [], [], [], []
                blocks = copy_blocks[own]
                i = np.repeat(np.arange(len(part)), blocks)
                rows.append(i)
                cell.append(own[i])
                of_members.append((mixed % member_blocks[own].astype(np.uint64)).astype(np.int64)[i])
                of_copies.append(np.arange(len(i)) - np.repeat(np.cumsum(blocks) - blocks, blocks))
                member.append(np.ones(len(i), bool))
                r, c = np.nonzero(copied_to(part))
                blocks = member_blocks[c]
                i = np.repeat(np.arange(len(r)), blocks)
                rows.append(r[i])
                cell.append(c[i])
                of_members.append(np.arange(len(i)) - np.repeat(np.cumsum(blocks) - blocks, blocks))
                of_copies.append(((mixed[r] >> np.uint64(5)) % copy_blocks[c].astype(np.uint64)).astype(np.int64)[i])
                member.append(np.zeros(len(i), bool))
                rows, cell, of_members, of_copies, member = (np.concatenate(x) for x in (rows, cell, of_members, of_copies, member))
                out = part[["point", "n", "data"]].iloc[rows].reset_index(drop=True)
                yield out.assign(cell=cell, block=of_members * copy_blocks[cell] + of_copies, member=member)

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        members, others = frame[frame["member"]], frame[~frame["member"]]
        if not len(members) or not len(others):
            return pd.DataFrame({"a": [], "b": [], "c": []})
        return block_links(members, others, cosine)

    sent = cells.mapInPandas(send, "point bigint, n bigint, data binary, cell int, block bigint, member boolean")
    return written(sent.groupBy("cell", "block").applyInPandas(join, "a bigint, b bigint, c bigint"), "links")


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", **how) -> DataFrame:
    """id, n_links, component_id, kept of every row."""
    rows = member_rows(vectors, id_col, vector_col)
    linked, edges = links(written(points(rows), "points"), cosine, **how)
    components = connected_components(edges).select(F.col("node").alias("point"), "component")
    by_point = linked.join(components, "point", "left").select("data", (F.col("n_links") + F.col("n") - 1).alias("n_links"), F.coalesce("component", "point").alias("component"))
    least = rows.where("data is not null").groupBy("data").agg(F.min("id").alias("least"))
    of_data = written(by_point.join(least, "data"), "linked")
    first = of_data.groupBy("component").agg(F.min(F.struct(F.col("least").isNull().alias("no_id"), "least", "data")).alias("first"))
    named = of_data.join(written(first, "first"), "component").select("data", "n_links", F.col("first.least").alias("component_id"), (F.col("data") == F.col("first.data")).alias("leads"))
    got = rows.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times")))).join(named, "data", "left")
    kept = F.col("leads") & F.col("id").eqNullSafe(F.col("component_id")) & (F.col("nth") == 1)
    component = F.when(F.col("leads").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return got.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.when(F.col("leads").isNull(), True).otherwise(kept).alias("kept"))


def member_rows(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, data (null if unusable), times of each id and vector, written; times: the rows it stands for, 1 unless id is null."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), packed_vectors(batch.column(1)), batch.column(2)], ["id", "data", "raw"])

    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.xxhash64(vector_col).alias("raw"))
    rows = rows.mapInArrow(pack, "id bigint, data binary, raw bigint")
    rows = rows.groupBy("id", "data", F.when(F.col("data").isNull(), F.col("raw")).alias("raw")).agg(F.count("*").alias("c"))
    return written(rows.select("id", "data", F.when(F.col("id").isNull(), F.col("c")).otherwise(F.lit(1)).cast("bigint").alias("times")), "vectors")


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates() of all embeddings; here every row of the component's least id is kept, as the query's contract says."""
    rows = near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return rows.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
