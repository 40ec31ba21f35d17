"""MinHash near-dedup with DartMinHash signatures.

A text is the set of its runs of five words (of all its words, if it has fewer), each weighing as often as it occurs, or
with weighted=False 1. Similarity is the weighted Jaccard coefficient: the sum of the lesser weights over that of the greater.

Signatures: every element owns a plane of weight x rank, cut into cells whose sides double. A cell's darts follow from
hashes of the element and the cell: a Poisson number of darts, each with a weight, a rank and one of k coordinates. A
text sees the darts below its elements' weights; of each coordinate it keeps the one of least rank. Two texts keep the same
dart at a coordinate with the probability of their similarity. Only ranks up to about k ln k / (total weight) are thrown, so
the work is one look at few cells per element and k log k darts, not k hashes per element; a text with an empty
coordinate throws again up to twice the rank.

Groups: copies of a text are one class from the start (digest of the text). Texts that agree in a band of 5 coordinates
(30 bands: a pair at similarity 0.8 shares none with a chance of 7e-6) are candidates. Each text is first compared
with the least head of its buckets, then one member of each component with the head of its bucket's least
component. Members of buckets that are then still of several components are compared with each other, in blocks of
bounded size, by sketches and then by their texts, until no pair is left that could join two components; what leaves a
block is one link for each join. Candidates whose sketches agree in less than 60 % of 150 coordinates (6 standard
deviations below 0.8) are dropped; all others are decided by the exact similarity of their texts. Components of the
links are the groups.

A text is known by its digest (128 bits) throughout, never by doc_id: `rep` is a number of the digest. A class is
reported by its least doc_id at the end, and one row of each class is kept: of the row of that doc_id, by digest.

Defined cases: null text counts as empty; texts without words link with nothing but their copies, which are their
class; repeated rows are copies, of which one is kept; different texts under one doc_id are compared like any others and
may be of different classes of that name, each with a row kept; rows with a null doc_id are compared, too, and come last
within their class: only a class without other ids has a null class_id and keeps one of them; an empty table gives no
rows; further columns are not read. Words are separated by ASCII white space and compared as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.common import connected_components, give_back, text_batches, touching, written
from tickloom.llm.suffix_dedup import Hashes, _column, _mixed

SHINGLE = 5
BANDS, ROWS = 30, 5
K = BANDS * ROWS
THRESHOLD = 0.8
SKETCH_LEAST = 0.6
MERGES = 1
BLOCK = 250
SLICE = 1 << 19
LOWEST = -8  # the first rank cell is [0, 2^LOWEST)

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def shingles(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every run of SHINGLE words, in order. data: bytes of the texts; ends: where each ends."""
    # A separator after each text keeps words of neighbours apart.
    wide = np.full(len(data) + len(ends), 32, np.uint8)
    begins = np.append(0, ends[:-1])
    text_of_byte = np.repeat(np.arange(len(ends)), ends - begins)
    wide[np.arange(len(data)) + text_of_byte] = data
    word = ~_SPACE[wide]
    edge = np.diff(word.astype(np.int8), prepend=0, append=0)
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes = Hashes(wide).of(start, stop)
    text = np.searchsorted(ends + np.arange(1, len(ends) + 1), start, side="right")
    n = np.bincount(text, minlength=len(ends))
    first = np.cumsum(n) - n
    nth = np.arange(len(start)) - first[text]
    # A run of k words is hashed by prefix sums, too: the sum of word hashes times powers of an odd number.
    up = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(start), 0xD6E8FEB86659FD93, np.uint64)]))
    down = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(start), pow(0xD6E8FEB86659FD93, -1, 1 << 64), np.uint64)]))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(hashes * up[:-1])])
    size = np.minimum(n, SHINGLE)[text]
    at = np.flatnonzero(nth <= n[text] - size)
    return text[at], _mixed((sums[at + size[at]] - sums[at]) * down[at])


def distinct(text: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash of 44 bits, count) of the distinct shingles of each text; at most 2^20 texts."""
    key, count = np.unique((text.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20)), return_counts=True)
    return (key >> np.uint64(44)).astype(np.int64), key & np.uint64((1 << 44) - 1), count


@cache
def poisson_limits(area: float) -> np.ndarray:
    """A hash below the n-th limit, as a number of 64 bits, means at most n darts."""
    reach = int(area + 12 * np.sqrt(area) + 24)
    terms = np.concatenate([[0.0], np.cumsum(np.log(area) - np.log(np.arange(1, reach)))])
    cdf = np.minimum(1.0, np.cumsum(np.exp(terms - area)))
    return (cdf * float(2**64 - 2048)).astype(np.uint64)


def signatures(text: np.ndarray, element: np.ndarray, weight: np.ndarray, n_texts: int, k: int = K) -> np.ndarray:
    """n_texts x k darts (rank and identity in 64 bits); all ones for texts without elements."""
    nothing = np.uint64(0xFFFFFFFFFFFFFFFF)
    best = np.full(n_texts * k, nothing)
    total = np.bincount(text, weight, n_texts)
    with np.errstate(divide="ignore"):
        reach = k * (np.log(k) + 3) / total
    base = _mixed(element + np.uint64(0x9E3779B97F4A7C15))
    todo = total > 0
    while todo.any():
        mine = np.flatnonzero(todo[text])
        t, b, w = text[mine], base[mine], weight[mine]
        top = np.maximum(0, np.ceil(np.log2(reach[t])) - LOWEST).astype(np.int64)
        for v in range(int(np.ceil(np.log2(max(1.0, w.max())))) + 1):
            low_w, high_w = (0.0, 1.0) if v == 0 else (2.0 ** (v - 1), 2.0**v)
            for r in range(int(top.max()) + 1):
                low_r, high_r = (0.0, 2.0**LOWEST) if r == 0 else (2.0 ** (LOWEST + r - 1), 2.0 ** (LOWEST + r))
                sel = np.flatnonzero((top >= r) & (w > low_w)) if v or r else np.arange(len(t))
                h = _mixed(b[sel] ^ np.uint64((v * 64 + r + 1) * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF))
                limits = poisson_limits((high_w - low_w) * (high_r - low_r))
                some = np.flatnonzero(h >= limits[0])
                n = np.searchsorted(limits, h[some], side="right")
                i = np.repeat(some, n)
                j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
                dart = _mixed(h[i] + (j + 1).astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB))
                more = _mixed(dart + np.uint64(0x8EBC6AF09C88C6E3))
                rank = low_r + (high_r - low_r) * ((dart >> np.uint64(11)).astype(np.float64) / 2.0**53)
                ok = rank <= reach[t[sel[i]]]
                if v or w.min() < 1:
                    ok &= low_w + (high_w - low_w) * ((more & np.uint64(0xFFFFFF)).astype(np.float64) / 2.0**24) < w[sel[i]]
                at = t[sel[i[ok]]] * k + ((more[ok] >> np.uint64(24)) % np.uint64(k)).astype(np.int64)
                value = (rank[ok].astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (_mixed(more[ok]) >> np.uint64(32))
                np.minimum.at(best, at, value)
        todo &= (best.reshape(n_texts, k) == nothing).any(1)
        again = np.repeat(todo, k)
        best[again] = nothing
        reach = np.where(todo, reach * 2, reach)
    return best.reshape(n_texts, k)


def banded(signature: np.ndarray) -> np.ndarray:
    """A hash of each band of a row."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x589965CC75374CC3), parts.shape[:2])
    for r in range(ROWS):
        h = _mixed(h * np.uint64(0xD6E8FEB86659FD93) + parts[:, :, r])
    return h


SIGNED = "doc_id bigint, d1 bigint, d2 bigint, bands array<bigint>, sketch binary"


def signed(docs: DataFrame, weighted: bool = True) -> DataFrame:
    """doc_id, digest (d1, d2), bands, sketch (a byte of each coordinate) of every document; bands null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = _column(batch, "data")
            low = 0
            while low < len(batch):
                begin = ends[low - 1] if low else 0
                high = max(low + 1, int(np.searchsorted(ends, begin + SLICE, side="right")))
                part = ends[low:high] - begin
                text, element, count = distinct(*shingles(data[begin : ends[high - 1]], part))
                sign = signatures(text, element, count.astype(float) if weighted else np.ones(len(count)), high - low)
                has = np.bincount(text, minlength=high - low) > 0
                bands = banded(sign).view(np.int64).reshape(-1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(high - low + 1, dtype=np.int32) * BANDS), pa.array(bands), mask=pa.array(~has))
                sketch = (sign & np.uint64(0xFF)).astype(np.uint8).tobytes()
                rows = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), rows.column(2), lists, pa.array([sketch[i * K : (i + 1) * K] for i in range(high - low)], pa.binary())], ["doc_id", "d1", "d2", "bands", "sketch"])
                low = high
            give_back()

    return docs.select("doc_id", "d1", "d2", "data").mapInArrow(run, SIGNED)


def with_digest(docs: DataFrame, *keep: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("d1"), F.xxhash64(F.lit(1), text).alias("d2"), text.cast("binary").alias("data"), *keep)


def with_components(buckets: DataFrame, links: DataFrame) -> DataFrame:
    """key, rep, component of the members of buckets."""
    labels = connected_components(links).withColumnRenamed("node", "rep")
    return written(buckets.join(labels, "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component")), "members")


def sketch_pairs(pairs: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """Those of pairs (a, b) whose sketches agree often enough. sketches: rep, sketch."""
    a, b = (sketches.select(F.col("rep").alias(x), F.col("sketch").alias(f"s{x}")) for x in "ab")

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, K) for i in (2, 3))
            near = (x == y).mean(1) >= least
            yield batch.select([0, 1]).filter(pa.array(near))

    return pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb").mapInArrow(agree, "a bigint, b bigint")


def shingle_sets(data: np.ndarray, ends: np.ndarray, weighted: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, weight) of the distinct shingles, sorted by text and hash."""
    text, h = shingles(data, ends)
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.flatnonzero(np.append(True, (np.diff(text) != 0) | (h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
    return text[new], h[new], np.diff(np.append(new, len(h))) if weighted else np.ones(len(new), np.int64)


def sets_of(data: np.ndarray, ends: np.ndarray, weighted: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """shingle_sets() of many texts, some at a time: the hashes of a slice take some forty times its bytes."""
    out, low = [shingle_sets(data[:0], ends[:0], weighted)], 0
    while low < len(ends):
        begin = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, begin + SLICE // 2, side="right")))
        text, h, weight = shingle_sets(data[begin : ends[high - 1]], ends[low:high] - begin, weighted)
        out.append((text + low, h, weight))
        low = high
    text, h, weight = (np.concatenate(x) for x in zip(*out, strict=True))
    return text, h, weight


def similarity(pair: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Exact (weighted) Jaccard of n pairs, from the shingles of both sides of each pair."""
    order = np.lexsort((h, pair))
    pair, h, weight = pair[order], h[order], weight[order]
    both = np.flatnonzero((pair[1:] == pair[:-1]) & (h[1:] == h[:-1]))
    shared = np.bincount(pair[both], np.minimum(weight[both], weight[both + 1]), n)
    return shared / np.maximum(np.bincount(pair, weight, n) - shared, 1)


def texts_of(ids: DataFrame, texts: DataFrame, reps: DataFrame) -> DataFrame:
    """rep, data of the texts in ids (rep): one row each. texts: d1, d2, id, data; reps: rep, d1, d2, id of the row to read."""
    wanted = reps.select("rep", "d1", "d2", "id").join(ids.select("rep").distinct(), "rep")
    # Partial aggregation first, so repeated rows of one id and text do not meet.
    once = touching(texts, wanted, "d1", "d2", "id").groupBy("d1", "d2", "id").agg(F.any_value("data").alias("data"))
    return once.join(wanted, ["d1", "d2", "id"]).select("rep", "data")


def similar(pairs: DataFrame, texts: DataFrame, reps: DataFrame, threshold: float, weighted: bool) -> DataFrame:
    """Those of pairs (a, b) whose texts reach the threshold exactly. texts, reps: as for texts_of()."""
    ids = pairs.select(F.col("a").alias("rep")).union(pairs.select(F.col("b").alias("rep")))
    near = texts_of(ids, texts, reps)
    a, b = (near.select(F.col("rep").alias(x), F.col("data").alias(f"d{x}")) for x in "ab")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 50):
                part = batch.slice(low, 50)
                sets = [sets_of(*_column(part, name), weighted) for name in ("da", "db")]
                found = similarity(*(np.concatenate(x) for x in zip(*sets, strict=True)), len(part))
                yield part.select([0, 1]).filter(pa.array(found >= threshold - 1e-9))
            give_back()

    return pairs.join(a, "a").join(b, "b").select("a", "b", "da", "db").mapInArrow(exact, "a bigint, b bigint")


GROUP = ("key", "i", "j")


def candidate_rows(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one group, from different components, whose sketches agree often enough; those that agree most first.

    table: sorted by key, i, j, with own, component, sketch.
    """
    cell = np.stack([table[c].to_numpy() for c in GROUP])
    own, component = table["own"].to_numpy(), table["component"].to_numpy()
    sketch = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(-1, K)
    group = np.cumsum(np.append(True, (cell[:, 1:] != cell[:, :-1]).any(0))) - 1
    size = np.bincount(group)[group]
    nth = np.arange(len(group)) - np.searchsorted(group, group)
    found = [np.zeros((3, 0), np.int64)]
    for step in range(1, int(size.max(initial=0))):
        x = np.flatnonzero(nth + step < size)
        y = x + step
        ok = (component[x] != component[y]) & ((own[x] != own[y]) | (cell[1][x] == cell[2][x]))
        x, y = x[ok], y[ok]
        for low in range(0, len(x), 50_000):
            p, q = x[low : low + 50_000], y[low : low + 50_000]
            alike = (sketch[p] == sketch[q]).sum(1)
            near = alike >= SKETCH_LEAST * K
            found.append(np.stack([p[near], q[near], alike[near]]))
    x, y, alike = np.concatenate(found, axis=1)
    best = np.argsort(-alike, kind="stable")
    return x[best], y[best]


def candidate_members(table: pa.Table) -> pa.Table:
    """The rows that are in a candidate pair."""
    return table.take(pa.array(np.unique(np.concatenate(candidate_rows(table)))))


def linked_members(table: pa.Table, threshold: float, weighted: bool) -> pa.Table:
    """Links (a, b) that join components within the groups of a table with data, too.

    Once a link has joined two components no further pair of theirs is looked at, so a component gives at most one link
    for each that it joins.
    """
    x, y = candidate_rows(table)
    rep, component = table["rep"].to_numpy(), table["component"].to_numpy()
    text, h, weight = sets_of(*_column(table.combine_chunks().to_batches()[0], "data"), weighted)
    begins = np.searchsorted(text, np.arange(len(table) + 1))
    label = np.unique(component, return_inverse=True)[1]
    links: list[tuple[int, int]] = []
    while len(x):
        apart = label[x] != label[y]
        x, y = x[apart], y[apart]
        p, q, x, y = x[:200], y[:200], x[200:], y[200:]
        at = np.concatenate([p, q])
        n = begins[at + 1] - begins[at]
        take = np.repeat(begins[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
        which = np.repeat(np.concatenate([np.arange(len(p))] * 2), n)
        for k in np.flatnonzero(similarity(which, h[take], weight[take], len(p)) >= threshold - 1e-9).tolist():
            a, b = label[p[k]], label[q[k]]
            if a != b:
                links.append((int(rep[p[k]]), int(rep[q[k]])))
                label[label == max(a, b)] = min(a, b)
    both = np.array(links, np.int64).reshape(-1, 2)
    return pa.table({"a": both.max(1), "b": both.min(1)})


def by_group(rows: DataFrame, work, schema: str, held_bytes: int = 2_000_000) -> DataFrame:
    """work(table) on whole groups (key, i, j) of rows, several groups at a time; a group has at most 2 BLOCK rows or so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(tables: list[pa.Table]) -> Iterator[pa.RecordBatch]:
            yield from work(pa.concat_tables(tables).combine_chunks()).to_batches()
            give_back()

        held: list[pa.Table] = []
        size = 0
        for batch in batches:  # sorted: a group's rows are neighbours
            table = pa.Table.from_batches([batch])
            cell = np.stack([table[c].to_numpy() for c in GROUP])
            cuts = np.flatnonzero((cell[:, 1:] != cell[:, :-1]).any(0)) + 1
            if held and [held[-1][c][-1].as_py() for c in GROUP] != cell[:, 0].tolist():
                cuts = np.append(0, cuts)
            low = 0
            for cut in cuts.tolist():
                piece = table.slice(low, cut - low)
                if size + piece.nbytes >= held_bytes:
                    yield from done([*held, piece])
                    held, size, low = [], 0, cut
            held.append(table.slice(low))
            size += held[-1].nbytes
        if size:
            yield from done(held)

    return rows.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(run, schema)


def cross_links(members: DataFrame, texts: DataFrame, reps: DataFrame, threshold: float, weighted: bool) -> DataFrame:
    """Links between members of one bucket and different components. members: key, rep, component, sketch.

    Buckets are dealt into blocks of about BLOCK members, and block pairs are joined apart: first by sketches alone, then,
    what is left of them, with the texts.
    """
    sized = members.join(members.groupBy("key").agg(F.count("*").alias("c")), "key").withColumn("blocks", F.ceil(F.col("c") / BLOCK).cast("int"))
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    placed = sized.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = placed.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "component", "sketch")
    left = written(by_group(dealt, candidate_members, "key bigint, i int, j int, own int, rep bigint, component bigint, sketch binary"), "candidates")
    return by_group(left.join(texts_of(left, texts, reps), "rep"), lambda t: linked_members(t, threshold, weighted), "a bigint, b bigint")


def classes(docs: DataFrame, threshold: float = THRESHOLD, weighted: bool = True) -> DataFrame:
    """doc_id, d1, d2, times, class_id, head of each distinct doc_id and text. docs: what with_digest() gave.

    times: how many rows it stands for; class_id: the least doc_id of its class; head: one of each class, and of that id.
    """
    text_batches(docs.sparkSession)
    sign = written(signed(docs, weighted), "signatures")
    texts_known = sign.groupBy("d1", "d2").agg(F.min("doc_id").alias("least"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch"))
    # Texts are numbered by half of their digest; those that share it, by a hash of the whole.
    nth = F.row_number().over(Window.partitionBy("d1").orderBy("d2"))
    numbers = F.when(nth == 1, F.col("d1")).otherwise(F.xxhash64("d2", "d1"))
    reps = written(texts_known.withColumn("rep", numbers).withColumn("id", F.coalesce("least", F.lit(0))), "reps")
    sketches = reps.select("rep", "sketch")
    bands = reps.select("rep", F.explode("bands").alias("key"))
    buckets = bands.groupBy("key").agg(F.count("*").alias("c"), F.min("rep").alias("head")).where("c > 1")
    buckets = written(bands.join(buckets, "key"), "buckets")
    texts = docs.select("d1", "d2", F.coalesce("doc_id", F.lit(0)).alias("id"), "data")

    def verified(pairs: DataFrame) -> DataFrame:
        near = written(sketch_pairs(pairs, sketches, SKETCH_LEAST), "near")
        return written(similar(near, texts, reps, threshold, weighted).distinct(), "links")

    # Each text with the least head of its buckets: one pair a text.
    tried = written(buckets.where("rep <> head").groupBy(F.col("rep").alias("a")).agg(F.min("head").alias("b")), "tried")
    found = verified(tried)
    for _ in range(MERGES):
        known = with_components(buckets, found)
        heads = known.groupBy("key").agg(F.min(F.struct("component", "rep")).alias("head"), F.max("component").alias("high")).where("head.component < high")
        pairs = known.join(heads, "key").where("component <> head.component").groupBy("component", F.col("head.component").alias("into")).agg(F.min(F.struct(F.col("rep"), F.col("head.rep").alias("other"))).alias("p"))
        pairs = written(pairs.select(F.col("p.rep").alias("a"), F.col("p.other").alias("b")).join(tried, ["a", "b"], "left_anti"), "tried")
        new = verified(pairs)
        if new.isEmpty():
            break
        tried, found = tried.union(pairs), found.union(new)
    # What is left: members of one bucket in several components.
    known = with_components(buckets, found)
    mixed = known.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    open_members = known.join(mixed, "key").join(sketches, "rep").select("key", "rep", "component", "sketch")
    second = cross_links(open_members, texts, reps, threshold, weighted)
    labels = connected_components(written(found.union(second).distinct(), "links")).withColumnRenamed("node", "rep")
    of_text = reps.select("rep", "d1", "d2", "least").join(labels, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    first = of_text.groupBy("component").agg(F.min(F.struct(F.col("least").isNull().alias("no_id"), "least", "d1", "d2")).alias("first"))
    named = of_text.join(first, "component").select("d1", "d2", F.col("first.least").alias("class_id"), F.struct("d1", "d2").eqNullSafe(F.struct("first.d1", "first.d2")).alias("leads"))
    # Two written tables join and nothing is counted by their key, so that Spark can split a text that very many documents are copies of.
    each = written(sign.groupBy("doc_id", "d1", "d2").agg(F.count("*").alias("times")), "each")
    return each.join(written(named, "named"), ["d1", "d2"]).select("doc_id", "d1", "d2", "times", "class_id", (F.col("leads") & F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("head"))


def groups(docs: DataFrame, threshold: float = THRESHOLD, weighted: bool = True) -> DataFrame:
    """doc_id, d1, d2, class_id, kept of every row. docs: what with_digest() gave."""
    found = classes(docs, threshold, weighted)
    rows = found.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times"))))
    return rows.select("doc_id", "d1", "d2", "class_id", (F.col("head") & (F.col("nth") == 1)).alias("kept"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(with_digest(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return found.select("doc_id", "class_id", "kept")


def minhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class: that of its least doc_id; of repeated rows of that document one."""
    found = written(classes(with_digest(docs)), "classes")
    text = F.coalesce(F.col("text"), F.lit(""))
    key = {"__d1": F.xxhash64(text), "__d2": F.xxhash64(F.lit(1), text), "__id": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)), "__null": F.col("doc_id").isNull()}
    lost = found.where("not head").select(F.col("d1").alias("__d1"), F.col("d2").alias("__d2"), F.coalesce("doc_id", F.lit(0)).alias("__id"), F.col("doc_id").isNull().alias("__null"))
    kept = docs.withColumns(key).join(lost, list(key), "left_anti")
    if found.where("head and times > 1").limit(1).count():
        one = Window.partitionBy(*key).orderBy(F.xxhash64(*docs.columns))
        kept = kept.withColumn("__n", F.row_number().over(one)).where("__n = 1")
    return kept.select(*docs.columns)
