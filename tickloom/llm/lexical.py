"""Ranked lexical search with per-term geometric blocking.

A document is a vector of impacts, one a term: (10^9 tf) div (1000 tf + 8 m), where m grows with its length. Its score for a
query is the sum of weight x impact over the query's terms; all of it is integers, so bounds and ties are exact.

1. Forward table: a pass over the texts counts the terms that any query has (their set is broadcast, see QUERY_BYTES) and the
   length of each document. Postings of terms that no query has would never be read, so they are not made.
2. Floors: documents of a sixteenth of all ids are scored in full; the tenth best score there is a floor under each query's tenth best.
3. Index, written as a table: consecutive documents form a shard of bounded size. In a shard each posting list is cut into
   blocks of similar documents: members go to the most similar of some of the list's documents (cosine of sketches), and
   each block stores the greatest impact of its members in every coordinate that a query with its term can use.
   Terms lead for a query down to the one from which on even the greatest impacts of the rest together stay below the floor:
   a document without a leading term can't reach it. Lists that lead nowhere are stored without blocks.
4. Search, a task a shard: a query takes the blocks of its leading terms by falling bound (weights x summary), scores their
   members, and stops at the first bound below the floor or below its tenth best so far. Blocks whose bound equals it
   are read, for ties. A shard hands on at most `top` documents a query, none below the floor.
5. The best of all shards are ranked by score and doc_id.

Scale: texts are read once and never shuffled; the index has an entry for each (document, query term), and a list of any length
is spread over all shards. Queries are broadcast: at most QUERY_BYTES of their text at a time; with more, each such set of
queries is a search of its own. Within a shard queries are handled in blocks of at most `width` terms, so that the
matrix of a task (terms x documents) has at most CELLS cells.

Defined cases: null text has no terms; documents without terms are not counted; rows that repeat are documents each and
rank one after the other; rows with a null doc_id come last among equal scores; rows that repeat an item and its text are
one query, different texts under one item are ranked apart; items without terms or without a scoring document give no
rows; no documents or no items give no rows; further columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.common import Scratch, give_back, table, text_batches, written
from tickloom.llm.terms import DIGITS, LETTERS, term_table, terms_of

TOP = 10
QUERY_BYTES = 8 << 20
SHARD = 2048
WIDTH = 8192
CELLS = 1 << 24
BLOCK = 32
SKETCH = 32
SAMPLE = 16
AT_ONCE = 16  # blocks
_TERMS = term_table(LETTERS + DIGITS)

FORWARD = "doc_id bigint, n bigint, terms array<int>, tfs array<int>"
INDEX = "shard bigint, part int, term int, block int, ids array<bigint>, docs array<int>, impacts array<int>, coords array<int>, maxima array<int>"
FOUND = "query int, item_id bigint, doc_id bigint, score bigint"


@dataclass
class Queries:
    """Queries of a search. A part is a set of queries that is handled at once, cols its terms, own the places of a query's terms in them."""

    items: list[int | None]
    terms: list[np.ndarray]
    vocabulary: dict[bytes, int]
    top: int = TOP
    width: int = WIDTH
    parts: list[list[int]] = field(default_factory=list)
    cols: list[np.ndarray] = field(default_factory=list)
    own: list[np.ndarray] = field(default_factory=list)
    weight: np.ndarray | None = None
    n_docs: int = 0
    n_terms: int = 0
    floor: np.ndarray | None = None

    def __post_init__(self):
        if self.parts:
            return
        seen: set[int] = set()
        for q, t in enumerate(self.terms):
            if not self.parts or len(seen) + len(t) > self.width:
                self.parts.append([])
                seen = set()
            self.parts[-1].append(q)
            seen.update(t.tolist())
        self.own = [np.zeros(0, np.int64)] * len(self.terms)
        for part in self.parts:
            cols = np.unique(np.concatenate([self.terms[q] for q in part]))
            self.cols.append(cols)
            for q in part:
                self.own[q] = np.searchsorted(cols, self.terms[q])

    @property
    def shard(self) -> int:
        """Documents of a shard."""
        return max(16, min(SHARD, CELLS // max((len(c) for c in self.cols), default=1)))

    def leading(self, q: int, most: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Places of the terms without which no document of the shard reaches the query's floor. most: greatest impact of each term there."""
        c = self.own[q]
        upper = weight[c] * most[c]
        order = np.argsort(-upper, kind="stable")
        rest = np.cumsum(upper[order][::-1])[::-1]
        return c[order[(upper[order] > 0) & (rest >= self.floor[q])]]


def read_queries(rows: list, top: int, width: int) -> Queries:
    vocabulary: dict[bytes, int] = {}
    items, terms = [], []
    for item, text in rows:
        said = set(terms_of(text.encode(), _TERMS))
        if said:
            items.append(item)
            terms.append(np.sort(np.array([vocabulary.setdefault(t, len(vocabulary)) for t in sorted(said)], np.int64)))
    return Queries(items, terms, vocabulary, top, width)


# ---- forward table, weights, floors


def forward(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """FORWARD of every document with a term: its number of terms, and those of the vocabulary with their counts."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value.get
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            keep, n, sizes, terms, tfs = [], [], [], [], []
            for i in range(len(batch)):
                said = terms_of(texts[i].as_py() or b"", _TERMS)
                if said:
                    held = Counter(map(known, said))
                    held.pop(None, None)
                    keep.append(i)
                    n.append(len(said))
                    sizes.append(len(held))
                    terms.extend(held)
                    tfs.extend(held.values())
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.array(x, np.int32))) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])
        give_back()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(count, FORWARD)


def weighed(found: DataFrame, queries: Queries) -> Queries:
    """With the weights of the terms and the corpus' sizes. found: forward(), written."""
    size = len(queries.vocabulary)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=size)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["term", "df"])

    n_docs, n_terms = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    weight = np.zeros(size, np.int64)
    for r in found.select("terms").mapInArrow(frequencies, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect():  # a row a query term
        weight[r["term"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["df"] + 1)))
    return replace(queries, weight=weight, n_docs=n_docs, n_terms=n_terms, floor=np.zeros(len(queries.items), np.int64))


@dataclass
class Shard:
    """Consecutive documents: ids, and (term, doc, impact) of their postings in order of doc."""

    ids: pa.Array
    term: np.ndarray
    doc: np.ndarray
    impact: np.ndarray

    def matrix(self, cols: np.ndarray, size: int) -> np.ndarray:
        """Impacts, a row for each of cols and a column a document. size: of the vocabulary."""
        place = np.full(size, -1, np.int64)
        place[cols] = np.arange(len(cols))
        at = place[self.term]
        out = np.zeros((len(cols), len(self.ids)), np.int32)
        out[at[at >= 0], self.doc[at >= 0]] = self.impact[at >= 0]
        return out


def shards(batches: Iterator[pa.RecordBatch], queries: Queries) -> Iterator[Shard]:
    def whole(parts: list[pa.RecordBatch]) -> Iterator[Shard]:
        rows = pa.Table.from_batches(parts).combine_chunks()
        for low in range(0, len(rows), queries.shard):
            part = rows.slice(low, queries.shard).combine_chunks()
            lists = part.column("terms").combine_chunks()
            doc = np.repeat(np.arange(len(part)), lists.value_lengths().to_numpy(zero_copy_only=False))
            tf = part.column("tfs").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            m = 10 + 90 * part.column("n").to_numpy() * queries.n_docs // queries.n_terms
            yield Shard(part.column("doc_id").combine_chunks(), lists.flatten().to_numpy(zero_copy_only=False), doc, 10**9 * tf // (1000 * tf + 8 * m[doc]))

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= queries.shard:
            yield from whole(held)
            held = []
    if held:
        yield from whole(held)


def floors(found: DataFrame, queries: Queries) -> Queries:
    """With the tenth best score of each query among a sixteenth of all doc_ids, 0 where there are fewer."""
    shared = found.sparkSession.sparkContext.broadcast(queries)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qs = shared.value
        best = [np.zeros(0, np.int64)] * len(qs.items)
        for shard in shards(batches, qs):
            for part, cols in zip(qs.parts, qs.cols, strict=True):
                impacts = shard.matrix(cols, len(qs.weight))
                for q in part:
                    both = np.concatenate([best[q], qs.weight[qs.terms[q]] @ impacts[qs.own[q]]])
                    best[q] = np.sort(both[both > 0])[::-1][: qs.top]
        for q, scores in enumerate(best):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(scores), q, np.int32)), pa.array(scores)], ["query", "score"])

    sample = found.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0)
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))
    floor = queries.floor.copy()
    for r in sample.mapInArrow(score, "query int, score bigint").withColumn("nth", nth).where(F.col("nth") == queries.top).collect():  # a row a query
        floor[r["query"]] = r["score"]
    return replace(queries, floor=floor)


# ---- index


def clustered(docs: np.ndarray, sketch: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """The documents in order of their blocks, and where blocks begin."""
    if len(docs) <= block:
        return docs, np.zeros(1, np.int64)
    heads = docs[np.arange(0, len(docs), block)]
    label = (sketch[docs] @ sketch[heads].T).argmax(1)
    order = np.argsort(label, kind="stable")
    label = label[order]
    run = np.flatnonzero(np.concatenate([[True], label[1:] != label[:-1]]))
    within = np.arange(len(docs)) - np.repeat(run, np.diff(np.append(run, len(docs))))
    return docs[order], np.flatnonzero(within % (2 * block) == 0)


def index(found: DataFrame, queries: Queries, block: int = BLOCK) -> DataFrame:
    """INDEX: the blocks of each shard and term (block -1: a list that leads for no query, without a summary); a row of term -1 has the shard's ids."""
    shared = found.sparkSession.sparkContext.broadcast(queries)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qs = shared.value
        base = TaskContext.get().partitionId() << 32
        signs = np.random.default_rng(1).choice(np.array([-1, 1], np.float32), (max(map(len, qs.cols)), SKETCH))
        for nth, shard in enumerate(shards(batches, qs)):
            for p, cols in enumerate(qs.cols):
                yield one(qs, base + nth, p, cols, shard, signs)
        give_back()

    def one(qs: Queries, number: int, p: int, cols: np.ndarray, shard: Shard, signs: np.ndarray) -> pa.RecordBatch:
        impacts = shard.matrix(cols, len(qs.weight))
        weight = qs.weight[cols]
        most = impacts.max(1, initial=0)
        mates: dict[int, list[np.ndarray]] = {}
        for q in qs.parts[p]:
            for t in qs.leading(q, most, weight).tolist():
                mates.setdefault(t, []).append(qs.own[q])
        sketch = (impacts * weight[:, None]).T.astype(np.float32) @ signs[: len(cols)]
        sketch /= np.maximum(np.sqrt((sketch * sketch).sum(1, keepdims=True)), 1e-9)
        rows: list[tuple[int, int]] = [(-1, -1)]
        docs, coords, maxima = ([np.zeros(0, np.int64)] for _ in range(3))
        values = [np.zeros(0, np.int32)]
        for t in np.flatnonzero(most).tolist():
            members = np.flatnonzero(impacts[t])
            if t not in mates:
                rows.append((t, -1))
                docs.append(members)
                values.append(impacts[t, members])
                coords.append(coords[0])
                maxima.append(maxima[0])
                continue
            members, starts = clustered(members, sketch, block)
            reach = np.unique(np.concatenate(mates[t]))
            top = np.maximum.reduceat(impacts[np.ix_(reach, members)], starts, axis=1)
            for b, (lo, hi) in enumerate(zip(starts.tolist(), [*starts[1:].tolist(), len(members)], strict=True)):
                some = np.flatnonzero(top[:, b])
                rows.append((t, b))
                docs.append(members[lo:hi])
                values.append(impacts[t, members[lo:hi]])
                coords.append(reach[some])
                maxima.append(top[some, b])

        def lists(parts: list[np.ndarray]) -> pa.Array:
            ends = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts).astype(np.int32)))

        n = len(rows)
        ids = pa.ListArray.from_arrays(pa.array(np.array([0, *[len(shard.ids)] * n], np.int32)), shard.ids)
        terms, blocks = (pa.array(np.array([r[i] for r in rows], np.int32)) for i in (0, 1))
        fixed = [pa.repeat(pa.scalar(number, pa.int64()), n), pa.repeat(pa.scalar(p, pa.int32()), n)]
        return pa.RecordBatch.from_arrays([*fixed, terms, blocks, ids, lists(docs), lists(values), lists(coords), lists(maxima)], [c.split()[0] for c in INDEX.split(", ")])

    return found.mapInArrow(build, INDEX)


# ---- search


def _ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, one after the other, and where each begins."""
    size = end - start
    begin = np.cumsum(size) - size
    return np.arange(size.sum()) - np.repeat(begin - start, size), begin


def found_in_shard(rows: pa.Table, qs: Queries) -> pa.Table:
    """FOUND: the shard's best documents of each query of one part. rows: INDEX."""
    part = rows.column("part")[0].as_py()
    cols = qs.cols[part]
    weight = qs.weight[cols]
    rows = rows.sort_by([("term", "ascending"), ("block", "ascending")]).combine_chunks()
    term, block = (rows.column(c).to_numpy() for c in ("term", "block"))
    ids = rows.column("ids").combine_chunks().flatten()
    flat = {c: rows.column(c).combine_chunks() for c in ("docs", "impacts", "coords", "maxima")}
    size = {c: flat[c].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("docs", "coords")}
    docs, values, coords, maxima = (flat[c].flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in flat)
    impacts = np.zeros((len(cols), len(ids)), np.int64)
    impacts[np.repeat(term, size["docs"]), docs] = values
    most = impacts.max(1, initial=0)
    doc_end, coord_end = np.cumsum(size["docs"]), np.cumsum(size["coords"])
    no_id = ids.is_null().to_numpy(zero_copy_only=False)
    id_of = ids.fill_null(0).to_numpy(zero_copy_only=False)
    out: list[tuple[int, np.ndarray, np.ndarray]] = []
    of_query = np.zeros(len(cols), np.int64)
    for q in qs.parts[part]:
        lead, own = qs.leading(q, most, weight), qs.own[q]
        if not len(lead):
            continue
        blocks, _ = _ranges(np.searchsorted(term, lead), np.searchsorted(term, lead, "right"))
        assert (block[blocks] >= 0).all()
        of_query[own] = weight[own]
        at, begin = _ranges(coord_end[blocks] - size["coords"][blocks], coord_end[blocks])
        bound = np.add.reduceat(of_query[coords[at]] * maxima[at], begin)
        of_query[own] = 0
        order = np.argsort(-bound, kind="stable")
        blocks, bound = blocks[order], bound[order]
        least = max(1, qs.floor[q])
        seen = np.zeros(len(ids), bool)
        best, score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for low in range(0, len(blocks), AT_ONCE):
            some = blocks[low : low + AT_ONCE][bound[low : low + AT_ONCE] >= least]
            if not len(some):
                break
            fresh, _ = _ranges(doc_end[some] - size["docs"][some], doc_end[some])
            fresh = np.unique(docs[fresh])
            fresh = fresh[~seen[fresh]]
            seen[fresh] = True
            best, score = np.append(best, fresh), np.append(score, weight[own] @ impacts[np.ix_(own, fresh)])
            order = np.lexsort((id_of[best], no_id[best], -score))[: qs.top]
            best, score = best[order], score[order]
            if len(score) == qs.top:
                least = max(least, score[-1])
        good = score >= least
        out.append((q, best[good], score[good]))
    query = np.concatenate([np.full(len(b), q, np.int32) for q, b, _ in out] or [np.zeros(0, np.int32)])
    best = np.concatenate([b for _, b, _ in out] or [np.zeros(0, np.int64)])
    items = pa.array(qs.items, pa.int64()).take(pa.array(query))
    return pa.table({"query": query, "item_id": items, "doc_id": ids.take(pa.array(best)), "score": np.concatenate([s for *_, s in out] or [np.zeros(0, np.int64)])})


def search(blocks: DataFrame, queries: Queries) -> DataFrame:
    """item_id, rank, doc_id, score of the best documents of each query. blocks: index(), written."""
    shared = blocks.sparkSession.sparkContext.broadcast(queries)
    got = blocks.groupBy("shard", "part").applyInArrow(lambda rows: found_in_shard(rows, shared.value), FOUND)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return got.withColumn("rank", rank).where(F.col("rank") <= queries.top).select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, query_bytes: int = QUERY_BYTES, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score: the `top` best documents of each item. The result is written; the tables behind it are deleted."""
    spark = docs.sparkSession
    text_batches(spark)
    asked = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("text is not null").distinct()
    turns = max(1, -(-asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0] // query_bytes))
    got = spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    scratch = Scratch()
    for turn in range(turns):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(turns)) == turn).orderBy("item_id", "text").collect()  # about query_bytes
        queries = read_queries(rows, top, width)
        if not queries.items:
            continue
        found = scratch.table(forward(docs, queries.vocabulary), "forward")
        queries = weighed(found, queries)
        if queries.n_docs:
            queries = floors(found, queries)
            blocks = scratch.table(index(found, queries, block), "blocks")
            got = got.unionByName(search(blocks, queries))
    got = written(got, "ranked")
    scratch.drop(*scratch.held.values())
    return got


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS said FROM documents),
g AS (SELECT count(*) AS n_docs, sum(len(said))::BIGINT AS n_terms FROM d WHERE len(said) > 0),
tf AS (SELECT doc_id, r, n, term, count(*) AS tf FROM (SELECT doc_id, r, len(said) AS n, unnest(said) AS term FROM d) GROUP BY ALL),
weight AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, g GROUP BY term, n_docs),
items AS (SELECT item_id, text, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)),
scores AS (SELECT item_id, text, doc_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::BIGINT AS score FROM items JOIN tf USING (term) JOIN weight USING (term), g GROUP BY ALL),
ranked AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
