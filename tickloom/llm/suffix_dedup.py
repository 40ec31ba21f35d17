"""Suffix-array dedup: units covered by a string of `length` units that starts anywhere else are removed.

Units are bytes (length 400: op1) or words (length 51, that is passages of over 50 words: the pipeline's stage). Words
are runs without ASCII white space; characters from U+3000 on (CJK, kana, Hangul, emoji) are words of their own, since
such texts have no spaces.

Distributed prefix doubling over a sampled suffix array. A full array would need a rank for every byte; here

1. every string of `length` units elects one position in it, the leftmost one of least hash among its prefixes of
   length/4. The choice depends on the string alone, so equal strings elect the same position. Neighbouring strings
   mostly elect the same one, which leaves about one position for each 3/8 of `length`. Its first key is the prefix there
   (`added`), by hash; `outer` tells apart all that its run of strings spans.
2. Equal keys are counted, keys of one position drop out, and Spark sorts the others by range: a position's rank is the
   place of its key in that order. A unique key: none of the run's strings occurs elsewhere, the run is done. An outer
   that occurs twice: all of them do, the run is done. What is left are runs at which a repeat begins or ends.
3. Those are ranked again by pairs (rank so far, what a longer window adds at both ends). The run's strings are cut into
   classes of neighbours, by their distance from the elected position, and the window of a class is what all its strings
   share: 100 of 400 bytes first, then, with classes of 49, 7 and 1 strings, 352, 394 and 400. The windows of a class hold
   that of the class it was cut from, so equal pairs are equal windows. Pairs are counted and sorted as in 2, unique ones
   drop out, and the rounds end when none is left or the window has the length of the string.

Windows grow towards the threshold, not by doubling: 200 neighbours share a window of 200 bytes, so that the step from 200
to 400 would make 200 rows of each. Sorting the counted pairs keeps hot ones to one row each.

Prefixes and what windows add are compared by 64-bit hashes. Equal strings have equal ranks by construction; two different
keys of one rank so far share a hash with a chance of about 2^-64 a pair.

Defined cases: null text counts as empty; texts shorter than `length` lose nothing; repeated rows with one doc_id are
told apart by a row number within it, so a doubled row repeats itself like any copy; a null doc_id is an id of its own;
an empty table gives no rows; further columns are not read, and the stage hands them on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.common import Scratch, give_back, text_batches, touching, written

LENGTH = 400
PASSAGE_WORDS = 51
SHRINK = 7
SEGMENT = 1 << 19

_BASE = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64)
_POWERS: dict[str, np.ndarray] = {}
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            table = np.full(n, base, np.uint64)
            table[0] = 1
            _POWERS[name] = np.multiply.accumulate(table)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Hashes:
    """Hashes of any substring of bytes, or of units given as numbers of 64 bits: prefix sums of a polynomial modulo 2^64."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((_BYTES[data] if data.dtype == np.uint8 else data) * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.down[start])

    def every(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return _mixed((self.sums[length:] - self.sums[:n]) * self.down[:n])


def word_bounds(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop) of every word of texts one after the other, and where each text's words end. ends: of the texts, in bytes."""
    word = ~_SPACE[data]
    begins = np.append(0, ends[:-1])
    start = word.copy()
    start[1:] &= ~word[:-1]
    start[begins[begins < len(data)]] = word[begins[begins < len(data)]]
    wide = np.flatnonzero(data >= 0xE3)  # first bytes of characters of three or four bytes from U+3000 on
    start[wide] = True
    after = wide + np.where(data[wide] >= 0xF0, 4, 3)
    after = after[after < len(data)]
    start[after] = word[after]
    breaks = np.append(np.flatnonzero(start | ~word), len(data))
    first = np.flatnonzero(start)
    return first, breaks[np.searchsorted(breaks, first, side="right")], np.searchsorted(first, ends)


def word_ranks(data: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A hash of each word, some at a time."""
    out, low = [np.zeros(0, np.uint64)], 0
    while low < len(first):
        high = max(low + 1, int(np.searchsorted(stop, first[low] + SEGMENT, side="right")))
        out.append(Hashes(data[first[low] : stop[high - 1]]).of(first[low:high] - first[low], stop[low:high] - first[low]))
        low = high
    return np.concatenate(out)


def units(data: np.ndarray, ends: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """The units of texts one after the other, and where each text's units end."""
    if unit == "bytes":
        return data, ends
    first, stop, ends = word_bounds(data, ends)
    return word_ranks(data, first, stop), ends


def least_positions(h: np.ndarray, width: int) -> np.ndarray:
    """For each i the leftmost position of the least of h[i : i + width], by its upper 40 bits."""
    m = (h >> np.uint64(24) << np.uint64(24)) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if span < width:
        m = np.minimum(m[: len(m) - (width - span)], m[width - span :])
    return (m & np.uint64((1 << 24) - 1)).astype(np.int64)


def core_of(length: int) -> int:
    return max(1, length // 4)


def runs_of_segment(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(inner: of the prefix at the elected position, outer, first, last, elected) of each run of strings that elect one position.

    data: units; starts: the positions, ascending, at which strings of `length` units within one document start.
    """
    core = core_of(length)
    hashes = Hashes(data)
    grams = hashes.every(core)
    elected = least_positions(grams, length - core + 1)[starts]
    new = np.flatnonzero(np.append(True, (np.diff(elected) != 0) | (np.diff(starts) != 1)))
    first, last = starts[new], starts[np.append(new[1:], len(starts)) - 1]
    at = elected[new]
    outer = hashes.of(first, last + length) ^ _mixed((at - first).astype(np.uint64))
    return grams[at], outer, first, last, at


RUNS = "doc_id bigint, row int, added bigint, outer bigint, first bigint, last bigint, elected bigint, n int"


def _column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column, and where each row ends; nulls are empty."""
    column = batch.column(batch.schema.get_field_index(name))
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, offsets[1:] - offsets[0]


def runs(docs: DataFrame, length: int, unit: str) -> DataFrame:
    """The runs of each document. Positions count from the document's start.

    Equal runs of a document become one row with n = 2, and where they stand, being repeats, rows without ranks.
    docs: doc_id, row, data (binary).
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = units(*_column(batch, "data"), unit)
            begins = np.append(0, ends[:-1])
            ids, rows = batch.column(0), batch.column(1).to_numpy()
            for low in range(0, max(1, len(data)), SEGMENT):
                part = data[low : low + SEGMENT + length]
                # Where strings start: before each document's last length - 1 units.
                a, b = np.maximum(begins, low), np.minimum(ends - length + 1, low + SEGMENT)
                some = np.flatnonzero(b > a)
                if not len(some):
                    continue
                counts = (b - a)[some]
                starts = np.repeat(a[some] - low - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
                inner, outer, first, last, at = runs_of_segment(part, starts, length)
                doc = np.searchsorted(ends, first + low, side="right")
                order = np.lexsort((first, outer, inner, doc))
                inner, outer, first, last, at, doc = (x[order] for x in (inner, outer, first, last, at, doc))
                new = np.append(True, (np.diff(doc) != 0) | (inner[1:] != inner[:-1]) | (outer[1:] != outer[:-1]))
                group = np.cumsum(new) - 1
                many = np.bincount(group)[group] > 1
                first, last, at = (x + low - begins[doc] for x in (first, last, at))

                def rows_of(d, *columns):
                    n = np.full(len(d), 2) if len(columns) == 2 else columns[-1]
                    ranks = [pa.nulls(len(d), pa.int64())] * 2 if len(columns) == 2 else [pa.array(c.view(np.int64)) for c in columns[3:5]]
                    elected = pa.nulls(len(d), pa.int64()) if len(columns) == 2 else pa.array(columns[2])
                    arrays = [ids.take(pa.array(d)), pa.array(rows[d].astype(np.int32)), *ranks, pa.array(columns[0]), pa.array(columns[1]), elected, pa.array(n.astype(np.int32))]
                    return pa.RecordBatch.from_arrays(arrays, ["doc_id", "row", "added", "outer", "first", "last", "elected", "n"])

                yield rows_of(doc[new], first[new], last[new], at[new], inner[new], outer[new], np.where(many, 2, 1)[new])
                if many.any():  # merged spans of the repeats within a document
                    d, f, e = doc[many], first[many], last[many]
                    o = np.lexsort((f, d))
                    d, f, e = d[o], f[o], e[o]
                    head = np.flatnonzero(np.append(True, (np.diff(d) != 0) | (f[1:] > e[:-1] + length)))
                    yield rows_of(d[head], f[head], np.maximum.reduceat(e, head))
            give_back()

    return docs.mapInArrow(scan, RUNS)


def sorted_ranks(found: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs (rank, added) of more than one row: next, their place in the order that Spark sorts them into, and whether they have several outer (mixed).

    Places rise with the pairs but have gaps, as partitions are numbered each for itself; the table fixes them.
    """
    pairs = found.groupBy("rank", "added").agg(F.sum("n").alias("t"), (F.min("outer") < F.max("outer")).alias("mixed")).where("t > 1")
    in_order = pairs.select("rank", "added", "mixed").repartitionByRange("rank", "added").sortWithinPartitions("rank", "added")
    return scratch.table(in_order.withColumn("next", F.monotonically_increasing_id()), "ranks")


def judged(found: DataFrame, scratch: Scratch, *place: str) -> DataFrame:
    """One round: the rows of found that are repeats (repeat) or may hold repeats (refine), with their new rank; place: what tells rows apart.

    Rows with a unique pair drop out. Of the rows of one rank and outer one is refined for all.
    """
    ranks = sorted_ranks(found, scratch)
    alive = scratch.table(found.join(ranks, ["rank", "added"]).drop("rank", "added").withColumnRenamed("next", "rank"), "alive")
    twice = scratch.table(alive.groupBy("rank", "outer").agg(F.sum("n").alias("c"), F.min(F.struct(*place)).alias("one")).where("c > 1").select("rank", "outer", "one"), "twice")
    refine = F.col("mixed") & (F.col("one").isNull() | F.struct(*place).eqNullSafe(F.col("one")))
    marks = alive.join(twice, ["rank", "outer"], "left").withColumn("repeat", F.col("one").isNotNull()).withColumn("refine", refine)
    marks = scratch.table(marks.where("repeat or refine").drop("outer", "n", "mixed", "one"), "marks")
    scratch.drop(ranks, alive, twice)
    return marks


def contexts(docs: DataFrame, marks: DataFrame, length: int, unit: str) -> DataFrame:
    """The units that each run to refine spans: ctx (a number), doc_id, row, first, at (elected, from first), hi (last, from first), rank, data."""
    wanted = marks.where("refine").groupBy("doc_id", "row").agg(F.collect_list(F.struct("first", "last", "elected", "rank")).alias("runs"))
    joined = touching(docs, wanted).join(wanted, _same(docs, wanted)).select(docs["doc_id"], docs["row"], "data", "runs")
    width = 1 if unit == "bytes" else 8

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = units(*_column(batch, "data"), unit)
            begins = np.append(0, ends[:-1])
            lists = batch.column(3)
            n = lists.value_lengths().to_numpy()
            first, last, elected, rank = (x.to_numpy() for x in lists.flatten().flatten())
            doc = np.repeat(np.arange(len(n)), n)
            raw = memoryview(np.ascontiguousarray(data)).cast("B")
            low, high = (begins[doc] + first) * width, (begins[doc] + last + length) * width
            for k in range(0, len(doc), 1000):
                some = slice(k, k + 1000)
                take = pa.array(doc[some])
                parts = pa.array([bytes(raw[x:y]) for x, y in zip(low[some].tolist(), high[some].tolist(), strict=True)], pa.binary())
                arrays = [batch.column(0).take(take), batch.column(1).take(take), pa.array(first[some]), pa.array((elected - first)[some].astype(np.int32)), pa.array((last - first)[some].astype(np.int32)), pa.array(rank[some]), parts]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "row", "first", "at", "hi", "rank", "data"])
            give_back()

    cuts = joined.mapInArrow(cut, "doc_id bigint, row int, first bigint, at int, hi int, rank bigint, data binary")
    return cuts.withColumn("ctx", F.monotonically_increasing_id())  # fixed once the table is written


def _same(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["row"] == b["row"])


def class_pairs(found: DataFrame, length: int, width: int, before: int, unit: str) -> DataFrame:
    """Classes of `width` neighbouring strings of contexts: rank (so far), added, outer, ctx, lo, hi (starts in the context), n.

    found: ctx, at, data, ranges (array of structs lo, hi, rank: strings of the context of one class of `before` neighbours, a
    multiple of width or all strings that can elect one position, and its rank).
    """
    farthest = length - core_of(length)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = _column(batch, "data")
            if unit != "bytes":
                data, ends = data.view(np.uint64), ends // 8
            begins = np.append(0, ends[:-1])
            elected = batch.column(1).to_numpy().astype(np.int64)
            lists = batch.column(3)
            of = np.repeat(np.arange(len(batch)), lists.value_lengths().to_numpy())
            low, high, rank = (x.to_numpy().astype(np.int64) for x in lists.flatten().flatten())
            # By distance d from the start of a string to the elected position: class j has the d from j width on.
            least, most = elected[of] - high, elected[of] - low
            k = most // width - least // width + 1
            i = np.repeat(np.arange(len(k)), k)
            j = (least // width)[i] + np.arange(len(i)) - np.repeat(np.cumsum(k) - k, k)
            at = elected[of[i]]
            first, last = at - np.minimum(most[i], j * width + width - 1), at - np.maximum(least[i], j * width)
            base = begins[of[i]]
            hashes = Hashes(data)

            def window(nearest, w):
                """What all strings at the distances nearest to nearest + w - 1 share."""
                return base + at - nearest, base + at - np.minimum(nearest + w - 1, farthest) + length

            start, stop = window(j * width, width)
            inside, end = window(j * width // before * before, before)
            left, right = hashes.of(start, inside), hashes.of(end, stop)
            added = _mixed(left + _mixed(right + np.uint64(_BASE)) + (j + 1).astype(np.uint64) * np.uint64(_BASE))
            outer = hashes.of(base + first, base + last + length) ^ _mixed((at - first).astype(np.uint64))
            arrays = [pa.array(rank[i]), pa.array(added.view(np.int64)), pa.array(outer.view(np.int64)), batch.column(0).take(pa.array(of[i])), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(np.ones(len(i), np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, ["rank", "added", "outer", "ctx", "lo", "hi", "n"])

    return found.select("ctx", "at", "data", "ranges").mapInArrow(pairs, "rank bigint, added bigint, outer bigint, ctx bigint, lo int, hi int, n int")


def class_widths(most: int, shrink: int) -> list[int]:
    """The powers of shrink below most, falling to 1; none if most is 1."""
    widths = [1]
    while widths[-1] * shrink < most:
        widths.append(widths[-1] * shrink)
    return widths[::-1] if most > 1 else []


def repeated_spans(docs: DataFrame, length: int = LENGTH, unit: str = "bytes", shrink: int = SHRINK) -> DataFrame:
    """doc_id, row, spans of the documents that hold repeats: structs (first, last), the first and last start of repeated strings."""
    text_batches(docs.sparkSession)
    scratch = Scratch()
    found = scratch.table(runs(docs, length, unit), "runs")
    marks = judged(found.where("added is not null").withColumn("rank", F.lit(0).cast("bigint")), scratch, "doc_id", "row", "first")
    spans = found.where("added is null").select("doc_id", "row", "first", "last")
    spans = spans.unionByName(marks.where("repeat").select("doc_id", "row", "first", "last"))
    before, held = length - core_of(length) + 1, None
    for width in class_widths(before, shrink):
        if marks.where("refine").isEmpty():
            break
        if held is None:
            held = scratch.table(contexts(docs, marks, length, unit), "contexts")
            places = held.select("ctx", "doc_id", "row", F.col("first").alias("from"))
            wanted = held.withColumn("ranges", F.array(F.struct(F.lit(0).alias("lo"), "hi", "rank")))
        else:
            still = marks.where("refine").groupBy("ctx").agg(F.collect_list(F.struct("lo", "hi", "rank")).alias("ranges"))
            wanted = held.join(still, "ctx")
        pairs = scratch.table(class_pairs(wanted, length, width, before, unit), "classes")
        if width > 1:
            marks = judged(pairs, scratch, "ctx", "lo")
            scratch.drop(pairs)
            repeats = marks.where("repeat")
        else:  # a pair is now a string
            repeats = pairs.join(sorted_ranks(pairs, scratch), ["rank", "added"])
        spans = spans.unionByName(repeats.join(places, "ctx").select("doc_id", "row", (F.col("from") + F.col("lo")).alias("first"), (F.col("from") + F.col("hi")).alias("last")))
        before = width
    lists = written(spans.groupBy("doc_id", "row").agg(F.collect_list(F.struct("first", "last")).alias("spans")), "spans")
    scratch.drop(*scratch.held.values())
    return lists


def covered(spans: Column, length: int) -> Column:
    """How many units the spans of a document cover."""
    start = F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("sum"))

    def add(so_far: Column, span: Column) -> Column:
        end = span["last"] + length
        more = F.greatest(F.lit(0).cast("bigint"), end - F.greatest(span["first"], so_far["end"]))
        return F.struct(F.greatest(end, so_far["end"]).alias("end"), (so_far["sum"] + more).alias("sum"))

    return F.aggregate(F.array_sort(spans), start, add, lambda x: x["sum"])


REMOVED = "doc_id bigint, row int, n_removed bigint, n_spans bigint, kept {}"


def removals(docs: DataFrame, length: int = LENGTH, unit: str = "bytes", as_text: bool = False, shrink: int = SHRINK) -> DataFrame:
    """doc_id, row, n_removed (units), n_spans, kept of the documents that lose something. docs: doc_id, row, data.

    kept: the remaining bytes, or as_text, without parts of characters at the cuts. A removed word goes with the white space after it.
    """
    lists = repeated_spans(docs, length, unit, shrink)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, row, data, spans in zip(*(batch.column(i) for i in range(4)), strict=True):
                raw = np.frombuffer(data.as_buffer(), np.uint8)
                # Where each unit begins.
                edges = np.arange(len(raw) + 1) if unit == "bytes" else np.append(word_bounds(raw, np.array([len(raw)]))[0], len(raw))
                first, last = (x.to_numpy() for x in spans.values.flatten())
                edge = np.zeros(len(edges), np.int64)
                np.add.at(edge, first, 1)
                np.add.at(edge, last + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                lost = gone if unit == "bytes" else np.repeat(np.append(False, gone), np.diff(edges, prepend=0))
                left = raw[~lost].tobytes()
                values = (doc_id.as_py(), row.as_py(), int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), left.decode("utf-8", "ignore") if as_text else left)
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string() if as_text else pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], ["doc_id", "row", "n_removed", "n_spans", "kept"])
            give_back()

    joined = touching(docs, lists).join(lists, _same(docs, lists)).select(docs["doc_id"], docs["row"], "data", "spans")
    return joined.mapInArrow(remove, REMOVED.format("string" if as_text else "binary"))


def numbered(docs: DataFrame, *keep: Column) -> DataFrame:
    """docs as doc_id, row, data and the columns keep; row: 0, or for repeated doc_ids their number by text hash."""
    base = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data"), *keep)
    names = [c for c in base.columns if c not in ("doc_id", "data")]
    repeated = docs.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id").limit(1)
    if repeated.isEmpty():
        return base.select("doc_id", F.lit(0).alias("row"), "data", *names)
    return written(base.withColumn("row", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("data"))) - 1).select("doc_id", "row", "data", *names), "numbered")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for strings of 400 bytes, and n_passage_words: words within passages of over 50 words that stand elsewhere, too."""
    docs = numbered(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    gone = removals(docs).select("doc_id", "row", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    passages = repeated_spans(docs, PASSAGE_WORDS, "words").select("doc_id", "row", covered(F.col("spans"), PASSAGE_WORDS).alias("n_passage_words"))
    whole = docs.select("doc_id", "row", F.length("data").cast("bigint").alias("n_bytes"), F.sha2("data", 256).alias("sha"))
    joined = whole.join(gone, _same(whole, gone), "left").join(passages, _same(whole, passages), "left")
    none = F.lit(0).cast("bigint")
    return joined.select(
        whole["doc_id"], "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), F.coalesce("n_passage_words", none).alias("n_passage_words")
    )


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the passages of over 50 words that stand elsewhere, too, with all their columns.

    n_chars is counted anew where text was lost; documents of which only white space is left go, all others stay.
    """
    base = numbered(docs, F.struct(*docs.columns).alias("doc"))
    lost = removals(base.select("doc_id", "row", "data"), PASSAGE_WORDS, "words", as_text=True).select("doc_id", "row", F.col("kept").alias("left"))
    rest = base.select("doc_id", "row", "doc")
    joined = rest.join(lost, _same(rest, lost), "left").where("left is null or trim(BOTH '\t\n\x0b\f\r ' FROM left) <> ''")
    changed = F.col("left").isNotNull()
    new = {"text": F.col("left"), "n_chars": F.length("left").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return joined.select(*(F.when(changed, new[c]).otherwise(F.col("doc")[c]).alias(c) if c in new else F.col("doc")[c].alias(c) for c in docs.columns))
