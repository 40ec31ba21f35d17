"""Token-id files: canonical length-limited Huffman coding in independent blocks.

Encoding runs in four Spark jobs: documents are range-partitioned by doc_id and tokenised once into a table in the shared
folder; ids are counted over all documents (partial counts per task, then summed); the driver builds one code from the
counts, which have at most one row per vocabulary entry; each part is cut into blocks of whole documents and coded.

A file set is a Parquet table `blocks` and one `code` row, so that any store Spark can write holds it. A block: part,
block (place of its first document in the part), start (place of its
first id in the part), doc_ids, doc_tokens, payload (bits, most significant first), checkpoints (bit offset of every 256th id). Ids follow
in ascending doc_id order by (part, block). `code` has the vocabulary size and the code length of every id; canonical
codes follow from the lengths (shorter first, then by id), none longer than 16 bits or, where more than 65,536 ids occur, than numbering them takes.

Decoding needs nothing but a block and the lengths: a table gives id and length for any bits of the longest code's length (65,536
entries at least), and all checkpoints of a block are decoded side by side, one id each per step.

Tokenising: the tokenizers library, called once per distinct piece between spaces of a task's batches. Texts with characters outside
the blocks where its Unicode tables are known to agree with Python's regex module go through it whole.

Defined cases: null or empty text gives only the end id; repeated doc_ids stay separate, ordered by text hash; a null doc_id
comes first; an empty table gives an empty file set; further columns are not read.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tickloom.llm.bpe import UNUSUAL
from tickloom.llm.common import give_back, removed, shared_dir, text_batches
from tickloom.llm.suffix_dedup import Hashes, _column

MAX_BITS = 16
STEP = 256
BLOCK_IDS = 1 << 17
CACHE = 1_500_000
#: A space with white space, or the text's end, on both sides.
BETWEEN = regex.compile(r"\s \s|\s $")
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True


class Pieces:
    """Ids of pieces by the 64-bit hash of their bytes: a large sorted array, a small one of late arrivals, and the ids in one row."""

    def __init__(self, kind: str):
        self.kind = kind
        self.clear()

    def clear(self) -> None:
        self.hashes, self.places = [np.zeros(0, np.uint64)] * 2, [np.zeros(0, np.int64)] * 2
        self.starts, self.counts, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.kind)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 where it isn't there."""
        out = np.full(len(hashes), -1)
        for known, places in zip(self.hashes, self.places, strict=True):
            if len(known):
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                hit = known[at] == hashes
                out[hit] = places[at[hit]]
        return out

    def add(self, hashes: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """hashes: ascending and new."""
        places = len(self.starts) + np.arange(len(hashes))
        self.starts = np.append(self.starts, len(self.ids) + np.cumsum(counts) - counts)
        self.counts, self.ids = np.append(self.counts, counts), np.append(self.ids, ids.astype(self.kind))
        for k in (1, 0):  # late arrivals join the large array when they have grown to a fourth of it
            hashes, places = np.append(self.hashes[k], hashes), np.append(self.places[k], places)
            order = np.argsort(hashes)
            self.hashes[k], self.places[k] = hashes[order], places[order]
            if k == 0 or len(hashes) * 4 < len(self.hashes[0]):
                break
            hashes, places = self.hashes[1], self.places[1]
            self.hashes[1], self.places[1] = self.hashes[1][:0], self.places[1][:0]


class CachedTokenizer:
    """encode() of the tokenizers library, once for each distinct piece between single spaces.

    A byte-level pre-tokenizer never joins what stands before a space with what follows it, unless the space has white
    space on its left and on its right (or the text's end); texts with such a space, with special tokens or with
    unusual characters go through the library whole. Pieces are told apart by the 64-bit hash of their bytes.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.size = self.tokenizer.get_vocab_size()
        self.kind = "<u2" if self.size <= 1 << 16 else "<u4"
        self.width = np.zeros(self.size, np.int64)  # bytes that a token stands for: one for each character of its name
        for token, i in self.tokenizer.get_vocab().items():
            self.width[i] = len(token)
        self.pieces = Pieces(self.kind)

    def odd(self, text: str) -> bool:
        """Whether a text must go through the library whole."""
        return bool(UNUSUAL.search(text) or any(t in text for t in self.special) or BETWEEN.search(text))

    def doubtful(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The texts that odd() has to look at: a few byte patterns clear all others."""
        nearby = np.append(data[1:], 0)
        space = (data == 32) & np.append(False, (data[:-1] == 32) | (data[:-1] == 10))
        rare = (data < 32) & (data != 10)
        other = (data >= 0xCC) & ((data < 0xD0) | (data > 0xD3))
        wide = (data == 0xC2) & ((nearby == 0x85) | (nearby == 0xA0))
        mark = (data == 60) & (nearby == 124)
        at = np.flatnonzero(space | rare | other | wide | mark)
        return np.unique(np.searchsorted(ends, at, side="right"))

    def library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int64) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def together(self, words: list[bytes], before: bytes, chunk: int = 3000) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words and how many each has: many words in one text, `before` in front of each (its ids are left out),
        cut where the bytes of the tokens add up to those of the words. Where they don't add up, words go singly."""
        ids, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        chunks = [words[k : k + chunk] for k in range(0, len(words), chunk)]
        for part, got in zip(chunks, self.library([(before + before.join(c)).decode() for c in chunks]), strict=True):
            reached = np.append(0, np.cumsum(self.width[got]))
            ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + len(before))
            first, last = (np.searchsorted(reached, x) for x in (np.append(0, ends[:-1]) + len(before), ends))
            if reached[-1] != ends[-1] or not np.array_equal(reached[last], ends) or not np.array_equal(reached[first], np.append(0, ends[:-1]) + len(before)):
                single = self.library([w.decode() for w in part])
                ids += single
                counts.append(np.array([len(x) for x in single], np.int64))
                continue
            n = last - first
            take = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
            ids.append(got[take] if before else got)
            counts.append(n)
        return np.concatenate(ids), np.concatenate(counts)

    def learn(self, hashes: np.ndarray, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> None:
        """Adds pieces, given by where they stand in data; a piece starts with its space or is a text's first one."""
        raw = data.tobytes()
        words = [raw[a:b] for a, b in zip(start.tolist(), stop.tolist(), strict=True)]
        led = data[start] == 32
        short = stop - start <= led
        inner = np.minimum(start + led, len(data) - 1)
        alone = short | _WHITE[data[inner]] | _WHITE[data[stop - 1]]
        kind = np.where(alone, 2, np.where(led, 0, 1))
        for k, before in ((0, b""), (1, b"\n"), (2, None)):
            at = np.flatnonzero(kind == k)
            if len(at):
                part = [words[i] for i in at]
                if before is None:
                    single = self.library([w.decode() for w in part])
                    ids, counts = np.concatenate(single), np.array([len(x) for x in single], np.int64)
                else:
                    ids, counts = self.together(part, before)
                self.pieces.add(hashes[at], ids, counts)

    def encode(self, data: np.ndarray, ends: np.ndarray, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and how many each text has (with end_id after each, if given).

        data: the texts' bytes; ends: where each text ends.
        """
        begins = np.append(0, ends[:-1])
        odd = np.zeros(len(ends), bool)
        for i in self.doubtful(data, ends):
            odd[i] = self.odd(data[begins[i] : ends[i]].tobytes().decode())
        # Pieces start at each text and at each space.
        cut = np.zeros(len(data) + 1, bool)
        cut[np.flatnonzero(data == 32)] = True
        cut[begins] = True
        start = np.flatnonzero(cut[:-1])  # a text without a byte has no piece
        text, stop = np.searchsorted(ends, start, side="right"), np.append(start[1:], len(data))
        keep = ~odd[text]
        start, stop, text = start[keep], stop[keep], text[keep]
        hashes = Hashes(data).of(start, stop) if len(start) else np.zeros(0, np.uint64)
        order = np.argsort(hashes)
        ranked = hashes[order]
        new = np.append(True, ranked[1:] != ranked[:-1]) if len(ranked) else np.zeros(0, bool)
        distinct, example = ranked[new], order[new]
        which = np.empty(len(hashes), np.int64)
        which[order] = np.cumsum(new) - 1
        if len(self.pieces.starts) + len(distinct) > CACHE:
            self.pieces.clear()
        place = self.pieces.find(distinct)
        fresh = np.flatnonzero(place < 0)
        if len(fresh):
            self.learn(distinct[fresh], data, start[example[fresh]], stop[example[fresh]])
            place = self.pieces.find(distinct)
        place = place[which]
        count = self.pieces.counts[place]
        take = np.repeat(self.pieces.starts[place] - np.cumsum(count) + count, count) + np.arange(count.sum())
        ids = self.pieces.ids[take]
        counts = np.bincount(text, count, len(ends)).astype(np.int64)
        if odd.any() or end_id is not None:
            at = np.flatnonzero(odd)
            others = dict(zip(at.tolist(), self.library([data[begins[i] : ends[i]].tobytes().decode() for i in at]), strict=True))
            # Each text's ids go to their place; end ids fill what is left.
            extra = 0 if end_id is None else 1
            total = counts + extra
            total[at] = [len(others[i]) + extra for i in at.tolist()]
            upto = np.cumsum(total)
            out = np.full(int(upto[-1]) if len(upto) else 0, end_id or 0, self.kind)
            first = upto - total
            to = np.repeat(first - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            out[to] = ids
            for i, x in others.items():
                out[first[i] : first[i] + len(x)] = x
            return out, total
        return ids, counts


_tokenizers: dict[str, CachedTokenizer] = {}


def cached_tokenizer(path: str) -> CachedTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = CachedTokenizer(path)
    return _tokenizers[path]


# ---- code


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most limit bits, or as many as numbering the ids takes (package-merge); 0 for ids that do not occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) == 0:
        return lengths
    if len(used) == 1:
        lengths[used] = 1
        return lengths
    limit = max(limit, (len(used) - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    # The list of a level: leaves and packages (pairs of the level below) by weight; True marks a leaf.
    levels, current = [], weights
    marks = np.ones(len(weights), bool)
    levels.append(marks)
    for _ in range(limit - 1):
        even = len(current) // 2 * 2
        packages = current[:even:2] + current[1:even:2]
        both = np.concatenate([weights, packages])
        at = np.argsort(both, kind="stable")
        current, marks = both[at], at < len(weights)
        levels.append(marks)
    # 2n - 2 items of the last list are taken; each package among them stands for two of the list below.
    take, depth = 2 * len(weights) - 2, np.zeros(len(weights), np.int64)
    for marks in reversed(levels):
        leaves = int(marks[:take].sum())
        depth[:leaves] += 1
        take = 2 * (take - leaves)
    lengths[order] = depth
    return lengths


def table_bits(lengths: np.ndarray) -> int:
    return max(MAX_BITS, int(lengths.max(initial=0)))


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    codes, top = np.zeros(len(lengths), np.uint32), table_bits(lengths)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        rest = top - lengths[order].astype(np.int64)
        span = 1 << rest
        codes[order] = (np.cumsum(span) - span) >> rest
    return codes


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, length) for every value of the next table_bits() bits."""
    top = table_bits(lengths)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    span = 1 << (top - lengths[order].astype(np.int64))
    ids, bits = np.zeros(1 << top, np.int64), np.full(1 << top, top, np.int64)
    ids[: span.sum()], bits[: span.sum()] = np.repeat(order, span), np.repeat(lengths[order], span)
    return ids, bits


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Bits of ids, and the bit offset of every STEP-th."""
    if not len(ids):
        return b"", np.zeros(0, np.int64)
    n = lengths[ids].astype(np.int64)
    ends = np.cumsum(n)
    at = ends - n
    word, shift = at >> 5, 64 - (at & 31) - n
    value = codes[ids].astype(np.uint64) << shift.astype(np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    out = np.zeros(word[-1] + 2, np.uint32)
    out[word[first]] |= np.bitwise_or.reduceat((value >> np.uint64(32)).astype(np.uint32), first)
    out[word[first] + 1] |= np.bitwise_or.reduceat((value & np.uint64(0xFFFFFFFF)).astype(np.uint32), first)
    return out.astype(">u4").tobytes()[: -(-int(ends[-1]) // 8)], at[::STEP]


def unpack(payload: bytes, checkpoints: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The n ids of a block; one lane per checkpoint."""
    if not n:
        return np.zeros(0, np.int64)
    ids, bits = table
    top = len(ids).bit_length() - 1
    wide = -(-(top + 7) // 8)  # bytes that hold a code wherever in a byte it starts
    b = np.frombuffer(payload + bytes(wide), np.uint8).astype(np.int64)
    window = b[: len(payload) + 1]
    for k in range(1, wide):
        window = (window << 8) | b[k : len(payload) + 1 + k]
    at = np.array(checkpoints, np.int64)
    out = np.zeros((STEP, len(at)), np.int64)
    limit = len(window) - 1
    for k in range(STEP):
        seen = (window[np.minimum(at >> 3, limit)] >> (8 * wide - top - (at & 7))) & ((1 << top) - 1)
        out[k] = ids[seen]
        at = at + bits[seen]
    return out.T.reshape(-1)[:n]


# ---- Spark jobs

BLOCKS = "part int, block bigint, start bigint, doc_ids array<bigint>, doc_tokens array<bigint>, payload binary, checkpoints array<bigint>"


def tokenise(docs: DataFrame, path: str, end_id: int | None, slice_bytes: int = 3_000_000) -> DataFrame:
    """doc_id, ids (little-endian unsigned 16-bit or, for larger vocabularies, 32-bit), nth, start (first id's place in the part), part: ascending doc_id by (part, nth)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, nth, first_id = cached_tokenizer(path), 0, 0
        width = np.dtype(tok.kind).itemsize
        for batch in batches:
            data, ends = _column(batch, "data")
            at = 0
            while at < len(batch):
                begin = ends[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(ends, begin + slice_bytes, side="right")))
                ids, counts = tok.encode(data[begin : ends[end - 1]], ends[at:end] - begin, end_id)
                upto = np.cumsum(counts)
                offsets = pa.py_buffer((np.append(0, upto) * width).astype(np.int32).tobytes())
                column = pa.Array.from_buffers(pa.binary(), end - at, [None, offsets, pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), column, pa.array(np.arange(nth, nth + end - at)), pa.array(first_id + upto - counts)], ["doc_id", "ids", "nth", "start"])
                nth, at, first_id = nth + end - at, end, first_id + int(upto[-1])
            give_back()

    dealt = docs.select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    # Rows of one doc_id may be many: they are dealt out by their texts.
    dealt = dealt.withColumn("h", F.xxhash64("data")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "data").drop("h")
    return dealt.mapInArrow(run, "doc_id bigint, ids binary, nth bigint, start bigint").select("doc_id", "ids", "nth", "start", F.spark_partition_id().alias("part"))


def write_token_files(docs: DataFrame, path: str, folder: str, end_id: int | None = 0) -> None:
    """Writes the file set of docs (doc_id, text) into folder; path: the tokenizer's file; end_id follows each document."""
    spark = docs.sparkSession
    text_batches(spark)
    kind, size = cached_tokenizer(path).kind, cached_tokenizer(path).size
    tokenise(docs, path, end_id).write.option("compression", "zstd").parquet(f"{folder}/tokens")
    tokens = spark.read.schema("doc_id bigint, ids binary, nth bigint, start bigint, part int").parquet(f"{folder}/tokens")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), kind), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])

    counts = np.zeros(size, np.int64)
    for row in tokens.select("ids").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[row["id"]] = row["n"]
    lengths = code_lengths(counts)
    spark.createDataFrame([(size, bytearray(lengths.tobytes()))], "vocabulary int, lengths binary").coalesce(1).write.parquet(f"{folder}/code")
    codes = canonical_codes(lengths)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, after, total, first = None, 0, 0, 0, 0
        doc_ids: list[int] = []
        held: list[np.ndarray] = []

        def closed() -> pa.RecordBatch:
            payload, checkpoints = pack(np.concatenate(held), codes, lengths)
            row = {"part": [part], "block": [block], "start": [first], "doc_ids": [doc_ids], "doc_tokens": [[len(x) for x in held]], "payload": [payload], "checkpoints": [checkpoints]}
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row.values(), kinds, strict=True)], list(row))

        for batch in batches:
            for doc_id, data, nth, start, of in zip(batch.column(0).to_pylist(), batch.column(1), *(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                ids = np.frombuffer(data.as_buffer(), kind).astype(np.int64)
                if held and ((of, nth) != (part, after) or total + len(ids) > BLOCK_IDS):
                    yield closed()
                    doc_ids, held, total = [], [], 0
                if not held:
                    part, block, first = of, nth, start
                after = nth + 1
                doc_ids.append(doc_id)
                held.append(ids)
                total += len(ids)
        if held:
            yield closed()

    # A block ends where the rows read are no longer neighbours, so it doesn't matter how files are dealt to tasks.
    tokens.mapInArrow(encode, BLOCKS).write.option("compression", "none").parquet(f"{folder}/blocks")
    removed(spark, f"{folder}/tokens")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the file set.

    start counts the ids of all documents before it: what earlier parts hold, one small row a part, and the place in the part.
    """
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    lengths = np.frombuffer(spark.read.parquet(f"{folder}/code").first()["lengths"], np.uint8)
    n = F.aggregate("doc_tokens", F.lit(0).cast("bigint"), lambda a, x: a + x)
    parts = blocks.groupBy("part").agg(F.sum(n).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decoding_table(lengths)
        for batch in batches:
            for row in batch.to_pylist():
                counts = np.array(row["doc_tokens"], np.int64)
                ids = unpack(row["payload"], row["checkpoints"], int(counts.sum()), table).astype("<u4")
                ends = np.cumsum(counts)
                crcs = [zlib.crc32(ids[e - c : e].tobytes()) for c, e in zip(counts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * len(counts), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(row["start"] + ends - counts), pa.array(counts), pa.array(crcs, pa.int64())],
                    ["part", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    docs = blocks.mapInArrow(decode, "part int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint")
    return docs.join(F.broadcast(starts), "part").select("doc_id", (F.col("part_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), byte_bpe_path(), folder)
    return read_token_files(spark, folder)
