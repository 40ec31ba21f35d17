"""Source divergence audit: how far each source's words are from those of its language and of its other sources.

1. A first pass counts, in each language, the documents that hold a term (partial counts in the tasks, then one sum). Terms
   in at least `least` documents are kept, exactly.
2. The kept terms are dealt into shards by hash, and each shard builds a minimal perfect hash: levels of bits in which a
   term owns a bit if no other term left falls on it, the others go to the next level; a term's slot is the number of bits
   set before its own. The terms themselves are stored in the order of their slots.
3. The shards are broadcast (at most `broadcast_bytes` of terms at a time; with more, the second pass runs once for each
   such set of shards, so that a broadcast never grows with the input). The second pass looks terms up in them, compares
   each with the stored term of its slot (a perfect hash gives any term some slot), and adds to dense blocks of SLOTS
   counters of its group (lang, source). Non-zero counters leave the task and are added up by Spark.
4. Shares p are integers; divergence sums over all kept terms run block by block of slots: a task holds one block of a
   language's terms for two tiles of its sources and returns sums, which Spark adds up. Zero counts enter with the share
   that a count of 0 has in their group.

Scale: text is read twice and never shuffled. A source with most of the rows is many partial sums. A pair sum needs
(sources of a language)^2 x terms steps, as many as its definition has; its tasks hold at most TILE x 2 sources x block terms.

Defined cases: null text, lang and source count as ''; texts without terms add nothing, but their group is there; a language
without kept terms has pairs of value 0 and no terms; rows that repeat count each; an empty table gives no rows; further
columns are not read. Shares use decimals of 38 digits, so counts up to 10^28 stay exact.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.common import Scratch, give_back, table, text_batches, written
from tickloom.llm.terms import LETTERS, term_table, terms_of

SHARD_KEYS = 1 << 19
SHARD_BYTES = 16 << 20
BROADCAST_BYTES = 64 << 20
HELD = 300_000  # terms that a task counts before it hands them on
MEMO = 300_000  # terms whose slots a task remembers
SLOTS = 4096
BLOCKS = 2000  # blocks of counters that a task holds
TILE = 256
CELLS = 1 << 21
LEVELS = 48
SEED = 42
_LETTERS = term_table(LETTERS)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15))


# ---- minimal perfect hash


def _mixed(h: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = h + _MIX[2] * np.uint64(level + 1)
        x = (x ^ (x >> np.uint64(30))) * _MIX[0]
        x = (x ^ (x >> np.uint64(27))) * _MIX[1]
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Distinct 64-bit hashes to 0 .. n-1. Hashes that no level separates (equal ones) are numbered last and found by their key."""

    def __init__(self, h: np.ndarray, keys: list[bytes]):
        left, base = np.arange(len(h)), 0
        slot = np.full(len(h), -1, np.int64)
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        for level in range(LEVELS):
            if not len(left):
                break
            size = 64 * (len(left) * 3 // 128 + 1)
            at = (_mixed(h[left], level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size)[at] == 1
            bits = np.zeros(size, bool)
            bits[at[alone]] = True
            words = np.packbits(bits, bitorder="little").view(np.uint64)
            before = base + np.concatenate([[0], np.cumsum(np.bitwise_count(words))[:-1]])
            self.levels.append((size, words, before.astype(np.int64)))
            slot[left[alone]] = base + np.cumsum(bits)[at[alone]] - 1
            base += int(bits.sum())
            left = left[~alone]
        left = np.array(sorted(left.tolist(), key=lambda i: keys[i]), np.int64)
        slot[left] = base + np.arange(len(left))
        self.rest = {keys[i]: int(slot[i]) for i in left}
        self.slot = slot
        order = np.empty(len(h), np.int64)
        order[slot] = np.arange(len(h))
        self.keys = pa.array(keys, pa.large_binary()).take(pa.array(order))

    def find(self, h: np.ndarray, keys: pa.Array) -> np.ndarray:
        """Slot of each key, -1 for those that are not stored."""
        slot, left = np.full(len(h), -1, np.int64), np.arange(len(h))
        for level, (size, words, before) in enumerate(self.levels):
            at = (_mixed(h[left], level) % np.uint64(size)).astype(np.int64)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            here = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            slot[left[here]] = (before[at >> 6] + below)[here]
            left = left[~here]
        found = np.flatnonzero(slot >= 0)
        same = pc.equal(self.keys.take(pa.array(slot[found])), keys.take(pa.array(found))).to_numpy(zero_copy_only=False)
        slot[found[~same]] = -1
        if self.rest:
            for i in np.flatnonzero(slot < 0):
                slot[i] = self.rest.get(keys[i].as_py(), -1)
        return slot


def hashed(keys: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(k, SEED) for k in keys), np.uint64, len(keys))


def term_key(lang: bytes, term: bytes) -> bytes:
    return b"%d:%b%b" % (len(lang), lang, term)


# ---- first pass


def document_frequencies(docs: DataFrame) -> DataFrame:
    """lang, term (binary), df. docs: lang, source, text without nulls."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, Counter] = {}
        n = 0

        def flush() -> pa.RecordBatch:
            lang = pa.array([k for k, c in held.items() for _ in c], pa.binary())
            term = pa.array([t for c in held.values() for t in c], pa.binary())
            df = pa.array(np.fromiter((x for c in held.values() for x in c.values()), np.int64))
            held.clear()
            return pa.RecordBatch.from_arrays([lang.cast(pa.string()), term, df], ["lang", "term", "df"])

        for batch in batches:
            langs, texts = (batch.column(i).cast(pa.binary()) for i in (0, 2))
            for i in range(len(batch)):
                counter = held.setdefault(langs[i].as_py(), Counter())
                size = len(counter)
                counter.update(set(terms_of(texts[i].as_py(), _LETTERS)))
                n += len(counter) - size
                if n > HELD:
                    yield flush()
                    n = 0
        if held:
            yield flush()
        give_back()

    return docs.mapInArrow(count, "lang string, term binary, df bigint").groupBy("lang", "term").agg(F.sum("df").alias("df"))


# ---- second pass


def _key() -> Column:
    lang = F.col("lang").cast("binary")
    return F.concat(F.concat(F.length(lang).cast("string"), F.lit(":")).cast("binary"), lang, F.col("term"))


def numbered(kept: DataFrame, scratch: Scratch, shard_keys: int = SHARD_KEYS, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, int]:
    """lang, term, key, shard and slot of each kept term, written; and the number of shards.

    A slot is the term's place in the shard by language and perfect hash, so that a group's counters lie together.
    """
    n, size = kept.agg(F.count("*"), F.coalesce(F.sum(F.length("term") + F.length("lang") + 8), F.lit(0))).first()
    shards = max(1, -(-n // shard_keys), -(-size // shard_bytes))
    keyed = kept.select("lang", "term", _key().alias("key")).withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))

    def build(rows: pa.Table) -> pa.Table:
        keys = rows.column("key").to_pylist()
        slot = PerfectHash(hashed(keys), keys).slot
        lang = np.unique(np.array([k[: k.index(b":") + 1 + int(k[: k.index(b":")])] for k in keys], object), return_inverse=True)[1]
        place = np.empty(len(keys), np.int64)
        place[np.lexsort((slot, lang))] = np.arange(len(keys))
        return rows.append_column("slot", pa.array(place))

    slots = scratch.table(keyed.groupBy("shard").applyInArrow(build, "lang string, term binary, key binary, shard bigint, slot bigint"), "slots")
    return slots, shards


def recount(docs: DataFrame, slots: DataFrame, shards: int, scratch: Scratch, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """lang, source, shard, slot, count (above 0) of the stored terms in all texts, written."""
    sizes = slots.groupBy("shard").agg(F.sum(F.length("key") + 8).alias("size")).orderBy("shard").collect()  # a row a shard
    turns: list[list[int]] = []
    room = 0
    for r in sizes:
        if not turns or r["size"] > room:
            turns.append([])
            room = broadcast_bytes
        turns[-1].append(r["shard"])
        room -= r["size"]
    got = docs.sparkSession.createDataFrame([], COUNTS)
    for turn in turns:
        got = got.unionByName(_recount(docs, slots, turn, shards))
    return scratch.table(got.groupBy("lang", "source", "shard", "slot").agg(F.sum("count").alias("count")), "counts")


COUNTS = "lang string, source string, shard bigint, slot bigint, count bigint"


def _recount(docs: DataFrame, slots: DataFrame, turn: list[int], shards: int) -> DataFrame:
    rows = slots.where(F.col("shard").isin(turn)).select("shard", "slot", "key").toArrow()  # at most broadcast_bytes of terms
    found: dict[int, tuple[PerfectHash, np.ndarray]] = {}
    for shard in turn:
        mine = rows.filter(pc.equal(rows.column("shard"), shard))
        keys = mine.column("key").to_pylist()
        perfect = PerfectHash(hashed(keys), keys)
        place = np.empty(len(keys), np.int64)
        place[perfect.slot] = mine.column("slot").to_numpy()
        found[shard] = perfect, place
    shared = docs.sparkSession.sparkContext.broadcast(found)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = shared.value
        dense: dict[tuple[bytes, bytes, int, int], np.ndarray] = {}

        memo: dict[bytes, dict[bytes, int]] = {}

        def look_up(lang: bytes, terms: list[bytes], known: dict[bytes, int]) -> None:
            """Adds slot x shards + shard of each term to known, -1 for those not stored."""
            keys = [term_key(lang, t) for t in terms]
            h = hashed(keys)
            shard = h.view(np.int64) % np.int64(shards)
            stored = pa.array(keys, pa.large_binary())
            at = np.full(len(keys), -1, np.int64)
            for s, (perfect, place) in hashes.items():
                mine = np.flatnonzero(shard == s)
                slot = perfect.find(h[mine], stored.take(pa.array(mine)))
                at[mine[slot >= 0]] = place[slot[slot >= 0]] * shards + s
            known.update(zip(terms, at.tolist(), strict=True))

        def add(lang: bytes, source: bytes, counter: Counter) -> None:
            known = memo.setdefault(lang, {})
            if new := [t for t in counter if t not in known]:
                look_up(lang, new, known)
            at = np.fromiter(map(known.get, counter), np.int64, len(counter))
            n = np.fromiter(counter.values(), np.int64, len(counter))
            at, n = at[at >= 0], n[at >= 0]
            slot, shard = at // shards, at % shards
            order = np.lexsort((slot, shard))
            slot, shard, n = slot[order], shard[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], (shard[1:] != shard[:-1]) | (slot[1:] // SLOTS != slot[:-1] // SLOTS)])) if len(slot) else []
            for lo, hi in zip(first, [*first[1:], len(slot)], strict=True) if len(slot) else ():
                block = int(slot[lo] // SLOTS)
                counters = dense.get(k := (lang, source, int(shard[lo]), block))
                if counters is None:
                    counters = dense[k] = np.zeros(SLOTS, np.int64)
                counters[slot[lo:hi] - block * SLOTS] += n[lo:hi]

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source, s, b), counters in dense.items():
                at = np.flatnonzero(counters)
                names = [pa.repeat(pa.scalar(x, pa.binary()), len(at)).cast(pa.string()) for x in (lang, source)]
                yield pa.RecordBatch.from_arrays([*names, pa.repeat(pa.scalar(s, pa.int64()), len(at)), pa.array(at + b * SLOTS), pa.array(counters[at])], ["lang", "source", "shard", "slot", "count"])
            dense.clear()

        held: dict[tuple[bytes, bytes], Counter] = {}
        n = 0
        for batch in batches:
            langs, sources, texts = (batch.column(i).cast(pa.binary()) for i in range(3))
            for i in range(len(batch)):
                counter = held.setdefault((langs[i].as_py(), sources[i].as_py()), Counter())
                size = len(counter)
                counter.update(terms_of(texts[i].as_py(), _LETTERS))
                n += len(counter) - size
                if n > HELD:
                    for group, c in held.items():
                        add(*group, c)
                    held.clear()
                    n = 0
                    if sum(map(len, memo.values())) > MEMO:
                        memo.clear()
                    if len(dense) > BLOCKS:
                        yield from flush()
        for group, c in held.items():
            add(*group, c)
            if len(dense) > BLOCKS:
                yield from flush()
        yield from flush()
        give_back()

    return docs.mapInArrow(count, COUNTS)


# ---- divergences


def share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (n + 2 v)), exactly."""
    wide = "decimal(38,0)"
    above, below = (count.cast("decimal(28,0)") + 2).cast(wide) * F.lit(10**9).cast("decimal(10,0)"), (n.cast("decimal(28,0)") + 2 * v).cast(wide)
    exact = above.cast(wide) - F.pmod(above.cast(wide), below)
    return (1 + (exact / below).cast(wide)).cast("bigint")


def gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def pair_sums(rows: pa.Table) -> pa.Table:
    """source, item, value: sums over the block's terms, each pair of a tile pair once.

    Rows with shard null give each group's share of a count of 0 and, as slot, the terms of the block.
    """
    left, right = rows.column("left")[0].as_py(), rows.column("right")[0].as_py()
    base = pc.is_null(rows.column("shard"))
    names = rows.filter(base)
    order = names.column("source").combine_chunks().cast(pa.binary())
    tiles = names.column("tile").to_numpy()
    zero = names.column("p").to_numpy()
    some = rows.filter(pc.invert(base))
    at = pc.index_in(some.column("source").combine_chunks().cast(pa.binary()), order).to_numpy(zero_copy_only=False)
    code = some.column("shard").to_numpy() * (1 << 40) + some.column("slot").to_numpy()
    terms, place = np.unique(code, return_inverse=True)
    absent = names.column("slot")[0].as_py() - len(terms)  # terms of which none of these sources has any
    shares = np.repeat(zero[:, None], len(terms), 1)
    shares[at, place] = some.column("p").to_numpy()
    a, b, value = [], [], []
    for i in np.flatnonzero(tiles == left):
        others = np.flatnonzero(tiles == right)
        others = others[others > i] if left == right else others
        if len(others):
            d, z = shares[others] - shares[i], zero[others] - zero[i]
            a.append(np.full(len(others), i))
            b.append(others)
            value.append((d * d // (shares[others] + shares[i])).sum(1) + absent * (z * z // (zero[others] + zero[i])))
    a, b, value = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b, value))
    text = order.cast(pa.string())
    lang = pa.repeat(pa.scalar(rows.column("lang")[0].as_py(), pa.string()), len(a))
    return pa.table({"lang": lang, "source": text.take(pa.array(a)), "item": text.take(pa.array(b)), "value": pa.array(value.astype(np.int64))})


def pairs(groups: DataFrame, counted: DataFrame, slots: DataFrame, tile: int = TILE, cells: int = CELLS) -> DataFrame:
    """lang, source, item, value of all ordered pairs of a language's sources. groups: lang, source, p0; counted: lang, source, shard, slot, p; slots: lang, shard, slot."""
    most = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    width = max(16, min(SLOTS, cells // min(most, 2 * tile)))
    by_lang = groups.groupBy("lang").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    in_blocks = slots.groupBy("lang", "shard", F.floor(F.col("slot") / width).alias("block")).agg(F.count("*").alias("terms"))
    blocks = in_blocks.unionByName(groups.select("lang", F.lit(-1).cast("bigint").alias("shard"), F.lit(-1).cast("bigint").alias("block"), F.lit(0).cast("bigint").alias("terms")).distinct())
    base = groups.join(blocks, "lang").select("lang", "source", F.col("shard").alias("of"), "block", F.lit(None).cast("bigint").alias("shard"), F.col("terms").alias("slot"), F.col("p0").alias("p"))
    some = counted.select("lang", "source", F.col("shard").alias("of"), F.floor(F.col("slot") / width).alias("block"), "shard", "slot", "p")
    rows = base.unionByName(some).join(by_lang, "lang").withColumn("tile", F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int"))
    sent = rows.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumns({"left": F.least("tile", "x"), "right": F.greatest("tile", "x")}).drop("x", "tiles")
    sums = sent.groupBy("lang", "of", "block", "left", "right").applyInArrow(pair_sums, "lang string, source string, item string, value bigint")
    once = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return once.unionByName(once.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))


def divergence(docs: DataFrame, least: int = 10, top: int = 10, shard_keys: int = SHARD_KEYS, broadcast_bytes: int = BROADCAST_BYTES, tile: int = TILE) -> DataFrame:
    """lang, source, part, item, value, rank: part `pair` for each other source of the language, `term` for the terms that mark a source.

    The result is written; the tables behind it are deleted.
    """
    text_batches(docs.sparkSession)
    scratch = Scratch()
    plain = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    kept = scratch.table(document_frequencies(plain).where(F.col("df") >= least), "kept")
    slots, shards = numbered(kept, scratch, shard_keys, SHARD_BYTES)
    counts = recount(plain, slots, shards, scratch, broadcast_bytes)

    sums = counts.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    held = kept.groupBy("lang").agg(F.count("*").alias("v"))
    groups = plain.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(held, "lang", "left").na.fill(0, ["n", "v"])
    zero = F.when(F.col("v") > 0, share(F.lit(0), F.col("n"), F.col("v"))).otherwise(F.lit(1))
    groups = scratch.table(groups.withColumn("p0", zero), "groups")
    in_lang = groups.groupBy("lang").agg(F.sum("n").alias("n_lang"))
    counted = counts.join(groups, ["lang", "source"]).withColumn("p", share(F.col("count"), F.col("n"), F.col("v")))
    counted = scratch.table(counted.join(in_lang, "lang").select("lang", "source", "shard", "slot", "count", "p", "v", "n_lang"), "shares")
    totals = counts.groupBy("shard", "slot").agg(F.sum("count").alias("total")).join(slots.select("shard", "slot", F.col("term").cast("string").alias("item")), ["shard", "slot"])

    def ranked(rows: DataFrame, part: str) -> DataFrame:
        w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        return rows.withColumn("rank", F.row_number().over(w)).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")

    q = share(F.col("total"), F.col("n_lang"), F.col("v"))
    marks = counted.join(totals, ["shard", "slot"]).withColumn("q", q).where("p > q").select("lang", "source", "item", gap(F.col("p"), F.col("q")).alias("value"))
    got = written(ranked(pairs(groups, counted, slots, tile), "pair").unionByName(ranked(marks, "term").where(F.col("rank") <= top)), "divergence")
    scratch.drop(*scratch.held.values())
    return got


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (SELECT coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS doc FROM documents),
words AS (SELECT lang, source, doc, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM words GROUP BY ALL HAVING count(DISTINCT doc) >= 10),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM d),
counts AS (SELECT lang, source, term, count(*) AS c FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
full_counts AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0)::HUGEINT AS c FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)),
n AS (SELECT lang, source, sum(c)::HUGEINT AS n FROM full_counts GROUP BY ALL),
p AS (SELECT lang, source, term, c, 1 + (1000000000 * (c + 2)) // (n + 2 * v) AS p FROM full_counts JOIN n USING (lang, source) JOIN v USING (lang)),
q AS (SELECT lang, term, 1 + (1000000000 * (c + 2)) // (n + 2 * v) AS q
      FROM (SELECT lang, term, sum(c)::HUGEINT AS c FROM full_counts GROUP BY ALL) JOIN (SELECT lang, sum(n)::HUGEINT AS n FROM n GROUP BY ALL) USING (lang) JOIN v USING (lang)),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
         LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value FROM p x JOIN p y USING (lang, term) GROUP BY ALL) s
         ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
mark AS (SELECT lang, source, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q),
ranked AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pair
           UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM mark)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
