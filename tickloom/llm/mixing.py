r"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree. DataFrame functions only.

1. Size of a document: its words, `[^\x20\x09-\x0D]+`. Each source's target is its weight's share of all words, at most
   max_repeats times its own words; the excess goes to the other sources by weight (water filling: one sort of the
   sources by cap/weight, no iteration).
2. The documents of a source stand in a seeded random order. A pass over that order repeats the source once, so a target
   of r times the source takes floor(r) passes and a prefix of the next one. Each (document, pass) within the target is
   a block; the last one is cut to the words that are missing, so a source's taken words equal its rounded target.
3. The block quotas of all sources are split among output shards: a binary tree halves the blocks, and at each node
   the left child's share of every source is drawn from the multivariate hypergeometric distribution (source by source,
   each a hypergeometric draw given the rest, by inverse CDF from a seeded hash). A shard's blocks of a source are an
   interval of the permuted order, so shards are disjoint and together hold every block.
4. Within its shard a block gets a seeded random key; sorting a shard by it is the local shuffle.

Prefix sums over a source run in two levels (hash buckets, then within a bucket), so a source with a third of all rows
is spread over many tasks. The tree holds one row per (node, source), the same for any number of documents.

Defined cases: null or empty text has size 0 and is never taken; a null source is a source of its own and sorts last; a
repeated row counts as often as it stands there (ties in the random order fall to doc_id, then text hash); an empty
table gives no rows; further columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.common import checkpointed, written

BROADCAST_ROWS = 200_000  # small tables of more rows are shuffled, not broadcast
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, max_repeats: float = 3.0, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """One row per source: source, idx, n_docs, source_size, target (words). sizes: source, size.

    The windows here run over one row per source.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    ordered = by.withColumn("idx", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("idx") % len(weights) + 1).cast("int"))
    every = Window.partitionBy(F.lit(0))
    fill = Window.partitionBy(F.lit(0)).orderBy("fill", "idx")
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    levels = (
        ordered.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * F.lit(float(max_repeats)))
        .withColumn("fill", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(every).cast("double"))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    )
    # The first source, by cap/weight, that its level does not fill sets the level of all that follow.
    level = F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", "idx", "level"))).over(every)["level"]
    return levels.withColumn("water", level).select(
        "source", "idx", "n_docs", "source_size", F.least(F.col("cap"), F.coalesce(F.col("water") * F.col("weight"), F.col("cap"))).alias("target")
    )


def _uniform(*keys: Column) -> Column:
    """(0, 1), from a hash of the keys."""
    return (F.pmod(F.xxhash64(*keys), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))


#: ln(n!) with n as a SQL expression: the table of factorials to 20, Stirling's series beyond (error below 1e-10).
LN_FACTORIAL = "CASE WHEN ({n}) <= 20 THEN ln(factorial(cast({n} as int))) ELSE (({n}) + 0.5) * ln({n}) - ({n}) + 0.9189385332046727 + 1 / (12.0D * ({n})) - 1 / (360.0D * pow({n}, 3)) END"


def hypergeometric(good: str, total: str, draws: str, u: str) -> str:
    """SQL for a hypergeometric draw: how many of `draws` blocks, of `total` with `good` of the source, are of the source.

    Inverse CDF over the support within 9 standard deviations of the mean (what lies outside is below 1e-17).
    All four arguments are names, not expressions.
    """
    ln = lambda n: LN_FACTORIAL.format(n=n)
    choose = lambda n, k: f"({ln(n)} - ({ln(k)}) - ({ln(f'({n} - {k})')}))"
    mean = f"({draws} * ({good} / cast({total} as double)))"
    sd = f"sqrt({mean} * (1 - {good} / cast({total} as double)) * ({total} - {draws}) / greatest(1.0D, {total} - 1.0D))"
    lo = f"greatest(0L, {draws} + {good} - {total}, cast(floor({mean} - 9 * {sd} - 9) as bigint))"
    hi = f"least({draws}, {good}, cast(ceil({mean} + 9 * {sd} + 9) as bigint))"
    start = f"exp({choose(good, 'lo')} + {choose(f'({total} - {good})', f'({draws} - lo)')} - {choose(total, draws)})"
    # Above lo each probability follows from the one before; x stops where the CDF passes u.
    step = f"""if(s.cdf >= {u}, s, named_struct('x', k, 'p', s.p * ({good} - k + 1D) * ({draws} - k + 1D) / (k * ({total} - {good} - {draws} + k + 0D)),
               'cdf', s.cdf + s.p * ({good} - k + 1D) * ({draws} - k + 1D) / (k * ({total} - {good} - {draws} + k + 0D))))"""
    draw = f"""aggregate(if(hi > lo, sequence(lo + 1, hi), array()), named_struct('x', lo, 'p', {start}, 'cdf', {start}), (s, k) -> {step}).x"""
    inner = f"element_at(transform(array({lo}), lo -> element_at(transform(array({hi}), hi -> {draw}), 1)), 1)"
    return f"CASE WHEN {good} <= 0 OR {draws} <= 0 THEN 0L WHEN {draws} >= {total} THEN {good} ELSE {inner} END"


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(idx, bounds): the ends of each shard's interval of the source's blocks, in shard order. quotas: idx, quota.

    Splits level by level; shards is a power of two.
    """
    nodes = quotas.select(F.lit(0).alias("node"), "idx", F.col("quota").cast("bigint"))
    levels = shards.bit_length() - 1
    if shards != 1 << levels:
        raise ValueError("shards must be a power of two")
    for level in range(levels):
        packed = nodes.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("idx", "quota"))).alias("items"), F.sum("quota").alias("total"))
        one = hypergeometric("good", "total", "draws", "u")
        state = "named_struct('total', total, 'draws', total div 2, 'out', cast(array() as array<struct<idx:int,quota:bigint,got:bigint>>))"
        # Names for the arguments of the draw, bound by one-element transforms.
        got = f"""element_at(transform(array(named_struct('good', i.quota, 'total', a.total, 'draws', a.draws, 'u', {{u}})), z ->
                  {one.replace('good', 'z.good').replace('total', 'z.total').replace('draws', 'z.draws').replace('{u}', 'z.u')}), 1)"""
        got = got.replace("'z.good'", "'good'").replace("'z.total'", "'total'").replace("'z.draws'", "'draws'")
        u = f"(pmod(xxhash64({seed}, {level}, node, i.idx), 4503599627370496L) + 0.5D) / 4503599627370496D"
        got = got.replace("{u}", u).replace(">= u,", ">= z.u,")
        fold = f"""aggregate(items, {state}, (a, i) -> element_at(transform(array({got}), g -> named_struct('total', a.total - i.quota, 'draws', a.draws - g,
                   'out', concat(a.out, array(named_struct('idx', i.idx, 'quota', i.quota, 'got', g))))), 1)).out"""
        halves = packed.select("node", F.explode(F.expr(fold)).alias("d")).select(
            "node", "d.idx", F.explode(F.expr("array(named_struct('side', 0, 'quota', d.got), named_struct('side', 1, 'quota', d.quota - d.got))")).alias("h")
        )
        nodes = halves.select((F.col("node") * 2 + F.col("h.side")).alias("node"), "idx", F.col("h.quota").alias("quota"))
    per = nodes.groupBy("idx").agg(F.array_sort(F.collect_list(F.struct("node", "quota"))).alias("q"))
    return per.select("idx", F.expr("aggregate(q, cast(array() as array<bigint>), (a, x) -> concat(a, array(coalesce(element_at(a, -1), 0L) + x.quota)))".replace("element_at(a, -1)", "if(size(a) = 0, 0L, a[size(a) - 1])")).alias("bounds"))


def mix_sources(docs: DataFrame, shards: int = 16, seed: int = 7, max_repeats: int = 3, weights: tuple[int, ...] = (1, 2, 3), keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, taken, copies, and the columns named in keep.

    copies: array of (pass, words, shard, local_key) for each time the document is drawn, words < size only for the one
    document where the source's last pass ends.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    base = docs.select("doc_id", "source", size.alias("size"), F.xxhash64(F.lit(seed), "doc_id", F.xxhash64("text")).alias("key"), *keep)
    # Words are counted in one scan of the texts; where columns are kept, their rows are counted again as they are read.
    narrow = written(base.drop(*keep), "sizes")
    # One row a source, computed once; how many sources and buckets there are decides how the small tables join.
    targets = checkpointed(source_targets(narrow.select("source", "size"), max_repeats, weights))
    n = targets.agg(F.count("*").alias("sources"), F.coalesce(F.sum(F.ceil(F.sqrt("n_docs"))), F.lit(0)).alias("buckets")).first()
    small = F.broadcast if max(n["sources"], n["buckets"]) <= BROADCAST_ROWS else (lambda df: df)
    spread = F.ceil(F.sqrt("n_docs"))  # buckets and rows in a bucket grow alike

    def dealt(rows: DataFrame) -> DataFrame:
        joined = rows.join(small(targets.withColumnRenamed("source", "of")), F.col("source").eqNullSafe(F.col("of"))).drop("of")
        return joined.withColumn("bucket", F.pmod(F.shiftright("key", 16), spread.cast("bigint")))

    placed = dealt(base if keep else narrow)
    cells = dealt(narrow).groupBy("idx", "bucket").agg(F.sum("size").alias("cell_size"), F.count("*").alias("cell_docs"), F.first("target").alias("t"))
    prior = Window.partitionBy("idx").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("idx", "bucket", F.coalesce(F.sum("cell_size").over(prior), F.lit(0)).alias("size_before"), F.coalesce(F.sum("cell_docs").over(prior), F.lit(0)).alias("docs_before"))
    inside = Window.partitionBy("idx", "bucket").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    at = (
        placed.withColumn("off", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .withColumn("nth", F.coalesce(F.count("*").over(inside), F.lit(0)))
        .join(small(cells), ["idx", "bucket"])
        .withColumn("off", F.col("off") + F.col("size_before"))
        .withColumn("nth", F.col("nth") + F.col("docs_before"))
    )
    goal = F.round(F.col("target")).cast("bigint")
    took = F.expr(
        f"transform(sequence(0, {max_repeats - 1}), p -> named_struct('pass', p, 'words', greatest(0L, least(size, goal - p * source_size - off)), 'nth', p * n_docs + nth))"
    )
    drawn = at.withColumn("goal", goal).withColumn("drawn", F.filter(took, lambda c: c["words"] > 0))
    # A source's blocks are counted up to the last one that is drawn; documents without words take a place but no words.
    quotas = drawn.groupBy("idx").agg(F.coalesce(F.max(F.expr("aggregate(drawn, -1L, (a, c) -> greatest(a, c.nth))")), F.lit(-1)).alias("last")).select("idx", (F.col("last") + 1).alias("quota"))
    bounds = split_quotas(quotas, shards, seed)
    shard = "size(filter(bounds, b -> b <= c.nth))"
    copies = F.expr(f"transform(drawn, c -> named_struct('pass', c.pass, 'words', c.words, 'shard', {shard}, 'local_key', xxhash64({seed}, key, c.pass)))")
    return drawn.join(small(bounds), "idx").select(
        "doc_id", "size", "source", "source_size", "target", F.expr("aggregate(drawn, 0L, (a, c) -> a + c.words)").alias("taken"), copies.alias("copies"), *keep
    )


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix as documents: one row for each drawn copy, in its shard's local order; a cut copy holds its first words.

    All columns of docs are handed on (n_chars, if there, counted anew for cut copies); doc_id repeats with the copies.
    """
    rows = mix_sources(docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("__doc")), keep=("__doc",), **how)
    rows = rows.select("size", "__doc", F.explode("copies").alias("c"))
    piece = F.array_join(F.slice(F.regexp_extract_all(F.col("__doc.text"), F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), F.lit(1), F.col("c.words").cast("int")), "")
    cut = F.col("c.words") < F.col("size")
    out = rows.select("__doc", F.when(cut, piece).alias("__cut"), F.col("c.shard").alias("__shard"), F.col("c.local_key").alias("__key"))
    # Ranges of (shard, random key): a shard is in its local order, over as many tasks as it needs.
    out = out.repartitionByRange("__shard", "__key").sortWithinPartitions("__shard", "__key")
    new = {"text": F.col("__cut")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("__cut").cast(docs.schema["n_chars"].dataType)
    return out.select(*(F.coalesce(new[c], F.col("__doc")[c]).alias(c) if c in new else F.col("__doc")[c].alias(c) for c in docs.columns))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken", F.transform("copies", lambda c: c["shard"]).alias("shards"))
