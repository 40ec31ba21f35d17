r"""Document fingerprints: a Merkle tree over sentences, paragraphs and sections. DataFrame functions only.

Sections are separated by an empty line, paragraphs by a line feed; a paragraph's leaves are runs of at most 48
characters that end with a sentence mark where there is one. A leaf's digest is the md5 of its text, a paragraph's that
of its leaves' digests, a section's that of its paragraphs', the root's that of its sections'. A fingerprint reads
root|section;section..., a section hash(paragraph,paragraph...), a paragraph hash[leaves as 8 hex digits each]: the
roots tell whether texts are equal, and where they differ the branches lead to the edited leaves.

Likeness of two fingerprints: Dice coefficient of the distinct leaf digests (8 hex digits) they hold; 1 if neither has any.

Defined cases: null text counts as empty (one section, one paragraph, no leaf); repeated ids are ordered by text hash;
an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LEAF = r"[^.!?]{0,47}[.!?]+ *|[^.!?]{1,48}"


def leaf_digests(text: Column) -> Column:
    """array of sections of arrays of paragraphs of arrays of leaf digests."""
    sections = F.split(text, "\n\n", -1)
    leaves = lambda p: F.transform(F.regexp_extract_all(p, F.lit(LEAF), F.lit(0)), F.md5)
    return F.transform(sections, lambda s: F.transform(F.split(s, "\n", -1), leaves))


def fingerprint(tree: Column) -> Column:
    """The fingerprint string of what leaf_digests() gave."""

    def node(shown: Column, parts: Column) -> Column:
        return F.struct(F.md5(F.array_join(parts, "")).alias("hash"), shown.alias("shown"))

    paragraph = lambda p: node(F.array_join(F.transform(p, lambda x: F.substring(x, 1, 8)), ""), p)
    framed = lambda n, a, b: F.concat(F.substring(n["hash"], 1, 16), F.lit(a), n["shown"], F.lit(b))
    section = lambda ps: node(F.array_join(F.transform(ps, lambda n: framed(n, "[", "]")), ","), F.transform(ps, lambda n: n["hash"]))
    sections = F.transform(F.transform(tree, lambda s: F.transform(s, paragraph)), section)
    return F.concat(F.md5(F.array_join(F.transform(sections, lambda n: n["hash"]), "")), F.lit("|"), F.array_join(F.transform(sections, lambda n: framed(n, "(", ")")), ";"))


def leaf_set(tree: Column) -> Column:
    return F.array_distinct(F.transform(F.flatten(F.flatten(tree)), lambda x: F.substring(x, 1, 8)))


def likeness(a: Column, b: Column) -> Column:
    """Of two leaf sets."""
    n = F.size(a) + F.size(b)
    return F.when(n == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / n)


def dealt(docs: DataFrame, per_bucket: int, max_cuts: int) -> DataFrame:
    """doc_id, text, times (equal rows that it stands for), bucket: a number that does not fall in the order of (doc_id, text hash).

    At most max_cuts approximate quantiles of doc_id bound the buckets; with more rows each range is cut evenly, so what
    reaches the driver is bounded. An id that holds several quantiles has buckets of its own, by ranges of the text hash, and
    of its equal rows one stands for all.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    id_ = F.coalesce("doc_id", F.lit(LEAST_ID))
    parts = max(1, -(-docs.count() // per_bucket))
    cuts = min(parts, max_cuts)
    got = docs.select(F.percentile_approx(id_, [i / cuts for i in range(cuts + 1)], 10_000).alias("q"), F.min(id_).alias("a"), F.max(id_).alias("b")).first()
    quantiles = [int(x) for x in got["q"] or []]
    bounds = sorted({*quantiles, *(int(x) for x in (got["a"], got["b"]) if x is not None)})
    bucket = _bucket(id_, bounds, -(-parts // cuts))
    often = Counter(quantiles)
    crowded = sorted(x for x, n in often.items() if n > 2)
    if not crowded:
        return docs.select("doc_id", "text", F.lit(1).alias("times"), bucket.alias("bucket"))
    pieces = max(often.values()) * -(-parts // cuts)
    of_hash = F.least(F.floor((F.xxhash64("text").cast("double") / 2.0**64 + 0.5) * pieces), F.lit(pieces - 1))
    here = id_.isin(crowded)
    rows = docs.where(~here).withColumn("times", F.lit(1).cast("bigint")).unionByName(docs.where(here).groupBy("doc_id", "text").agg(F.count("*").alias("times")))
    return rows.select("doc_id", "text", "times", (bucket * (pieces + 1) + F.when(here, of_hash).otherwise(pieces)).alias("bucket"))


def with_next(docs: DataFrame, per_bucket: int = 4000, max_cuts: int = 1024) -> DataFrame:
    """doc_id, text, next_text: the text of the row before in ascending doc_id (the last row's for the first).

    lag() runs within a bucket of dealt(). The last row of a bucket is carried to the next one by a join of one row per
    bucket, which moves no other text.
    """
    rows = dealt(docs, per_bucket, max_cuts)
    place = F.struct(F.coalesce("doc_id", F.lit(LEAST_ID)), F.xxhash64("text"))
    lasts = rows.groupBy("bucket").agg(F.max_by("text", place).alias("carried"))
    # The bucket before each one: a window over one number per bucket.
    every = Window.orderBy("bucket")
    before = lasts.select("bucket", F.coalesce(F.lag("bucket").over(every), F.max("bucket").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("prior"))
    carried = before.join(lasts.withColumnRenamed("bucket", "prior"), "prior").select("bucket", "carried")
    w = Window.partitionBy("bucket").orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    within = rows.withColumn("before", F.lag("text").over(w)).join(carried, "bucket").withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    return within.select("doc_id", "text", F.when(F.col("nth") > 1, F.col("text")).otherwise(F.coalesce("before", "carried")).alias("next_text"))


LEAST_ID = -(1 << 63)


def _bucket(id_: Column, bounds: list[int], pieces: int) -> Column:
    """A number that does not fall as id_ rises: the last of the bounds at or below it (binary search), times pieces, plus
    its place among as many even pieces of that range."""
    if len(bounds) < 2:
        return F.lit(0).cast("bigint")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    table = F.array(*[F.lit(b) for b in bounds])
    at = F.aggregate(steps, F.lit(0), lambda low, step: F.when(F.coalesce(F.get(table, low + step) <= id_, F.lit(False)), low + step).otherwise(low))
    if pieces == 1:
        return at.cast("bigint")
    low, high = F.get(table, at).cast("double"), F.coalesce(F.get(table, at + 1), F.lit(bounds[-1])).cast("double")
    return at.cast("bigint") * pieces + F.least(F.floor((id_.cast("double") - low) / (high - low + 1) * pieces), F.lit(pieces - 1))


def edited(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, next_text) with edited_text: its last floor(n/2) code points replaced by the next text's first."""
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    return docs.withColumn("edited_text", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)))


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = edited(with_next(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    trees = docs.select(
        "doc_id", F.length("text").cast("bigint").alias("n_chars"), F.sha2("edited_text", 256).alias("edited_sha256"),
        leaf_digests(F.col("text")).alias("own"), leaf_digests(F.col("edited_text")).alias("other"), leaf_digests(F.col("next_text")).alias("next"),
    )
    sets = trees.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("other")).alias("edited_fingerprint"),
                        leaf_set(F.col("own")).alias("own"), leaf_set(F.col("other")).alias("other"), leaf_set(F.col("next")).alias("next"))
    return sets.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id DESC), first_value(coalesce(text, '')) OVER (ORDER BY doc_id DESC)) AS next_text FROM documents),
e AS (SELECT doc_id, text, next_text, substr(text, 1, length(text) - length(text) // 2) || substr(next_text, 1, length(text) // 2) AS edited_text FROM d),
t AS (
  SELECT doc_id, length(text) AS n_chars, sha256(edited_text) AS edited_sha256,
         {own} AS own, {edited} AS other, {next} AS nxt FROM e),
s AS (
  SELECT doc_id, n_chars, edited_sha256, {fp_own} AS fingerprint, {fp_other} AS edited_fingerprint,
         list_distinct(list_transform(flatten(flatten(own)), lambda x: substr(x, 1, 8))) AS a,
         list_distinct(list_transform(flatten(flatten(other)), lambda x: substr(x, 1, 8))) AS b,
         list_distinct(list_transform(flatten(flatten(nxt)), lambda x: substr(x, 1, 8))) AS c FROM t)
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
       CASE WHEN len(a) + len(b) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(a, b)) / (len(a) + len(b)) END AS near_edited,
       CASE WHEN len(a) + len(c) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect(a, c)) / (len(a) + len(c)) END AS near_next
FROM s
"""


def _sql_tree(text: str) -> str:
    return rf"list_transform(string_split({text}, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), lambda p: list_transform(regexp_extract_all(p, '{LEAF}'), lambda x: md5(x))))"


def _sql_print(tree: str) -> str:
    join = "coalesce(list_aggregate({}, 'string_agg', '{}'), '')"
    par = f"list_transform(s, lambda p: {{'hash': md5({join.format('p', '')}), 'shown': {join.format('list_transform(p, lambda x: substr(x, 1, 8))', '')}}})"
    sec = f"list_transform(list_transform({tree}, lambda s: {par}), lambda ps: {{'hash': md5({join.format('list_transform(ps, lambda n: n.hash)', '')}), 'shown': {join.format("list_transform(ps, lambda n: substr(n.hash, 1, 16) || '[' || n.shown || ']')", ',')}}})"
    return f"(SELECT md5({join.format('list_transform(z, lambda n: n.hash)', '')}) || '|' || {join.format("list_transform(z, lambda n: substr(n.hash, 1, 16) || '(' || n.shown || ')')", ';')} FROM (SELECT {sec} AS z))"


OP6_SQL = OP6_SQL.format(own=_sql_tree("text"), edited=_sql_tree("edited_text"), next=_sql_tree("next_text"), fp_own=_sql_print("own"), fp_other=_sql_print("other"))
