"""Walk-forward folds, chronological splits, episode pools and seeded draws.

Draws hash keys with a seed instead of calling rand(), so they don't depend on how rows are partitioned.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.operators.scan import placed, running_sums
from tickloom.operators.windows import ordered


def uniform(seed: int, *keys: Column | str) -> Column:
    """A number in (0, 1) for the keys."""
    return (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def walk_forward(spark: SparkSession, first_year: int, last_year: int, train_years: int = 10, valid_years: int = 1) -> DataFrame:
    """fold, train_start, train_end, valid_start, valid_end: training grows by a validation span per fold; the last fold trains on all, without validation."""
    n = max(0, (last_year - first_year + 1 - train_years) // valid_years)
    year = F.lit(first_year + train_years) + F.col("id").cast("int") * valid_years
    last = F.col("id") == n
    day = lambda y, m, d: F.make_date(y, F.lit(m), F.lit(d))
    return spark.range(n + 1).select(
        F.col("id").cast("int").alias("fold"), day(F.lit(first_year), 1, 1).alias("train_start"), day(F.when(last, F.lit(last_year)).otherwise(year - 1), 12, 31).alias("train_end"),
        F.when(~last, day(year, 1, 1)).alias("valid_start"), F.when(~last, day(year + valid_years - 1, 12, 31)).alias("valid_end"),
    )


def chronological_split(df: DataFrame, by: str, order: str, train: float = 0.7, valid: float = 0.15) -> DataFrame:
    """split: train, valid or test by place in time."""
    i, n = F.row_number().over(ordered(by, order)) - 1, F.count("*").over(Window.partitionBy(by))
    a, b = F.floor(n * train), F.floor(n * (train + valid))
    return df.withColumn("split", F.when(i < a, "train").when(i < b, "valid").otherwise("test"))


def trimmed(df: DataFrame, by: str, date: str) -> DataFrame:
    """Without each key's first and last date."""
    w = Window.partitionBy(by)
    return df.withColumns({"__a": F.min(date).over(w), "__b": F.max(date).over(w)}).where((F.col(date) > F.col("__a")) & (F.col(date) < F.col("__b"))).drop("__a", "__b")


def episode_pool(dates: DataFrame, length: int, decay: float = 0.0, stride: int = 1, by: str | None = None) -> DataFrame:
    """start_idx, start_date, end_date, weight of every episode of `length` steps; the weight falls with age by exp(-decay age).

    With by, episodes of each key (a ticker) are numbered within it; ages and weights are those of the whole pool, by start_date.
    Places come from two-level sums: no window goes over a whole series or pool. An episode's end is the row length - 1 places on.
    """
    keys = [by] if by else []
    at = placed(dates.select(*keys, "bar_date"), keys, ["bar_date"], "start_idx")
    ends = at.select(*keys, (F.col("start_idx") - (length - 1)).alias("start_idx"), F.col("bar_date").alias("end_date"))
    pool = at.where(F.col("start_idx") % stride == 0).join(ends, [*keys, "start_idx"]).select(*keys, "start_idx", F.col("bar_date").alias("start_date"), "end_date")
    return weighted_by_recency(pool, ["start_date", by] if by else "start_idx", decay)


def weighted_by_recency(pool: DataFrame, order: str | list[str], decay: float) -> DataFrame:
    """age 0 (newest) to 1 and weight exp(-decay age), adding up to 1."""
    order = [order] if isinstance(order, str) else order
    at = placed(pool, [], order, "__place")
    one = F.lit(1).alias("__one")
    raw = at.select("*", one)
    n = raw.groupBy("__one").agg(F.count("*").alias("__n"))  # one row
    aged = raw.join(F.broadcast(n), "__one").withColumn("age", 1 - F.coalesce(F.try_divide(F.col("__place"), F.col("__n") - 1), F.lit(0.0)))
    aged = aged.withColumn("__w", F.exp(-F.lit(decay) * F.col("age")))
    total = aged.groupBy("__one").agg(F.sum("__w").alias("__sum"))  # one row
    return aged.join(F.broadcast(total), "__one").withColumn("weight", F.col("__w") / F.col("__sum")).drop("__w", "__n", "__sum", "__place", "__one")


SLICES = 4096
DIGITS = 18


def drawn(pool: DataFrame, n: int, seed: int, order: list[str] | None = None) -> DataFrame:
    """n draws with replacement by weight: draw, and the pool's columns. Each draw falls into one cumulative band.

    Bands are sums of decimals in two levels, so they do not depend on how rows are dealt out, and the last one ends where draws
    end: a draw is a share of the total. Bands and draws meet by an equi join on slices of the total; a band is sent to
    the slices it touches, the draws of a slice are split by Spark where there are many.
    """
    order = order or ["start_idx"]
    bands = running_sums(pool, [], order, {"__hi": F.col("weight")}, DIGITS)
    total = bands.agg(F.max("__hi").alias("t")).first()["t"]
    if not total:
        return pool.limit(0).select(F.lit(0).cast("bigint").alias("draw"), "*")
    share = lambda c: (c / F.lit(float(total))).cast("double")
    lo = F.col("__hi") - F.col("weight").cast(f"decimal(38,{DIGITS})")
    bands = bands.withColumns({"__lo": share(lo.cast("double")), "__up": F.when(F.col("__hi") == F.lit(total), 2.0).otherwise(share(F.col("__hi").cast("double")))})
    slice_of = lambda c: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)) * SLICES)
    draws = pool.sparkSession.range(n).select(F.col("id").alias("draw"), uniform(seed, "id").alias("__u"))
    spread = bands.withColumn("__s", F.explode(F.sequence(slice_of(F.col("__lo")), slice_of(F.col("__up")))))
    inside = (F.col("__u") >= F.col("__lo")) & (F.col("__u") < F.col("__up"))
    hit = draws.withColumn("__s", slice_of(F.col("__u"))).join(spread, "__s").where(inside)
    # rounding may let two neighbouring bands claim a draw that lies on their edge: the first has it
    best = hit.groupBy("draw").agg(F.min_by(F.struct(*pool.columns), "__hi").alias("__row"))
    return best.select("draw", "__row.*")


def validation_set(pool: DataFrame, n: int, seed: int) -> DataFrame:
    """n episodes without replacement."""
    return pool.orderBy(uniform(seed, "start_idx"), "start_idx").limit(n)


def capped_validation_set(pool: DataFrame, n: int, seed: int) -> DataFrame:
    """n episodes, as evenly over tickers as they allow: every ticker's first before any second."""
    turn = F.row_number().over(Window.partitionBy("ticker").orderBy(uniform(seed, "ticker", "start_idx"), "start_idx"))
    return pool.withColumn("__turn", turn).orderBy("__turn", uniform(seed + 1, "ticker"), "ticker").limit(n).drop("__turn")


# ---- replay


def ring(rows: DataFrame, order: str, capacity: int) -> DataFrame:
    """What a ring buffer holds: the last `capacity` rows, with slot."""
    kept = rows.orderBy(F.desc(order)).limit(capacity)
    return kept.withColumn("slot", F.pmod(F.col(order), F.lit(capacity)))


def recency_sample(spark: SparkSession, size: int, pointer: int, capacity: int, batch: int, decay: float, seed: int) -> DataFrame:
    """draw, slot: exponentially more often recent slots; decay 0 is uniform."""
    u = uniform(seed, "id")
    age = u if decay == 0 else -F.ln(1 - u * (1 - math.exp(-decay))) / decay
    back = F.least(F.floor(age * size), F.lit(size - 1))
    return spark.range(batch).select(F.col("id").alias("draw"), F.pmod(F.lit(pointer - 1) - back, F.lit(capacity)).cast("bigint").alias("slot"))


def gathered(draws: DataFrame, buffer: DataFrame) -> DataFrame:
    """The buffer's rows of the slots drawn."""
    return draws.join(buffer, "slot")


def flattened(df: DataFrame, parts: list[str], name: str = "state") -> DataFrame:
    return df.withColumn(name, F.concat(*parts))


def unflattened(df: DataFrame, sizes: dict[str, int], name: str = "state") -> DataFrame:
    at, out = 1, {}
    for part, n in sizes.items():
        out[part] = F.slice(name, at, n)
        at += n
    return df.withColumns(out)
