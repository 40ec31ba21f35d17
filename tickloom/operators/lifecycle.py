"""Bars over the life of a ticker: segments, gaps, splits, renames."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.joins import asof_next, within_days
from tickloom.operators.windows import forward_filled, islands, ordered

SPLIT_GAP, REPORT_GAP = 10, 5
TYPES = ("CS", "ADRC", "OS")
MIN_ROWS = 564
JUMP, HALF_JUMP = math.log(2.0), math.log(1.5)


def with_gaps(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Bars with idx of their session and gap, the sessions missed since the ticker's bar before.

    Bars of no session have null idx; the calendar is one row per day and is broadcast.
    """
    w = ordered("ticker", "bar_date")
    indexed = bars.join(F.broadcast(calendar.select("bar_date", "idx")), "bar_date", "left")
    return indexed.withColumn("gap", F.col("idx") - F.lag("idx").over(w) - 1)


def segments(bars: DataFrame, calendar: DataFrame, gap: int = SPLIT_GAP) -> DataFrame:
    """Bars with source_ticker, segment (0 the oldest) and ticker: source_ticker, or with .n for all but the newest segment."""
    w = ordered("ticker", "bar_date")
    cut = islands(with_gaps(bars, calendar), F.col("gap") >= gap, w, "segment")
    newest = F.max("segment").over(Window.partitionBy("ticker"))
    named = F.when(F.col("segment") == newest, F.col("ticker")).otherwise(F.concat_ws(".", "ticker", F.col("segment") + 1))
    return cut.withColumn("source_ticker", F.col("ticker")).withColumn("ticker", named)


def segment_bounds(segmented: DataFrame) -> DataFrame:
    return segmented.groupBy("source_ticker", "segment").agg(F.min("bar_date").alias("first_date"), F.max("bar_date").alias("last_date"), F.count("*").alias("n_bars"))


def suspicious_gaps(bars: DataFrame, calendar: DataFrame, low: int = REPORT_GAP, high: int = SPLIT_GAP, top: int = 20) -> DataFrame:
    """The tickers with most gaps of [low, high) sessions."""
    found = with_gaps(bars, calendar).where(F.col("gap").between(low, high - 1))
    return found.groupBy("ticker").agg(F.count("*").alias("n_gaps"), F.max("gap").alias("longest")).orderBy(F.desc("n_gaps"), F.desc("longest"), "ticker").limit(top)


def densified(bars: DataFrame, calendar: DataFrame, fill_zero: tuple[str, ...] = ("volume", "transactions")) -> DataFrame:
    """Bars on every session between a ticker's first and last one: prices carried forward, volume 0."""
    life = bars.groupBy("ticker").agg(F.min("bar_date").alias("lo"), F.max("bar_date").alias("hi"))
    days = life.select("ticker", F.explode(F.sequence("lo", "hi")).alias("bar_date"))
    grid = days.join(calendar.select("bar_date"), "bar_date", "left_semi")
    w = ordered("ticker", "bar_date")
    full = grid.join(bars.withColumn("__real", F.lit(True)), ["ticker", "bar_date"], "left")
    close = forward_filled(F.col("close"), w)
    out = full.withColumn("filled", F.col("__real").isNull()).withColumn("close", close)
    for c in ("open", "high", "low"):
        out = out.withColumn(c, F.coalesce(c, "close"))
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in fill_zero}).drop("__real")


def split_adjusted(bars: DataFrame, splits: DataFrame) -> DataFrame:
    """Prices times, volume over, the factor of the first split after the bar's date; 1 if none.

    splits: ticker, execution_date, factor.
    """
    got = asof_next(bars, splits, ["ticker"], "bar_date", "execution_date", ["factor"])
    factor = F.coalesce("factor", F.lit(1.0))
    return got.withColumns({c: F.col(c) * factor for c in ("open", "high", "low", "close")} | {"volume": F.col("volume") / factor})


def segment_split_adjusted(segmented: DataFrame, splits: DataFrame) -> DataFrame:
    """split_adjusted() of segments(): a split counts for the bars of its source ticker's segment only, up to the segment's last date.

    So bars of a company that had the symbol before are left alone by splits of the one that has it now.
    """
    last = segmented.groupBy("source_ticker", "segment").agg(F.max("bar_date").alias("__last"))
    bounded = segmented.join(last, ["source_ticker", "segment"])
    dated = splits.select(F.col("ticker").alias("source_ticker"), "execution_date", F.col("execution_date").alias("__on"), "factor")
    got = asof_next(bounded, dated, ["source_ticker"], "bar_date", "execution_date", ["__on", "factor"])
    factor = F.when(F.col("__on") <= F.col("__last"), F.col("factor")).otherwise(F.lit(1.0))
    made = {c: F.col(c) * F.coalesce(factor, F.lit(1.0)) for c in ("open", "high", "low", "close")} | {"volume": F.col("volume") / F.coalesce(factor, F.lit(1.0))}
    return got.withColumns(made).drop("__last", "__on", "factor").select(segmented.columns)


def suspect_renames(renames: DataFrame, splits: DataFrame) -> DataFrame:
    """Renames whose previous name has a split after the change: the name lives on, so it was no rename."""
    s = splits.select(F.col("ticker").alias("previous_ticker"), "execution_date")
    return renames.join(s, (renames["previous_ticker"] == s["previous_ticker"]) & (s["execution_date"] > renames["change_date"]), "left_semi")


def stitched(bars: DataFrame, renames: DataFrame) -> DataFrame:
    """Bars under current names: rows of previous names before the change, of the current one from the last change on."""
    last = renames.groupBy("current_ticker").agg(F.max("change_date").alias("since"))
    joined = bars.join(last, bars["ticker"] == last["current_ticker"], "left")
    alone = joined.where("since is null").select(bars["*"])  # no old rows come to these: they need no place
    own = joined.where("bar_date >= since").select(bars["*"])
    old = bars.join(renames, bars["ticker"] == renames["previous_ticker"]).where("bar_date < change_date")
    moved = old.select(*[F.col("current_ticker").alias("ticker") if c == "ticker" else bars[c] for c in bars.columns])
    pick = Window.partitionBy("ticker", "bar_date").orderBy("__rank")
    both = own.withColumn("__rank", F.lit(0)).unionByName(moved.withColumn("__rank", F.lit(1)))
    return alone.unionByName(both.withColumn("__n", F.row_number().over(pick)).where("__n = 1").drop("__n", "__rank"))


def aliases(renames: DataFrame) -> DataFrame:
    """current_ticker and its previous names, oldest change first."""
    return renames.groupBy("current_ticker").agg(F.transform(F.array_sort(F.collect_list(F.struct("change_date", "previous_ticker"))), lambda x: x["previous_ticker"]).alias("previous"))


def liquid(bars: DataFrame, min_value: float, min_price: float, min_days: int) -> DataFrame:
    """avg_value, median_close, n_days of each ticker that passes all three gates."""
    return liquidity(bars).where((F.col("avg_value") >= min_value) & (F.col("median_close") >= min_price) & (F.col("n_days") >= min_days))


def liquidity(bars: DataFrame) -> DataFrame:
    return bars.groupBy("ticker").agg(F.avg(F.col("close") * F.col("volume")).alias("avg_value"), F.median("close").alias("median_close"), F.count("*").alias("n_days"))


def gate_funnel(stats: DataFrame, min_value: float, min_price: float, min_days: int) -> DataFrame:
    """How many tickers are left after each gate."""
    a, b, c = F.col("avg_value") >= min_value, F.col("median_close") >= min_price, F.col("n_days") >= min_days
    return stats.agg(F.count("*").alias("n_all"), F.count_if(a).alias("n_value"), F.count_if(a & b).alias("n_price"), F.count_if(a & b & c).alias("n_days"))


def long_enough(bars: DataFrame, n: int = MIN_ROWS) -> DataFrame:
    return bars.withColumn("__n", F.count("*").over(Window.partitionBy("ticker"))).where(F.col("__n") >= n).drop("__n")


def continuous(bars: DataFrame, jump: float = JUMP) -> DataFrame:
    """Bars of tickers without a log return of jump or more; undefined returns pass."""
    w = ordered("ticker", "bar_date")
    moved = F.abs(F.ln("close") - F.ln(F.lag("close").over(w)))
    worst = F.max("__r").over(Window.partitionBy("ticker"))
    return bars.withColumn("__r", moved).withColumn("__w", worst).where(F.coalesce(F.col("__w") < jump, F.lit(True))).drop("__r", "__w")


def ticker_status(bars: DataFrame, least_rows: int = MIN_ROWS, jump: float = JUMP) -> DataFrame:
    """ticker, status (ok or skipped), reason, n_rows of every ticker, by the gates of long_enough() and continuous()."""
    moved = F.abs(F.ln("close") - F.ln(F.lag("close").over(ordered("ticker", "bar_date"))))
    by = bars.select("ticker", moved.alias("r")).groupBy("ticker").agg(F.count("*").alias("n_rows"), F.max("r").alias("worst"))
    reason = F.when(F.col("n_rows") < least_rows, "too few rows").when(F.col("worst") >= jump, "discontinuous")
    return by.select("ticker", F.when(reason.isNull(), "ok").otherwise("skipped").alias("status"), reason.alias("reason"), "n_rows")


def tradable(bars: DataFrame, details: DataFrame, regime: list[str], types: tuple[str, ...] = TYPES) -> DataFrame:
    """Bars of common stock (by details: ticker, type) and of regime tickers."""
    return bars.join(details.select("ticker", "type"), "ticker", "left").where(F.col("type").isin(*types) | F.col("ticker").isin(*regime)).drop("type")


def verified_splits(bars: DataFrame, splits: DataFrame, days: int = 5, jump: float = 0.2, shift: float = 0.15) -> DataFrame:
    """For each split: bars within `days` of it, jumps among them, the shift of the mean close across it, and a verdict."""
    w = ordered("ticker", "bar_date")
    moves = bars.withColumn("move", F.abs(F.try_divide(F.col("close"), F.lag("close").over(w)) - 1))
    near = within_days(moves, splits, "ticker", "bar_date", "execution_date", days)
    before, after = F.avg(F.when(F.col("bar_date") < F.col("execution_date"), F.col("close"))), F.avg(F.when(F.col("bar_date") >= F.col("execution_date"), F.col("close")))
    out = near.groupBy("ticker", "execution_date").agg(F.count("*").alias("n_bars"), F.count_if(F.col("move") > jump).alias("n_jumps"), (F.try_divide(after, before) - 1).alias("mean_shift"))
    return out.withColumn("suspect", F.coalesce((F.col("n_jumps") > 0) | (F.abs("mean_shift") > shift), F.lit(False)))


def discontinuities(bars: DataFrame, suspicious: float = HALF_JUMP, critical: float = JUMP) -> DataFrame:
    """Every close-to-close log return at or above suspicious, with its severity."""
    w = ordered("ticker", "bar_date")
    r = F.ln("close") - F.ln(F.lag("close").over(w))
    return bars.select("ticker", "bar_date", r.alias("log_return")).where(F.abs("log_return") >= suspicious).withColumn("severity", F.when(F.abs("log_return") >= critical, "critical").otherwise("suspicious"))


def worst_tickers(found: DataFrame, top: int = 30) -> DataFrame:
    by = found.groupBy("ticker").agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "critical").alias("n_critical"), F.max(F.abs("log_return")).alias("largest"))
    return by.orderBy(F.desc("n_critical"), F.desc("n"), F.desc("largest"), "ticker").limit(top)
