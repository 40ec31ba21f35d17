"""Queries over bars: rollups, windows, joins, life of a ticker, normalisation, regime, audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions import scalars as S
from tickloom.operators import audit as A
from tickloom.operators import audit_scan as AS
from tickloom.operators import features as FT
from tickloom.operators import gram as G
from tickloom.operators import joins as J
from tickloom.operators import lifecycle as L
from tickloom.operators import normalize as N
from tickloom.operators import order_stats as OS
from tickloom.operators import regime as R
from tickloom.operators import windows as W
from tickloom.operators.rollup import coarser, live_view, rollup
from tickloom.plans.registry import query
from tickloom.sources.tables import DAILY_BARS_SQL, HOURLY_BARS_SQL, TICKS_SQL, daily_bars, hourly_bars, table, ticks, trades

BARS = f"WITH {DAILY_BARS_SQL}"
HOURS = f"WITH {HOURLY_BARS_SQL}"
CALENDAR_SQL = """calendar AS (
  SELECT d::DATE AS bar_date, row_number() OVER (ORDER BY d) - 1 AS idx
  FROM (SELECT unnest(generate_series((SELECT min(bar_date) FROM bars)::TIMESTAMP, (SELECT max(bar_date) FROM bars)::TIMESTAMP, INTERVAL 1 DAY)) AS d) WHERE isodow(d) < 6)"""
P = "PARTITION BY ticker ORDER BY bar_date"


def weekdays(bars: DataFrame) -> DataFrame:
    """bar_date, idx of the weekdays that bars span."""
    span = bars.agg(F.min("bar_date").alias("a"), F.max("bar_date").alias("b"))
    days = span.select(F.explode(F.sequence("a", "b")).alias("bar_date")).where(F.weekday("bar_date") < 5)
    return days.withColumn("idx", (F.row_number().over(Window.orderBy("bar_date")) - 1).cast("bigint"))


def weekday_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_bars(spark, sf_dir).where(F.weekday("bar_date") < 5)


WEEKDAY_BARS = DAILY_BARS_SQL.replace("bars AS (", "all_bars AS (", 1) + ", bars AS (SELECT * FROM all_bars WHERE isodow(bar_date) < 6)"

# ---- rollups


@query(f"{HOURS} SELECT ticker, bucket, open, high, low, close, volume, ln(close / lag(close) OVER (PARTITION BY ticker ORDER BY bucket)) AS log_return FROM bars", "log_return")
def hourly_returns(spark, sf_dir):
    """Hourly bars of ticks with the log return from bar to bar."""
    bars = hourly_bars(spark, sf_dir)
    r = F.ln(F.col("close") / F.lag("close").over(W.ordered("ticker", "bucket")))
    return bars.select("*", r.alias("log_return"))


def _bucketed(minutes: int) -> str:
    return f"""WITH {TICKS_SQL} SELECT ticker, time_bucket(INTERVAL {minutes} MINUTE, ts) AS bucket, arg_min(price, ts + to_microseconds(id)) AS open, max(price) AS high,
               min(price) AS low, arg_max(price, ts + to_microseconds(id)) AS close, count(*) AS volume FROM ticks GROUP BY ALL"""


@query(_bucketed(5))
def rollup_5m(spark, sf_dir):
    return rollup(ticks(spark, sf_dir), "5 minutes")


@query(_bucketed(15))
def rollup_15m(spark, sf_dir):
    return rollup(ticks(spark, sf_dir), "15 minutes")


@query(_bucketed(30))
def rollup_30m(spark, sf_dir):
    return rollup(ticks(spark, sf_dir), "30 minutes")


@query(_bucketed(1440))
def rollup_1d_of_1h(spark, sf_dir):
    """Daily bars made of hourly bars."""
    return coarser(hourly_bars(spark, sf_dir), "1 day")


@query(_bucketed(60))
def rollup_live_view(spark, sf_dir):
    """Stored buckets up to a watermark united with fresh ones after it."""
    t = ticks(spark, sf_dir)
    mark = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    return live_view(rollup(t.where(F.col("ts") < mark), "1 hour"), t, "1 hour", mark)


@query(f"{BARS} SELECT * FROM bars", "open high low close volume")
def daily_ohlcv(spark, sf_dir):
    return daily_bars(spark, sf_dir)


# ---- scans, projections, scalar functions


@query("SELECT r_name AS ticker FROM region WHERE r_regionkey NOT IN (SELECT n_regionkey FROM nation WHERE n_name LIKE 'I%')")
def missing_keys(spark, sf_dir):
    """Wanted keys that have no row."""
    from tickloom.sources.bars import missing

    nations = table(spark, sf_dir, "nation").where(F.col("n_name").startswith("I")).select(F.col("n_regionkey").alias("k"))
    wanted = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), "r_name")
    return missing(wanted, nations, "k").join(wanted, "k").select(F.col("r_name").alias("ticker"))


@query("SELECT event_id, ts, value FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12'")
def time_slice(spark, sf_dir):
    """A half-open time range; the filter reaches the scan."""
    from tickloom.sources.bars import between

    lo, hi = (F.lit(x).cast("timestamp_ntz") for x in ("2024-01-05", "2024-01-12"))
    rows = table(spark, sf_dir, "events").select("event_id", "ts", "value")
    return between(rows, None, None).where((F.col("ts") >= lo) & (F.col("ts") < hi))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_property(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query(
    """SELECT o_orderkey, isodow(o_orderdate) AS iso_day, sin(2 * pi() * isodow(o_orderdate) / 5.0) AS day_sin, cos(2 * pi() * isodow(o_orderdate) / 5.0) AS day_cos,
       sin(2 * pi() * month(o_orderdate) / 12.0) AS month_sin, cos(2 * pi() * month(o_orderdate) / 12.0) AS month_cos,
       sin(2 * pi() * ((dayofyear(o_orderdate) - 1) % 91) / 91.0) AS quarter_sin, cos(2 * pi() * ((dayofyear(o_orderdate) - 1) % 91) / 91.0) AS quarter_cos FROM orders""",
    "day_sin day_cos month_sin month_cos quarter_sin quarter_cos",
)
def calendar_phases(spark, sf_dir):
    """Day of the week, month and 91-day phase on circles."""
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", S.iso_weekday(d).cast("bigint").alias("iso_day"), *S.daily_phases(d))


@query(
    """SELECT event_id, sin(2 * pi() * minute(ts) / 60.0) AS minute_sin, cos(2 * pi() * minute(ts) / 60.0) AS minute_cos, sin(2 * pi() * hour(ts) / 24.0) AS hour_sin,
       cos(2 * pi() * hour(ts) / 24.0) AS hour_cos, sin(2 * pi() * (isodow(ts) - 1) / 5.0) AS day_sin, cos(2 * pi() * (isodow(ts) - 1) / 5.0) AS day_cos FROM events""",
    "minute_sin minute_cos hour_sin hour_cos day_sin day_cos",
)
def minute_phases(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", *S.minute_phases(F.col("ts")))


_UP = S.SIC_UP_TO
_LADDER = "CASE " + " ".join(f"WHEN two <= {a} THEN {b}" for a, b in _UP) + f" ELSE {S.OTHER} END"
_NAMES = "[" + ", ".join(f"'{n}'" for n in S.SECTORS) + "]"


@query(f"SELECT p_partkey, {_LADDER} AS sector, ({_NAMES})[{_LADDER} + 1] AS sector_name, CAST({_LADDER} = 7 AS DOUBLE) AS is_consumer FROM (SELECT p_partkey, TRY_CAST(substr(lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0'), 1, 2) AS INT) AS two FROM part)")
def sic_sectors(spark, sf_dir):
    """Sector of a four-digit code by its first two digits."""
    code = F.lpad((F.col("p_partkey") % 10000).cast("string"), 4, "0")
    rows = table(spark, sf_dir, "part").select("p_partkey", S.sic_sector(code).alias("sector"))
    return rows.select("p_partkey", "sector", S.sector_name(F.col("sector")).alias("sector_name"), (F.col("sector") == 7).cast("double").alias("is_consumer"))


@query(
    f"""SELECT l_orderkey, l_linenumber, p + (0.01 + p * 0.0005) AS buy_at, p - (0.01 + p * 0.0005) AS sell_at, q * {S.CAT_PER_SHARE} AS buy_fee,
       q * {S.CAT_PER_SHARE} + ceil(e * {S.SEC_PER_DOLLAR} * 100) / 100 + least(ceil(q * {S.TAF_PER_SHARE} * 100) / 100, {S.TAF_CAP}) AS sell_fee
       FROM (SELECT l_orderkey, l_linenumber, CAST(l_extendedprice / l_quantity AS DOUBLE) AS p, CAST(l_quantity AS DOUBLE) AS q, CAST(l_extendedprice AS DOUBLE) AS e FROM lineitem)""",
    "buy_at sell_at buy_fee sell_fee", 8,
)
def execution_costs(spark, sf_dir):
    """Execution prices and regulatory fees of trades."""
    p, q, e = F.col("l_extendedprice") / F.col("l_quantity"), F.col("l_quantity"), F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", S.execution_price(p, "buy", 0.02, 0.0005).alias("buy_at"), S.execution_price(p, "sell", 0.02, 0.0005).alias("sell_at"),
        S.regulatory_fees("buy", q, e).alias("buy_fee"), S.regulatory_fees("sell", q, e).alias("sell_fee"),
    )


@query(
    "SELECT vec_id, exp(a) / (1 + exp(a) + exp(b)) AS w1, exp(b) / (1 + exp(a) + exp(b)) AS w2, 1 / (1 + exp(a) + exp(b)) AS cash FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b FROM embeddings)",
    "w1 w2 cash",
)
def softmax_weights(spark, sf_dir):
    """Portfolio weights of logits with a cash logit of 0."""
    two = F.transform(F.slice("embedding", 1, 2), lambda x: x.cast("double"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", S.softmax_weights(two).alias("w"))
    return rows.select("vec_id", F.get("w", F.lit(0)).alias("w1"), F.get("w", F.lit(1)).alias("w2"), (1 - F.get("w", F.lit(0)) - F.get("w", F.lit(1))).alias("cash"))


# ---- windows


@query(
    f"""{BARS} SELECT ticker, bar_date, CASE WHEN count(close) OVER w = 20 THEN avg(close) OVER w END AS mean, CASE WHEN count(close) OVER w = 20 THEN stddev_samp(close) OVER w END AS sd,
        CASE WHEN count(close) OVER w = 20 THEN stddev_pop(close) OVER w END AS sd_pop, CASE WHEN count(close) OVER w = 20 THEN sum(volume) OVER w END AS total
        FROM bars WINDOW w AS ({P} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""",
    "mean sd sd_pop total", 5,
)
def rolling_statistics(spark, sf_dir):
    """Moving mean, deviations and sum of the 20 rows before."""
    w = W.ordered("ticker", "bar_date")
    c = F.col("close")
    return daily_bars(spark, sf_dir).select(
        "ticker", "bar_date", W.rolling("avg", c, w, 20, 1).alias("mean"), W.rolling("stddev_samp", c, w, 20, 1).alias("sd"), W.rolling("stddev_pop", c, w, 20, 1).alias("sd_pop"), W.rolling("sum", F.col("volume"), w, 20, 1).alias("total")
    )


@query(
    f"""{BARS} SELECT ticker, bar_date, CASE WHEN count(close) OVER w = 60 THEN quantile_cont(close, 0.01) OVER w END AS q01, CASE WHEN count(close) OVER w = 60 THEN quantile_cont(close, 0.99) OVER w END AS q99
        FROM bars WINDOW w AS ({P} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)""",
    "q01 q99",
)
def rolling_quantiles(spark, sf_dir):
    bars = daily_bars(spark, sf_dir).select("ticker", "bar_date", "close")
    return OS.rolling_order(bars, ["close"], 60, {"q01": 0.01, "q99": 0.99}, lag=1).select("ticker", "bar_date", F.col("close_q01").alias("q01"), F.col("close_q99").alias("q99"))


@query(
    f"""{BARS} SELECT ticker, bar_date, CASE WHEN count(close) OVER w = 60 THEN list_sort(list(close) OVER w)[31] END AS mid
        FROM bars WINDOW w AS ({P} ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)""",
    "mid",
)
def rolling_nearest_rank(spark, sf_dir):
    """A rolling quantile that is one of the values: nearest rank, half up."""
    bars = daily_bars(spark, sf_dir).select("ticker", "bar_date", "close")
    return OS.rolling_order(bars, ["close"], 60, {"mid": 0.5}, mode="nearest").select("ticker", "bar_date", F.col("close_mid").alias("mid"))


@query(
    f"""{BARS} SELECT ticker, bar_date, CASE WHEN count(*) OVER w < 20 OR min(volume) OVER w = max(volume) OVER w OR min(close) OVER w = max(close) OVER w THEN 0.0
        ELSE coalesce(greatest(-1.0, least(1.0, corr(volume, close) OVER w)), 0.0) END AS r FROM bars WINDOW w AS ({P} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
    "r",
)
def rolling_correlation(spark, sf_dir):
    w = W.ordered("ticker", "bar_date")
    return daily_bars(spark, sf_dir).select("ticker", "bar_date", W.rolling_corr(F.col("volume"), F.col("close"), w, 20).alias("r"))


@query(
    f"""{BARS} SELECT ticker, bar_date, coalesce(close - lag(close, 5) OVER w, 0.0) AS diff_5, (max(close) OVER u - close) / max(close) OVER u AS drawdown, sum(volume) OVER u AS running_volume
        FROM bars WINDOW w AS ({P}), u AS ({P} ROWS UNBOUNDED PRECEDING)""",
    "diff_5 drawdown running_volume",
)
def cumulative_windows(spark, sf_dir):
    """Differences, drawdown from the running maximum, running sum."""
    w = W.ordered("ticker", "bar_date")
    return daily_bars(spark, sf_dir).select("ticker", "bar_date", W.diff(F.col("close"), 5, w).alias("diff_5"), W.drawdown(F.col("close"), w).alias("drawdown"), F.sum("volume").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("running_volume"))


@query(
    f"""{HOURS} SELECT ticker, bucket, product(1 + (close / open - 1) / 10000) OVER (PARTITION BY ticker ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS growth FROM bars""",
    "growth",
)
def running_growth(spark, sf_dir):
    w = W.ordered("ticker", "bucket")
    return hourly_bars(spark, sf_dir).select("ticker", "bucket", W.running_product(1 + (F.col("close") / F.col("open") - 1) / 10000, w).alias("growth"))


@query(
    f"""{BARS}, marked AS (SELECT *, sum(CASE WHEN abs(move) > 0.2 THEN 1 ELSE 0 END) OVER ({P} ROWS UNBOUNDED PRECEDING) AS run
        FROM (SELECT ticker, bar_date, close / lag(close) OVER ({P}) - 1 AS move FROM bars))
        SELECT ticker, bar_date, row_number() OVER (PARTITION BY ticker, run ORDER BY bar_date) - 1 AS since_change FROM marked"""
)
def since_significant_move(spark, sf_dir):
    """Rows since the last move of more than 20 %."""
    w = W.ordered("ticker", "bar_date")
    moved = daily_bars(spark, sf_dir).withColumn("move", F.col("close") / F.lag("close").over(w) - 1)
    out = W.since_change(moved, F.abs("move") > 0.2, w, ["ticker"], ["bar_date"])
    return out.select("ticker", "bar_date", F.col("since_change").cast("bigint").alias("since_change"))


@query(
    f"""WITH {TICKS_SQL} SELECT ticker, id, row_number() OVER s - 1 AS since_open, count(*) OVER d - row_number() OVER s AS to_close FROM ticks
        WINDOW s AS (PARTITION BY ticker, ts::DATE ORDER BY ts, id), d AS (PARTITION BY ticker, ts::DATE)"""
)
def session_positions(spark, sf_dir):
    """Place of a tick in its day, from either end."""
    t = ticks(spark, sf_dir).withColumn("day", F.to_date("ts"))
    return W.positions(t, ["ticker", "day"], ["ts", "id"]).select("ticker", "id", F.col("since_open").cast("bigint").alias("since_open"), F.col("to_close").cast("bigint").alias("to_close"))


@query(
    f"""{HOURS} SELECT ticker, bucket, list_aggregate(o, 'sum') AS total, len(o) AS n, o[1] AS oldest FROM (SELECT ticker, bucket, list_concat(list_transform(range(8 - len(g)), lambda x: 0.0), g) AS o
        FROM (SELECT ticker, bucket, list(CAST(close AS DOUBLE)) OVER (PARTITION BY ticker ORDER BY bucket ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS g FROM bars))""",
    "total oldest",
)
def padded_observations(spark, sf_dir):
    """The last eight closes as an array, zeros in front."""
    o = W.observation(F.col("close"), W.ordered("ticker", "bucket"), 8)
    rows = hourly_bars(spark, sf_dir).select("ticker", "bucket", o.alias("o"))
    return rows.select("ticker", "bucket", F.aggregate("o", F.lit(0.0), lambda a, x: a + x).alias("total"), F.size("o").cast("bigint").alias("n"), F.get("o", F.lit(0)).alias("oldest"))


# ---- life of a ticker


@query(
    f"""WITH {WEEKDAY_BARS}, {CALENDAR_SQL}, g AS (SELECT b.ticker, b.bar_date, c.idx, c.idx - lag(c.idx) OVER (PARTITION BY b.ticker ORDER BY b.bar_date) - 1 AS gap FROM bars b LEFT JOIN calendar c USING (bar_date)),
        s AS (SELECT *, sum(CASE WHEN coalesce(gap >= 10, true) THEN 1 ELSE 0 END) OVER (PARTITION BY ticker ORDER BY bar_date ROWS UNBOUNDED PRECEDING) - 1 AS segment FROM g),
        n AS (SELECT *, max(segment) OVER (PARTITION BY ticker) AS newest FROM s)
        SELECT ticker AS source_ticker, CASE WHEN segment = newest THEN ticker ELSE ticker || '.' || CAST(segment + 1 AS VARCHAR) END AS ticker, CAST(segment AS BIGINT) AS segment, bar_date FROM n"""
)
def lifecycle_segments(spark, sf_dir):
    """Segments of a ticker's life, cut at gaps of ten sessions."""
    bars = weekday_bars(spark, sf_dir)
    return L.segments(bars, weekdays(bars)).select("source_ticker", "ticker", F.col("segment").cast("bigint").alias("segment"), "bar_date")


@query(
    f"""WITH {WEEKDAY_BARS}, {CALENDAR_SQL}, g AS (SELECT b.ticker, c.idx - lag(c.idx) OVER (PARTITION BY b.ticker ORDER BY b.bar_date) - 1 AS gap FROM bars b JOIN calendar c USING (bar_date))
        SELECT ticker, count(*) AS n_gaps, CAST(max(gap) AS BIGINT) AS longest FROM g WHERE gap BETWEEN 5 AND 9 GROUP BY ticker ORDER BY n_gaps DESC, longest DESC, ticker LIMIT 20"""
)
def suspicious_gaps(spark, sf_dir):
    """The twenty tickers with most gaps of five to nine sessions (a top-k report)."""
    bars = weekday_bars(spark, sf_dir)
    return L.suspicious_gaps(bars, weekdays(bars))


_DENSE = f"""WITH {WEEKDAY_BARS}, {CALENDAR_SQL}, life AS (SELECT ticker, min(bar_date) AS lo, max(bar_date) AS hi FROM bars GROUP BY ticker),
        grid AS (SELECT ticker, c.bar_date FROM life JOIN calendar c ON c.bar_date BETWEEN lo AND hi),
        f AS (SELECT g.ticker, g.bar_date, b.open, b.high, b.low, last_value(b.close IGNORE NULLS) OVER (PARTITION BY g.ticker ORDER BY g.bar_date ROWS UNBOUNDED PRECEDING) AS close,
              coalesce(b.volume, 0) AS volume, coalesce(b.transactions, 0) AS transactions, b.close IS NULL AS filled FROM grid g LEFT JOIN bars b USING (ticker, bar_date))"""


@query(f"{_DENSE} SELECT ticker, bar_date, coalesce(open, close) AS open, coalesce(high, close) AS high, coalesce(low, close) AS low, close, volume, transactions, filled FROM f", "open high low close volume")
def densified_bars(spark, sf_dir):
    """Bars on every session of a ticker's life."""
    bars = weekday_bars(spark, sf_dir)
    return L.densified(bars, weekdays(bars)).select("ticker", "bar_date", "open", "high", "low", "close", "volume", "transactions", "filled")


@query(
    """SELECT o_orderkey, o_custkey, o_orderdate, (SELECT arg_min(n.o_totalprice, (n.o_orderdate, n.o_totalprice)) FROM orders n WHERE n.o_custkey = o.o_custkey AND n.o_orderdate > o.o_orderdate) AS next_price FROM orders o""",
    "next_price",
)
def asof_next_order(spark, sf_dir):
    """Each order with the price of the customer's first order strictly after it."""
    o = table(spark, sf_dir, "orders")
    left = o.select("o_orderkey", "o_custkey", "o_orderdate")
    right = o.select("o_custkey", F.col("o_orderdate").alias("at"), F.col("o_totalprice").alias("next_price"))
    return J.asof_next(left, right, ["o_custkey"], "o_orderdate", "at", ["next_price"])


_SPLITS = """splits AS (SELECT ticker, bar_date AS execution_date, CASE WHEN CAST(ticker AS INT) % 2 = 0 THEN 0.5 ELSE 0.25 END AS factor FROM (
        SELECT ticker, bar_date, row_number() OVER (PARTITION BY ticker ORDER BY bar_date) AS i FROM bars) WHERE i % 97 = 50)"""


def _splits(bars: DataFrame) -> DataFrame:
    i = F.row_number().over(W.ordered("ticker", "bar_date"))
    factor = F.when(F.col("ticker").cast("int") % 2 == 0, 0.5).otherwise(0.25)
    return bars.withColumn("i", i).where(F.col("i") % 97 == 50).select("ticker", F.col("bar_date").alias("execution_date"), factor.alias("factor"))


@query(
    f"""{BARS}, {_SPLITS}, f AS (SELECT b.*, coalesce((SELECT arg_min(s.factor, s.execution_date) FROM splits s WHERE s.ticker = b.ticker AND s.execution_date > b.bar_date), 1.0) AS k FROM bars b)
        SELECT ticker, bar_date, close * k AS close, volume / k AS volume FROM f""",
    "close volume", 4,
)
def split_adjusted_bars(spark, sf_dir):
    """Prices adjusted by the first split after them."""
    bars = daily_bars(spark, sf_dir)
    return L.split_adjusted(bars, _splits(bars)).select("ticker", "bar_date", "close", "volume")


_SEGMENTED = f"""g AS (SELECT b.*, c.idx - lag(c.idx) OVER (PARTITION BY b.ticker ORDER BY b.bar_date) - 1 AS gap FROM bars b LEFT JOIN calendar c USING (bar_date)),
        s AS (SELECT *, sum(CASE WHEN coalesce(gap >= 10, true) THEN 1 ELSE 0 END) OVER (PARTITION BY ticker ORDER BY bar_date ROWS UNBOUNDED PRECEDING) - 1 AS segment FROM g),
        n AS (SELECT *, max(segment) OVER (PARTITION BY ticker) AS newest, max(bar_date) OVER (PARTITION BY ticker, segment) AS last FROM s)"""
_NAMED = "CASE WHEN segment = newest THEN ticker ELSE ticker || '.' || CAST(segment + 1 AS VARCHAR) END"


@query(
    f"""WITH {WEEKDAY_BARS}, {CALENDAR_SQL}, {_SPLITS}, {_SEGMENTED},
        f AS (SELECT n.*, (SELECT arg_min(struct_pack(k := x.factor, d := x.execution_date), x.execution_date) FROM splits x WHERE x.ticker = n.ticker AND x.execution_date > n.bar_date) AS next FROM n)
        SELECT {_NAMED} AS ticker, bar_date, close * coalesce(CASE WHEN next.d <= last THEN next.k END, 1.0) AS close, volume / coalesce(CASE WHEN next.d <= last THEN next.k END, 1.0) AS volume FROM f""",
    "close volume", 4,
)
def segment_split_adjusted_bars(spark, sf_dir):
    """Prices adjusted by the first split after them within their segment."""
    bars = weekday_bars(spark, sf_dir)
    return L.segment_split_adjusted(L.segments(bars, weekdays(bars)), _splits(bars)).select("ticker", "bar_date", "close", "volume")


@query(
    f"""{BARS}, {_SPLITS}, m AS (SELECT ticker, bar_date, close, abs(close / lag(close) OVER ({P}) - 1) AS move FROM bars),
        n AS (SELECT m.*, s.execution_date FROM m JOIN splits s ON m.ticker = s.ticker AND abs(date_diff('day', m.bar_date, s.execution_date)) <= 5)
        SELECT ticker, execution_date, count(*) AS n_bars, count(*) FILTER (move > 0.2) AS n_jumps,
               avg(close) FILTER (bar_date >= execution_date) / avg(close) FILTER (bar_date < execution_date) - 1 AS mean_shift,
               coalesce(count(*) FILTER (move > 0.2) > 0 OR abs(avg(close) FILTER (bar_date >= execution_date) / avg(close) FILTER (bar_date < execution_date) - 1) > 0.15, false) AS suspect
        FROM n GROUP BY ALL""",
    "mean_shift",
)
def verified_splits(spark, sf_dir):
    """Splits against the bars around them: jumps, and a shift of the mean."""
    bars = daily_bars(spark, sf_dir)
    return L.verified_splits(bars, _splits(bars).drop("factor"))


@query(
    """WITH r AS (SELECT o_custkey AS current_ticker, o_custkey + 1 AS previous_ticker, min(o_orderdate)::DATE AS change_date FROM orders WHERE o_custkey % 7 = 0 GROUP BY o_custkey)
       SELECT * FROM r WHERE EXISTS (SELECT 1 FROM orders s WHERE s.o_custkey = r.previous_ticker AND s.o_orderdate::DATE > r.change_date)"""
)
def suspect_renames(spark, sf_dir):
    """Renames contradicted by later events of the old name: a semi join with an inequality."""
    o = table(spark, sf_dir, "orders")
    renames = o.where(F.col("o_custkey") % 7 == 0).groupBy(F.col("o_custkey").alias("current_ticker")).agg((F.first("o_custkey") + 1).alias("previous_ticker"), F.to_date(F.min("o_orderdate")).alias("change_date"))
    splits = o.select(F.col("o_custkey").alias("ticker"), F.to_date("o_orderdate").alias("execution_date"))
    return L.suspect_renames(renames, splits)


_RENAMES = "renames AS (SELECT * FROM (VALUES ('1', '2', DATE '1997-06-01'), ('3', '4', DATE '1996-03-01'), ('3', '5', DATE '1998-01-01')) v(current_ticker, previous_ticker, change_date))"


@query(
    f"""{BARS}, {_RENAMES}, last AS (SELECT current_ticker, max(change_date) AS since FROM renames GROUP BY current_ticker),
        both_ AS (SELECT b.*, 0 AS rank FROM bars b LEFT JOIN last ON b.ticker = current_ticker WHERE since IS NULL OR bar_date >= since
                  UNION ALL SELECT r.current_ticker, b.* EXCLUDE (ticker), 1 FROM bars b JOIN renames r ON b.ticker = r.previous_ticker WHERE bar_date < change_date)
        SELECT ticker, bar_date, min(rank) AS rank, count(*) > 1 AS several FROM both_ GROUP BY ALL"""
)
def stitched_tickers(spark, sf_dir):
    """Bars of renamed tickers under their current names."""
    bars = daily_bars(spark, sf_dir)
    days = [("1", "2", "1997-06-01"), ("3", "4", "1996-03-01"), ("3", "5", "1998-01-01")]
    renames = spark.createDataFrame(days, "current_ticker string, previous_ticker string, change_date string").withColumn("change_date", F.to_date("change_date"))
    out = L.stitched(bars.withColumn("source", F.col("ticker")), renames)
    every = bars.join(renames, bars["ticker"] == renames["previous_ticker"]).where("bar_date < change_date").groupBy(F.col("current_ticker").alias("ticker"), "bar_date").agg(F.count("*").alias("olds"))
    got = out.join(F.broadcast(every), ["ticker", "bar_date"], "left")  # the bars of three tickers at most
    own = F.col("source") == F.col("ticker")
    return got.select("ticker", "bar_date", F.when(own, 0).otherwise(1).alias("rank"), (F.coalesce("olds", F.lit(0)) + own.cast("int") > 1).alias("several"))


@query(f"{BARS} SELECT ticker, avg(close * volume) AS avg_value, median(close) AS median_close, count(*) AS n_days FROM bars GROUP BY ticker HAVING avg(close * volume) >= 20000 AND median(close) >= 900 AND count(*) >= 100", "avg_value median_close", 3)
def liquid_tickers(spark, sf_dir):
    return L.liquid(daily_bars(spark, sf_dir), 20_000, 900, 100)


@query(
    f"""{BARS}, s AS (SELECT avg(close * volume) >= 38000 AS a, median(close) >= 1350 AS b, count(*) >= 100 AS c FROM bars GROUP BY ticker)
        SELECT count(*) AS n_all, count(*) FILTER (a) AS n_value, count(*) FILTER (a AND b) AS n_price, count(*) FILTER (a AND b AND c) AS n_days FROM s"""
)
def liquidity_funnel(spark, sf_dir):
    return L.gate_funnel(L.liquidity(daily_bars(spark, sf_dir)), 38_000, 1_350, 100)


@query(f"{BARS} SELECT ticker, bar_date, close FROM bars QUALIFY count(*) OVER (PARTITION BY ticker) >= 564", "close")
def long_histories(spark, sf_dir):
    return L.long_enough(daily_bars(spark, sf_dir)).select("ticker", "bar_date", "close")


@query(
    f"""{BARS}, r AS (SELECT ticker, bar_date, ln(close) - ln(lag(close) OVER ({P})) AS log_return FROM bars)
        SELECT ticker, bar_date, log_return, CASE WHEN abs(log_return) >= ln(2) THEN 'critical' ELSE 'suspicious' END AS severity FROM r WHERE abs(log_return) >= ln(1.5)""",
    "log_return",
)
def discontinuities(spark, sf_dir):
    return L.discontinuities(daily_bars(spark, sf_dir))


@query(
    f"""{BARS}, r AS (SELECT ticker, abs(ln(close) - ln(lag(close) OVER ({P}))) AS m FROM bars)
        SELECT ticker, count(*) AS n, count(*) FILTER (m >= ln(2)) AS n_critical, max(m) AS largest FROM r WHERE m >= ln(1.5) GROUP BY ticker ORDER BY n_critical DESC, n DESC, largest DESC, ticker LIMIT 30""",
    "largest",
)
def worst_tickers(spark, sf_dir):
    """The thirty tickers with most discontinuities (a top-k report)."""
    return L.worst_tickers(L.discontinuities(daily_bars(spark, sf_dir)))


@query(
    f"""{HOURS}, r AS (SELECT ticker, max(abs(ln(close) - ln(p))) AS worst FROM (SELECT ticker, close, lag(close) OVER (PARTITION BY ticker ORDER BY bucket) AS p FROM bars) GROUP BY ticker)
        SELECT b.ticker, b.bucket AS bar_date FROM bars b JOIN r USING (ticker) WHERE coalesce(worst < 6, true)"""
)
def continuous_tickers(spark, sf_dir):
    """Tickers without a jump of the given size."""
    return L.continuous(hourly_bars(spark, sf_dir).withColumnRenamed("bucket", "bar_date"), 6.0).select("ticker", "bar_date")


# ---- joins and reshaping


@query(f"{BARS} SELECT b.ticker, b.bar_date, b.close / s.close AS against FROM bars b JOIN bars s ON s.bar_date = b.bar_date AND s.ticker = '1'", "against")
def benchmark_ratio(spark, sf_dir):
    """Each bar against the benchmark's on the same date."""
    out = J.with_benchmark(daily_bars(spark, sf_dir), F.col("ticker") == "1", "bar_date", ["close"])
    return out.where("benchmark_close is not null").select("ticker", "bar_date", (F.col("close") / F.col("benchmark_close")).alias("against"))


@query(f"{HOURS} SELECT ticker, bucket, close FROM bars WHERE bucket IN (SELECT bucket FROM bars GROUP BY bucket HAVING count(DISTINCT ticker) = (SELECT count(DISTINCT ticker) FROM bars))")
def complete_hours(spark, sf_dir):
    """Hours in which every ticker traded: an inner chain without the chain."""
    return J.complete_keys(hourly_bars(spark, sf_dir), "ticker", "bucket").select("ticker", "bucket", "close")


@query("SELECT l_orderkey, l_linenumber, feature, value FROM (SELECT l_orderkey, l_linenumber, l_quantity AS quantity, l_discount AS discount, l_tax AS tax FROM lineitem) UNPIVOT (value FOR feature IN (quantity, discount, tax))")
def unpivoted(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    return A.long_form(rows, ["l_orderkey", "l_linenumber"], ["quantity", "discount", "tax"])


@query(f"{HOURS} SELECT bucket, max(close) FILTER (ticker = 'click') AS click, max(close) FILTER (ticker = 'view') AS view, max(close) FILTER (ticker = 'purchase') AS purchase FROM bars GROUP BY bucket")
def basket_wide(spark, sf_dir):
    """A small basket with a column per ticker."""
    return hourly_bars(spark, sf_dir).groupBy("bucket").pivot("ticker", ["click", "view", "purchase"]).agg(F.max("close"))


@query("SELECT o_custkey AS current_ticker, array_to_string(list(CAST(o_orderkey AS VARCHAR) ORDER BY o_orderdate, o_orderkey), ' ') AS previous FROM orders GROUP BY o_custkey")
def name_histories(spark, sf_dir):
    """Names of a ticker in order of change: a group as a list of structs."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("current_ticker"), F.struct("o_orderdate", "o_orderkey").alias("x"))
    return o.groupBy("current_ticker").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["o_orderkey"].cast("string")), " ").alias("previous"))


@query(
    """SELECT current_ticker, previous_ticker, change_date FROM (SELECT o_custkey AS current_ticker, o_orderdate AS change_date, lead(CAST(o_orderkey AS VARCHAR)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR)) AS previous_ticker FROM orders) WHERE previous_ticker IS NOT NULL"""
)
def rename_pairs(spark, sf_dir):
    """Consecutive names out of a list of events per ticker."""
    from tickloom.sources.bars import rename_pairs as pairs

    o = table(spark, sf_dir, "orders")
    events = o.groupBy(F.col("o_custkey").alias("current_ticker")).agg(F.collect_list(F.struct(F.col("o_orderdate").alias("date"), F.col("o_orderkey").cast("string").alias("name"))).alias("names"))
    return pairs(events)


# ---- features and normalisation

_X = "greatest(high - low, 1e-8)"


@query(
    f"""{BARS} SELECT ticker, bar_date, (high + low + close) / 3 AS vwap, coalesce(ln(open / (lag(close) OVER w + 1e-8)), 0.0) AS overnight_gap, ln(close / (open + 1e-8)) AS intraday_return,
        (high - greatest(open, close)) / {_X} AS upper_wick_ratio, (least(open, close) - low) / {_X} AS lower_wick_ratio FROM bars WINDOW w AS ({P})""",
    "vwap overnight_gap intraday_return upper_wick_ratio lower_wick_ratio",
)
def candle_features(spark, sf_dir):
    made = FT.candles(W.ordered("ticker", "bar_date"))
    return daily_bars(spark, sf_dir).select("ticker", "bar_date", *[c.alias(n) for n, c in made.items()])


@query(
    f"""{BARS} SELECT ticker, bar_date, ln(close / lag(close, 5) OVER w) AS log_return_5, ln(close / lag(close, 20) OVER w) AS log_return_20, ln(close / lag(close, 60) OVER w) AS log_return_60,
        ln(close / lag(close, 120) OVER w) AS log_return_120, ln(close / lag(close, 252) OVER w) AS log_return_252,
        CASE WHEN lag(close, 10) OVER w IS NOT NULL THEN greatest(-3.0, least(3.0, 100 * (close / lag(close, 10) OVER w - 1))) END AS roc_10, close / lag(close, 15) OVER w - 1 AS cum_return_15 FROM bars WINDOW w AS ({P})""",
    "log_return_5 log_return_20 log_return_60 log_return_120 log_return_252 roc_10 cum_return_15",
)
def return_features(spark, sf_dir):
    w = W.ordered("ticker", "bar_date")
    return daily_bars(spark, sf_dir).select("ticker", "bar_date", *[c.alias(n) for n, c in (FT.returns(w) | FT.momentum(w)).items()])


def _sd(n: int) -> str:
    return f"CASE WHEN count(close) OVER w{n} = {n} THEN stddev_pop(close) OVER w{n} END"


@query(
    f"""{BARS} SELECT ticker, bar_date, ln(({_sd(5)} + 1e-8) / ({_sd(20)} + 1e-8)) AS volatility_5_20_ratio, ln(({_sd(20)} + 1e-8) / ({_sd(60)} + 1e-8)) AS volatility_20_60_ratio,
        ln(({_sd(60)} + 1e-8) / ({_sd(252)} + 1e-8)) AS volatility_60_252_ratio, ln(1 + {_sd(15)}) AS volatility_15 FROM bars WINDOW """
    + ", ".join(f"w{n} AS ({P} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (5, 15, 20, 60, 252)),
    "volatility_5_20_ratio volatility_20_60_ratio volatility_60_252_ratio volatility_15", 4,
)
def volatility_features(spark, sf_dir):
    return FT.with_volatility(daily_bars(spark, sf_dir).select("ticker", "bar_date", "close"), counted=trades(spark, sf_dir)).drop("close")


@query(
    f"""{BARS}, f AS (SELECT ticker, bar_date, close, volume, (high + low + close) / 3 AS tp FROM bars)
        SELECT ticker, bar_date, ln(1 + volume) AS volume_log, (close - tp) / (tp + 1e-8) AS price_vwap_distance, sum(coalesce(sign(close - p), 0) * volume) OVER ({P} ROWS UNBOUNDED PRECEDING) AS obv
        FROM (SELECT *, lag(close) OVER ({P}) AS p FROM f)""",
    "volume_log price_vwap_distance obv",
)
def volume_features(spark, sf_dir):
    w = W.ordered("ticker", "bar_date")
    made = FT.volume(w) | {"obv": FT.oscillators(w)["obv"]}
    return daily_bars(spark, sf_dir).select("ticker", "bar_date", *[made[n].alias(n) for n in ("volume_log", "price_vwap_distance", "obv")])


@query(
    f"""{BARS}, t AS (SELECT *, (high + low + close) / 3 AS tp FROM bars), d AS (SELECT *, tp - lag(tp) OVER ({P}) AS rise FROM t),
        f AS (SELECT ticker, bar_date, CASE WHEN rise > 0 THEN tp * volume WHEN rise IS NOT NULL THEN 0 END AS i, CASE WHEN rise < 0 THEN tp * volume WHEN rise IS NOT NULL THEN 0 END AS o FROM d)
        SELECT ticker, bar_date, CASE WHEN count(i) OVER w = 14 THEN 100 * sum(i) OVER w / nullif(sum(i) OVER w + sum(o) OVER w, 0) END AS mfi FROM f WINDOW w AS ({P} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)""",
    "mfi",
)
def money_flow_index(spark, sf_dir):
    return FT.money_flow(daily_bars(spark, sf_dir)).select("ticker", "bar_date", "mfi")


@query(
    f"""WITH {TICKS_SQL}, d AS (SELECT *, ts::DATE AS day, 1.0 + id % 5 AS v FROM ticks)
        SELECT ticker, id, sum(price * v) OVER w / sum(v) OVER w AS vwap FROM d WINDOW w AS (PARTITION BY ticker, day ORDER BY ts ROWS UNBOUNDED PRECEDING)""",
    "vwap", 9,
)
def session_vwap(spark, sf_dir):
    """Running volume-weighted price of the day."""
    t = ticks(spark, sf_dir).withColumn("day", F.to_date("ts")).withColumn("volume", 1.0 + F.col("id") % 5)
    bars = t.withColumns({c: F.col("price") for c in ("high", "low", "close")})
    return FT.session_vwap(bars, "day", "ts").select("ticker", "id", "vwap")


@query(
    f"""{BARS} SELECT ticker, bar_date, lag(close, 1) OVER w AS close_lag_1, lag(close, 10) OVER w AS close_lag_10, CASE WHEN count(close) OVER w5 = 5 THEN avg(close) OVER w5 END AS close_mean_5,
        CASE WHEN count(close) OVER w30 = 30 THEN stddev_samp(close) OVER w30 END AS close_std_30, close - lag(close) OVER w AS close_diff, close / lag(close) OVER w - 1 AS close_pct
        FROM bars WINDOW w AS ({P}), w5 AS ({P} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), w30 AS ({P} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""",
    "close_lag_1 close_lag_10 close_mean_5 close_std_30 close_diff close_pct", 5,
)
def lag_pack(spark, sf_dir):
    made = FT.lag_pack(["close"], W.ordered("ticker", "bar_date"))
    names = ("close_lag_1", "close_lag_10", "close_mean_5", "close_std_30", "close_diff", "close_pct")
    return daily_bars(spark, sf_dir).select("ticker", "bar_date", *[made[n].alias(n) for n in names])


def _z(x: str, over: str, n: int) -> str:
    held = f"greatest(quantile_cont({x}, 0.01) OVER {over}, least(quantile_cont({x}, 0.99) OVER {over}, {x}))"
    return f"CASE WHEN count({x}) OVER {over} < {n} THEN 0.0 WHEN {x} IS NULL THEN NULL ELSE tanh(({held} - avg({x}) OVER {over}) / greatest(stddev_samp({x}) OVER {over}, 1e-8)) END"


@query(f"{BARS} SELECT ticker, bar_date, {_z('close', 'w', 60)} AS close, {_z('volume', 'w', 60)} AS volume FROM bars WINDOW w AS ({P} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)", "close volume")
def rolling_z_scores(spark, sf_dir):
    """Causal rolling z-scores of two columns in one window."""
    return N.rolling_normalised(daily_bars(spark, sf_dir).select("ticker", "bar_date", "close", "volume"), ["close", "volume"], n=60)


#: 22 columns of a bar, as both engines read them.
BAR_FEATURES = {
    "close": "close", "open": "open", "high": "high", "low": "low", "volume": "CAST(volume AS DOUBLE)", "trades": "CAST(transactions AS DOUBLE)", "log_close": "ln(close)", "log_volume": "ln(1 + volume)",
    "body": "close - open", "span": "high - low", "middle": "(high + low) / 2", "typical": "(high + low + close) / 3", "weighted": "(high + low + 2 * close) / 4", "upper": "high - greatest(open, close)", "lower": "least(open, close) - low",
    "day_return": "ln(close / open)", "reach": "ln(high / low)", "up": "ln(high / open)", "down": "ln(low / open)", "trade_size": "volume / greatest(transactions, 1)", "turnover": "close * volume", "log_turnover": "ln(1 + close * volume)",
}


@query(
    f"""{BARS}, f AS (SELECT ticker, bar_date, {', '.join(f'{e} AS {n}' for n, e in BAR_FEATURES.items())} FROM bars)
        SELECT ticker, bar_date, {', '.join(f"{_z(n, 'w', 252)} AS {n}" for n in BAR_FEATURES)} FROM f WINDOW w AS ({P} ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING)""",
    " ".join(BAR_FEATURES), 5,
)
def rolling_z_features(spark, sf_dir):
    """22 columns against their last 252 rows, in one pass over the rows."""
    features = daily_bars(spark, sf_dir).selectExpr("ticker", "bar_date", *[f"{e} AS {n}" for n, e in BAR_FEATURES.items()])
    return OS.rolling_scores(features, list(BAR_FEATURES), counted=trades(spark, sf_dir))


@query(
    f"""{BARS}, z AS (SELECT ticker, bar_date, {_z('close', 'w', 60)} AS z FROM bars WINDOW w AS ({P} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))
        SELECT ticker, bar_date, coalesce(z - lag(z, 20) OVER w, 0.0) AS z_delta_20, coalesce(z - lag(z, 60) OVER w, 0.0) AS z_delta_60 FROM z WINDOW w AS ({P})""",
    "z_delta_20 z_delta_60",
)
def level_deltas(spark, sf_dir):
    z = N.rolling_normalised(daily_bars(spark, sf_dir).select("ticker", "bar_date", F.col("close").alias("z")), ["z"], n=60)
    return N.deltas(z, {"z": [20, 60]}).select("ticker", "bar_date", "z_delta_20", "z_delta_60")


def _cs(x: str, by: str) -> str:
    return f"tanh(({x} - avg({x}) OVER {by}) / CASE WHEN stddev_pop({x}) OVER {by} < 1e-8 THEN 1.0 ELSE stddev_pop({x}) OVER {by} END)"


@query(
    f"""{BARS}, r AS (SELECT ticker, bar_date, ln(close / open) AS x, CAST(ticker AS INT) % 4 AS sector FROM bars), n AS (SELECT sector, count(DISTINCT ticker) AS k FROM r GROUP BY sector)
        SELECT ticker, bar_date, {_cs('x', 'd')} AS x_cs_zscore, CASE WHEN k >= 2 THEN {_cs('x', 's')} ELSE 0.0 END AS x_sector_zscore
        FROM r JOIN n USING (sector) WINDOW d AS (PARTITION BY bar_date), s AS (PARTITION BY bar_date, sector)""",
    "x_cs_zscore x_sector_zscore",
)
def cross_section_scores(spark, sf_dir):
    """z-scores of a date's rows, overall and within sectors."""
    r = daily_bars(spark, sf_dir).select("ticker", "bar_date", F.ln(F.col("close") / F.col("open")).alias("x"), (F.col("ticker").cast("int") % 4).alias("sector"))
    return N.cross_section(r, ["x"], sector="sector").select("ticker", "bar_date", "x_cs_zscore", "x_sector_zscore")


@query(
    f"""{BARS}, s AS (SELECT avg(close) AS m, stddev_pop(close) AS d FROM bars WHERE year(bar_date) < 1997)
        SELECT ticker, bar_date, greatest(-5.0, least(5.0, (close - m) / CASE WHEN d > 0 THEN d ELSE 1.0 END)) AS close FROM bars, s""",
    "close",
)
def train_fitted_scaler(spark, sf_dir):
    bars = daily_bars(spark, sf_dir).select("ticker", "bar_date", "close")
    return N.fitted_scaler(bars, ["close"], F.year("bar_date") < 1997)


# ---- regime


@query(
    f"""{BARS}, r AS (SELECT ticker, bar_date, ln(close / lag(close) OVER ({P})) AS r FROM bars),
        s AS (SELECT bar_date, """
    + ", ".join(f"CASE WHEN count(r) OVER w{n} = {n} THEN sum(r) OVER w{n} END AS s{n}" for n in (5, 20, 60, 200))
    + " FROM r WINDOW "
    + ", ".join(f"w{n} AS ({P} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (5, 20, 60, 200))
    + ") SELECT bar_date, "
    + ", ".join(f"avg(CASE WHEN s{n} > 0 THEN 1.0 WHEN s{n} IS NOT NULL THEN 0.0 END) AS breadth_{n}d" for n in (5, 20, 60, 200))
    + " FROM s GROUP BY bar_date",
    "breadth_5d breadth_20d breadth_60d breadth_200d",
)
def market_breadth(spark, sf_dir):
    """Share of tickers that rose over n days."""
    bars = daily_bars(spark, sf_dir)
    r = F.ln(F.col("close") / F.lag("close").over(W.ordered("ticker", "bar_date")))
    return R.breadth(bars.select("ticker", "bar_date", r.alias("r")), "r", counted=trades(spark, sf_dir))


_LEGS = "legs AS (SELECT a.bar_date, ln(a.close / (b.close + 1e-8)) AS x FROM bars a JOIN bars b USING (bar_date) WHERE a.ticker = '1' AND b.ticker = '2')"


@query(
    f"""{BARS}, {_LEGS} SELECT bar_date, m5 AS pair_ma5, m60 AS pair_ma60, coalesce(m60 - lag(m60, 20) OVER (ORDER BY bar_date), 0.0) AS pair_delta FROM (SELECT bar_date,
        CASE WHEN count(x) OVER a = 5 THEN avg(x) OVER a END AS m5, CASE WHEN count(x) OVER b = 60 THEN avg(x) OVER b END AS m60 FROM legs
        WINDOW a AS (ORDER BY bar_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), b AS (ORDER BY bar_date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))""",
    "pair_ma5 pair_ma60 pair_delta",
)
def ratio_regime(spark, sf_dir):
    """Log ratio of two tickers: averages and their change."""
    return R.ratio_regime(daily_bars(spark, sf_dir), "1", "2", "pair")


@query(
    f"""{BARS}, {_LEGS}, m AS (SELECT bar_date, CASE WHEN count(x) OVER a = 5 THEN avg(x) OVER a END AS t5, CASE WHEN count(x) OVER b = 20 THEN avg(x) OVER b END AS t20, CASE WHEN count(x) OVER c = 60 THEN avg(x) OVER c END AS t60 FROM legs
        WINDOW a AS (ORDER BY bar_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), b AS (ORDER BY bar_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), c AS (ORDER BY bar_date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))
        SELECT bar_date, {_z('t5', 'w', 40)} AS term_structure_5d, {_z('t20', 'w', 40)} AS term_structure_20d, {_z('t60', 'w', 40)} AS term_structure_60d FROM m WINDOW w AS (ORDER BY bar_date ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING)""",
    "term_structure_5d term_structure_20d term_structure_60d",
)
def term_structure(spark, sf_dir):
    """Averages of a log ratio against their own past."""
    return R.term_structure(daily_bars(spark, sf_dir), "1", "2", n=40)


@query(
    f"""{BARS}, r AS MATERIALIZED (SELECT ticker, bar_date, ln(close / lag(close) OVER ({P})) AS r FROM bars),
        s AS MATERIALIZED (SELECT ticker, bar_date, CASE WHEN count(r) OVER a = 5 THEN sum(r) OVER a END AS s5, CASE WHEN count(r) OVER b = 20 THEN sum(r) OVER b END AS s20 FROM r
              WINDOW a AS ({P} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), b AS ({P} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
        k AS MATERIALIZED (SELECT bar_date, s5, s20 FROM s WHERE ticker = '1'),
        d AS MATERIALIZED (SELECT s.ticker, s.bar_date, s.s5 - k.s5 AS rs_5d, s.s20 - k.s20 AS rs_20d FROM s LEFT JOIN k ON s.bar_date = k.bar_date)
        SELECT ticker, bar_date, {_z('rs_5d', 'w', 40)} AS rs_5d, {_z('rs_20d', 'w', 40)} AS rs_20d FROM d WINDOW w AS ({P} ROWS BETWEEN 40 PRECEDING AND 1 PRECEDING)""",
    "rs_5d rs_20d", 5,
)
def relative_strength(spark, sf_dir):
    """Sums of log returns less the benchmark's, against their own past."""
    r = F.ln(F.col("close") / F.lag("close").over(W.ordered("ticker", "bar_date")))
    return R.relative_strength(daily_bars(spark, sf_dir).select("ticker", "bar_date", r.alias("r")), "r", "1", (5, 20), n=40)


def _framed(kind: str, x: str, n: int, by: str = "") -> str:
    over = f"OVER ({by} ORDER BY bar_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {over} = {n} THEN {kind}({x}) {over} END"


def _deltas(columns: dict[str, tuple[int, ...]]) -> str:
    return ", ".join(f"coalesce({c} - lag({c}, {n}) OVER (ORDER BY bar_date), 0.0) AS {c}_delta_{n}" for c, ns in columns.items() for n in ns)


_SPANS, _TERMS, _ROTATIONS, _PAST = (3, 5, 10, 20), (3, 5, 10), (5, 20), 20
_PAIRS = {"curve": ("1", "2"), "credit": ("3", "4"), "size": ("5", "1"), "growth": ("6", "1")}
_REGIME = [f"breadth_{k}d" for k in _SPANS]
_REGIME_DELTAS = {f"breadth_{k}d": (1, 5, 20) for k in _SPANS[:-1]} | {f"breadth_{_SPANS[-1]}d": (20, 60)}
_TERM_DELTAS = {f"term_structure_{k}d": (1, 5, 20) for k in _TERMS}
_ROTATION = [f"rotation_{kind}_{k}" for kind in ("std", "range") for k in _ROTATIONS]
_ROTATION_DELTAS = [f"rotation_{kind}_{_ROTATIONS[-1]}_delta" for kind in ("std", "range")]
_RATIOS = [f"{p}_{x}" for p in _PAIRS for x in ("ma5", "ma60", "delta")]


def _regime_sql() -> str:
    part = "PARTITION BY ticker"
    past = f"w AS (ORDER BY bar_date ROWS BETWEEN {_PAST} PRECEDING AND 1 PRECEDING)"
    legs = lambda a, b: f"(SELECT x.bar_date, ln(x.close / (y.close + 1e-8)) AS x FROM bars x JOIN bars y USING (bar_date) WHERE x.ticker = '{a}' AND y.ticker = '{b}')"
    ctes = [
        f"r AS MATERIALIZED (SELECT ticker, bar_date, ln(close / lag(close) OVER ({P})) AS r FROM bars)",
        "s AS MATERIALIZED (SELECT bar_date, " + ", ".join(f"{_framed('sum', 'r', k, part)} AS s{k}" for k in _SPANS) + " FROM r)",
        "b AS MATERIALIZED (SELECT bar_date, " + ", ".join(f"avg(CAST(s{k} > 0 AS INT)) AS breadth_{k}d" for k in _SPANS) + " FROM s GROUP BY bar_date)",
        f"bd AS MATERIALIZED (SELECT *, {_deltas(_REGIME_DELTAS)} FROM b)",
        "t AS MATERIALIZED (SELECT bar_date, " + ", ".join(f"{_framed('avg', 'x', k)} AS t{k}" for k in _TERMS) + f" FROM {legs('1', '2')})",
        "tz AS MATERIALIZED (SELECT bar_date, " + ", ".join(f"{_z(f't{k}', 'w', _PAST)} AS term_structure_{k}d" for k in _TERMS) + f" FROM t WINDOW {past})",
        f"td AS MATERIALIZED (SELECT *, {_deltas(_TERM_DELTAS)} FROM tz)",
        "g AS MATERIALIZED (SELECT bar_date, " + ", ".join(f"ln(close / lag(close, {k}) OVER ({P})) AS r{k}" for k in _ROTATIONS) + " FROM bars WHERE CAST(ticker AS INT) BETWEEN 1 AND 11)",
        "h AS MATERIALIZED (SELECT bar_date, " + ", ".join(f"CASE WHEN count(r{k}) >= 2 THEN stddev_samp(r{k}) END AS s{k}, CASE WHEN count(r{k}) >= 2 THEN max(r{k}) - min(r{k}) END AS g{k}" for k in _ROTATIONS) + " FROM g GROUP BY bar_date)",
        "rz AS MATERIALIZED (SELECT bar_date, " + ", ".join(f"{_z(c + str(k), 'w', _PAST)} AS rotation_{kind}_{k}" for c, kind in (("s", "std"), ("g", "range")) for k in _ROTATIONS) + f" FROM h WINDOW {past})",
        "rd AS MATERIALIZED (SELECT *, " + ", ".join(f"coalesce({c.removesuffix('_delta')} - lag({c.removesuffix('_delta')}, 20) OVER (ORDER BY bar_date), 0.0) AS {c}" for c in _ROTATION_DELTAS) + " FROM rz)",
    ]
    for p, (a, b) in _PAIRS.items():
        ctes.append(f"m_{p} AS MATERIALIZED (SELECT bar_date, {_framed('avg', 'x', 5)} AS {p}_ma5, {_framed('avg', 'x', 60)} AS {p}_ma60 FROM {legs(a, b)})")
        ctes.append(f"d_{p} AS MATERIALIZED (SELECT *, coalesce({p}_ma60 - lag({p}_ma60, 20) OVER (ORDER BY bar_date), 0.0) AS {p}_delta FROM m_{p})")
    joins = "".join(f" LEFT JOIN {t} USING (bar_date)" for t in ("td", *(f"d_{p}" for p in _PAIRS), "rd"))
    return f"{BARS}, {', '.join(ctes)} SELECT * FROM bd{joins}"


@query(_regime_sql(), " ".join([*_REGIME, *(f"{c}_delta_{n}" for c, ns in (_REGIME_DELTAS | _TERM_DELTAS).items() for n in ns), *_TERM_DELTAS, *_RATIOS, *_ROTATION, *_ROTATION_DELTAS]), 4)
def regime_table(spark, sf_dir):
    """All 45 market-wide columns of a date in one table."""
    return _regime_rows(spark, sf_dir)


def _regime_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.ln(F.col("close") / F.lag("close").over(W.ordered("ticker", "bar_date")))
    rows = daily_bars(spark, sf_dir).select("ticker", "bar_date", "close", r.alias("r"))
    return R.regime_table(rows, "r", ("1", "2"), _PAIRS, [str(k) for k in range(1, 12)], _SPANS, _TERMS, _ROTATIONS, _PAST)


@query(
    f"""{BARS}, r AS (SELECT bar_date, ln(close / lag(close, 5) OVER w) AS r5, ln(close / lag(close, 20) OVER w) AS r20 FROM bars WHERE CAST(ticker AS INT) BETWEEN 1 AND 11 WINDOW w AS ({P})),
        d AS (SELECT bar_date, CASE WHEN count(r5) >= 2 THEN stddev_samp(r5) END AS s5, CASE WHEN count(r20) >= 2 THEN stddev_samp(r20) END AS s20,
              CASE WHEN count(r5) >= 2 THEN max(r5) - min(r5) END AS g5, CASE WHEN count(r20) >= 2 THEN max(r20) - min(r20) END AS g20 FROM r GROUP BY bar_date),
        z AS (SELECT bar_date, {_z('s5', 'w', 30)} AS rotation_std_5, {_z('s20', 'w', 30)} AS rotation_std_20, {_z('g5', 'w', 30)} AS rotation_range_5, {_z('g20', 'w', 30)} AS rotation_range_20 FROM d
              WINDOW w AS (ORDER BY bar_date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING))
        SELECT *, coalesce(rotation_std_20 - lag(rotation_std_20, 20) OVER (ORDER BY bar_date), 0.0) AS rotation_std_20_delta, coalesce(rotation_range_20 - lag(rotation_range_20, 20) OVER (ORDER BY bar_date), 0.0) AS rotation_range_20_delta FROM z""",
    "rotation_std_5 rotation_std_20 rotation_range_5 rotation_range_20 rotation_std_20_delta rotation_range_20_delta", 5,
)
def sector_rotation(spark, sf_dir):
    """Dispersion of a group's returns over dates."""
    return R.rotation(daily_bars(spark, sf_dir), [str(k) for k in range(1, 12)], (5, 20), n=30)


# ---- audit


def _longform(cols: str) -> str:
    return f"(SELECT {cols} FROM bars) UNPIVOT (value FOR feature IN ({cols}))"


@query(f"{BARS} SELECT feature, avg(value) AS mean, var_samp(value) AS variance, avg(pow(value - m, 3)) / pow(avg(pow(value - m, 2)), 1.5) AS skew, avg(CASE WHEN abs(value) > 0.99 THEN 1.0 ELSE 0.0 END) AS saturation FROM (SELECT *, avg(value) OVER (PARTITION BY feature) AS m FROM {_longform('open, close, volume')}) GROUP BY feature", "mean variance skew saturation", 3)
def feature_statistics(spark, sf_dir):
    return A.statistics(daily_bars(spark, sf_dir), ["open", "close", "volume"])


@query(f"{BARS} SELECT feature, count(*) FILTER (value IS NULL) AS n_null, count(*) FILTER (isnan(value)) AS n_nan, count(*) FILTER (isinf(value)) AS n_inf FROM (SELECT 'x' AS feature, CASE WHEN volume > 40 THEN NULL WHEN volume > 30 THEN 'nan'::DOUBLE WHEN volume > 25 THEN 'inf'::DOUBLE ELSE close END AS value FROM bars) GROUP BY feature")
def invalid_values(spark, sf_dir):
    v = F.col("volume")
    x = F.when(v > 40, F.lit(None).cast("double")).when(v > 30, F.lit(float("nan"))).when(v > 25, F.lit(float("inf"))).otherwise(F.col("close"))
    return A.missing_and_invalid(daily_bars(spark, sf_dir).select(x.alias("x")), ["x"])


@query(
    f"""{BARS}, y AS (SELECT feature, year(bar_date) AS year, avg(value) AS m, stddev_samp(value) AS s FROM (SELECT bar_date, close, volume FROM bars) UNPIVOT (value FOR feature IN (close, volume)) GROUP BY ALL HAVING count(value) >= 10)
        SELECT b.feature, b.year, abs(b.m - a.m) / nullif(a.s, 0) AS mean_shift, abs(b.s - a.s) / nullif(a.s, 0) AS std_shift, coalesce(abs(b.m - a.m) / nullif(a.s, 0) > 0.5 OR abs(b.s - a.s) / nullif(a.s, 0) > 0.5, false) AS drifted
        FROM y a JOIN y b ON a.feature = b.feature AND b.year = a.year + 1""",
    "mean_shift std_shift",
)
def yearly_drift(spark, sf_dir):
    out = A.yearly_drift(daily_bars(spark, sf_dir), ["close", "volume"])
    return out.withColumn("year", F.col("year").cast("bigint"))


@query(
    f"""{BARS}, s AS (SELECT CASE WHEN year(bar_date) < 1997 THEN 'train' WHEN year(bar_date) < 1998 THEN 'valid' ELSE 'test' END AS split, close, volume FROM bars),
        g AS (SELECT split, feature, avg(value) AS m, stddev_samp(value) AS d FROM s UNPIVOT (value FOR feature IN (close, volume)) GROUP BY ALL)
        SELECT g.feature, g.split, (g.m - b.m) / b.d AS mean_shift FROM g JOIN g b ON b.split = 'train' AND b.feature = g.feature WHERE g.split <> 'train'""",
    "mean_shift",
)
def split_drift(spark, sf_dir):
    y = F.year("bar_date")
    rows = daily_bars(spark, sf_dir).withColumn("split", F.when(y < 1997, "train").when(y < 1998, "valid").otherwise("test"))
    return A.split_drift(rows, ["close", "volume"], "split")


@query(f"{BARS}, r AS (SELECT ticker, corr(close, high) AS a, corr(close, volume) AS b, corr(high, volume) AS c FROM bars GROUP BY ticker), l AS (SELECT 'close' AS a, 'high' AS b, a AS r FROM r UNION ALL SELECT 'close', 'volume', b FROM r UNION ALL SELECT 'high', 'volume', c FROM r) SELECT a, b, count(*) FILTER (abs(r) >= 0.95) AS n_high, avg(abs(r)) AS mean_abs_r FROM l GROUP BY ALL", "mean_abs_r")
def collinear_features(spark, sf_dir):
    return A.multicollinear(daily_bars(spark, sf_dir), ["close", "high", "volume"])


@query(f"{BARS}, l AS (SELECT ticker, max(bar_date) FILTER (close > 0) AS last_valid FROM bars GROUP BY ticker) SELECT ticker, last_valid, date_diff('day', last_valid, (SELECT max(last_valid) FROM l)) <= 30 AS active FROM l")
def survivorship(spark, sf_dir):
    return A.survivorship(daily_bars(spark, sf_dir))


@query(
    f"""{BARS}, n AS (SELECT ticker, bar_date, CASE WHEN transactions > 1 THEN close END AS close, row_number() OVER ({P}) AS i FROM bars), g AS (SELECT ticker, count(*) AS n, min(i) FILTER (close IS NOT NULL) AS lo, max(i) FILTER (close IS NOT NULL) AS hi, count(*) FILTER (close IS NULL) AS k FROM n GROUP BY ticker)
        SELECT ticker, coalesce(lo - 1, n) AS leading, coalesce(n - hi, 0) AS trailing, k - coalesce(lo - 1, n) - coalesce(n - hi, 0) AS interior FROM g"""
)
def null_runs(spark, sf_dir):
    rows = daily_bars(spark, sf_dir).withColumn("close", F.when(F.col("transactions") > 1, F.col("close")))
    return A.close_nulls(rows)


@query(f"{BARS} SELECT feature, max(abs(value - CAST(CAST(value AS FLOAT) AS DOUBLE))) AS loss, max(abs(value - CAST(CAST(value AS FLOAT) AS DOUBLE))) <= 1e-6 AS fits FROM {_longform('close, volume')} GROUP BY feature", "loss", 8)
def downcastable_columns(spark, sf_dir):
    return A.downcastable(daily_bars(spark, sf_dir), ["close", "volume"])


_AUDITED = ("close", "high", "low", "open", "volume")
_ROWS_SQL = " UNION ALL ".join(f"SELECT ticker, bar_date, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM bars" for c in _AUDITED)
_PAIRS_SQL = " UNION ALL ".join(f"SELECT '{a}|{b}' AS subject, corr({a}, {b}) AS r FROM bars GROUP BY ticker" for i, a in enumerate(_AUDITED) for b in _AUDITED[i + 1 :])


@query(
    f"""{BARS}, l AS ({_ROWS_SQL}), y AS (SELECT feature, year(bar_date) AS y, avg(value) AS m, stddev_samp(value) AS d FROM l GROUP BY ALL HAVING count(value) >= 10),
      moved AS (SELECT a.feature, abs(a.m - b.m) / b.d > 0.5 OR abs(a.d - b.d) / b.d > 0.5 AS drifted FROM y a JOIN y b ON a.feature = b.feature AND a.y = b.y + 1),
      j AS (SELECT ticker, abs(ln(close) - ln(lag(close) OVER ({P}))) AS r FROM bars), ends AS (SELECT ticker, max(bar_date) FILTER (close > 0) AS until FROM bars GROUP BY ticker)
      SELECT 'saturation' AS check, feature AS subject, 'info' AS severity, avg(CAST(abs(value) > 0.99 AS DOUBLE)) AS value FROM l GROUP BY feature HAVING avg(CAST(abs(value) > 0.99 AS DOUBLE)) > 0.05
      UNION ALL SELECT 'missing', feature, 'warning', CAST(count(*) - count(value) AS DOUBLE) FROM l GROUP BY feature HAVING count(*) > count(value)
      UNION ALL SELECT 'downcast', feature, 'info', max(abs(value - CAST(CAST(value AS FLOAT) AS DOUBLE))) FROM l GROUP BY feature HAVING max(abs(value - CAST(CAST(value AS FLOAT) AS DOUBLE))) <= 1e-6
      UNION ALL SELECT 'drift', feature, 'warning', CAST(count(*) AS DOUBLE) FROM moved WHERE drifted GROUP BY feature HAVING count(*) >= 2
      UNION ALL SELECT 'discontinuity', ticker, CASE WHEN r >= ln(2.0) THEN 'critical' ELSE 'suspicious' END AS s, CAST(count(*) AS DOUBLE) FROM j WHERE r >= ln(1.5) GROUP BY ticker, s
      UNION ALL SELECT 'delisted', ticker, 'info', 1.0 FROM ends WHERE date_diff('day', until, (SELECT max(until) FROM ends)) > 30
      UNION ALL SELECT 'collinear', subject, 'info', CAST(count(*) AS DOUBLE) FROM ({_PAIRS_SQL}) WHERE abs(r) >= 0.95 GROUP BY subject""",
    "value",
)
def audit_report(spark, sf_dir):
    """All checks as one tidy table, from one scan."""
    return AS.audit(daily_bars(spark, sf_dir), list(_AUDITED))


#: The market-wide columns that every date has.
REGIME_COLUMNS = [*_REGIME, *(f"{c}_delta_{n}" for c, ns in _REGIME_DELTAS.items() for n in ns), *_ROTATION, *_ROTATION_DELTAS]
REGIME_SQL = _regime_sql()
_REGIME_PAIRS = [(a, b) for i, a in enumerate(sorted(REGIME_COLUMNS)) for b in sorted(REGIME_COLUMNS)[i + 1 :]]


@query(
    f"""WITH t AS MATERIALIZED ({REGIME_SQL}), k AS MATERIALIZED (SELECT * FROM t WHERE {' AND '.join(f'{c} IS NOT NULL' for c in REGIME_COLUMNS)}),
      p AS ({' UNION ALL '.join(f"SELECT '{a}' AS a, '{b}' AS b, CASE WHEN stddev_pop({a}) > 0 AND stddev_pop({b}) > 0 THEN corr({a}, {b}) END AS r, count(*) AS n FROM k" for a, b in _REGIME_PAIRS)})
      SELECT a, b, r FROM p WHERE n >= 100 AND abs(r) >= 0.9 ORDER BY round(abs(r), 9) DESC, a, b LIMIT 30""",
    "r",
)
def regime_collinearity(spark, sf_dir):
    """The pairs of market-wide columns that say the same: |r| of 0.9 and more over at least 100 complete dates."""
    return G.regime_collinear(_regime_rows(spark, sf_dir), list(REGIME_COLUMNS))
