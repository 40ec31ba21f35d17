"""Queries over curves, folds, samples, the simulator, indicators, sinks and vectors."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.operators import folds as FO
from tickloom.operators import recursions as RC
from tickloom.operators import metrics as M
from tickloom.operators import simulator as SIM
from tickloom.operators import windows as W
from tickloom.plans.registry import query
from tickloom.session import shared_folder
from tickloom.sources.tables import DAILY_BARS_SQL, HOURLY_BARS_SQL, daily_bars, hourly_bars, table, trades

BARS = f"WITH {DAILY_BARS_SQL}"
HOURS = f"WITH {HOURLY_BARS_SQL}"
#: A mild equity curve per ticker out of hourly bars.
_CURVE = "100000 * product(1 + (close / open - 1) / 10000) OVER (PARTITION BY ticker ORDER BY bucket ROWS UNBOUNDED PRECEDING)"
CURVES = f"{HOURS}, curves AS (SELECT ticker AS curve, bucket AS step, {_CURVE} AS pv FROM bars)"
_METRICS = """r AS (SELECT *, pv / lag(pv) OVER w - 1 AS r, pv - lag(pv) OVER w AS pnl, (max(pv) OVER u - pv) / max(pv) OVER u AS dd FROM curves
    WINDOW w AS (PARTITION BY curve ORDER BY step), u AS (PARTITION BY curve ORDER BY step ROWS UNBOUNDED PRECEDING)),
    g AS (SELECT curve, arg_min(pv, step) AS a, arg_max(pv, step) AS b, count(*) - 1 AS n, avg(r - 0.02 / 252) AS x, stddev_samp(r) AS sd, sqrt(avg(pow(least(r - 0.02 / 252, 0), 2))) AS down,
          max(dd) AS max_drawdown, sum(greatest(pnl, 0)) AS gain, sum(greatest(-pnl, 0)) AS loss FROM r GROUP BY curve)"""


def curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.ordered("ticker", "bucket")
    pv = 100_000 * W.running_product(1 + (F.col("close") / F.col("open") - 1) / 10_000, w)
    return hourly_bars(spark, sf_dir).select(F.col("ticker").alias("curve"), F.col("bucket").alias("step"), pv.alias("pv"))


@query(
    f"""{CURVES}, {_METRICS} SELECT curve, b / a - 1 AS total_return, pow(b / a, 252.0 / n) - 1 AS annual_return, x / sd * sqrt(252) AS sharpe, x / nullif(down, 0) * sqrt(252) AS sortino,
        max_drawdown, (pow(b / a, 252.0 / n) - 1) / nullif(max_drawdown, 0) AS calmar, gain / nullif(loss, 0) AS profit_factor FROM g""",
    "total_return annual_return sharpe sortino max_drawdown calmar profit_factor", 5,
)
def curve_performance(spark, sf_dir):
    """Return, Sharpe, Sortino, drawdown, Calmar and profit factor of equity curves."""
    return M.performance(curves(spark, sf_dir))


@query(
    f"""{BARS}, f AS (SELECT ticker, arg_min(close, bar_date) AS p0 FROM bars GROUP BY ticker)
        SELECT 'hold' AS curve, bar_date AS step, sum(close / p0) * (100000.0 / (SELECT count(DISTINCT ticker) FROM bars)) AS pv FROM bars JOIN f USING (ticker) GROUP BY bar_date""",
    "pv", 4,
)
def buy_and_hold_curve(spark, sf_dir):
    return M.buy_and_hold(daily_bars(spark, sf_dir))


@query(
    f"""{CURVES}, s AS (SELECT month(step) * 100 + day(step) // 8 AS segment, step, pv FROM curves WHERE curve = 'click'),
        e AS (SELECT segment, arg_min(pv, step) AS a, arg_max(pv, step) AS b FROM s GROUP BY segment),
        k AS (SELECT segment, a, coalesce(product(b / a) OVER (ORDER BY segment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1.0) AS grown FROM e)
        SELECT segment, step, pv / a * grown * 100000 AS pv FROM s JOIN k USING (segment)""",
    "pv", 4,
)
def compounded_segments(spark, sf_dir):
    """Segments that each began anew, as one curve."""
    c = curves(spark, sf_dir).where(F.col("curve") == "click")
    return M.compounded(c.select((F.month("step") * 100 + F.floor(F.day("step") / 8)).cast("bigint").alias("segment"), "step", "pv"))


@query(
    """WITH d AS (SELECT bar_date, row_number() OVER (ORDER BY bar_date) - 1 AS i FROM (SELECT DISTINCT l_shipdate::DATE AS bar_date FROM lineitem)),
       b AS (SELECT bar_date, i // 252 AS segment FROM d UNION ALL SELECT bar_date, i // 252 - 1 FROM d WHERE i > 0 AND i % 252 = 0)
       SELECT segment, min(bar_date) AS first_date, max(bar_date) AS last_date, count(*) AS n_steps FROM b GROUP BY segment HAVING count(*) > 1"""
)
def protocol_segments(spark, sf_dir):
    """Stretches of 252 steps that share their boundary date."""
    return M.protocol_segments(daily_bars(spark, sf_dir).select("bar_date").distinct())


@query(
    f"""{BARS}, p AS (SELECT * FROM bars WHERE ticker IN ('1', '2')), n AS (SELECT bar_date, count(*) AS n FROM p GROUP BY bar_date), e AS (SELECT min(bar_date) AS first_date, max(bar_date) AS last_date FROM n WHERE n = 2)
        SELECT first_date, last_date, count(*) FILTER (n < 2) AS n_gaps FROM n JOIN e ON bar_date BETWEEN first_date AND last_date GROUP BY ALL"""
)
def basket_range(spark, sf_dir):
    """Dates at which the whole basket is priced, and the gaps between."""
    return M.valid_range(daily_bars(spark, sf_dir).where(F.col("ticker").isin("1", "2")), 2)


_EPISODES = "e AS (SELECT o_custkey % 9 AS model, o_orderkey AS episode, (o_totalprice - 150000) / 5000000 AS ret, 0.001 AS benchmark FROM orders)"


@query(
    f"""WITH {_EPISODES} SELECT model, count(*) AS n, avg(ret) AS mean, median(ret) AS median, stddev_pop(ret) AS std, min(ret) AS worst, max(ret) AS best, avg(CAST(ret > 0 AS DOUBLE)) AS positive,
        avg(CAST(ret > benchmark AS DOUBLE)) AS beat_benchmark, ln(product(1 + ret)) AS log_growth, avg(ret) / stddev_samp(ret) * sqrt(252 / 5.0) AS sharpe FROM e GROUP BY model""",
    "mean median std worst best positive beat_benchmark log_growth sharpe",
)
def episode_summaries(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    e = o.select((F.col("o_custkey") % 9).alias("model"), F.col("o_orderkey").alias("episode"), ((F.col("o_totalprice") - 150_000) / 5_000_000).alias("ret"), F.lit(0.001).alias("benchmark"))
    return M.episode_summary(e, ["model"]).drop("cumulative")


@query(
    """WITH w AS (SELECT l_orderkey % 50 AS episode, l_orderkey AS step, l_returnflag AS asset, sum(l_extendedprice) / 1e6 AS weight FROM lineitem GROUP BY ALL),
       s AS (SELECT DISTINCT episode, step FROM w), a AS (SELECT DISTINCT episode, asset FROM w),
       g AS (SELECT s.episode, s.step, a.asset, coalesce(w.weight, 0) AS weight FROM s JOIN a USING (episode) LEFT JOIN w USING (episode, step, asset)
             UNION ALL SELECT episode, step, 'cash', 1 - sum(weight) FROM w GROUP BY ALL)
       SELECT episode, asset, avg(weight) AS mean, stddev_pop(weight) AS std, min(weight) AS least, max(weight) AS most FROM g GROUP BY ALL""",
    "mean std least most",
)
def episode_weights(spark, sf_dir):
    """Statistics of what each asset, and cash, weighs over the steps of an episode."""
    lines = table(spark, sf_dir, "lineitem")
    w = lines.select((F.col("l_orderkey") % 50).alias("episode"), F.col("l_orderkey").alias("step"), F.col("l_returnflag").alias("asset"), (F.col("l_extendedprice") / 1e6).alias("weight"))
    return M.weight_statistics(w, ["episode"])


@query("SELECT fold, arg_max(call, (score, -call)) AS call, max(score) AS score FROM (SELECT o_custkey % 50 AS fold, o_orderkey AS call, round(o_totalprice, -4) AS score FROM orders) GROUP BY fold")
def best_checkpoints(spark, sf_dir):
    """The earliest best call of each fold."""
    calls = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("fold"), F.col("o_orderkey").alias("call"), F.round("o_totalprice", -4).alias("score"))
    return M.best_checkpoint(calls)


@query(
    "SELECT o_custkey, o_orderkey, CASE WHEN row_number() OVER w >= 10 THEN avg(o_totalprice) OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) END AS ma FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)",
    "ma", 4,
)
def smoothed_metric(spark, sf_dir):
    return M.smoothed(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_totalprice").select("o_custkey", "o_orderkey", "ma")


# ---- folds and samples


@query(
    """WITH y AS (SELECT min(year(o_orderdate)) AS a, max(year(o_orderdate)) AS b FROM orders)
       SELECT CAST(k AS INT) AS fold, make_date(a, 1, 1) AS train_start, CASE WHEN a + k + 3 > b THEN make_date(b, 12, 31) ELSE make_date(a + k + 2, 12, 31) END AS train_end,
       CASE WHEN a + k + 3 <= b THEN make_date(a + k + 3, 1, 1) END AS valid_start, CASE WHEN a + k + 3 <= b THEN make_date(a + k + 3, 12, 31) END AS valid_end FROM y, range(100) t(k) WHERE k <= b - a - 2"""
)
def walk_forward_folds(spark, sf_dir):
    """Expanding folds by year over the years of the orders; the last one trains on everything."""
    years = table(spark, sf_dir, "orders").agg(F.min(F.year("o_orderdate")).alias("first"), F.max(F.year("o_orderdate")).alias("last")).first()
    return FO.walk_forward(spark, years["first"], years["last"], train_years=3)


@query(
    """WITH f AS (SELECT CAST(k AS INT) AS fold, make_date(1998 + k, 1, 1) AS a, make_date(1998 + k, 12, 31) AS b FROM range(4) t(k))
       SELECT fold, count(*) AS n, min(o_orderkey) AS first_key FROM orders JOIN f ON o_orderdate::DATE BETWEEN a AND b GROUP BY fold"""
)
def orders_by_fold(spark, sf_dir):
    """Dates in ranges: a small table of folds is broadcast."""
    from tickloom.operators.joins import in_ranges

    folds = FO.walk_forward(spark, 1995, 2001, train_years=3).where("valid_start is not null").select("fold", "valid_start", "valid_end")
    o = table(spark, sf_dir, "orders").withColumn("d", F.to_date("o_orderdate"))
    return in_ranges(o, folds, "d", "valid_start", "valid_end").groupBy("fold").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"))


@query(
    """SELECT o_orderkey, CASE WHEN i < floor(n * 0.7) THEN 'train' WHEN i < floor(n * 0.85) THEN 'valid' ELSE 'test' END AS split FROM (
       SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)"""
)
def chronological_splits(spark, sf_dir):
    return FO.chronological_split(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey").select("o_orderkey", "split")


@query("SELECT o_orderkey FROM orders QUALIFY o_orderdate > min(o_orderdate) OVER (PARTITION BY o_custkey) AND o_orderdate < max(o_orderdate) OVER (PARTITION BY o_custkey)")
def trimmed_days(spark, sf_dir):
    """Without each key's first and last date."""
    return FO.trimmed(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate").select("o_orderkey")


_POOL = """d AS (SELECT DISTINCT l_shipdate::DATE AS bar_date FROM lineitem), e AS (SELECT bar_date AS start_date, row_number() OVER (ORDER BY bar_date) - 1 AS start_idx, lead(bar_date, 251) OVER (ORDER BY bar_date) AS end_date FROM d),
    p AS (SELECT *, 1 - CAST(row_number() OVER (ORDER BY start_idx) - 1 AS DOUBLE) / (count(*) OVER () - 1) AS age FROM e WHERE end_date IS NOT NULL AND start_idx % 5 = 0)"""


@query(f"WITH {_POOL} SELECT start_idx, start_date, end_date, age, exp(-2.0 * age) / sum(exp(-2.0 * age)) OVER () AS weight FROM p", "age weight", 9)
def episode_pool(spark, sf_dir):
    """Starts of 252-step episodes, every fifth date, weighted by recency."""
    return FO.episode_pool(daily_bars(spark, sf_dir).select("bar_date").distinct(), 252, 2.0, 5)


@query()
def drawn_episodes(spark, sf_dir):
    """A seeded draw with replacement by weight."""
    return FO.drawn(FO.episode_pool(daily_bars(spark, sf_dir).select("bar_date").distinct(), 252, 2.0), 1000, 3)


@query()
def validation_episodes(spark, sf_dir):
    """A fixed set without replacement, spread over tickers (the sampling operator's own limit)."""
    pool = daily_bars(spark, sf_dir).select("ticker", F.datediff("bar_date", F.lit("1995-01-01").cast("date")).alias("start_idx"))
    return FO.capped_validation_set(pool, 300, 3)


@query("SELECT event_id, value, event_id % 512 AS slot FROM events ORDER BY event_id DESC LIMIT 512")
def ring_buffer(spark, sf_dir):
    """The last 512 rows, as a ring holds them."""
    return FO.ring(table(spark, sf_dir, "events").select("event_id", "value"), "event_id", 512)


@query()
def recency_batch(spark, sf_dir):
    """A batch drawn from a ring, recent slots more often."""
    held = FO.ring(table(spark, sf_dir, "events").select("event_id", "value"), "event_id", 512)
    return FO.gathered(FO.recency_sample(spark, 512, 100, 512, 256, 2.0, 5), held)


@query("SELECT vec_id, list_sum(CAST(embedding[1:3] AS DOUBLE[])) AS head, list_sum(CAST(embedding[4:64] AS DOUBLE[])) AS tail FROM embeddings", "head tail", 5)
def state_parts(spark, sf_dir):
    """A flat state cut into its parts."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("state"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return FO.unflattened(FO.flattened(e, ["state"]), {"head": 3, "tail": 61}).select("vec_id", total("head").alias("head"), total("tail").alias("tail"))


# ---- simulator and indicators


def steps(spark: SparkSession, sf_dir: str, n: int = 5) -> DataFrame:
    """Episodes by day over hourly closes of the five tickers, carried forward, with prices and logits."""
    bars = hourly_bars(spark, sf_dir)
    hours = bars.groupBy("bucket").pivot("ticker").agg(F.max("close"))
    names = sorted(c for c in hours.columns if c != "bucket")
    w = Window.partitionBy(F.to_date("bucket")).orderBy("bucket")
    filled = hours.select("bucket", *[F.coalesce(F.last(c, True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first(c, True).over(w.rowsBetween(0, Window.unboundedFollowing))).alias(c) for c in names])
    logits = F.array(*[F.sin(F.hour("bucket") + F.lit(float(k))) for k in range(len(names))])
    return filled.select(F.to_date("bucket").cast("string").alias("episode"), F.unix_timestamp(F.col("bucket").cast("timestamp")).alias("step"), F.array(*[F.col(c) for c in names]).alias("prices"), logits.alias("actions")).where(~F.exists("prices", F.isnull))


@query()
def simulated_steps(spark, sf_dir):
    """Every step of the simulator over daily episodes."""
    return SIM.simulate(steps(spark, sf_dir)).select("episode", "step", "pv", "cash", "reward", "turnover", "n_trades", "n_round_trips", "n_wins", "fees")


@query()
def simulated_episodes(spark, sf_dir):
    """Ratios of each simulated episode."""
    return SIM.episode_info(SIM.simulate(steps(spark, sf_dir)))


@query()
def policy_episodes(spark, sf_dir):
    """The simulator driven by a policy over Arrow batches."""

    def momentum(state: pd.DataFrame) -> pd.Series:
        return pd.Series([[0.0 if p > 250 else 1.0 for p in prices] for prices in state["prices"]], dtype=object)

    return SIM.episode_info(SIM.simulate(SIM.with_policy(steps(spark, sf_dir).drop("actions"), momentum, ["prices"])))


def _recursion(name: str, source: str, averages: dict[str, tuple[str, int, int, float, float]]) -> str:
    """CTEs with each average of source (ticker, pos and columns). averages: column, position of its first value, values that begin it, their divisor, alpha."""
    start = {n: first + seeds - 1 for n, (_, first, seeds, _, _) in averages.items()}
    seed = ", ".join(f"sum({x}) OVER (PARTITION BY ticker ORDER BY pos ROWS BETWEEN {seeds - 1} PRECEDING AND CURRENT ROW) / {div}.0 AS s_{n}" for n, (x, _, seeds, div, _) in averages.items())
    step = ", ".join(f"CASE WHEN b.pos < {start[n]} THEN NULL WHEN b.pos = {start[n]} THEN b.s_{n} ELSE {1 - a!r} * r.{n} + {a!r} * b.{x} END" for n, (x, _, _, _, a) in averages.items())
    return f"""{name}_base AS (SELECT *, {seed} FROM {source}),
      {name}(ticker, pos, {', '.join(averages)}) AS (SELECT ticker, pos, {', '.join('NULL::DOUBLE' for _ in averages)} FROM {name}_base WHERE pos = 0
        UNION ALL SELECT b.ticker, b.pos, {step} FROM {name} r JOIN {name}_base b ON b.ticker = r.ticker AND b.pos = r.pos + 1)"""


def _of_ema(column: str, n: int, first: int = 0) -> tuple[str, int, int, float, float]:
    return column, first, n, n, 2 / (n + 1)


def _of_wilder(column: str, n: int, first: int) -> tuple[str, int, int, float, float]:
    return column, first, n, n, 1 / n


def _directional_sql(spans: tuple[int, ...], averages: dict, more: dict, further: str = "") -> str:
    """first: averages and Wilder's sums; second: ADX and more; joined as m, first, second."""
    sums = {f"{s}_{n}": (s, 1, n - 1, n, 1 / n) for n in spans for s in ("tr", "plus", "minus")}
    sides = ", ".join(f"CASE WHEN f.pos >= {n} THEN coalesce(100 * f.{s}_{n} / nullif(f.tr_{n}, 0), 0) END AS {s[0]}di_{n}" for n in spans for s in ("plus", "minus"))
    dx = ", ".join(f"CASE WHEN pdi_{n} + mdi_{n} > 0 THEN 100 * abs(pdi_{n} - mdi_{n}) / (pdi_{n} + mdi_{n}) WHEN pdi_{n} IS NOT NULL THEN 0 END AS dx_{n}" for n in spans)
    return f"""WITH RECURSIVE {DAILY_BARS_SQL}, p AS (SELECT *, row_number() OVER w - 1 AS pos, lag(close) OVER w AS before, high - lag(high) OVER w AS up, lag(low) OVER w - low AS down FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY bar_date)),
      m AS (SELECT ticker, bar_date, pos, close, CAST(volume AS DOUBLE) AS volume, CAST(transactions AS DOUBLE) AS transactions, volume / greatest(transactions, 1) AS trade_size, (high - low) / greatest(transactions, 1) AS trade_range,
        CASE WHEN pos > 0 THEN greatest(high - low, abs(high - before), abs(low - before)) END AS tr, CASE WHEN pos > 0 THEN CASE WHEN up > down AND up > 0 THEN up ELSE 0 END END AS plus,
        CASE WHEN pos > 0 THEN CASE WHEN down > up AND down > 0 THEN down ELSE 0 END END AS minus, CASE WHEN pos > 0 THEN greatest(close - before, 0) END AS gain, CASE WHEN pos > 0 THEN greatest(before - close, 0) END AS loss FROM p),
      {_recursion('first', 'm', averages | sums)}, sides AS (SELECT f.*, {sides}{further} FROM first f),
      dx AS (SELECT *, {dx} FROM sides), {_recursion('second', 'dx', {f"adx_{n}": _of_wilder(f"dx_{n}", n, n) for n in spans} | more)}"""


_TREND = {f"{c}_ema_{n}": _of_ema(c, n) for c, ns in {"close": (5, 20, 60, 120, 252), "volume": (5, 20, 60), "trade_size": (60,), "trade_range": (60,), "transactions": (60,)}.items() for n in ns}
_log_of = lambda a, b: f"ln(nullif(({a} + 1e-8) / ({b} + 1e-8), 0))"
_TREND_OUT = (
    {f"ema_close_ratio_{n}": _log_of("m.close", f"d.close_ema_{n}") for n in (5, 20, 60, 120, 252)}
    | {f"ema_{a}_{b}_ratio": _log_of(f"d.close_ema_{a}", f"d.close_ema_{b}") for a, b in ((5, 20), (20, 60))}
    | {"adx_14": "s.adx_14 / 100", "adx_5_20": _log_of("s.adx_5", "s.adx_20"), "adx_20_60": _log_of("s.adx_20", "s.adx_60"), "volume_ema_ratio_20": _log_of("m.volume", "d.volume_ema_20")}
    | {f"volume_{a}_{b}_ratio": _log_of(f"d.volume_ema_{a}", f"d.volume_ema_{b}") for a, b in ((5, 20), (20, 60))}
    | {"avg_trade_size_ratio": _log_of("m.trade_size", "d.trade_size_ema_60"), "range_per_trade_ratio": _log_of("m.trade_range", "d.trade_range_ema_60"), "trade_intensity_ratio": _log_of("m.transactions", "d.transactions_ema_60")}
)


@query(
    f"""{_directional_sql((5, 14, 20, 60), _TREND, {})}
      SELECT m.ticker, m.bar_date, {', '.join(f'{e} AS {n}' for n, e in _TREND_OUT.items())} FROM m JOIN dx d USING (ticker, pos) JOIN second s USING (ticker, pos)""",
    " ".join(_TREND_OUT),
)
def trend_indicators(spark, sf_dir):
    """EMA and ADX features: recursive averages by scans over chunks."""
    return RC.trend(daily_bars(spark, sf_dir), counted=trades(spark, sf_dir))


_CLASSIC = {f"ema_{n}": _of_ema("close", n) for n in (3, 9, 12, 21, 26)} | {"up_14": _of_wilder("gain", 14, 1), "down_14": _of_wilder("loss", 14, 1), "atr_14": _of_wilder("tr", 14, 1)}
_RSI = ", ema_12 - ema_26 AS macd, CASE WHEN up_14 + down_14 > 0 THEN 100 * up_14 / (up_14 + down_14) WHEN up_14 IS NOT NULL THEN 0 END AS rsi_14"


@query(
    f"""{_directional_sql((20,), _CLASSIC, {"macd_signal": _of_ema("macd", 9, 25)}, _RSI)}
      SELECT m.ticker, m.bar_date, d.rsi_14, d.macd, s.macd_signal, d.pdi_20 AS plus_di_20, d.mdi_20 AS minus_di_20, s.adx_20, d.atr_14, d.ema_3, d.ema_9, d.ema_21,
        CASE WHEN count(d.rsi_14) OVER w = 14 THEN (d.rsi_14 - min(d.rsi_14) OVER w) / nullif(max(d.rsi_14) OVER w - min(d.rsi_14) OVER w, 0) END AS stoch_rsi
      FROM m JOIN dx d USING (ticker, pos) JOIN second s USING (ticker, pos) WINDOW w AS (PARTITION BY ticker ORDER BY pos ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)""",
    "rsi_14 macd macd_signal plus_di_20 minus_di_20 adx_20 atr_14 ema_3 ema_9 ema_21 stoch_rsi", 5,
)
def classic_indicators(spark, sf_dir):
    return RC.classic(daily_bars(spark, sf_dir), counted=trades(spark, sf_dir))


# ---- sinks and vectors


@query(
    """WITH r AS (SELECT CASE WHEN event_id % 50 = 0 THEN NULL ELSE event_type END AS ticker, date_trunc('hour', ts) AS timestamp, value AS volume, event_id AS k FROM events),
       g AS (SELECT * FROM r WHERE ticker IS NOT NULL), f AS (SELECT *, row_number() OVER (PARTITION BY ticker, timestamp ORDER BY k) AS n FROM g)
       SELECT ticker, timestamp, CAST(round_even(volume, 0) AS BIGINT) AS volume, k FROM f WHERE n = 1 AND timestamp >= TIMESTAMP '2024-01-10'"""
)
def first_arrivals(spark, sf_dir):
    """What an ingest appends: rows with keys, the first of each, none that the target has."""
    from tickloom.sources.sinks import new_rows, typed

    e = table(spark, sf_dir, "events")
    rows = e.select(F.when(F.col("event_id") % 50 != 0, F.col("event_type")).alias("ticker"), F.date_trunc("hour", "ts").alias("timestamp"), F.col("value").alias("volume"), F.lit(1).alias("transactions"), F.col("event_id").alias("k"))
    good, _ = typed(rows)
    target = good.where(F.col("timestamp") < F.lit("2024-01-10").cast("timestamp")).select("ticker", "timestamp").distinct()
    return new_rows(good, target, ["ticker", "timestamp"], F.col("k")).select("ticker", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "volume", "k")


@query("SELECT label, count(*) AS n, count(DISTINCT vec_id) AS n_ids FROM embeddings GROUP BY label")
def label_counts(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("vec_id").alias("n_ids"))


@query()
def principal_components(spark, sf_dir):
    """The fewest components that hold 95 % of the variance, of standardised vectors."""
    from tickloom.operators.reduce import reduced

    return reduced(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.95)


@query(
    f"""{BARS.replace('WITH ', 'WITH ', 1)}, x AS (SELECT 1) SELECT ticker, bar_date, close FROM bars WHERE year(bar_date) = 1999""",
    "close",
)
def stored_year(spark, sf_dir):
    """A partitioned table written and read with partition pruning."""
    from tickloom.sources.sinks import write_unified

    path = f"{shared_folder(spark)}/unified-{uuid.uuid4().hex}"
    write_unified(daily_bars(spark, sf_dir), path)
    return spark.read.parquet(path).where("year = 1999").select("ticker", "bar_date", "close")
