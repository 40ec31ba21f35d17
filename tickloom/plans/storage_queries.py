"""Queries that write and read tables and files, the calendar, a stream, and small projections."""

from __future__ import annotations

import json
import os
import uuid
from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions import scalars as S
from tickloom.operators import lifecycle as L
from tickloom.operators import metrics as M
from tickloom.operators import regime as R
from tickloom.operators import windows as W
from tickloom.operators.scan import placed
from tickloom.plans.bars_queries import _bucketed
from tickloom.plans.registry import query
from tickloom.session import shared_folder
from tickloom.sources import bars as B
from tickloom.sources import sinks as K
from tickloom.sources import vendor as V
from tickloom.sources.tables import DAILY_BARS_SQL, HOURLY_BARS_SQL, daily_bars, hourly_bars, table, ticks, trades

BARS = f"WITH {DAILY_BARS_SQL}"
HOURS = f"WITH {HOURLY_BARS_SQL}"
P = "PARTITION BY ticker ORDER BY bar_date"


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# ---- files


@query(f"{HOURS} SELECT ticker, open, high, low, close, CAST(volume AS DOUBLE) AS volume, CAST(epoch_us(bucket) AS BIGINT) AS at, CAST(bucket::DATE AS VARCHAR) AS day FROM bars WHERE ticker IN ('click', 'purchase')", "open high low close volume")
def flat_file_bars(spark, sf_dir):
    """Compressed CSV files of bars in nested folders, read with a given schema and a ticker filter in the scan."""
    path = _folder(spark, "flat")
    bars = hourly_bars(spark, sf_dir).withColumn("window_start", F.unix_micros(F.col("bucket").cast("timestamp")) * 1000)
    flat = bars.select("ticker", F.col("volume").cast("double"), "open", "close", "high", "low", "window_start", F.lit(1).alias("transactions"))
    for k in range(2):
        K.write_csv(flat.where(F.pmod(F.floor(F.col("window_start") / 3_600_000_000_000), F.lit(2)) == k), f"{path}/2024/{k}", compression="gzip")
    rows = B.flat_bars(spark, path, ["click", "purchase"])
    return rows.select("ticker", "open", "high", "low", "close", "volume", F.unix_micros("timestamp").alias("at"), F.col("bar_date").cast("string").alias("day"))


@query("SELECT p_partkey, p_brand, p_size FROM part WHERE p_size > 25")
def json_round_trip(spark, sf_dir):
    path = _folder(spark, "json")
    K.write_json(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size"), path)
    kinds = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size").schema
    return spark.read.schema(kinds).json(path).where("p_size > 25")


@query(f"{BARS} SELECT ticker, CAST(epoch_us(bar_date) AS BIGINT) AS at, open, high, low, close, CAST(volume AS DOUBLE) AS volume, (high + low + close) / 3 AS vwap FROM bars", "open high low close volume vwap")
def json_ticker_bars(spark, sf_dir):
    """JSON arrays of a ticker's bars of a year, many a file, read with a given schema."""
    path = _folder(spark, "jsonbars")
    bars = daily_bars(spark, sf_dir).withColumns({"timestamp": F.col("bar_date").cast("timestamp"), "vwap": (F.col("high") + F.col("low") + F.col("close")) / 3})
    K.write_json_bars(bars.select("ticker", "timestamp", "open", "high", "low", "close", "transactions", F.col("volume").cast("double"), "vwap"), path)
    return B.json_bars(spark, path, lines=True).select("ticker", F.unix_micros("timestamp").alias("at"), "open", "high", "low", "close", "volume", "vwap")


@query(f"{BARS} SELECT ticker, avg(close) AS mean, count(*) AS n FROM bars WHERE bar_date >= DATE '1997-01-01' AND volume > 20 GROUP BY ticker", "mean")
def warehouse_fetch(spark, sf_dir):
    """A bulk load into a schema of the warehouse, analysed, and read back by SQL with bound arguments."""
    K.create_schemas(spark)
    name = f"features.bars_{uuid.uuid4().hex}"
    K.load_table(daily_bars(spark, sf_dir), name, _folder(spark, "warehouse"), {"spark__sql__parquet__compression__codec": "lz4"})
    text = "SELECT ticker, avg(close) AS mean, count(*) AS n FROM IDENTIFIER(:bars) WHERE bar_date >= :start AND volume > :least GROUP BY ticker"
    return K.fetch(spark, text, bars=name, start=date(1997, 1, 1), least=20)


@query(
    " UNION ALL ".join(f"SELECT '{c}' AS name, CAST(min({c}) AS VARCHAR) AS least, CAST(max({c}) AS VARCHAR) AS most, count(*) - count({c}) AS n_nulls FROM lineitem" for c in ("l_orderkey", "l_suppkey", "l_linenumber"))
)
def table_statistics(spark, sf_dir):
    """What the optimizer knows of a table's columns after the load."""
    K.create_schemas(spark)
    name = f"staging.lines_{uuid.uuid4().hex}"
    K.load_table(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber"), name, _folder(spark, "lines"))
    return K.column_statistics(spark, name).drop("n_distinct")


@query(f"{BARS} SELECT ticker, CAST(bar_date AS VARCHAR) AS day, close FROM bars WHERE ticker IN ('3', '7')", "close")
def ticker_folders(spark, sf_dir):
    """A folder a hash of tickers; of tickers asked for only their folders are read."""
    path = _folder(spark, "tickers")
    K.write_features(daily_bars(spark, sf_dir).select("ticker", "bar_date", "close"), path)
    return K.read_features(spark, path, "ticker string, bar_date date, close double", ["3", "7"]).select("ticker", F.col("bar_date").cast("string").alias("day"), "close")


@query(f"{BARS} SELECT ticker, CAST(bar_date AS VARCHAR) AS day, close FROM bars", "close")
def compacted_table(spark, sf_dir):
    """Bars appended in two batches to a table partitioned by month, of which the old months are then written anew."""
    path = _folder(spark, "months")
    rows = daily_bars(spark, sf_dir).select("ticker", "bar_date", "close", F.trunc("bar_date", "month").alias("month"), F.col("bar_date").cast("timestamp").alias("timestamp"))
    for k in range(2):
        K.append_bars(rows.where(F.pmod(F.xxhash64("ticker"), F.lit(2)) == k), path, "month")
    K.compact(spark, path, "1996-01-01", "month")
    return spark.read.parquet(path).select("ticker", F.col("bar_date").cast("string").alias("day"), "close")


@query("SELECT column_name AS name FROM information_schema.columns WHERE table_name = 'lineitem'")
def column_names(spark, sf_dir):
    """Columns from the files' metadata."""
    return spark.createDataFrame([(c,) for c in B.columns_of(spark, f"{sf_dir}/lineitem.parquet")], "name string")


@query("SELECT CAST(max(o_orderkey) + 1 AS BIGINT) AS number FROM orders")
def run_number(spark, sf_dir):
    """One more than the largest number in names."""
    names = table(spark, sf_dir, "orders").select(F.concat(F.lit("run_"), F.col("o_orderkey")).alias("name")).unionByName(spark.createDataFrame([("run_x",), ("other_99999999",)], "name string"))
    return spark.createDataFrame([(K.next_run_number(names),)], "number bigint")


# ---- calendar

_CLOSED = """'2024-01-01', '2024-01-15', '2024-02-19', '2024-03-29', '2024-05-27', '2024-06-19', '2024-07-04', '2024-09-02', '2024-11-28', '2024-12-25',
    '2025-01-01', '2025-01-09', '2025-01-20', '2025-02-17', '2025-04-18', '2025-05-26', '2025-06-19', '2025-07-04', '2025-09-01', '2025-11-27', '2025-12-25'"""
_SHORT = "'2024-07-03', '2024-11-29', '2024-12-24', '2025-07-03', '2025-11-28', '2025-12-24'"
_SESSIONS = f"""s AS (SELECT d::DATE AS d, CASE WHEN d::DATE IN ({_SHORT}) THEN 13 ELSE 16 END AS close_hour FROM generate_series(DATE '2024-01-01', DATE '2025-12-31', INTERVAL 1 DAY) t(d)
    WHERE isodow(d) < 6 AND d::DATE NOT IN ({_CLOSED}))"""


def _sessions(spark: SparkSession, sf_dir: str):
    """Sessions of all years in which there are events."""
    years = table(spark, sf_dir, "events").agg(F.min(F.year("ts")).alias("first"), F.max(F.year("ts")).alias("last")).first()
    return B.sessions(spark, f"{years['first']}-01-01", f"{years['last']}-12-31")


@query(
    f"""WITH {_SESSIONS}, e AS (SELECT ts::DATE AS d, count(*) AS n FROM events GROUP BY 1)
        SELECT CAST(d AS VARCHAR) AS day, close_hour, row_number() OVER (ORDER BY d) - 1 AS idx, coalesce(n, 0) AS n_events FROM s LEFT JOIN e USING (d)
        WHERE year(d) BETWEEN (SELECT min(year(ts)) FROM events) AND (SELECT max(year(ts)) FROM events)"""
)
def exchange_sessions(spark, sf_dir):
    """Sessions of the years of the events by the calendar's rules, and the events of each; the SQL lists the closures."""
    events = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("bar_date")).agg(F.count("*").alias("n"))
    days = _sessions(spark, sf_dir).join(events, "bar_date", "left")
    return days.select(F.col("bar_date").cast("string").alias("day"), "close_hour", "idx", F.coalesce("n", F.lit(0)).alias("n_events"))


@query(
    f"""WITH {_SESSIONS}, z AS (SELECT *, CASE WHEN d BETWEEN DATE '2024-03-10' AND DATE '2024-11-02' OR d BETWEEN DATE '2025-03-09' AND DATE '2025-11-01' THEN 4 ELSE 5 END AS behind FROM s
        WHERE year(d) BETWEEN (SELECT min(year(ts)) FROM events) AND (SELECT max(year(ts)) FROM events)),
        o AS (SELECT CAST(d AS VARCHAR) AS day, (close_hour - 9) * 60 - 30 AS minutes, CAST(epoch_us(d::TIMESTAMP) AS BIGINT) + (570 + behind * 60) * 60000000::BIGINT AS opens FROM z)
        SELECT day, minutes, opens, (SELECT count(*) FROM events WHERE epoch_us(ts) >= opens AND epoch_us(ts) < opens + minutes * 60000000::BIGINT) AS n_events FROM o"""
)
def session_minute_spans(spark, sf_dir):
    """Minutes of each session, the first one in UTC across changes of the clock, and the events within the session."""
    minute = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000)
    events = table(spark, sf_dir, "events").groupBy(minute.alias("m")).agg(F.count("*").alias("n"))
    minutes = B.session_minutes(_sessions(spark, sf_dir)).withColumn("m", F.floor(F.unix_micros("timestamp") / 60_000_000)).join(events, "m", "left")
    return minutes.groupBy(F.col("bar_date").cast("string").alias("day")).agg(
        F.count("*").alias("minutes"), F.min(F.unix_micros("timestamp")).alias("opens"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_events")
    )


@query(f"{BARS} SELECT ticker, bar_date, avg(close) OVER ({P} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS mean_20 FROM bars", "mean_20")
def clustered_window(spark, sf_dir):
    """A window by ticker over a bucketed, sorted table: it is planned without a shuffle."""
    name = f"clustered_{uuid.uuid4().hex}"
    K.write_clustered(daily_bars(spark, sf_dir).select("ticker", "bar_date", "close"), name, _folder(spark, name), 8)
    return spark.table(name).select("ticker", "bar_date", F.avg("close").over(W.trailing(W.ordered("ticker", "bar_date"), 20)).alias("mean_20"))


# ---- a stream


@query(f"{HOURS} SELECT * FROM bars")
def streamed_bars(spark, sf_dir):
    """The same bars as the hourly rollup, by a stream over the files that keeps a table up to date."""
    from tickloom.streaming.rollups import streamed_rollup, tick_stream, upserted

    path, source = _folder(spark, "streamed"), _folder(spark, "ticks")
    rows = ticks(spark, sf_dir).select("ticker", "ts", "id", "price")
    rows.write.parquet(source)
    upserted(streamed_rollup(tick_stream(spark, source, rows.schema, 4), "1 hour", late="400 days"), path, f"{path}-checkpoint").awaitTermination()
    return spark.read.parquet(path).drop("day").withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


def _pages(rows, folder: str, name: str, size: int) -> None:
    """Writes pages as a vendor serves them below a folder that all tasks share: {name}-{k}.json of `size` records, each with the next one's name.

    rows: name, at (place of the record, from 0), record (JSON). A page is written by the task that has its records; a task has many, one after another.
    """
    os.makedirs(folder.removeprefix("file://"), exist_ok=True)

    def write(who: str, k: int, records: list[str], last: bool) -> int:
        with open(f"{folder.removeprefix('file://')}/{who}-{k}.json", "w") as f:
            f.write(f'{{"results":[{",".join(records)}],"next_url":{"null" if last else json.dumps(f"{who}-{k + 1}.json")}}}')
        return len(records)

    def run(batches):
        held, key, n, end = [], None, 0, False
        for batch in batches:
            for who, k, record, last in zip(*(batch.column(c).to_pylist() for c in ("name", "page", "record", "last")), strict=True):
                if (who, k) != key and held:
                    n += write(*key, held, end)
                    held, end = [], False
                key = who, k
                held.append(record)
                end |= last
        if held:
            n += write(*key, held, end)
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    ends = rows.groupBy("name").agg(F.max("at").alias("end"))
    marked = rows.join(ends, "name").select("name", F.floor(F.col("at") / size).alias("page"), "at", "record", (F.col("at") == F.col("end")).alias("last"))
    marked.repartition("name", "page").sortWithinPartitions("name", "page", "at").mapInArrow(run, "n long").agg(F.sum("n")).collect()


@query(f"{BARS} SELECT ticker, bar_date, close, volume FROM bars WHERE bar_date >= DATE '1996-01-01'", "close volume")
def paged_bars(spark, sf_dir):
    """Bars read page by page as a vendor serves them, a request a ticker and a partition many requests; the date filter goes with the request."""
    folder = _folder(spark, "pages")
    bars = daily_bars(spark, sf_dir).select("ticker", "bar_date", "close", F.col("volume").cast("double"))
    at = F.row_number().over(Window.partitionBy("ticker").orderBy("bar_date")) - 1
    _pages(bars.select(F.col("ticker").alias("name"), at.alias("at"), F.to_json(F.struct("*")).alias("record")), folder, "bars", 200)
    tickers = [r["ticker"] for r in bars.select("ticker").distinct().orderBy("ticker").collect()]  # what is asked for
    rows = V.vendor_rows(spark, f"{folder}/{{tickers}}-0.json", tickers, "ticker string, bar_date date, close double, volume double", batch=1)
    return rows.where(F.col("bar_date") >= F.lit("1996-01-01").cast("date"))


@query(f"{HOURS} SELECT * FROM bars")
def message_bars(spark, sf_dir):
    """Hourly bars of messages read by number from a stream with offsets, a batch at a time."""
    from tickloom.streaming.rollups import streamed_rollup, upserted

    folder, path = _folder(spark, "messages"), _folder(spark, "message-bars")
    rows = placed(ticks(spark, sf_dir).select("ticker", "ts", "id", "price"), [], ["id"])
    message = F.to_json(F.struct("ticker", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"), "id", "price"))
    _pages(rows.select(F.lit("log").alias("name"), F.col("position").alias("at"), message.alias("record")), folder, "log", 500)
    with open(f"{folder.removeprefix('file://')}/offset.json", "w") as f:
        json.dump({"offset": rows.count()}, f)
    stream = V.message_stream(spark, f"{folder}/log-{{segment}}.json", f"{folder}/offset.json", "ticker string, ts timestamp, id bigint, price double", segment=500)
    upserted(streamed_rollup(stream, "1 hour", late="400 days"), path, f"{path}-checkpoint").awaitTermination()
    return spark.read.parquet(path).drop("day").withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query(_bucketed(1440))
def refreshed_bars(spark, sf_dir):
    """Daily bars kept by policy: every third tick comes a batch late and re-aggregates its day; the newest day is live."""
    from tickloom.streaming import refresh as R

    folder = _folder(spark, "refreshed")
    rows = ticks(spark, sf_dir).select("ticker", F.col("ts").cast("timestamp").alias("ts"), "id", "price")
    now = rows.agg(F.max("ts").alias("t")).first()["t"]
    policy = R.Policy("1 day", start=timedelta(days=400))
    for k, part in enumerate((F.col("id") % 3 != 0, F.col("id") % 3 == 0)):
        R.append(rows.where(part), k, folder, policy)
        R.refresh(spark, folder, now, policy)
    return R.live(spark, folder, now, policy).withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


# ---- small projections and joins


@query(
    """SELECT event_id, CASE WHEN event_id % 7 = 0 OR event_id % 11 = 0 THEN 0.0 ELSE value END AS clean, CASE WHEN event_id % 7 <> 0 THEN greatest(-1.0, least(1.0, (value - 50) / 20)) END AS held,
              greatest(value, user_id) AS high, least(value, user_id) AS low FROM events""",
    "clean held high low",
)
def clean_values(spark, sf_dir):
    """Null and NaN made 0, values held within bounds, extremes across columns."""
    e = table(spark, sf_dir, "events")
    odd = F.when(F.col("event_id") % 7 == 0, None).when(F.col("event_id") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    held = S.clipped(F.when(F.col("event_id") % 7 != 0, (F.col("value") - 50) / 20), -1.0, 1.0)
    wide = F.col("user_id").cast("double")
    return e.select("event_id", S.neutralised(odd).alias("clean"), held.alias("held"), F.greatest("value", wide).alias("high"), F.least("value", wide).alias("low"))


@query(f"{BARS} SELECT ticker, count(*) AS n FROM bars WHERE CAST(ticker AS INT) % 4 IN (0, 1, 2) OR ticker IN ('3', '7') GROUP BY ticker")
def tradable_bars(spark, sf_dir):
    """Bars of common stock and of regime tickers."""
    kinds = F.element_at(F.array(*[F.lit(x) for x in ("CS", "ADRC", "OS", "ETF")]), (F.col("s_suppkey") % 4 + 1).cast("int"))
    details = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("ticker"), kinds.alias("type"))
    return L.tradable(daily_bars(spark, sf_dir), details, ["3", "7"]).groupBy("ticker").agg(F.count("*").alias("n"))


@query(
    f"{BARS} SELECT CAST(bar_date AS VARCHAR) AS day, " + ", ".join(f"max({c}) FILTER (ticker = '{t}') AS t{t}_{c}" for t in "123" for c in ("close", "volume")) + " FROM bars WHERE ticker IN ('1', '2', '3') GROUP BY bar_date",
    " ".join(f"t{t}_{c}" for t in "123" for c in ("close", "volume")),
)
def wide_columns(spark, sf_dir):
    """Prefixed columns of several tickers side by side by date; raw columns that are not wanted are dropped by pattern."""
    rows = daily_bars(spark, sf_dir).where(F.col("ticker").isin("1", "2", "3")).withColumn("ticker", F.concat(F.lit("t"), "ticker"))
    wide = rows.groupBy(F.col("bar_date").cast("string").alias("day")).pivot("ticker", ["t1", "t2", "t3"]).agg(F.max("open").alias("open"), F.max("close").alias("close"), F.max("volume").alias("volume"))
    return wide.drop(*[c for c in wide.columns if c.endswith("_open")])


@query(f"{BARS} SELECT ticker, count(*) AS n FROM bars WHERE bar_date IN (SELECT bar_date FROM bars WHERE ticker = '1') GROUP BY ticker")
def aligned_times(spark, sf_dir):
    """Rows at the times that one series has."""
    bars = daily_bars(spark, sf_dir)
    times = bars.where(F.col("ticker") == "1").select("bar_date")
    return bars.join(times, "bar_date", "left_semi").groupBy("ticker").agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, o_custkey AS k FROM orders), b AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, user_id AS k FROM events)
          SELECT a.o_orderkey, b.event_id FROM a JOIN b ON a.k = b.k AND a.i = b.i""")  # fmt: skip
def positional_pairs(spark, sf_dir):
    """Rows of two tables side by side by their place within a key."""
    nth = lambda df, k, o: df.select(F.col(k).alias("k"), o, F.row_number().over(Window.partitionBy(k).orderBy(o)).alias("i"))
    return nth(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey").join(nth(table(spark, sf_dir, "events"), "user_id", "event_id"), ["k", "i"]).select("o_orderkey", "event_id")


@query(f"{BARS} SELECT DISTINCT CAST(bar_date AS VARCHAR) AS day FROM bars WHERE year(bar_date) IN (1997, 1998)")
def evaluation_window(spark, sf_dir):
    """The dates of the last two calendar years up to one."""
    dates = daily_bars(spark, sf_dir).select("bar_date").distinct()
    return M.test_window(dates, 1998, 2).select(F.col("bar_date").cast("string").alias("day"))


@query(
    f"""{BARS}, x AS MATERIALIZED (SELECT bar_date, close, ln(close) - ln(lag(close) OVER (ORDER BY bar_date)) AS r FROM bars WHERE ticker = '1'),
        v AS MATERIALIZED (SELECT bar_date, CASE WHEN count(r) OVER c = 20 THEN stddev_samp(r) OVER c END AS vol, CASE WHEN count(close) OVER a = 50 THEN avg(close) OVER a END AS m50, CASE WHEN count(close) OVER b = 200 THEN avg(close) OVER b END AS m200 FROM x
              WINDOW a AS (ORDER BY bar_date ROWS 49 PRECEDING), b AS (ORDER BY bar_date ROWS 199 PRECEDING), c AS (ORDER BY bar_date ROWS 19 PRECEDING)),
        q AS (SELECT *, CASE WHEN count(vol) OVER w = 252 THEN quantile_cont(vol, 0.5) OVER w END AS lim FROM v WINDOW w AS (ORDER BY bar_date ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING))
        SELECT CAST(bar_date AS VARCHAR) AS day, 2 * CAST(m50 > m200 AS INT) + CAST(vol > lim AS INT) AS state FROM q"""
)
def market_states(spark, sf_dir):
    """Four states of a market: trend by averages, volatility against its past."""
    return R.trend_states(daily_bars(spark, sf_dir), "1").select(F.col("bar_date").cast("string").alias("day"), "state")


@query(
    f"""{BARS}, c AS (SELECT ticker, count(*) AS n, max(abs(ln(close / p))) AS jump FROM (SELECT ticker, close, lag(close) OVER ({P}) AS p FROM bars) GROUP BY ticker)
        SELECT ticker, CASE WHEN n < 520 THEN 'skipped' WHEN jump >= 6.5 THEN 'skipped' ELSE 'ok' END AS status, CASE WHEN n < 520 THEN 'too few rows' WHEN jump >= 6.5 THEN 'discontinuous' END AS reason, n AS n_rows FROM c"""
)
def ticker_status(spark, sf_dir):
    """What becomes of each ticker: ok, or skipped and why, and its rows."""
    return L.ticker_status(daily_bars(spark, sf_dir), 520, 6.5)


@query(
    f"""{BARS}, s AS MATERIALIZED (SELECT ticker FROM (SELECT ticker, count(*) AS n, max(abs(ln(close / p))) AS jump FROM (SELECT ticker, close, lag(close) OVER ({P}) AS p FROM bars) GROUP BY ticker) WHERE n >= 520 AND NOT coalesce(jump >= 6.5, false)),
        f AS MATERIALIZED (SELECT ticker, bar_date, ln(close / (open + 1e-8)) AS intraday_return, ln(1 + volume) AS volume_log, ln(close / lag(close, 20) OVER ({P})) AS log_return_20 FROM bars WHERE ticker IN (SELECT ticker FROM s)),
        z AS MATERIALIZED (SELECT ticker, bar_date, {{intraday_return}} AS intraday_return, {{volume_log}} AS volume_log, {{log_return_20}} AS log_return_20 FROM f WINDOW w AS ({P} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
        k AS MATERIALIZED (SELECT bar_date, avg(volume_log) AS m, stddev_pop(volume_log) AS d FROM z GROUP BY bar_date)
        SELECT ticker, CAST(bar_date AS VARCHAR) AS day, intraday_return, volume_log, log_return_20, tanh((volume_log - m) / CASE WHEN d < 1e-8 THEN 1.0 ELSE d END) AS volume_log_cs_zscore FROM z JOIN k USING (bar_date)""".format(
        **{
            c: f"CASE WHEN count({c}) OVER w < 60 THEN 0.0 WHEN {c} IS NULL THEN NULL ELSE tanh((greatest(quantile_cont({c}, 0.01) OVER w, least(quantile_cont({c}, 0.99) OVER w, {c})) - avg({c}) OVER w) / greatest(stddev_samp({c}) OVER w, 1e-8)) END"
            for c in ("intraday_return", "volume_log", "log_return_20")
        }
    ),
    "intraday_return volume_log log_return_20 volume_log_cs_zscore", 4,
)
def daily_pipeline(spark, sf_dir):
    """The daily flow: gates on history and jumps, window features, normalisation over time, then across the universe."""
    from tickloom.plans.flows import daily_flow

    return daily_flow(daily_bars(spark, sf_dir), ["intraday_return", "volume_log", "log_return_20"], ["volume_log"], least_rows=520, jump=6.5, n=60, counted=trades(spark, sf_dir)).select(
        "ticker", F.col("bar_date").cast("string").alias("day"), "intraday_return", "volume_log", "log_return_20", "volume_log_cs_zscore"
    )
