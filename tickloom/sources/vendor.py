"""Vendor data over HTTP as Spark sources: paged batch reads and a replayable stream of messages.

    spark.dataSource.register(VendorSource)
    spark.read.format("vendor").schema(SPLITS).option("url", "https://host/splits?ticker={tickers}&gte={start}").option("tickers", "A,B").load()

Batch: a request asks for `batch` tickers; requests are dealt into partitions (dealt()), so pages are fetched by executors side by side. A page is a JSON object with
`results` and, unless it is the last, `next_url` (absolute, or relative to the page). Failed requests (no answer, half an
answer, status 429 or 5xx) are tried again, `retries` times, after waits that double; other errors end the query. Filters on
`ticker` leave out tickers before anything is fetched, filters on the date column fill {start} and {end}; Spark applies
all filters again. Pages become Arrow batches one by one, so a partition holds one page at a time.

Stream: messages are numbered. `offset_url` gives {"offset": number of messages so far}; message k is record k mod `segment` of the page of
`url` with {segment} = k div `segment`. A batch is a range of numbers, so a batch that runs again after a failure reads the
same messages. At most `most` messages a batch once the stream knows where it is.

url may be http(s) or file, with {tickers}, {start}, {end} or {segment} in it. The token, if any, is sent as a bearer token.
"""

from __future__ import annotations

import datetime
import http.client
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import DateType, StructType, TimestampNTZType, TimestampType

AGGREGATES = "ticker string, timestamp bigint, open double, high double, low double, close double, transactions bigint, volume double, vwap double"
SPLITS = "ticker string, execution_date date, split_from double, split_to double"
EVENTS = "current_ticker string, names array<struct<date: date, name: string>>"
#: The most requests of a partition, and how many partitions there are before they get more than one.
REQUESTS, SIDE_BY_SIDE = 128, 64
FLOOR, CEILING = "0001-01-01", "9999-12-31"


def fetched(url: str, token: str = "", retries: int = 5, wait: float = 0.5, timeout: float = 30.0) -> dict:
    """The JSON object at url; a path without a scheme is a file."""
    url = url if ":" in url.split("/", 1)[0] else f"file://{url}"
    for attempt in range(retries + 1):
        try:
            request = urllib.request.Request(url, headers={"Authorization": f"Bearer {token}"} if token else {})
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                return json.loads(answer.read())
        except urllib.error.HTTPError as e:
            if e.code != 429 and e.code < 500 or attempt == retries:
                raise
        except (OSError, ValueError, http.client.HTTPException):  # no connection, a broken one, or half a page
            if attempt == retries:
                raise
        time.sleep(wait * 2**attempt)
    raise AssertionError


def pages(url: str, **how) -> Iterator[list[dict]]:
    """Records of the page at url and of those that follow it."""
    while url:
        page = fetched(url, **how)
        yield page.get("results") or []
        url = urllib.parse.urljoin(url, page["next_url"]) if page.get("next_url") else ""


def _arrow(records: list[dict], schema: StructType) -> Iterator[pa.RecordBatch]:
    from pyspark.sql.pandas.types import to_arrow_schema

    def plain(value, kind):
        if value is None:
            return None
        if isinstance(kind, DateType):
            return datetime.date.fromisoformat(value[:10])
        if isinstance(kind, (TimestampType, TimestampNTZType)):
            at = datetime.datetime.fromisoformat(value) if isinstance(value, str) else datetime.datetime.fromtimestamp(value / 1000, datetime.UTC)
            return at if isinstance(kind, TimestampType) else at.replace(tzinfo=None)
        if hasattr(kind, "elementType"):
            return [plain(v, kind.elementType) for v in value]
        if isinstance(kind, StructType):
            return {f.name: plain(value.get(f.name), f.dataType) for f in kind.fields}
        return value

    rows = [{f.name: plain(r.get(f.name), f.dataType) for f in schema.fields} for r in records]
    if rows:
        yield from pa.Table.from_pylist(rows, to_arrow_schema(schema)).to_batches()


class _Options:
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.options = schema, options
        self.how = {"token": options.get("token", ""), "retries": int(options.get("retries", 5)), "wait": float(options.get("wait", 0.5)), "timeout": float(options.get("timeout", 30))}


def dealt(requests: list) -> list[InputPartition]:
    """Partitions of requests that follow each other: one each while they are few, up to REQUESTS where there are many, which a task makes one after another."""
    size = max(1, min(REQUESTS, len(requests) // SIDE_BY_SIDE))
    return [InputPartition(requests[k : k + size]) for k in range(0, len(requests), size)]


class VendorReader(_Options, DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        super().__init__(schema, options)
        self.tickers = list(dict.fromkeys(t for t in options["tickers"].split(",") if t))
        self.date = options.get("date", "bar_date").lower()
        self.start, self.end = options.get("start", FLOOR), options.get("end", CEILING)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[-1].lower() if hasattr(f, "attribute") else ""
            if name == "ticker" and isinstance(f, (EqualTo, In)):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.tickers = [t for t in self.tickers if t in wanted]
            elif name == self.date and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.start = max(self.start, str(f.value)[:10])
            if name == self.date and isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                self.end = min(self.end, str(f.value)[:10])
            yield f  # Spark applies all of them again

    def partitions(self) -> list[InputPartition]:
        size = int(self.options.get("batch", 100))
        return dealt([self.tickers[k : k + size] for k in range(0, len(self.tickers), size)])

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        for batch in partition.value or []:
            names = urllib.parse.quote(",".join(batch), safe=",")
            for records in pages(self.options["url"].format(tickers=names, start=self.start, end=self.end), **self.how):
                yield from _arrow(records, self.schema)


class VendorStream(_Options, DataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        super().__init__(schema, options)
        self.size, self.most = int(options.get("segment", 1000)), int(options.get("most", 1 << 62))
        self.at: int | None = None

    def initialOffset(self) -> dict:
        self.at = int(self.options.get("from", 0))
        return {"n": self.at}

    def latestOffset(self) -> dict:
        n = int(fetched(self.options["offset_url"], **self.how)["offset"])
        return {"n": n if self.at is None else max(self.at, min(n, self.at + self.most))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        low, high = start["n"], end["n"]
        self.at = high
        return dealt([(s, max(low, s * self.size), min(high, (s + 1) * self.size)) for s in range(low // self.size, -(-high // self.size))])

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        for segment, low, high in partition.value:
            page = fetched(self.options["url"].format(segment=segment), **self.how)["results"]
            records = page[low - segment * self.size : high - segment * self.size]
            if len(records) != high - low:
                raise ValueError(f"segment {segment} has lost messages {low} to {high}")
            yield from _arrow(records, self.schema)

    def commit(self, end: dict) -> None:
        self.at = end["n"]


class VendorSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vendor"

    def schema(self) -> str:
        return AGGREGATES

    def reader(self, schema: StructType) -> VendorReader:
        return VendorReader(schema, self.options)

    def streamReader(self, schema: StructType) -> VendorStream:
        return VendorStream(schema, self.options)


def vendor_rows(spark: SparkSession, url: str, tickers: list[str], schema: str, **options) -> DataFrame:
    """Rows of all tickers, each column by the name it has in the records."""
    spark.dataSource.register(VendorSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("vendor").schema(schema).options(url=url, tickers=",".join(tickers), **options).load()


def vendor_bars(spark: SparkSession, url: str, tickers: list[str], **options) -> DataFrame:
    """Aggregates with their timestamps (milliseconds) as such."""
    return vendor_rows(spark, url, tickers, AGGREGATES, **options).withColumn("timestamp", F.timestamp_millis("timestamp"))


def vendor_splits(spark: SparkSession, url: str, tickers: list[str], **options) -> DataFrame:
    from tickloom.sources.bars import with_effective_ratio

    return with_effective_ratio(vendor_rows(spark, url, tickers, SPLITS, date="execution_date", **options))


def vendor_renames(spark: SparkSession, url: str, tickers: list[str], **options) -> DataFrame:
    """current_ticker, previous_ticker, change_date of the names that each ticker has had."""
    from tickloom.sources.bars import rename_pairs

    return rename_pairs(vendor_rows(spark, url, tickers, EVENTS, **{"batch": 1, **options}))


def cached_splits(spark: SparkSession, url: str, tickers: list[str], path: str, **options) -> DataFrame:
    """Splits of tickers from the cache at path; only tickers that it doesn't know are fetched and appended, those without a split as a row of nulls."""
    known = spark.read.schema(f"{SPLITS}, effective_ratio double").parquet(path) if _there(spark, path) else spark.createDataFrame([], f"{SPLITS}, effective_ratio double")
    asked = spark.createDataFrame([(t,) for t in tickers], "ticker string").distinct()
    new = [r["ticker"] for r in asked.join(known.select("ticker").distinct(), "ticker", "left_anti").collect()]  # at most the tickers asked for
    if new:
        fresh = vendor_splits(spark, url, sorted(new), **options)
        spark.createDataFrame([(t,) for t in new], "ticker string").join(fresh, "ticker", "left").select(known.columns).write.mode("append").parquet(path)
    held = spark.read.schema(f"{SPLITS}, effective_ratio double").parquet(path) if _there(spark, path) else known
    return held.join(asked, "ticker", "left_semi").where("execution_date is not null")


def _there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def message_stream(spark: SparkSession, url: str, offset_url: str, schema: str, **options) -> DataFrame:
    spark.dataSource.register(VendorSource)
    return spark.readStream.format("vendor").schema(schema).options(url=url, offset_url=offset_url, **options).load()
