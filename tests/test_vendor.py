"""Paged reads and the message stream against a server in this process that fails now and then."""

import json
import threading
import zlib
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from tickloom.sources import vendor


class Server:
    """Pages of `size` records; every third request fails: by status, by half a page, or by a closed connection."""

    def __init__(self):
        self.records: dict[str, list[dict]] = {}
        self.messages: list[dict] = []
        self.size, self.served, self.tried, self.asked, self.failing = 3, Counter(), Counter(), [], True
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                with outer.lock:
                    outer.tried[self.path] += 1
                    n = outer.tried[self.path]
                at, ask = urlparse(self.path), {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
                if at.path == "/gone":
                    return self.send_error(404)
                if outer.failing and n <= zlib.crc32(self.path.encode()) % 3:
                    if n == 1:
                        return self.send_error(503)
                    self.send_response(200)
                    self.send_header("Content-Length", "5")
                    self.end_headers()
                    return self.wfile.write(b'{"re')
                if at.path == "/offset":
                    body = {"offset": len(outer.messages)}
                elif at.path == "/log":
                    k = int(ask["segment"])
                    body = {"results": outer.messages[k * 4 : (k + 1) * 4]}
                else:
                    outer.asked.append(ask)
                    rows = [r for t in ask["tickers"].split(",") for r in outer.records.get(t, []) if ask.get("start", "") <= r.get("execution_date", "~")]
                    low = int(ask.get("cursor", 0))
                    body = {"results": rows[low : low + outer.size]}
                    if low + outer.size < len(rows):
                        body["next_url"] = f"/rows?tickers={ask['tickers']}&start={ask.get('start', '')}&cursor={low + outer.size}"
                outer.served[self.path] += 1
                data = json.dumps(body).encode()
                self.send_response(200)
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            def log_message(self, *args):
                pass

        self.lock = threading.Lock()
        self.http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.url = f"http://127.0.0.1:{self.http.server_port}"
        threading.Thread(target=self.http.serve_forever, daemon=True).start()


@pytest.fixture
def server():
    got = Server()
    yield got
    got.http.shutdown()


def splits_of(n):
    return {f"T{k}": [{"ticker": f"T{k}", "execution_date": f"20{10 + j:02d}-01-05", "split_from": 1, "split_to": j + 2} for j in range(k % 5)] for k in range(n)}


def test_pages_are_each_fetched_once(spark, server):
    server.records = splits_of(23)
    got = vendor.vendor_splits(spark, f"{server.url}/rows?tickers={{tickers}}&start={{start}}", [*server.records, "T3"], batch=4, wait=0.01).collect()
    want = [(r["ticker"], r["execution_date"], float(r["split_to"])) for rows in server.records.values() for r in rows]
    assert sorted((r["ticker"], str(r["execution_date"]), r["effective_ratio"]) for r in got) == sorted(want)
    assert set(server.served.values()) == {1} and len(server.served) >= 12 and max(server.tried.values()) > 1


def test_filters_reach_the_vendor(spark, server):
    server.records = splits_of(23)
    rows = vendor.vendor_splits(spark, f"{server.url}/rows?tickers={{tickers}}&start={{start}}", list(server.records), batch=1, wait=0.01)
    got = rows.where(F.col("ticker").isin("T4", "T9") & (F.col("execution_date") >= F.lit("2012-01-01").cast("date"))).collect()
    assert sorted((r["ticker"], str(r["execution_date"])) for r in got) == [(t, d) for t in ("T4", "T9") for d in ("2012-01-05", "2013-01-05")]
    assert {a["tickers"] for a in server.asked} == {"T4", "T9"} and {a["start"] for a in server.asked} == {"2012-01-01"}


def test_what_is_cached_is_not_asked_for(spark, server, tmp_path):
    server.records, server.failing = splits_of(8), False
    ask = lambda names: vendor.cached_splits(spark, f"{server.url}/rows?tickers={{tickers}}", names, f"{tmp_path}/cache", batch=2, wait=0.01)
    assert ask(["T0", "T1", "T2"]).count() == 3
    assert ask(["T2", "T3", "T0"]).count() == 5  # T0 has no split and is known to have none
    assert Counter(t for a in server.asked for t in a["tickers"].split(",") if "cursor" not in a) == Counter(["T0", "T1", "T2", "T3"])


def test_bars_renames_and_errors(spark, server):
    server.records = {"A": [{"ticker": "A", "timestamp": 86_400_000 * k, "open": 1, "close": 2.5, "volume": None} for k in range(7)]}
    bars = vendor.vendor_bars(spark, f"{server.url}/rows?tickers={{tickers}}", ["A", "B"], wait=0.01).orderBy("timestamp").collect()
    assert len(bars) == 7 and bars[1]["timestamp"].day == 2 and bars[0]["open"] == 1.0 and bars[0]["volume"] is None and bars[0]["vwap"] is None
    server.records = {"N": [{"current_ticker": "N", "names": [{"date": "2015-01-01", "name": "O"}, {"date": "2020-02-02", "name": "N"}]}]}
    assert [(r["previous_ticker"], str(r["change_date"])) for r in vendor.vendor_renames(spark, f"{server.url}/rows?tickers={{tickers}}", ["N"], wait=0.01).collect()] == [("O", "2020-02-02")]
    with pytest.raises(Exception, match="404"):
        vendor.vendor_bars(spark, f"{server.url}/gone", ["A"], wait=0.01).collect()


def test_a_stream_that_dies_between_batches_loses_nothing(spark, server, tmp_path):
    """Messages arrive while the stream is down, a batch fails after writing; the table of bars equals the batch rollup."""
    from tickloom.operators.rollup import rollup
    from tickloom.streaming.rollups import streamed_rollup, upserted

    tick = lambda k: {"ticker": f"T{k % 3}", "ts": f"2024-01-0{1 + k % 4}T0{k % 10}:1{k % 6}:00+00:00", "id": k, "price": float(k * 7 % 11)}
    schema = "ticker string, ts timestamp, id bigint, price double"
    ticks = lambda: vendor.message_stream(spark, f"{server.url}/log?segment={{segment}}", f"{server.url}/offset", schema, segment=4, wait=0.01)
    run = lambda **how: upserted(streamed_rollup(ticks(), "1 hour"), f"{tmp_path}/bars", f"{tmp_path}/cp", **how).awaitTermination()
    server.messages = [tick(k) for k in range(10)]
    run()
    server.messages += [tick(k) for k in range(10, 27)]

    def broken(batch, batch_id):
        batch.count()
        raise ValueError("killed")

    dead = streamed_rollup(ticks(), "1 hour").writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").foreachBatch(broken).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="killed"):
        dead.awaitTermination()
    server.messages += [tick(k) for k in range(27, 40)]
    run()
    run()
    got = spark.read.parquet(f"{tmp_path}/bars").drop("day")
    want = rollup(vendor_ticks(spark, server.messages, schema), "1 hour")
    assert got.count() == want.count() and got.select(want.columns).exceptAll(want).count() == 0


def vendor_ticks(spark, messages, schema):
    return spark.createDataFrame([(m["ticker"], m["ts"], m["id"], m["price"]) for m in messages], schema.replace("timestamp", "string")).withColumn("ts", F.col("ts").cast("timestamp"))
