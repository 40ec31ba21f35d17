"""All checks of a table of bars in one scan: partial results that merge, from tasks over ranges of (ticker, date).

A task reads its range once, in order, and returns for each column counts, shifted power sums and the largest loss of a float, for each
column and year counts and sums, and for each ticker in the range its edges: rows, nulls at either end and in all, first and
last close, jumps, last valid date, and the products of all pairs of columns. Edges of a ticker that spans several ranges are
merged in order of the ranges (a row a range), so a ticker of any length is as many tasks as ranges. What is merged is small:
a row for each (range, ticker), (range, column, year).
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.gram import pearson, products, shifts
from tickloom.operators.lifecycle import HALF_JUMP, JUMP
from tickloom.operators.scan import materialised

PARTIAL = "kind string, subject string, year int, part int, valid_until date, values array<double>"
ROW = "check string, subject string, severity string, value double"
_NAMES = [c.split()[0] for c in PARTIAL.split(", ")]
_TYPES = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.date32(), pa.list_(pa.float64())]


class _Ticker:
    """Edges of one ticker's rows in a range: n, nulls in front, nulls at the end, nulls, first and last close, suspicious and critical jumps, then products."""

    def __init__(self, width: int):
        self.n = self.lead = self.trail = self.null = self.suspicious = self.critical = 0
        self.first = self.last = np.nan
        self.valid_until: date | None = None
        self.sums = np.zeros((6, width, width))

    def add(self, close: np.ndarray, dates: np.ndarray, x: np.ndarray, limits: tuple[float, float]) -> None:
        null = np.isnan(close)
        some = np.flatnonzero(~null)
        if not self.n:
            self.first = close[0]
        if self.lead == self.n:
            self.lead += int(some[0]) if len(some) else len(close)
        self.trail = int(len(close) - 1 - some[-1]) if len(some) else self.trail + len(close)
        self.n += len(close)
        self.null += int(null.sum())
        found = jumps(np.concatenate([[self.last], close]), limits)
        self.suspicious += found[0]
        self.critical += found[1]
        self.last = close[-1]
        valid = np.flatnonzero(close > 0)
        if len(valid):
            self.valid_until = dates[valid[-1]]
        self.sums += products(x, x)

    def values(self) -> list[float]:
        return [self.n, self.lead, self.trail, self.null, self.first, self.last, self.suspicious, self.critical, *self.sums.ravel()]


def jumps(close: np.ndarray, limits: tuple[float, float]) -> tuple[int, int]:
    with np.errstate(invalid="ignore", divide="ignore"):
        r = np.abs(np.diff(np.log(np.where(close > 0, close, np.nan))))
    return int(((r >= limits[0]) & (r < limits[1])).sum()), int((r >= limits[1]).sum())


def partials(bars: DataFrame, columns: list[str], saturated: float = 0.99, limits: tuple[float, float] = (HALF_JUMP, JUMP)) -> DataFrame:
    """PARTIAL rows of bars (ticker, bar_date, close and columns)."""
    shift = shifts(bars, columns)
    names = list(dict.fromkeys([*columns, "close"]))
    rows = bars.select("ticker", "bar_date", *[F.col(c).cast("double").alias(c) for c in names]).repartitionByRange("ticker", "bar_date").sortWithinPartitions("ticker", "bar_date")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        by_column = np.zeros((len(columns), 9))
        loss = np.full(len(columns), -1.0)
        by_year: dict[int, np.ndarray] = {}
        held: dict[str | None, _Ticker] = {}

        def told(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)

        def of_ticker() -> list[tuple]:
            out = [("ticker", t, None, part, v.valid_until, v.values()) for t, v in held.items()]
            held.clear()
            return out

        for batch in batches:
            if not len(batch):
                continue
            there = [batch.column(2 + k).is_valid().to_numpy(zero_copy_only=False) for k in range(len(names))]
            raw = np.stack([batch.column(2 + k).to_numpy(zero_copy_only=False).astype(float) for k in range(len(columns))], 1)
            known = np.stack(there[: len(columns)], 1)
            good = known & np.isfinite(raw)
            x = np.where(good, raw - shift, np.nan)
            z = np.where(good, x, 0.0)
            with np.errstate(invalid="ignore", over="ignore"):
                lost = np.abs(raw - raw.astype(np.float32).astype(float))
                by_column += np.stack([(~known).sum(0), (known & np.isnan(raw)).sum(0), (known & np.isinf(raw)).sum(0), good.sum(0), z.sum(0), (z * z).sum(0), (z**3).sum(0), (known & (np.abs(raw) > saturated)).sum(0), known.sum(0)], 1)
            loss = np.maximum(loss, np.where(good, lost, -1.0).max(0, initial=-1.0))
            dates = batch.column(1).to_numpy(zero_copy_only=False)
            years = dates.astype("datetime64[Y]").astype(int) + 1970
            for y in np.unique(years):
                m = years == y
                by_year[int(y)] = by_year.get(int(y), 0) + np.stack([good[m].sum(0), z[m].sum(0), (z[m] ** 2).sum(0)], 1)
            close = batch.column(2 + names.index("close")).to_numpy(zero_copy_only=False).astype(float)
            tickers = batch.column(0).to_pylist()
            starts = [0, *[k for k in range(1, len(tickers)) if tickers[k] != tickers[k - 1]], len(tickers)]
            days = batch.column(1).to_pylist()
            for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                if tickers[lo] not in held and held:
                    yield told(of_ticker())
                held.setdefault(tickers[lo], _Ticker(len(columns))).add(close[lo:hi], days[lo:hi], x[lo:hi], limits)
        rest = of_ticker() + [("column", c, None, part, None, [*by_column[k], loss[k]]) for k, c in enumerate(columns)]
        rest += [("year", c, y, part, None, list(v[k])) for y, v in by_year.items() for k, c in enumerate(columns)]
        yield told(rest)

    return materialised(rows.mapInArrow(run, PARTIAL))


def audit(bars: DataFrame, columns: list[str], active_days: int = 30, drift: float = 0.5, least: int = 10, collinear: float = 0.95, tolerance: float = 1e-6, share: float = 0.05, limits: tuple[float, float] = (HALF_JUMP, JUMP)) -> DataFrame:
    """(check, subject, severity, value) of all checks that found something; the table is scanned once."""
    columns = sorted(columns)
    found = partials(bars, columns, limits=limits)
    at = lambda k: F.sum(F.col("values")[k])
    row = lambda check, subject, severity, value: [F.lit(check).alias("check"), subject.alias("subject"), F.lit(severity).alias("severity"), value.cast("double").alias("value")]

    sums = found.where("kind = 'column'").groupBy("subject").agg(at(0).alias("n_null"), at(1).alias("n_nan"), at(2).alias("n_inf"), at(7).alias("high"), at(8).alias("known"), F.max(F.col("values")[9]).alias("loss"))
    subject = F.col("subject")
    bad = F.col("n_null") + F.col("n_nan") + F.col("n_inf")
    saturation = F.try_divide("high", "known")
    loss = F.when(F.col("loss") >= 0, F.col("loss"))
    out = [
        sums.where(bad > 0).select(*row("missing", subject, "warning", bad)),
        sums.where(saturation > share).select(*row("saturation", subject, "info", saturation)),
        sums.where(F.coalesce(loss <= tolerance, F.lit(True))).select(*row("downcast", subject, "info", loss)),
    ]

    years = found.where("kind = 'year'").groupBy("subject", "year").agg(at(0).alias("n"), at(1).alias("s"), at(2).alias("ss")).where(F.col("n") >= least)
    mean, deviation = F.col("s") / F.col("n"), F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col("ss") - F.col("s") * F.col("s") / F.col("n"), F.col("n") - 1)))
    w = Window.partitionBy("subject").orderBy("year")
    before = lambda c: F.when(F.lag("year").over(w) == F.col("year") - 1, F.lag(c).over(w))
    moved = years.withColumns({"m": mean, "d": deviation}).withColumns({"pm": before("m"), "pd": before("d")}).where("pm is not null")
    beyond = (F.try_divide(F.abs(F.col("m") - F.col("pm")), "pd") > drift) | (F.try_divide(F.abs(F.col("d") - F.col("pd")), "pd") > drift)
    drifted = moved.where(F.coalesce(beyond, F.lit(False))).groupBy("subject").agg(F.count("*").alias("years")).where("years >= 2")
    out.append(drifted.select(*row("drift", subject, "warning", F.col("years"))))

    p = len(columns)
    pairs = [(i, j) for i in range(p) for j in range(i + 1, p)]

    def merged(table: pa.Table) -> pa.Table:
        """Checks of one ticker from its ranges in order."""
        table = table.sort_by("part")
        v = np.array(table.column("values").to_pylist())
        n, lead, trail, null, first, last, suspicious, critical = v[:, :8].T
        whole = lead == n
        front = int(n[: np.argmin(whole)].sum() + lead[np.argmin(whole)]) if not whole.all() else int(n.sum())
        back = int(n[::-1][: np.argmin(whole[::-1])].sum() + trail[::-1][np.argmin(whole[::-1])]) if not whole.all() else 0
        inside = int(null.sum()) - front - back
        between = [jumps(np.array([a, b]), limits) for a, b in zip(last[:-1], first[1:], strict=True)]
        counts = [int(suspicious.sum()) + sum(b[0] for b in between), int(critical.sum()) + sum(b[1] for b in between)]
        name = table.column("subject")[0].as_py()
        _, r = pearson(v[:, 8:].sum(0).reshape(6, p, p))
        until = [d for d in table.column("valid_until").to_pylist() if d is not None]
        rows = [("interior nulls", name, "critical", float(inside), None)] if inside > 0 else []
        rows += [("discontinuity", name, s, float(c), None) for s, c in zip(("suspicious", "critical"), counts, strict=True) if c]
        rows += [("collinear", f"{columns[i]}|{columns[j]}", "info", 1.0, None) for i, j in pairs if abs(r[i, j]) >= collinear]
        rows.append(("delisted", name, "info", 1.0, max(until) if until else None))
        types = [pa.string(), pa.string(), pa.string(), pa.float64(), pa.date32()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["check", "subject", "severity", "value", "until"])

    tickers = materialised(found.where("kind = 'ticker'").groupBy("subject").applyInArrow(merged, f"{ROW}, until date"))
    end = tickers.agg(F.max("until").alias("end"))  # one row
    gone = tickers.where("check = 'delisted'").withColumn("one", F.lit(1)).join(F.broadcast(end.withColumn("one", F.lit(1))), "one").where(F.datediff("end", "until") > active_days)
    plain = [c.split()[0] for c in ROW.split(", ")]
    out += [
        gone.select(plain),
        tickers.where("check in ('interior nulls', 'discontinuity')").select(plain),
        tickers.where("check = 'collinear'").groupBy("check", "subject", "severity").agg(F.sum("value").alias("value")).select(plain),
    ]
    union = out[0]
    for part in out[1:]:
        union = union.unionByName(part)
    return union
