"""What was known at every date: filings replayed once, in the order in which they were filed.

``pit.as_known_at`` answers for one date. Here each ticker's concept is a series of filing events that one
task streams through, in one shuffle for all concepts. An event changes the levels that it names, and of a
flow only the ladder of its fiscal year is worked out again; where the value that is known changes, an
interval ``[valid_from, valid_to)`` ends and the next begins. Any number of dates is then a filter of each
interval's dates, with no range join. What a task holds of a series are its distinct periods, not its filings.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import quarters_spanned
from ..shared import checked, written
from .pit import FLOWS, STOCKS


class Level:
    """The newest period's value, of its newest filing."""

    def __init__(self) -> None:
        self.best: tuple | None = None

    def add(self, filed, seq, end, n, fy, value) -> None:
        if value is not None and end is not None and (self.best is None or (end, filed, seq) >= self.best[0]):
            self.best = (end, filed, seq), value

    def value(self) -> float | None:
        return self.best[1] if self.best else None


class Flow:
    """The sum of the last four discrete quarters, as ``pit.quarters`` and ``pit.trailing_sums`` define them."""

    def __init__(self) -> None:
        self.direct: dict = {}  # period end: value, fiscal year and order of the first row
        self.ones: dict = {}  # fiscal year: period end: order of the first row, of direct quarters
        self.above: dict = {}  # fiscal year: quarters: the latest level and its period end
        self.derived: dict = {}  # period end: fiscal year: value
        self.given: dict = {}  # fiscal year: the period ends that its ladder gives, and their values
        self.there: list = []  # period ends with a value, sorted
        self.stale: set = set()  # ladders with events since the last value
        self.moved: set = set()  # period ends that may have come or gone since then

    def add(self, filed, seq, end, n, fy, value) -> None:
        if n is None or value is None or fy is None:
            return
        self.stale.add(fy)
        if n > 1:
            key, above = (filed, end, seq), self.above.setdefault(fy, {})
            if n not in above or key >= above[n][0]:
                above[n] = key, value
            return
        old = self.direct.get(end)
        if old is None:
            self.moved.add(end)
            fy1, seq1 = fy, seq
        else:
            _, fy1, seq1 = old
            self.stale.add(fy1)
            if seq < seq1:
                self.ones[fy1].pop(end)
                fy1, seq1 = fy, seq
        self.ones.setdefault(fy1, {})[end] = seq1
        self.direct[end] = value, fy1, seq1

    def _ladder(self, fy: float) -> dict:
        """Period ends and values of each contiguous step of a fiscal year; the step of fewer quarters comes first."""
        out: dict = {}
        below, base = 0, 0.0
        if ones := self.ones.get(fy):
            end = min((seq1, e) for e, seq1 in ones.items())[1] if len(ones) > 1 else next(iter(ones))
            below, base = 1, self.direct[end][0]
            out[end] = base
        if above := self.above.get(fy):
            for n in (2, 3, 4):
                if n in above:
                    (_, end, _), value = above[n]
                    if n - below == 1:
                        out.setdefault(end, value - base)
                    below, base = n, value
        return out

    def value(self) -> float | None:
        for fy in self.stale:
            old, new = self.given.get(fy, {}), self._ladder(fy)
            if old.keys() != new.keys():
                self.moved |= old.keys() ^ new.keys()
                for end in old.keys() - new.keys():
                    del self.derived[end][fy]
            for end, value in new.items():
                self.derived.setdefault(end, {})[fy] = value
            self.given[fy] = new
        self.stale.clear()
        there = self.there
        for end in self.moved:
            at = bisect_left(there, end)
            found = at < len(there) and there[at] == end
            if end in self.direct or self.derived.get(end):
                if not found:
                    there.insert(at, end)
            elif found:
                del there[at]
        self.moved.clear()
        if len(there) < 4:
            return None
        return sum([self.direct[e][0] if e in self.direct else self.derived[e][min(self.derived[e])] for e in there[:-5:-1]])


def _values(column: pa.Array) -> list:
    """``column`` as a list, without an Arrow scalar for each value; dates as the numbers of their days."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        coded = column.dictionary_encode()
        names = [*coded.dictionary.to_pylist(), None]
        return [names[i] for i in coded.indices.fill_null(len(names) - 1).to_numpy().tolist()]
    if pa.types.is_date32(column.type):
        column = column.cast(pa.int32())
    out = column.fill_null(0).to_numpy().tolist()
    if column.null_count:
        for i in np.flatnonzero(column.is_null().to_numpy(zero_copy_only=False)).tolist():
            out[i] = None
    return out


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by series and filing: the intervals of each series in which its value stays."""
    rows: list[tuple] = []
    key = day = state = since = known = None

    def close(until) -> None:
        """Ends the day that was open, and the interval before it if the value has changed."""
        nonlocal since, known
        now = state.value()
        if since is None:
            since, known = day, now
        elif now != known:
            rows.append((*key, known, since, day))
            since, known = day, now
        if until is None:
            rows.append((*key, known, since, None))

    def batch() -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * 5
        rows.clear()
        days = [pa.array(c, pa.int32()).cast(pa.date32()) for c in columns[3:]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.float64()))] + days, ["ticker", "concept", "value", "valid_from", "valid_to"])

    for b in batches:
        for ticker, concept, filed, seq, end, n, fy, value in zip(*map(_values, b.columns)):
            if key is None or concept != key[1] or ticker != key[0]:
                if key is not None:
                    close(None)
                key, day, since, known = (ticker, concept), filed, None, None
                state = Flow() if concept in FLOWS else Level()
            elif filed != day:
                close(filed)
                day = filed
            state.add(filed, seq, end, n, fy, value)
        if rows:
            yield batch()
    if key is not None:
        close(None)
        yield batch()


def _replayed(facts: DataFrame) -> DataFrame:
    """The intervals of every series; other concepts than levels and flows are taken as levels.

    The number of partitions is given, so that Spark doesn't join small ones: a task's work is in its rows, not its bytes.
    """
    rows = facts.where(F.col("filed").isNotNull())
    rows = rows.select("ticker", "concept", "filed", "seq", "period_end", quarters_spanned(F.col("period_start"), F.col("period_end")).alias("n"), F.col("fy").cast("double").alias("fy"), F.col("value").cast("double").alias("value"))
    parts = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = rows.repartition(parts, "ticker", "concept").sortWithinPartitions("ticker", "concept", "filed", "seq")
    return own.mapInArrow(_replay, "ticker string, concept string, value double, valid_from date, valid_to date")


def intervals(facts: DataFrame) -> DataFrame:
    """``ticker, concept, value, valid_from, valid_to`` of levels and of flows' trailing sums; the last has no end.

    Rows without a filing date are never known. A row that no one uses (no value, period or fiscal year)
    still begins its series, with NULL.
    """
    return _replayed(facts.where(F.col("concept").isin(*STOCKS, *FLOWS)))


def on_dates(known: DataFrame, dates: DataFrame) -> DataFrame:
    """``t, ticker, concept, value``: intervals at each ``t`` of ``dates``, a calendar that fits one row."""
    days = dates.select("t").distinct().agg(F.array_sort(F.collect_set("t")).alias("_days"))
    inside = F.filter("_days", lambda d: (d >= F.col("valid_from")) & (F.col("valid_to").isNull() | (d < F.col("valid_to"))))
    return known.crossJoin(F.broadcast(days)).select(F.explode(inside).alias("t"), "ticker", "concept", "value")


def as_known_on(facts: DataFrame, dates: DataFrame) -> DataFrame:
    """``t``, and the row of ``pit.as_known_at`` for each ticker with facts filed by then, for all ``dates`` in one pass.

    ``facts`` and ``dates`` are computed once each: intervals and dates are written, and all else begins there.
    """
    columns = [*STOCKS, *FLOWS]
    days = written(dates.select("t").distinct(), "dates")
    known = written(_replayed(facts), "intervals")  # facts of other concepts make a ticker known too
    wide = on_dates(known.where(F.col("concept").isin(*columns)), days).groupBy("t", "ticker").agg(*[F.max(F.when(F.col("concept") == c, F.col("value"))).alias(c if c in STOCKS else f"{c}_ttm") for c in columns])
    began = known.groupBy("ticker").agg(F.min("valid_from").alias("began"))
    there = began.join(checked(days), F.col("t") >= F.col("began")).select("t", "ticker")
    return there.join(wide, ["t", "ticker"], "left")
