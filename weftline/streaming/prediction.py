"""Forecasts of a stream of rows, with the trailing state of each series.

The batch form is ``comparison.interval_schemes`` (scheme shrunk252) with the
rank among earlier predictions and the shrunk event rate; both give equal rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "asset string, date date, predicted double, residuals long, bound0 double, bound1 double, bound2 double, bound3 double, rank double, prior double"
_STATE = "last date, ratios array<double>, predictions array<double>, events array<long>"
_POINTS = (0.1, 0.25, 0.75, 0.9)


def _half_up(x: float, digits: int) -> float:
    scale = 10.0**digits
    return float(np.floor(x * scale + 0.5) / scale)


class Trailing:
    """What the last n rows of a series say about the next."""

    def __init__(self, known: tuple | None, common: tuple[float, ...], base_rate: float, n: int = 252, least: int = 60, pull: float = 100.0):
        self.common, self.base_rate, self.n, self.least, self.pull = common, base_rate, n, least, pull
        self.last, ratios, predictions, events = known or (None, [], [], [])
        self.ratios, self.predictions, self.events = list(ratios), list(predictions), list(events)

    @property
    def state(self) -> tuple:
        return self.last, self.ratios, self.predictions, self.events

    def forecast(self, predicted: float) -> tuple:
        """residuals, bounds, rank (null before n predictions) and prior for the next row."""
        held = [x for x in self.ratios if x == x]
        k = len(held)
        if k >= self.least:
            share = k / (k + self.pull)
            quantiles = [share * _half_up(float(q), 10) + (1.0 - share) * g for q, g in zip(np.quantile(held, _POINTS), self.common, strict=True)]
        else:
            quantiles = self.common
        full = len(self.predictions) == self.n
        rank = _half_up(bisect_right(sorted(self.predictions), predicted) * 100.0 / self.n, 6) if full else None
        known = [e for e in self.events if e >= 0]
        prior = (sum(known) + self.pull * self.base_rate) / (len(known) + self.pull)
        return k, *(_half_up(q * predicted, 6) for q in quantiles), rank, _half_up(prior, 6)

    def add(self, day, predicted: float, actual: float | None, event: int | None) -> None:
        """A row whose outcome is known (or never will be, null)."""
        self.last = day
        known = actual is not None and actual == actual
        self.ratios = [*self.ratios, _half_up(actual / max(predicted, 0.01), 8) if known else float("nan")][-self.n :]
        self.predictions = [*self.predictions, predicted][-self.n :]
        self.events = [*self.events, int(event) if event is not None and event == event else -1][-self.n :]


def stream_forecasts(rows: DataFrame, common: tuple[float, ...], base_rate: float, n: int = 252, least: int = 60, pull: float = 100.0) -> DataFrame:
    """A forecast (OUTPUT) for each row of a stream of asset, date, predicted, y, event.

    Of each series the state holds its last date, and the last n ratios of outcome
    to prediction, predictions and events. A batch's rows of a series are taken in
    the order of their dates; a row that is not later than the last one seen is a
    repeated one and ignored, so a source that delivers twice changes nothing.
    common: quantiles known before the stream; base_rate: what priors are shrunk to.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = Trailing(state.get if state.exists else None, common, base_rate, n, least, pull)
        out = []
        for r in pd.concat(list(batches)).sort_values("date", kind="stable").itertuples(index=False):
            if held.last is None or r.date > held.last:
                out.append((key[0], r.date, r.predicted, *held.forecast(r.predicted)))
                held.add(r.date, r.predicted, r.y, r.event)
        state.update(held.state)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")]).astype({"rank": float})

    return rows.groupBy("asset").applyInPandasWithState(run, OUTPUT, _STATE, "append", GroupStateTimeout.NoTimeout)
