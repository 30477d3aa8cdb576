"""Streaming operators over the live metric stream.

State is kept per (scenario, cell, slice), or per cell, and bounded: 60 rows of history, 64 samples
in the replay buffer, one parameter vector. What reports after every micro-batch runs on the rows
of one key of that batch; controllers and learners work on whole periods of event time.
"""

from __future__ import annotations

import hashlib
import math
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from slicewise import dims
from slicewise.operators import allocate as A
from slicewise.operators import live as L
from slicewise.operators.federated import federated_average
from slicewise.sinks.documents import allocation_document

# processors travel as they are: the worker that Spark starts beside the driver for them has no
# packages that were shipped to executors
cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEYS = ["scenario", "gnb", "slice"]
EPOCH = 1704067200
#: Watermark, and the seconds of event time after which the state of an ended series goes.
LATENESS, IDLE = "30 seconds", 3600
NEVER = -(1 << 62)
# fixed values of the learner
BUFFER = 64
BATCH = 8
PERIOD = 15
RATE = 1e-5
CLIP = 1.0
ROUND_EVERY = 5


def event_time(stream: DataFrame) -> DataFrame:
    """One simulated second is one second after 2024-01-01."""
    return stream.withColumn("ts", F.timestamp_seconds(F.lit(EPOCH) + F.col("simtime_s")))


def tumbling_kpi(stream: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Per period and series: means and row count. Rows later than two periods are dropped."""
    agg = (event_time(stream).withWatermark("ts", lateness)
           .groupBy(F.window("ts", f"{PERIOD} seconds").alias("w"), *KEYS)
           .agg(F.avg("avg_latency_ms").alias("lat"), F.avg("throughput_mbps").alias("thr"),
                F.count("*").alias("n_rows")))
    return agg.select(*KEYS, (F.unix_timestamp("w.start") - EPOCH).alias("period_start"),
                      "lat", "thr", "n_rows")


def _timed(stream: DataFrame, *columns: str) -> DataFrame:
    """Rows with their event time and a watermark, which ends the state of series that stopped."""
    return event_time(stream).withWatermark("ts", LATENESS).select(*KEYS, "ts", *columns)


def _keep(state: GroupState, value: tuple, last_second: float) -> None:
    """Stores the state until ``IDLE`` seconds of event time after its newest row."""
    state.update(value)
    due = int((EPOCH + last_second + IDLE) * 1000)
    state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1000))


def latest(stream: DataFrame) -> DataFrame:
    """After every micro-batch, the newest row of each series with new rows."""
    cols = ["simtime_s", "avg_latency_ms", "throughput_mbps", "pkt_count"]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        old = pd.DataFrame([state.get] if state.exists else [], columns=cols).astype(
            {"pkt_count": "int64", **{c: float for c in cols[:3]}})
        row = _newest(batches, old, 1).iloc[0]
        value = tuple(float(row[c]) for c in cols[:3]) + (int(row["pkt_count"]),)
        _keep(state, value, value[0])
        yield pd.DataFrame([[*key, *value]], columns=[*KEYS, *cols])

    schema = "simtime_s double, avg_latency_ms double, throughput_mbps double, pkt_count bigint"
    return _timed(stream, *cols).groupBy(*KEYS).applyInPandasWithState(
        step, f"scenario string, gnb string, slice string, {schema}", schema,
        "append", GroupStateTimeout.EventTimeTimeout)


def _newest(batches: Iterator[pd.DataFrame], old: pd.DataFrame, n: int) -> pd.DataFrame:
    """The newest ``n`` rows of the kept ones and the arriving chunks; never holds more than
    one chunk beside them."""
    for pdf in batches:
        both = pd.concat([old, pdf[old.columns]]) if len(old) else pdf[old.columns]
        old = both.sort_values("simtime_s", kind="stable").tail(n)
    return old


def history(stream: DataFrame, n: int = dims.HISTORY, recent: int = L.RECENT) -> DataFrame:
    """After every micro-batch, per series with new rows: length of the kept history, whether
    it is full, and the means of the newest rows."""
    cols = ["simtime_s", "avg_latency_ms", "throughput_mbps"]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
             ) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        old = dict(zip(cols, state.get)) if state.exists else {c: [] for c in cols}
        kept = _newest(batches, pd.DataFrame(old, dtype=float), n)
        _keep(state, tuple(kept[c].tolist() for c in cols), float(kept["simtime_s"].iloc[-1]))
        last = kept.tail(recent)
        yield pd.DataFrame({**{k: [v] for k, v in zip(KEYS, key)},
                            "last_tick": [int(kept["simtime_s"].iloc[-1])],
                            "n_rows": [len(kept)], "ready": [len(kept) >= n],
                            "lat": [last["avg_latency_ms"].mean()],
                            "thr": [last["throughput_mbps"].mean()],
                            "lat_history": [kept["avg_latency_ms"].mean()]})

    return _timed(stream, *cols).groupBy(*KEYS).applyInPandasWithState(
        step,
        "scenario string, gnb string, slice string, last_tick bigint, n_rows bigint, "
        "ready boolean, lat double, thr double, lat_history double",
        "t array<double>, lat array<double>, thr array<double>",
        "append", GroupStateTimeout.EventTimeTimeout)


def with_reactive_load(hist: DataFrame) -> DataFrame:
    h = hist.withColumns({"lat": F.round("lat", 9), "thr": F.round("thr", 9)})
    return A.with_facts(h).withColumn(
        "rho", F.round(L.observed_load(F.col("lat"), F.col("thr")), 9)).select(
        *KEYS, "last_tick", "rho")


# ---- controller ---------------------------------------------------------------------

FITS = ["n_rows", "thr_last", "lat_recent", "thr_recent", "mean_thr", "slope_thr", "mean_lat_log",
        "slope_lat_log"]


def _fits(h: pd.DataFrame, recent: int) -> list[float]:
    """Newest values, means and slopes of one history (time, latency, throughput in order)."""
    n, last = len(h), h.tail(recent)
    back = np.arange(-n, 0) - np.arange(-n, 0).mean()
    out = [n, h["thr"].iloc[-1], last["lat"].mean(), last["thr"].mean()]
    for v in (h["thr"].to_numpy(), np.log1p(h["lat"].clip(0, 600000.0)).to_numpy()):
        out += [v.mean(), float(back @ v / (back @ back)) if n > 1 else np.nan]
    return out


class _ByPeriod(StatefulProcessor):
    """Work on whole periods of event time, once the watermark has passed their end.

    Arriving rows are added to the open periods of their key, one state entry each, in whatever order
    they come within the watermark's grace; Spark drops and counts later ones. An event-time
    timer at a period's end takes up its rows. So results follow from event time alone, and the
    worker holds one period and the bounded state ``own`` of a key, however long a backlog is.
    ``own`` goes ``IDLE`` seconds of event time after the last row, and a key that starts again after
    a longer gap starts afresh."""

    columns = ["simtime_s", "avg_latency_ms", "throughput_mbps"]

    def __init__(self, rows: str, own: str):
        self.schemas = rows, own

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        rows, own = self.schemas
        self.open = handle.getMapState("open", "period bigint", rows)
        # the bounded state, newest second, last finished period, timer at which the state goes
        self.own = handle.getValueState("own", f"{own}, last double, closed bigint, due bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        closed = self.own.get()[-2] if self.own.exists() else NEVER
        for pdf in rows:
            pdf = pdf.assign(p=(pdf["simtime_s"] // PERIOD).astype("int64"))
            for p, part in pdf[pdf["p"] > closed].groupby("p"):
                self.handle.registerTimer(_millis((p + 1) * PERIOD))
                self.add(int(p), part)
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        # a key's timers come in the order of their time, so periods do too
        now = expiredTimerInfo.getExpiryTimeInMs() / 1000 - EPOCH
        p = round(now / PERIOD) - 1
        *own, last, closed, due = self.own.get() if self.own.exists() else (None, NEVER, NEVER, 0)
        own = own if self.own.exists() else None
        if (p + 1) * PERIOD != now or not self.open.containsKey((p,)):
            if own is not None and _millis(now) >= due:
                self.own.clear()
            return
        rows = self.open.getValue((p,))
        self.open.removeKey((p,))
        first, newest = self.span(rows)
        if own is not None and first - last > IDLE:
            own = None
        own, out = self.finish(key, p, rows, closed if own is not None else p - 1, own)
        if due:
            self.handle.deleteTimer(due)
        # after the end of the last period that could still follow without too long a gap
        due = _millis(((newest + IDLE) // PERIOD + 1) * PERIOD + 1)
        self.handle.registerTimer(due)
        self.own.update((*own, float(newest), p, due))
        if out is not None and len(out):
            yield out


def _millis(second: float) -> int:
    return int((EPOCH + second) * 1000)


class _Fits(_ByPeriod):
    """Newest rows of each slice of a cell; ``finish`` gives the fits of all its slices."""

    def __init__(self, n: int, recent: int):
        rows = "slice array<string>, t array<double>, lat array<double>, thr array<double>"
        super().__init__(rows, rows)
        self.n, self.recent = n, recent

    def add(self, p: int, part: pd.DataFrame) -> None:
        new = [part[c].tolist() for c in ("slice", *self.columns)]
        old = self.open.getValue((p,)) if self.open.containsKey((p,)) else ([],) * 4
        self.open.updateValue((p,), tuple([*a, *b] for a, b in zip(old, new)))

    def span(self, rows: tuple) -> tuple[float, float]:
        return min(rows[1]), max(rows[1])

    def finish(self, key: tuple, p: int, rows: tuple, closed: int, own: list | None) -> tuple[tuple, pd.DataFrame]:
        names = ["slice", "t", "lat", "thr"]
        kept = pd.DataFrame(dict(zip(names, own or ([],) * 4)))
        out = []

        def publish(q: int) -> None:
            for slice_, h in kept.groupby("slice"):
                out.append([*key, (q + 1) * PERIOD, slice_, *_fits(h, self.recent)])

        for q in range(closed + 1, p):              # periods without rows, at most IDLE / PERIOD
            publish(q)
        new = pd.DataFrame(dict(zip(names, rows)))
        kept = pd.concat([kept, new]) if len(kept) else new
        kept = kept.sort_values(["t", "lat", "thr"]).groupby("slice").tail(self.n)
        publish(p)
        return (tuple(kept[c].tolist() for c in names),
                pd.DataFrame(out, columns=["scenario", "gnb", "period_end", "slice", *FITS]))


def periodic_fits(stream: DataFrame, n: int = dims.HISTORY, recent: int = L.RECENT) -> DataFrame:
    """For every finished period of a cell, the fits of all its slices, with or without new rows:
    (scenario, gnb, period_end, slice) and ``FITS``.

    A period of a cell is published when the watermark has passed its end, up to the period of the
    cell's newest row; periods without rows in between follow with the next that has some. Rows
    within the grace of ``LATENESS`` count wherever they come, later ones are dropped and counted
    by Spark (``replay.dropped_rows``). State of a cell: the newest ``n`` rows of each slice, and the
    rows of its open periods. See ``_ByPeriod``."""
    shape = ("scenario string, gnb string, period_end bigint, slice string, n_rows bigint, "
             + ", ".join(f"{c} double" for c in FITS[1:]))
    return _timed(stream, *_ByPeriod.columns).groupBy("scenario", "gnb").transformWithStateInPandas(
        _Fits(n, recent), shape, "append", "eventtime")


def _documents(loads: DataFrame) -> DataFrame:
    keys = ["scenario", "of_cell", "period_end"]
    # a cell's budget is its own: only the units of the cell that finished a period are chosen
    full = L.fill_missing(loads.withColumn("of_cell", F.col("gnb")), keys).filter(F.col("gnb") == F.col("of_cell"))
    chosen = A.choose_fold(A.problems(full, keys, live=True), exact=False)
    return allocation_document(A.live_allocation(chosen, keys), keys).withColumnRenamed("of_cell", "gnb")


def _nine(fits: DataFrame) -> DataFrame:
    return fits.withColumns({c: F.round(F.when(~F.isnan(c), F.col(c)), 9) for c in FITS[1:] if c != "thr_last"})


def allocate_reactive(fits: DataFrame) -> DataFrame:
    """Allocation documents of the cells and periods finished in a micro-batch, from the newest rows."""
    f = A.with_facts(_nine(fits))
    rho = F.round(L.observed_load(F.col("lat_recent"), F.col("thr_recent")), 9)
    return _documents(f.select("scenario", "period_end", "gnb", "slice", rho.alias("rho")))


def allocate_predictive(fits: DataFrame) -> DataFrame:
    """The same from the forecast of the newest 60 rows and its fallbacks."""
    loads = L.predicted_loads(_nine(fits), ["scenario", "period_end"])
    return _documents(loads.select("scenario", "period_end", "gnb", "slice", "rho"))


# ---- online learning --------------------------------------------------------------

def gradient_step(w: np.ndarray, x: np.ndarray, y: np.ndarray, rate: float = RATE,
                  clip: float = CLIP) -> tuple[np.ndarray, float]:
    """One step of squared error on a small batch, the gradient kept within ``clip``."""
    err = x @ w - y
    grad = 2.0 * x.T @ err / len(y)
    norm = float(np.linalg.norm(grad))
    if norm > clip:
        grad = grad * (clip / norm)
    return w - rate * grad, float(np.mean(err ** 2))


class _Learner:
    """Replay buffer, weights and steps of one series, as lists in the state. A sample is the means of a
    period with the log latency of the next, and is named by its period."""

    def __init__(self, x=(), y=(), at=(), prev=(), w=(0.0, 0.0, 0.0), steps: int = 0):
        self.x, self.y = np.array(x, float).reshape(-1, 3), np.array(y, float)
        self.at, self.prev = np.array(at, np.int64), np.array(prev, float)
        self.w, self.steps = np.array(w, float), steps

    def learn(self, p: int, sums: tuple, rate: float, name: str | None = None) -> float:
        """Takes the finished period ``p`` in; the loss of the step it led to, nan if there was none.
        The step is taken on the newest eight samples, or on a random eight for a series with ``name``."""
        n, lat, thr = sums
        now, loss = np.array([1.0, lat / n, thr / n / 10.0]), np.nan
        if len(self.prev):
            self.x = np.vstack([self.x, self.prev])[-BUFFER:]
            self.y = np.append(self.y, now[1])[-BUFFER:]
            self.at = np.append(self.at, p)[-BUFFER:]
            if len(self.y) >= BATCH:
                some = drawn(name, p, self.at) if name else np.arange(len(self.y))[-BATCH:]
                self.w, loss = gradient_step(self.w, self.x[some], self.y[some], rate)
                self.steps += 1
        self.prev = now
        return loss

    def state(self) -> list[float]:
        parts = [[self.steps, len(self.y), len(self.prev)], self.w, self.x.ravel(), self.y, self.at, self.prev]
        return [float(v) for part in parts for v in part]

    @classmethod
    def of(cls, v: list[float]) -> _Learner:
        steps, n, m = int(v[0]), int(v[1]), int(v[2])
        w, rest = v[3:6], v[6:]
        return cls(rest[:3 * n], rest[3 * n:4 * n], rest[4 * n:5 * n], rest[5 * n:5 * n + m], w, steps)


def drawn(name: str, p: int, at: np.ndarray) -> np.ndarray:
    """Positions of a random ``BATCH`` of the samples ``at``: those whose hash with the series and the
    period is least. The draw repeats in every run and retry, and every set is as likely."""
    ranks = sorted(range(len(at)), key=lambda k: hashlib.md5(f"{name}|{p}|{int(at[k])}".encode()).hexdigest())
    return np.sort(np.array(ranks[:BATCH]))


class _Sums(_ByPeriod):
    """Open periods as sums (rows, log latency, throughput) of each cell."""

    def __init__(self, own: str, rate: float):
        super().__init__("gnb array<string>, n array<double>, lat array<double>, thr array<double>, t array<double>", own)
        self.rate = rate

    def add(self, p: int, part: pd.DataFrame) -> None:
        new = part.assign(n=1.0, lat=np.log1p(part["avg_latency_ms"].clip(0, 600000.0)))
        sums = new.groupby("gnb")[["n", "lat", "throughput_mbps"]].sum()
        cells = dict(zip(sums.index, sums.to_numpy()))
        t = [float(part["simtime_s"].min()), float(part["simtime_s"].max())]
        if self.open.containsKey((p,)):
            names, *old, span = self.open.getValue((p,))
            for k, name in enumerate(names):
                cells[name] = cells.get(name, np.zeros(3)) + np.array([column[k] for column in old])
            t = [min(t[0], span[0]), max(t[1], span[1])]
        names = sorted(cells)
        self.open.updateValue((p,), (names, *([float(cells[c][k]) for c in names] for k in range(3)), t))

    def span(self, rows: tuple) -> tuple[float, float]:
        return rows[4][0], rows[4][1]


class _Online(_Sums):
    def finish(self, key: tuple, p: int, rows: tuple, closed: int, own: list | None) -> tuple[tuple, pd.DataFrame]:
        learner = _Learner.of(own[0]) if own else _Learner()
        loss = learner.learn(p, [column[0] for column in rows[1:4]], self.rate)
        y = learner.y
        row = [*key, p, len(y), len(y) >= BATCH, learner.steps, loss, y[-BATCH:].mean() if len(y) else np.nan, learner.w.tolist()]
        return (learner.state(),), pd.DataFrame([row], columns=[*KEYS, "period", "n_buffer", "ready", "step", "loss",
                                                                "batch_lat_log", "w"])


def online_learning(stream: DataFrame, rate: float = RATE) -> DataFrame:
    """Per series and finished period: the bounded replay buffer grows by one sample and, once
    eight are there, the linear forecaster takes one step on the newest eight. A period is
    finished when the watermark has passed its end; see ``_ByPeriod``."""
    shape = ("scenario string, gnb string, slice string, period bigint, n_buffer bigint, ready boolean, "
             "step bigint, loss double, batch_lat_log double, w array<double>")
    return _timed(stream, *_ByPeriod.columns).groupBy(*KEYS).transformWithStateInPandas(
        _Online("learner array<double>", rate), shape, "append", "eventtime")


class _Together(_Sums):
    def __init__(self, rate: float, every: int, slice_: str):
        super().__init__("cells array<string>, learners array<array<double>>", rate)
        self.every, self.slice = every, slice_

    def finish(self, key: tuple, p: int, rows: tuple, closed: int, own: list | None) -> tuple[tuple, pd.DataFrame]:
        cells = {c: _Learner.of(v) for c, v in zip(*own)} if own else {}
        names, sums, rows = rows[0], list(zip(*rows[1:4])), []
        for cell, sums in zip(names, sums):
            learner = cells.setdefault(cell, _Learner())
            before = learner.steps
            loss = learner.learn(p, sums, self.rate, "|".join([key[0], cell, key[1]]))
            if learner.steps > before:
                rows.append((cell, learner, loss))
        able = [c for c in cells.values() if c.steps]
        due = bool(rows) and key[1] == self.slice and max(c.steps for c in able) % self.every == 0
        if due:
            mean = np.mean([c.w for c in able], axis=0)
            for c in able:
                c.w = mean
        out = [[key[0], cell, key[1], p, c.steps, loss, due, c.w.tolist()] for cell, c, loss in rows]
        return ((list(cells), [c.state() for c in cells.values()]),
                pd.DataFrame(out, columns=["scenario", "gnb", "slice", "period", "step", "loss", "fedavg", "w"]))


def federated_learning(stream: DataFrame, rate: float = RATE, every: int = ROUND_EVERY,
                       slice_: str = "eMBB") -> DataFrame:
    """Online learning of the cells of a slice together, each on random batches of its replay buffer:
    whenever the cells' largest step number is a multiple of ``every``, the cells of ``slice_`` that
    have learned take on the mean of their weights and go on from there.

    State is kept per (scenario, slice) and holds the learner of each cell, a fixed number. A period is
    finished for all cells when the watermark has passed its end; see ``_ByPeriod``."""
    shape = ("scenario string, gnb string, slice string, period bigint, step bigint, loss double, "
             "fedavg boolean, w array<double>")
    return _timed(stream, *_ByPeriod.columns).groupBy("scenario", "slice").transformWithStateInPandas(
        _Together(rate, every, slice_), shape, "append", "eventtime")


def federated_rounds(updates: DataFrame, every: int = ROUND_EVERY, slice_: str = "eMBB"
                     ) -> DataFrame:
    """Average of the cells' parameters after every fifth step of one slice."""
    due = updates.filter((F.col("slice") == slice_) & (F.col("step") > 0)
                         & (F.col("step") % every == 0))
    rows = due.select("scenario", "slice", "step", F.posexplode("w").alias("idx", "value"))
    return federated_average(rows, ("scenario", "slice", "step", "idx"))
