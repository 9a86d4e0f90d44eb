"""When a page has turned: the first frame that differs and then holds still, in batch and as a stream.

Frames are rows (source, ts in seconds, frame array<double>), the first of a source being the page that is left. States: still
the old page; or a candidate, seen so many times in a row. Once something has changed, the old page isn't looked at again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.operators.pixels import same_frames


#: Seconds that one attempt to turn a page waits at least.
SHORTEST = 1.5


def stable_frames(frames: DataFrame, tolerance: float = 8, need: int = 2, timeout: float = 5.0, retries: int = 0) -> DataFrame:
    """(source, ts, outcome): of each source the first frame, after its first, that has been seen `need` times in a row since
    the page changed (`stable`); if none is by the timeout, the candidate of that time (`timeout`), or without any
    change the last frame in time (`end`).

    With retries, an attempt that ends without any change is followed by another of the same length. A null frame is a lost source:
    it ends the attempt, candidate or not, and the last attempt with the outcome `lost`. A source whose frames are all
    null has no row. Only frames within the attempts' time after a source's first frame reach its group.

    A run of like frames starts where a frame differs from the one that began the run, which is the frame before unless
    frames drift; as in the stream, frames are held against the run's first.
    """
    kinds = {f.name: f.dataType.simpleString() for f in frames.schema}

    def watch(pdf: pd.DataFrame) -> pd.DataFrame:
        watcher = Watcher(tolerance, need, timeout, retries)
        out = None
        for ts, frame in zip(*(pdf.sort_values("ts")[c] for c in ("ts", "frame")), strict=True):
            if out := watcher.see(float(ts), None if frame is None else list(frame)):
                break
        out = out or watcher.expire()
        return pd.DataFrame([(pdf["source"].iloc[0], *out)] if out else [], columns=["source", "ts", "outcome"])

    # The running least time is that of the first frame, which needs no buffer; the group keeps the window's partitioning.
    began = F.min(F.when(F.col("frame").isNotNull(), F.col("ts"))).over(Window.partitionBy("source").orderBy("ts"))
    near = frames.select("source", "ts", "frame", began.alias("_began")).where(F.col("ts") - F.col("_began") <= timeout * (retries + 1) * (1 + 1e-9)).drop("_began")
    return near.groupBy("source").applyInPandas(watch, f"source {kinds['source']}, ts double, outcome string")


def retried_turns(frames: DataFrame, retries: int, timeout: float = 5.0, tolerance: float = 8, need: int = 2) -> DataFrame:
    """stable_frames() of page turns that are tried again up to `retries` times, each for 1.5 seconds at least."""
    return stable_frames(frames, tolerance, need, max(SHORTEST, timeout), max(0, retries))


def first_changes(frames: DataFrame, tolerance: float = 8) -> DataFrame:
    """frames with run, the number of changes so far, and nth, the place in the run, each frame held against the one before. By
    window functions alone: enough where frames don't drift."""
    order = Window.partitionBy("source").orderBy("ts")
    new = frames.withColumn("_before", F.lag("frame").over(order))
    new = new.withColumn("_new", F.when(F.col("_before").isNotNull() & ~same_frames("frame", "_before", tolerance), 1).otherwise(0)).drop("_before")
    new = new.withColumn("run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_new")
    return new.withColumn("nth", F.row_number().over(Window.partitionBy("source", "run").orderBy("ts")))


class Watcher:
    """One source's state: page, candidate, how often it was seen, and when watching began."""

    def __init__(self, tolerance: float, need: int, timeout: float, retries: int = 0) -> None:
        self.tolerance, self.need, self.timeout, self.left = tolerance, need, timeout, retries
        self.page: list[float] | None = None
        self.candidate: list[float] | None = None
        self.since = self.seen_at = self.began = 0.0
        self.times = 0

    def alike(self, a: list[float], b: list[float]) -> bool:
        return len(a) == len(b) and all(abs(x - y) <= self.tolerance for x, y in zip(a, b, strict=True))

    def expire(self) -> tuple[float, str] | None:
        if self.page is None:
            return None
        return (self.seen_at, "timeout") if self.candidate is not None else (self.seen_at, "end")

    def see(self, ts: float, frame: list[float] | None) -> tuple[float, str] | None:
        if self.page is None:
            self.page, self.began, self.seen_at = frame, ts, ts
            return None
        while ts - self.began > self.timeout:
            if self.candidate is not None or not self.left:
                return self.expire()
            self.left, self.began = self.left - 1, self.began + self.timeout
        self.seen_at = ts
        if frame is None:
            if not self.left:
                return ts, "lost"
            self.left, self.began, self.candidate, self.times = self.left - 1, ts, None, 0
            return None
        if self.candidate is None:
            if self.alike(frame, self.page):
                return None
            self.candidate, self.times = frame, 1
        elif self.alike(frame, self.candidate):
            self.times += 1
        else:
            self.candidate, self.times = frame, 1
        return (ts, "stable") if self.times >= self.need else None


def stream_stable_frames(frames: DataFrame, tolerance: float = 8, need: int = 2, timeout: float = 5.0, idle: float | None = None, retries: int = 0) -> DataFrame:
    """The same over a stream of frames, whose ts are seconds: a row per page turn; the emitted frame is the next page to be left,
    or after a lost source the next frame there is.

    State lives in the store by source: page, candidate, count, times and attempts left. Frames of a source must arrive in the order of ts
    between batches; within a batch they are sorted. Without further frames a processing-time timer ends the wait after
    `idle` seconds, by default the time of all attempts, with what the batch form would say. Needs the RocksDB state store.
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    kinds = {f.name: f.dataType.simpleString() for f in frames.schema}

    class Turn(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.state = handle.getValueState("watch", "page array<double>, candidate array<double>, times int, began double, seen_at double, left int")

        def load(self) -> Watcher:
            w = Watcher(tolerance, need, timeout, retries)
            if self.state.exists():
                page, candidate, w.times, w.began, w.seen_at, w.left = self.state.get()
                w.page = list(page) if page is not None else None
                w.candidate = list(candidate) if candidate is not None else None
            return w

        def save(self, w: Watcher) -> None:
            self.state.update((w.page, w.candidate, w.times, w.began, w.seen_at, w.left))

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            w, out = self.load(), []
            for pdf in sorted((p for p in rows), key=lambda p: p["ts"].min()):
                for ts, frame in zip(*(pdf.sort_values("ts")[c] for c in ("ts", "frame")), strict=True):
                    frame = None if frame is None else [float(x) for x in frame]
                    if hit := w.see(float(ts), frame):
                        out.append((key[0], *hit))
                        again = Watcher(tolerance, need, timeout, retries)
                        again.see(float(ts), frame)
                        w = again
            self.save(w)
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(1000 * (timeout * (retries + 1) if idle is None else idle)))
            yield pd.DataFrame(out, columns=["source", "ts", "outcome"])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            w = self.load()
            hit = w.expire()
            self.state.clear()
            yield pd.DataFrame([(key[0], *hit)] if hit else [], columns=["source", "ts", "outcome"])

        def close(self) -> None:
            pass

    return frames.groupBy("source").transformWithStateInPandas(Turn(), f"source {kinds['source']}, ts double, outcome string", "Append", "ProcessingTime")
