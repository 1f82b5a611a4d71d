"""Structured Streaming: refreshing an index as its files change, and attributing reads to searches as they come."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..plans.shared import ready

IGNORED = (".git", "node_modules", ".obsidian", "target")
QUIET_MS, TICK_MS, WATERMARK = 500, 200, "60 seconds"
#: Searches of a source that may still get a read, and for how many seconds.
RECENT, WINDOW_SECONDS = 64, 60
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def relevant(events: DataFrame, ignored: tuple[str, ...] = IGNORED) -> DataFrame:
    """Changes of files (source, path, kind, ts) that call for a refresh."""
    wanted = F.col("kind").isin("create", "modify", "remove")
    return events.where(wanted & ~F.arrays_overlap(F.split("path", "/"), F.array(*[F.lit(x) for x in ignored])))


def bursts(events: DataFrame, quiet_ms: int = QUIET_MS, late: str = "10 seconds") -> DataFrame:
    """Rows (source, first, last, n): changes of a source with no pause of ``quiet_ms`` between them are one burst.

    Works on a stream, with a watermark, and on a table alike.
    """
    rows = relevant(events)
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    found = rows.groupBy("source", F.session_window("ts", f"{quiet_ms} milliseconds")).agg(F.count("*").alias("n"))
    return found.select("source", F.col("session_window.start").alias("first"), F.col("session_window.end").alias("last"), "n")


def quiet_sources(events: DataFrame, quiet_ms: int = QUIET_MS) -> DataFrame:
    """A stream of sources: each when nothing has changed in it for ``quiet_ms``, by the clock of the machine.

    The state is one row for each source that isn't quiet yet.
    """

    def run(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"source": [key[0]]})
        else:
            state.update((True,))
            state.setTimeoutDuration(quiet_ms)

    return relevant(events).select("source").groupBy("source").applyInPandasWithState(run, "source string", "waits boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)


def watch(events: DataFrame, refresh: Callable[[str], object], checkpoint: str, every_ms: int = TICK_MS, quiet_ms: int = QUIET_MS, once: bool = False):
    """Refresh each source of a stream of changes once its burst of changes is over.

    With ``once`` what is there is taken as over: each source is refreshed once. ``refresh`` compares snapshots, so a
    change that is seen twice, or late, does no harm, and a batch that is run again after a failure finds nothing to do.
    """
    ready(events.sparkSession)

    def apply(batch: DataFrame, _: int) -> None:
        for row in batch.select("source").distinct().toLocalIterator():  # as many rows as sources
            refresh(row["source"])

    writer = (relevant(events) if once else quiet_sources(events, quiet_ms)).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{every_ms} milliseconds")
    return writer.start()


def attributed(reads: DataFrame, searches: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """A stream of reads (source, path, read_at) joined to searches (source, path, search_id, search_at) of the minute before.

    Both sides forget what is older than the watermark, so the state is bounded.
    """
    left = reads.withWatermark("read_at", watermark).alias("r")
    right = searches.withWatermark("search_at", watermark).alias("s")
    met = (F.col("r.source") == F.col("s.source")) & (F.col("r.path") == F.col("s.path")) & (F.col("s.search_at") <= F.col("r.read_at")) & (F.col("s.search_at") >= F.col("r.read_at") - F.expr("INTERVAL 60 SECONDS"))
    return left.join(right, met).select("r.source", "r.path", "r.read_at", "s.search_id", "s.search_at")


class Attribution(StatefulProcessor):
    """Gives each read of a source to its latest search: rows wait until the watermark has passed them, then go in order.

    The state is what waits, and the last ``recent`` paths that searches of the last ``seconds`` returned.
    """

    def __init__(self, seconds: int, recent: int):
        self.seconds, self.recent = seconds, recent

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "path string, kind string, id long, at long")
        self.searches = handle.getListState("searches", "path string, id long, at long, used boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            self.waiting.appendList([(path, kind, int(i), int(at)) for path, kind, i, at in zip(batch["path"], batch["kind"], batch["id"], batch["at"], strict=True)])
        yield from self._settled(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._settled(key, timerValues)

    def _settled(self, key, timers) -> Iterator[pd.DataFrame]:
        passed = timers.getCurrentWatermarkInMs()
        rows = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        due = sorted((at, kind != "search", i, path) for path, kind, i, at in rows if at * 1000 < passed)
        held = [list(r) for r in self.searches.get()] if self.searches.exists() else []
        out = []
        for at, read, i, path in due:
            held = [s for s in held if s[2] >= at - self.seconds]
            if not read:
                held = [*held, [path, i, at, False]][-self.recent :]
                continue
            near = max((s for s in held if s[0] == path), key=lambda s: (s[2], s[1]), default=None)
            if near is not None and not near[3]:  # a search counts once, for its first read
                near[3] = True
                out.append((key[0], path, i, near[1], at - near[2]))
        left = [r for r in rows if r[3] * 1000 >= passed]
        self.waiting.put(left) if left else self.waiting.clear()
        self.searches.put([tuple(s) for s in held]) if held else self.searches.clear()
        if left:
            self.handle.registerTimer((min(r[3] for r in left) + 1) * 1000)
        yield pd.DataFrame(out, columns=["source", "path", "read_id", "search_id", "lag"])

    def close(self) -> None:
        pass


def attributed_once(events: DataFrame, seconds: int = WINDOW_SECONDS, recent: int = RECENT, late: str = WATERMARK) -> DataFrame:
    """A stream (source, path, read_id, search_id, lag): what ``usage.attribute`` gives for the same rows, in whatever order they come.

    ``events`` is a stream of (source, path, kind, id, ts): a row of kind ``search`` for each path that a search returned,
    and one of kind ``read`` for each read; ids are whole numbers. Rows that come later than ``late`` are left out. Times
    count in whole seconds.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    ready(events.sparkSession)
    rows = events.withWatermark("ts", late).select("source", "path", "kind", "id", F.unix_seconds("ts").alias("at"), "ts")
    return rows.groupBy("source").transformWithStateInPandas(Attribution(seconds, recent), "source string, path string, read_id long, search_id long, lag long", "Append", "EventTime")
