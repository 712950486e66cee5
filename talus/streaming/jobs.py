"""Streaming forms of the scheduled jobs: micro-batch ingestion, late data, windowed counts, rate limits, sessions."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import values as V
from ..functions.text import normalize_state
from ..operators import dedup, merge, score
from ..operators import ingest as operators_ingest
from ..sources.files import settled
from ..sources.store import Store

LATENESS = "4 days"


def in_window(reports: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Reports by event time: the watermark bounds state, and equal hashes inside it are one report."""
    return reports.withWatermark("date", lateness).dropDuplicatesWithinWatermark(["hash"])


def in_scan(reports: DataFrame, first: Column, last: Column) -> DataFrame:
    """Reports whose date is inside the scan window: exact, where a watermark only bounds state."""
    return reports.where(F.col("date").between(first, last))


def by_region(reports: DataFrame) -> DataFrame:
    """reports with the region of their state (null where it has none): a stream for each region is a filter of this one."""
    regions = F.create_map(*[x for r, states in V.REGIONS.items() for s in states for x in (F.lit(s), F.lit(r))])
    return reports.withColumn("region", F.try_element_at(regions, normalize_state("state")))


def ingest_regions(reports: DataFrame, apply: Callable[[str], Callable[[DataFrame, int], None]], checkpoint: str, every: str | None = None) -> list[StreamingQuery]:
    """One query for each region, side by side, each with its own checkpoint; apply(region) gives what a region does with a micro-batch."""
    placed = by_region(reports)
    return [ingest(placed.where(F.col("region") == r).drop("region"), apply(r), f"{checkpoint}/{r}", every) for r in V.REGIONS]


def into_store(store: Store, writer: str, now: Callable[[], Column] = F.current_timestamp, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> Callable[[DataFrame, int], None]:
    """What ingestion does with a micro-batch of raw reports: they are matched with the newest version of the store, and the rows that are new or changed are committed.

    `writer` names the stream, for instance by its region: a batch that is run again is not committed twice, and streams that commit
    at the same time each see what the others have committed. Matches look at all stored rows, however old, not at stream state.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        reports = settled(prepare(batch), "batch")
        if reports.isEmpty():
            return
        store.commit(spark, lambda rows: (operators_ingest.changes(reports, rows, now()), None), writer, number)

    return run


def sweep_into(store: Store, writer: str, since: Column, confirm: Callable[[dict], tuple[bool, str]] = dedup.answered, most: int | None = 5, soft: bool = False) -> Callable[[DataFrame, int], None]:
    """The duplicate sweep as a micro-batch job: rows created since then are compared with all within the window, the best candidates (None: all) confirmed and merged, the worse reports deleted (`soft`: marked as deleted), and what changes is committed."""

    def change(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        found = settled(dedup.merged_pairs(dedup.scan_recent(rows, since), confirm, most), "confirmed-pairs")
        merged, gone = merge.merge_pairs(rows, found), found.select(F.col("dropped").alias("_id"))
        if soft:
            marked = merge.soft_delete(rows.join(gone, "_id", "left_semi"), gone, "Duplicate")
            return merge.upsert(marked, merged), None
        return merged, gone

    def run(batch: DataFrame, number: int) -> None:
        store.commit(batch.sparkSession, change, writer, number)

    return run


def candidates(left: DataFrame, right: DataFrame, threshold: float = score.THRESHOLD, lateness: str = f"{score.WINDOW_DAYS} days") -> DataFrame:
    """The duplicate sweep as a stream: (id_a, id_b, score, reason) of pairs of two streams of incidents (or of one with itself) of one state, within the window, as soon as the later row is there; each unordered pair once.

    An interval join with a watermark on both sides: a row is held while one within WINDOW_DAYS of it may still come, which is
    the window and the lateness long. Rows of null dates or states have no pairs.
    """
    days = F.expr(f"INTERVAL {score.WINDOW_DAYS} DAYS")
    a, b = (score.features(x.withWatermark("date", lateness)).alias(n) for x, n in ((left, "a"), (right, "b")))
    on = (F.col("a.f_state") == F.col("b.f_state")) & (F.col("b.date") >= F.col("a.date") - days) & (F.col("b.date") <= F.col("a.date") + days) & (F.col("a._id") < F.col("b._id"))
    return dedup._scored(a.join(b, on), threshold)


def ingest(reports: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Runs `apply` on each micro-batch, every so often or until the input is used up; a batch that is run again has the same number."""
    writer = reports.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def windowed_counts(events: DataFrame, width: str = "1 day", lateness: str = LATENESS) -> DataFrame:
    """Counts and sums by tumbling window and type; works on streams and tables."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sliding_counts(events: DataFrame, width: str = "60 seconds", step: str = "30 seconds", lateness: str = LATENESS) -> DataFrame:
    """Hits of each user by sliding window; the watermark ends a window's state."""
    return events.withWatermark("ts", lateness).groupBy("user_id", F.window("ts", width, step)).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = LATENESS) -> DataFrame:
    """Sessions of each user, ended by a gap; the watermark ends a session's state."""
    return events.withWatermark("ts", lateness).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


FIXED_SCHEMA = "user_id long, event_id long, ts timestamp, allowed boolean, remaining int"

#: What a limiter remembers of a user, and what a hit makes of it: step(held, seconds) -> (held, allowed, remaining).
Step = Callable[[list[float], float], tuple[list[float], bool, int]]


def fixed_window_step(opened: float | None, count: int, ts: float, width: float, limit: int) -> tuple[float, int, bool, int]:
    """One hit: a window opens at the first hit and again at the first after it has ended."""
    if opened is None or ts > opened + width:
        opened, count = ts, 0
    allowed = count < limit
    count += allowed
    return opened, count, allowed, limit - count


def fixed_steps(width_seconds: float, limit: int) -> Step:
    """A window that opens at its first hit; held are when it opened and how many hits it has allowed."""

    def step(held: list[float], ts: float) -> tuple[list[float], bool, int]:
        opened, count, allowed, left = fixed_window_step(*((held[0], int(held[1])) if held else (None, 0)), ts, width_seconds, limit)
        return [opened, float(count)], allowed, left

    return step


def sliding_steps(width_seconds: float, limit: int) -> Step:
    """A window that moves: a hit is allowed if fewer than `limit` were in the width before it; held are the times of these, `limit` at most."""

    def step(held: list[float], ts: float) -> tuple[list[float], bool, int]:
        now = [t for t in held if t > ts - width_seconds]
        allowed = len(now) < limit
        now = [*now, ts] if allowed else now
        return now, allowed, limit - len(now)

    return step


def limited(hits: DataFrame, steps: Step) -> DataFrame:
    """Whether each hit (user_id, event_id, ts) of a table is allowed, and how many more would be, by the steps of a limiter.

    Hits are sorted by user, time and event inside partitions of users and streamed, so a user's hits are never gathered.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, held = None, []
        for b in batches:
            rows = []
            for u, e, ts in zip(b["user_id"], b["event_id"], b["ts"], strict=True):
                if u != user:
                    user, held = u, []
                held, allowed, left = steps(held, ts.timestamp())
                rows.append((u, e, ts, allowed, left))
            yield pd.DataFrame(rows, columns=["user_id", "event_id", "ts", "allowed", "remaining"])

    return hits.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts")).repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id").mapInPandas(run, FIXED_SCHEMA)


def fixed_window(hits: DataFrame, width_seconds: float = 60.0, limit: int = 60) -> DataFrame:
    """limited() by windows that open at their first hit."""
    return limited(hits, fixed_steps(width_seconds, limit))


def sliding_window(hits: DataFrame, width_seconds: float = 60.0, limit: int = 60) -> DataFrame:
    """limited() by a window that moves with the hits."""
    return limited(hits, sliding_steps(width_seconds, limit))


class _Limiter(StatefulProcessor):
    """Hits of a user wait until the watermark has passed them, and are then taken in order of time and event; what is held ends with the window."""

    def __init__(self, steps: Step, width_seconds: float):
        self.steps, self.width = steps, width_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "times array<double>")
        self.waiting = handle.getListState("waiting", "ts timestamp, event_id long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        for b in rows:
            for ts, event in zip(b["ts"], b["event_id"], strict=True):
                self.waiting.appendValue((ts, int(event)))
                self.handle.registerTimer(self._millis(ts.timestamp()))
        yield pd.DataFrame(columns=["user_id", "event_id", "ts", "allowed", "remaining"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        # The watermark has passed every hit whose timer is due.
        passed = timerValues.getCurrentWatermarkInMs()
        hits = sorted((pd.Timestamp(h[0]), h[1]) for h in self.waiting.get())
        due = [h for h in hits if self._millis(h[0].timestamp()) <= passed]
        held, out = list(self.held.get()[0]) if self.held.exists() else [], []
        for ts, event in due:
            held, allowed, left = self.steps(held, ts.timestamp())
            out.append((key[0], event, ts, allowed, left))
        if len(due) < len(hits):
            self.waiting.put([(h[0].to_pydatetime(), h[1]) for h in hits[len(due) :]])
        else:
            self.waiting.clear()
        if due:
            self.held.update((held,))
            self.handle.registerTimer(self._millis(max(held) + self.width) + 1 if held else passed + 1)
        elif self.held.exists() and max(held, default=0.0) + self.width < passed / 1000:
            self.held.clear()
        yield pd.DataFrame(out, columns=["user_id", "event_id", "ts", "allowed", "remaining"])

    def close(self) -> None:
        pass

    @staticmethod
    def _millis(seconds: float) -> int:
        return math.ceil(seconds * 1000)


def limited_stream(hits: DataFrame, steps: Step, width_seconds: float, lateness: str = "10 minutes") -> DataFrame:
    """limited() on a stream: the same answers, whatever the order in which hits come and however triggers cut them, once the watermark has passed a hit. Later ones are dropped.

    State is a list of the hits that wait and what the limiter holds, which a timer of event time ends with its window; needs the
    state store of RocksDB (spark.sql.streaming.stateStore.providerClass).
    """
    ready = hits.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", lateness)
    return ready.groupBy("user_id").transformWithStateInPandas(_Limiter(steps, width_seconds), FIXED_SCHEMA, "Append", "EventTime")


def fixed_window_stream(hits: DataFrame, width_seconds: float = 60.0, limit: int = 60) -> DataFrame:
    """fixed_window() on a stream that answers at once, hits in the order in which triggers bring them; state ends when a user has been quiet for the width. limited_stream() waits for the order of event time."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        opened, count = state.get if state.exists else (None, 0)
        rows = []
        # A user's hits of one trigger may come in several batches: they are put in order together.
        hits = [x for b in batches for x in zip(b["event_id"], b["ts"], strict=True)]
        for e, ts in sorted(hits, key=lambda x: (x[1], x[0])):
            opened, count, allowed, left = fixed_window_step(opened, count, ts.timestamp(), width_seconds, limit)
            rows.append((key[0], e, ts, allowed, left))
        if opened is not None:
            state.update((opened, count))
            state.setTimeoutDuration(int(width_seconds * 1000))
        yield pd.DataFrame(rows, columns=["user_id", "event_id", "ts", "allowed", "remaining"])

    return hits.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts")).groupBy("user_id").applyInPandasWithState(step, FIXED_SCHEMA, "opened double, count long", "append", GroupStateTimeout.ProcessingTimeTimeout)
