"""The event logs as streams: the same rules as the batch operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from poolwright.operators.extraction import STATES, state_columns
from poolwright.operators.graph import graph_columns, graph_view
from poolwright.functions.files import clean_name, upload_kind
from poolwright.operators.pool import latest


def extract_state(events: DataFrame, order: tuple[str, ...] = ("t", "event_id"), docs: DataFrame | None = None) -> DataFrame:
    """Document state, updated as events arrive. Use output mode ``update``.

    With ``docs`` (doc_id) events of unknown documents change nothing, as in ``fold_events``.
    """
    if docs is not None:
        events = events.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    return events.filter(F.col("state").isin(*STATES)).groupBy("doc_id").agg(*state_columns(order))


def graph_state(events: DataFrame, order: tuple[str, ...] = ("t", "event_id")) -> DataFrame:
    """Graph state, updated as events arrive. Use output mode ``update``."""
    return events.groupBy("graph_id").agg(*graph_columns(order)).select("graph_id", *graph_view())


BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def arriving_files(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the files that appear in a folder.

    Spark sees each path once: a new version of a file has to come under another path.
    """
    return spark.readStream.format("binaryFile").schema(BINARY_FILE).load(path)


def judged_files(files: DataFrame) -> DataFrame:
    """Arriving files, judged: path, name, size, modificationTime, mime, reason.

    ``files``: path, modificationTime, length, content, as the binaryFile stream gives them.
    """
    name = clean_name(F.regexp_extract("path", "([^/]*)$", 1))
    kind = upload_kind(name, "content")
    # Judged before the rows meet: the bytes do not travel.
    return files.select(
        "path", name.alias("name"), F.col("length").alias("size"), "modificationTime", kind.alias("_k")
    ).select("path", "name", "size", "modificationTime", "_k.mime", "_k.reason")


def new_files(files: DataFrame, delay: str = "1 hour") -> DataFrame:
    """``judged_files`` with each path once within ``delay``, for those who want a file's arrival and no later version."""
    return judged_files(files).withWatermark("modificationTime", delay).dropDuplicatesWithinWatermark(["path"])


def upsert_into(
    stream: DataFrame, path: str, checkpoint: str, key: str = "path", order: tuple[str, ...] = ("modificationTime",)
) -> DataStreamWriter:
    """Write each micro-batch to its own folder of ``path``; ``upserted`` reads the table.

    Of the rows of one key in a batch the last by ``order`` is written. A batch that is run again
    after a failure overwrites its own folder only, so the table holds every row once.
    """
    return stream.writeStream.foreachBatch(epoch_writer(path, key, order)).option("checkpointLocation", checkpoint)


def epoch_writer(path: str, key: str, order: tuple[str, ...]) -> Callable[[DataFrame, int], None]:
    """What ``upsert_into`` does with a micro-batch and its epoch."""

    def write(batch: DataFrame, epoch: int) -> None:
        latest(batch, [key], list(order)).select(*batch.columns).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return write


def upserted(spark: SparkSession, path: str, key: str = "path", order: tuple[str, ...] = ("modificationTime",)) -> DataFrame:
    """The table that ``upsert_into`` has written: the last row of each key by ``order``, then by arrival.

    So a late file never replaces a newer one, however the files fell into batches.
    """
    return latest(spark.read.parquet(path), [key], [*order, "batch"]).drop("batch")


ROCKSDB = (
    "spark.sql.streaming.stateStore.providerClass",
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
)
PROGRESS = "doc_id long, idx int, outcome string, attempts int, step int"
STATE = "timed_out int, deadline long, ended boolean, step int, late int"


class SectionDeadline(StatefulProcessor):
    """One section's attempts under a deadline that doubles on the second try.

    Input rows: doc_id, idx, t (event time), ms (the same in milliseconds), event_id (orders events of one time), kind
    (``start``, ``read``, ``error``, ``outage``). A start arms a timer; a deadline that passes before a result is a time-out,
    whether the timer fires or a later event shows it. After the second time-out the
    section is too slow. An outage is no attempt. ``step`` numbers the outcomes of a section.

    The state of a section that has ended goes ``keep_seconds`` of event time later, by a timer. Until then
    its events are dropped and counted; with ``report_late`` the count is a row of outcome ``late`` when
    the state goes. Rows behind the watermark never reach the state: Spark drops
    them and counts them in the query progress.
    """

    def __init__(self, first_seconds: int = 300, most: int = 2, keep_seconds: int = 86_400, report_late: bool = False):
        self.first_ms, self.most, self.keep_ms, self.report_late = first_seconds * 1000, most, keep_seconds * 1000, report_late

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("attempts", STATE)

    def _get(self) -> tuple[int, int, bool, int, int]:
        return tuple(self.state.get() or (0, 0, False, 0, 0))

    def _arm(self, armed: int, deadline: int) -> None:
        """Replace the timer of a section by another; 0 is none."""
        if armed != deadline:
            if armed:
                self.handle.deleteTimer(armed)
            if deadline:
                self.handle.registerTimer(deadline)

    @staticmethod
    def _row(key, outcome: str, attempts: int, step: int) -> Row:
        return Row(doc_id=key[0], idx=key[1], outcome=outcome, attempts=attempts, step=step)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # Each call of the state or of a timer is a trip to the JVM: one state is read and one written, whatever the number of rows.
        timed_out, deadline, ended, step, late = self._get()
        armed = deadline
        for r in sorted(rows, key=lambda r: (r.t, r.event_id is None, r.event_id or 0)):
            at = r.ms
            if ended:
                late += 1
                continue
            if deadline and at >= deadline:
                # Rows are seen before timers, so a timer due by now has not fired yet.
                timed_out, deadline, step = timed_out + 1, 0, step + 1
                ended = timed_out >= self.most
                yield self._row(key, "too_slow" if ended else "timeout", timed_out, step)
                if ended:
                    # The event that shows it comes too late itself.
                    deadline, late = at + self.keep_ms, late + 1
                    continue
            if r.kind == "start":
                deadline = at + self.first_ms * (timed_out + 1)
            elif r.kind == "outage":
                deadline, step = 0, step + 1
                yield self._row(key, "interrupted", timed_out, step)
            else:
                deadline, ended, step = at + self.keep_ms, True, step + 1
                yield self._row(key, r.kind, timed_out + 1, step)
        self._arm(armed, deadline)
        self.state.update((timed_out, deadline, ended, step, late))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        timed_out, deadline, ended, step, late = self._get()
        if not deadline:
            return
        if ended:
            self.state.clear()
            if self.report_late and late:
                yield self._row(key, "late", late, step + 1)
            return
        timed_out, last = timed_out + 1, timed_out + 1 >= self.most
        keep = deadline + self.keep_ms if last else 0
        self._arm(0, keep)
        self.state.update((timed_out, keep, last, step + 1, late))
        yield self._row(key, "too_slow" if last else "timeout", timed_out, step + 1)

    def close(self) -> None:
        pass


def section_progress(
    events: DataFrame, delay: str = "1 minute", first_seconds: int = 300, most: int = 2, keep_seconds: int = 86_400, report_late: bool = False
) -> DataFrame:
    """Outcomes of sections as they are decided: doc_id, idx, outcome, attempts, step.

    Timers need the RocksDB state store, which the session must name before the query starts.
    ``keep_seconds`` has to exceed the time by which events of a section can follow its end.
    ``events``: doc_id, idx, t, kind, and event_id if events of one time have an order.
    """
    place = F.col("event_id") if "event_id" in events.columns else F.lit(0)
    return (
        events.select("doc_id", "idx", "t", F.unix_millis("t").alias("ms"), place.cast("long").alias("event_id"), "kind")
        .withWatermark("t", delay)
        .groupBy("doc_id", "idx")
        .transformWithState(
            statefulProcessor=SectionDeadline(first_seconds, most, keep_seconds, report_late),
            outputStructType=PROGRESS,
            outputMode="update",
            timeMode="EventTime",
        )
    )
