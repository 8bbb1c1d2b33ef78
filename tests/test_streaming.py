"""Streams give what the batch rules give."""

import os
import random
import uuid

from pyspark.sql import Row, functions as F

from poolwright.operators import extraction, graph
from poolwright.plans.queries import QUERIES, _drain
from poolwright.streaming import jobs
from test_models import EVENTS, read_events


def feed(spark, tmp_path, rows, schema, files=6):
    """The rows in several shuffled files, read as a stream of one file at a time."""
    random.Random(9).shuffle(rows)
    home = str(tmp_path / uuid.uuid4().hex)
    for k in range(files):
        spark.createDataFrame(rows[k::files], schema).coalesce(1).write.mode("append").parquet(home)
    return spark.readStream.schema(spark.read.parquet(home).schema).option("maxFilesPerTrigger", 1).parquet(home), spark.read.parquet(home)


def test_extract_state(spark, tmp_path):
    names = [c.split()[0] for c in EVENTS.split(", ")]
    rows = [tuple(e[n] for n in names) for e in read_events(random.Random(10), 40, 8)]
    stream, batch = feed(spark, tmp_path, rows, EVENTS)
    got = _drain(jobs.extract_state(stream), ["doc_id"])
    assert sorted(got.collect()) == sorted(extraction.fold_events(batch, order=("t", "event_id")).select(*got.columns).collect())


def test_graph_state(spark, tmp_path):
    rng = random.Random(11)
    rows = [
        (f"g{k}", t, t, rng.choice(["ok", "empty", "failed", "manual", "restore"]), f"{k}.{t}", "key", "n", "m", "e", t)
        for k in range(30) for t in range(rng.randint(1, 8))
    ]
    schema = "graph_id string, t long, event_id long, kind string, graph string, source_key string, note string, model string, engine string, at long"
    stream, batch = feed(spark, tmp_path, rows, schema)
    got = _drain(jobs.graph_state(stream), ["graph_id"])
    want = graph.fold_graphs(batch, ("t", "event_id")).select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_section_deadlines(spark, tmp_path):
    """A read in time, an outage, two time-outs, and one time-out followed by a read."""
    log = [
        (1, 0, 0, "start"), (1, 0, 60, "read"),
        (2, 0, 0, "start"), (2, 0, 10, "outage"),
        (3, 0, 0, "start"), (3, 0, 400, "start"),
        (4, 0, 0, "start"), (4, 0, 401, "start"), (4, 0, 800, "read"),
        (9, 0, 350, "start"), (9, 0, 5000, "read"), (9, 1, 9000, "start"),
    ]
    home = str(tmp_path / "log")
    # One file per event, in order of time, so that the watermark moves between them.
    for n, (d, x, t, k) in enumerate(sorted(log, key=lambda e: e[2])):
        one = spark.createDataFrame([(d, x, t + 1000, k)], "doc_id long, idx int, s long, kind string")
        one.select("doc_id", "idx", F.timestamp_seconds("s").alias("t"), "kind").coalesce(1).write.parquet(f"{home}/n={n:03d}")
    stream = (
        spark.readStream.schema("doc_id long, idx int, t timestamp, kind string").option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", "true").parquet(home)
    )
    before = spark.conf.get(jobs.ROCKSDB[0])
    spark.conf.set(*jobs.ROCKSDB)
    try:
        got = {(r.doc_id, r.idx): (r.outcome, r.attempts) for r in _drain(jobs.section_progress(stream, "1 second"), ["doc_id", "idx"], order=("step",)).collect()}
    finally:
        spark.conf.set(jobs.ROCKSDB[0], before)
    assert got[(1, 0)] == ("read", 1)
    assert got[(2, 0)] == ("interrupted", 0)  # as in section_outcomes, an outage is no attempt
    assert got[(3, 0)] == ("too_slow", 2)
    assert got[(4, 0)] == ("read", 2)


def test_ended_sections_leave_the_state(spark, tmp_path):
    """Events of a section that has ended are counted, and its state goes when it has been kept long enough."""
    log = [(k, 0, 0, "start") for k in range(6)] + [(k, 0, 10 + k, "read") for k in range(6)]
    log += [(1, 0, 20, "start"), (1, 0, 21, "read"), (9, 0, 2000, "start"), (9, 0, 4000, "start"), (9, 0, 9000, "start")]
    home = str(tmp_path / "log")
    for n, t in enumerate(sorted({e[2] for e in log})):
        rows = [(d, x, at + 1000, k) for d, x, at, k in log if at == t]
        one = spark.createDataFrame(rows, "doc_id long, idx int, s long, kind string")
        one.select("doc_id", "idx", F.timestamp_seconds("s").alias("t"), "kind").coalesce(1).write.parquet(f"{home}/n={n:03d}")
    stream = (
        spark.readStream.schema("doc_id long, idx int, t timestamp, kind string").option("maxFilesPerTrigger", 4)
        .option("recursiveFileLookup", "true").parquet(home)
    )
    before = spark.conf.get(jobs.ROCKSDB[0])
    spark.conf.set(*jobs.ROCKSDB)
    seen = []
    try:
        progress = jobs.section_progress(stream, "1 second", keep_seconds=600, report_late=True)
        q = progress.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "mark")).foreachBatch(
            lambda batch, epoch: seen.extend(batch.collect())
        ).trigger(availableNow=True).start()
        q.awaitTermination()
        rows = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    finally:
        spark.conf.set(jobs.ROCKSDB[0], before)
    assert max(rows) >= 6 and rows[-1] < max(rows)
    assert [(r.doc_id, r.attempts) for r in seen if r.outcome == "late"] == [(1, 2)]


def test_upserts_are_decided_by_time(spark, tmp_path):
    """A key twice in a batch, a late older version, and an epoch that runs twice."""
    out = str(tmp_path / "out")
    schema = "path string, modificationTime long, size long"
    first = spark.createDataFrame([("a", 5, 1), ("a", 9, 2), ("a", 7, 3), ("b", 1, 4)], schema)
    late = spark.createDataFrame([("a", 8, 5), ("b", 2, 6), ("c", 1, 7)], schema)
    write = jobs.epoch_writer(out, "path", ("modificationTime",))
    for epoch, batch in ((0, first), (1, late), (1, late)):
        write(batch, epoch)
    assert spark.read.parquet(out).count() == 5
    assert sorted((r.path, r.size) for r in jobs.upserted(spark, out).collect()) == [("a", 2), ("b", 6), ("c", 7)]


def test_a_later_version_of_a_file_replaces_its_row(spark, tmp_path):
    """Versions arrive in folders of their own and out of order; the name is the key and time decides."""
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    for folder, at, text in (("v2", 1_700_000_100, b"longer"), ("v1", 1_700_000_000, b"one"), ("v3", 1_700_000_200, b"longest")):
        (tmp_path / "in" / folder).mkdir(parents=True)
        (tmp_path / "in" / folder / "n.md").write_bytes(text)
        os.utime(tmp_path / "in" / folder / "n.md", (at, at))
        files = jobs.judged_files(jobs.arriving_files(spark, str(tmp_path / "in" / "*")))
        jobs.upsert_into(files, out, mark, key="name").trigger(availableNow=True).start().awaitTermination()
        got = [(r.name, r.size) for r in jobs.upserted(spark, out, key="name").collect()]
        assert got == [("n.md", 7 if folder == "v3" else 6)]


def test_new_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"n{k}.md").write_bytes(b"# hi")
    (tmp_path / "in" / "b.bin").write_bytes(b"\x00\x01")
    files = jobs.arriving_files(spark, str(tmp_path / "in"))
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    for extra in (None, b"%PDF-1.7"):
        if extra:
            (tmp_path / "in" / "later.pdf").write_bytes(extra)
        q = jobs.upsert_into(jobs.new_files(files), out, mark).trigger(availableNow=True).start()
        q.awaitTermination()
    got = {r.name: r.mime for r in spark.read.parquet(out).collect()}
    assert got == {"n0.md": "text/markdown", "n1.md": "text/markdown", "n2.md": "text/markdown", "b.bin": "", "later.pdf": "application/pdf"}


def test_tables_in_several_files_stream_whole(spark, tmp_path):
    """A table may be one file or a folder of part files, under any file system."""
    one, many = "/root/testdata/sf0.001", str(tmp_path / "many")
    for name in ("pages", "events", "documents"):
        spark.read.parquet(f"{one}/{name}.parquet").repartition(3).write.parquet(f"{many}/{name}.parquet")
    for query in ("stream_new_files__s5", "stream_graph_state__s2", "stream_extract_state__s1"):
        want, got = (sorted(map(str, QUERIES[query](spark, d).collect())) for d in (one, many))
        assert got and got == want


class Handle:
    """Counts the trips to the state and the timers of one section."""

    def __init__(self):
        self.calls, self.value, self.timers = 0, None, set()

    def getValueState(self, name, schema):
        return self

    def exists(self):
        self.calls += 1
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def clear(self):
        self.update(None)

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


def test_one_trip_to_the_state_for_all_rows_of_a_section():
    """Hundreds of attempts in one batch read and write the state once and leave one timer."""
    handle, section = Handle(), jobs.SectionDeadline()
    section.init(handle)
    start = [Row(t=k, ms=k * 1000, event_id=None, kind=kind) for k in range(200) for kind in ("start", "outage")]
    out = list(section.handleInputRows((1, 0), iter(start + [Row(t=300, ms=300_000, event_id=1, kind="start")]), None))
    assert [r.outcome for r in out] == ["interrupted"] * 200 and handle.timers == {600_000} and handle.calls <= 4
    handle.calls = 0
    out = list(section.handleInputRows((1, 0), iter([Row(t=400, ms=400_000, event_id=2, kind="read")]), None))
    assert [(r.outcome, r.attempts, r.step) for r in out] == [("read", 1, 201)] and handle.timers == {86_800_000} and handle.calls <= 4
