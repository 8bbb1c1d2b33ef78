"""Session helpers: a tuned local session and the shared scratch folder."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the bench. Clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("poolwright")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_own_folder: dict[str, str] = {}


def scratch_folder(spark: SparkSession) -> str:
    """The folder all executors share.

    The cluster names it in ``spark.checkpoint.dir``; only a session without that
    setting (a test) gets a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        _own_folder[app] = tempfile.mkdtemp(prefix="spark-")
    return _own_folder[app]


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage so that a lost executor re-reads the table instead of
    re-deciding anything that depends on partition boundaries, and gives the
    planner the real size of the table when it chooses a join.
    """
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def run_folder(spark: SparkSession) -> str:
    """The part of the shared folder that belongs to this application."""
    return f"{scratch_folder(spark).rstrip('/')}/poolwright-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote, once nothing reads them any more."""
    for df in tables:
        ours = run_folder(df.sparkSession).split("://")[-1].split(":")[-1]
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if ours in folder:
                _delete(df.sparkSession, folder)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """On leaving, delete whatever ``materialize`` wrote inside: ``with scratch(spark): df.write...``.

    A query returns a lazy table that still reads what it has stored, so only the
    one who writes its result knows when the folder can go.
    """
    before = _children(spark)
    try:
        yield
    finally:
        for path in _children(spark) - before:
            _delete(spark, path)


def _children(spark: SparkSession) -> set[str]:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return {f.getPath().toString() for f in files.listStatus(folder)} if files.exists(folder) else set()
