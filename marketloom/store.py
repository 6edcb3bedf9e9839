"""Tables in the folder that driver and executors share. They cut lineage and outlive a lost executor."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar, copy_context
from threading import Lock

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder: spark.checkpoint.dir where it is set.

    A local session that has none (tests) gets a temporary folder of its own; on a cluster, whose machines don't share such a
    folder, that is an error.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("marketloom.shared.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        base = tempfile.mkdtemp(prefix="marketloom-")
        spark.conf.set("marketloom.shared.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it goes when the driver's Python ends."""
    path = f"{shared_dir(spark)}/marketloom-{name}-{uuid.uuid4().hex}"

    def gone() -> None:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended before Python does
            pass

    atexit.register(gone)
    for made in _open.get():
        made.append(path)
    return path


#: Paths made inside each ``freed`` block that is open in this thread, or in the one that gave it work (``together``).
_open: ContextVar[tuple[list[str], ...]] = ContextVar("open", default=())


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Tables that are stored inside the block go at its end: for steps whose result has been written elsewhere by then.

    Tables of other threads stay, but for threads that the block itself started by ``together``.
    """
    made: list[str] = []
    token = _open.set((*_open.get(), made))
    try:
        yield
    finally:
        _open.reset(token)
        for path in made:
            _delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """A table in the shared folder that nobody reads any more."""
    _delete(spark, path)


def stored(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write to the shared folder and read back: lineage ends here, and a lost executor loses no part of it."""
    spark, schema = df.sparkSession, df.schema
    path = scratch(spark, name)
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(schema).parquet(path)


_kept: dict[tuple[str, str, str], tuple[str, str, DataFrame]] = {}
_locks: defaultdict[tuple[str, str, str], Lock] = defaultdict(Lock)


def together(*builds: Callable[[], DataFrame]) -> list[DataFrame]:
    """Independent tables at the same time: their jobs share the executors, where one alone would leave most idle between its stages."""
    with ThreadPoolExecutor(len(builds)) as pool:
        return [f.result() for f in [pool.submit(copy_context().run, b) for b in builds]]


def version(spark: SparkSession, folder: str) -> str:
    """Names, sizes and times of the tables in a folder, and how many bytes and files lie below: it changes when a table is written anew."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    below = files.getContentSummary(path)
    tables = sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in files.listStatus(path))
    return repr((below.getLength(), below.getFileCount(), tables))


def kept(name: str):
    """Store what a builder (spark, sf_dir) returns once in an application: many studies start from the same bars.

    A table is made anew when its source folder has changed since.
    """

    def wrap(build):
        def get(spark: SparkSession, sf_dir: str) -> DataFrame:
            key, now = (spark.sparkContext.applicationId, sf_dir, name), version(spark, sf_dir)
            with _locks[key]:  # whoever comes second waits for the table
                if key not in _kept or _kept[key][0] != now:
                    made = stored(build(spark, sf_dir), name)
                    if key in _kept and _kept[key][1]:
                        _delete(spark, _kept[key][1])  # of the source as it was
                    _kept[key] = (now, made.inputFiles()[0].rsplit("/", 1)[0] if made.inputFiles() else "", made)
                return _kept[key][2]

        return get

    return wrap


def release(spark: SparkSession) -> None:
    """Forget the application's kept tables and delete their files."""
    own = spark.sparkContext.applicationId
    for key in [k for k in _kept if k[0] == own]:
        _, path, _ = _kept.pop(key)
        if path:
            _delete(spark, path)
